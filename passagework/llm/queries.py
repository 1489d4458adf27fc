"""Queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.llm import leakage, neardup, neighbours, packing, pii, spans, splitting
from passagework.llm.components import components
from passagework.workspace import materialise, table


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "access_events").select(F.lit("query").alias("record_kind"), F.col("access_id").alias("record_id"), F.col("query").alias("text"))
    answers = table(spark, d, "query_outcomes").select(F.lit("answer").alias("record_kind"), F.col("outcome_id").alias("record_id"), F.col("answer").alias("text"))
    return queries.unionByName(answers)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(p1_records(spark, d)).select("record_kind", "record_id", "entity_kind", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(p1_records(spark, d))


def _p2(spark: SparkSession, d: str, every: int) -> DataFrame:
    vectors = table(spark, d, "chunks").where("embedding_model = 'nw-embed-2'").select(F.col("chunk_id").alias("id"), "embedding")
    return neighbours.nearest(vectors, F.col("id") % every == 0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _p2(spark, d, 97)
    return pairs.select(F.least("query_id", "neighbour_id").alias("chunk_id_a"), F.greatest("query_id", "neighbour_id").alias("chunk_id_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Ranked neighbours of the chunks whose id is divisible by 100, against all chunks."""
    return _p2(spark, d, 100).withColumn("similarity", F.round("similarity", 6))


CHUNKS = neardup.Similar(threshold=700)
TITLES = neardup.Similar(threshold=700, rows=5, lists=48)


def _p4(spark: SparkSession, d: str):
    chunks = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("content").alias("body"))
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("title").alias("body"))
    yield "chunk", neardup.similar_classes(chunks, neardup.word_shingles(3, 20), CHUNKS)
    yield "title", neardup.similar_classes(titles, neardup.char_shingles(3, 15), TITLES)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = [neardup.record_pairs(*found).select(F.lit(kind).alias("record_kind"), "id_a", "id_b") for kind, found in _p4(spark, d)]
    return a.unionByName(b)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a group of near-duplicates with the group's least id and the number of similar classes."""
    out = []
    for kind, (links, members) in _p4(spark, d):
        links = materialise(links, "near-links")
        groups = components(links)
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
        sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_copies"))
        full = members.join(sizes, "class_id").join(groups.withColumnRenamed("id", "class_id"), "class_id", "left").join(degree.withColumnRenamed("id", "class_id"), "class_id", "left")
        out.append(full.where("component is not null or n_copies > 1").select(F.lit(kind).alias("record_kind"), "id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies"))
    return out[0].unionByName(out[1])


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("record_kind"), "doc_id", F.col("chunk_index").alias("item_no"), F.col("content").alias("body"), F.col("section_path").alias("trail"), F.lit(False).alias("is_code"))
    blocks = table(spark, d, "blocks").select(F.lit("block").alias("record_kind"), "doc_id", F.col("block_pos").alias("item_no"), F.col("block_text").alias("body"), F.array_join("heading_path", " > ").alias("trail"), (F.col("block_type") == "code").alias("is_code"))
    return chunks.unionByName(blocks)


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(p5_items(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).select("record_kind", "doc_id", "item_no").distinct()


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents").select("doc_id", "source", "text"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packing(spark, d))


MIXTURE = packing.Packing(temper=0.5, window=16)


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How well windows keep to shares in proportion to the square root of each source's tokens."""
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    items = materialise(packing.measured_items(documents, MIXTURE), "mixture-items")
    return packing.mixture_report(packing.pack(documents, MIXTURE), packing.target_shares(items, MIXTURE))


def p6_assigned(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_rows, whole: every document is assigned once, in pieces that follow each other; no sequence is over full."""
    packed = materialise(p6_packing(spark, d), "assigned")
    used = packed.groupBy("shard", "sequence_no").agg((F.sum("n_tokens") <= 2048).alias("fits"))
    each = packed.join(used, ["shard", "sequence_no"])
    return each.groupBy("doc_id").agg(F.count_distinct("copy_no").alias("n_rows"), (F.bool_and("fits") & (F.max("piece_no") + 1 == F.count_distinct("piece_no")) & (F.min("token_start") == 0)).alias("whole"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each cut item: the characters its pieces cover, and whether they follow each other and are under the limit."""
    pieces = p5_pieces(spark, d)
    w = Window.partitionBy("record_kind", "doc_id", "item_no", "trail").orderBy("piece_no")
    joined = pieces.withColumn("follows", F.coalesce(F.lag("end_pos").over(w) + 1 == F.col("body_pos"), F.col("body_pos") == 1))
    return joined.groupBy("record_kind", "doc_id", "item_no").agg(F.sum(F.col("end_pos") - F.col("body_pos") + 1).cast("long").alias("n_chars"), F.bool_and(F.col("follows") & (F.col("n_tokens") <= 700)).alias("sound"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.verbatim_leaks(table(spark, d, "documents"), table(spark, d, "eval_cases")).select("case_id", "doc_id")


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised_leaks(table(spark, d, "documents"), table(spark, d, "eval_cases"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.record_pairs(*spans.shared_spans(table(spark, d, "documents")))


def p8_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


def p8_paragraph_repeats(spark: SparkSession, d: str) -> DataFrame:
    return spans.near_duplicate_paragraphs(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_coverage": p5_coverage, "p6_packing": p6_packing, "p6_fill": p6_fill, "p6_mixture": p6_mixture, "p6_assigned": p6_assigned, "p7_found": p7_found, "p7_reparameterised": p7_reparameterised, "p8_found": p8_found, "p8_shared_share": p8_shared_share, "p8_paragraph_repeats": p8_paragraph_repeats}
