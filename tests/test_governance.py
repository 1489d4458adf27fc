import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from passagework.operators import answers as an
from passagework.operators import governance as gv
from passagework.operators import limiter
from passagework.operators import permissions as pm
from passagework.operators import sync as sy
from passagework.plans import ingest_queries
from passagework.sources import listing as ls
from passagework.sources.versions import VersionedTables
from passagework.streaming import jobs

NOW = dt.datetime(2025, 3, 1, 12)


def test_sliding_window():
    w = limiter.SlidingWindow(2, 10)
    assert [w.hit(t) for t in (0, 1, 5, 10, 10.5, 11)] == [None, None, 5, None, 0.5, None]


def test_the_limit_as_a_batch_and_as_a_stream(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    rows = [(k, 100 * k + i, base + dt.timedelta(seconds=s)) for k in (1, 2) for i, s in enumerate((0, 1, 2, 9, 10, 11, 12, 30))]
    hits = spark.createDataFrame([*rows, (None, 1, base)], "key long, hit_id long, at timestamp")
    batch = {(r.hit_id, r.allowed, r.retry_after) for r in limiter.limited(hits, 2, 10).collect()}
    assert len(batch) == 16
    micros = hits.where("key is not null").select("key", "hit_id", F.unix_micros("at").alias("us"))
    for part, cond in (("a", "hit_id % 100 < 4"), ("b", "hit_id % 100 >= 4")):
        micros.where(cond).coalesce(1).write.parquet(str(tmp_path / "in" / part))
    seen = []
    for part in ("a", "b"):
        stream = spark.readStream.schema(jobs.HITS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in" / part) if part == "a" else str(tmp_path / "in"))
        q = jobs.limited_stream(stream, 2, 10).writeStream.format("memory").queryName(f"limited_{part}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        seen.append({(r.hit_id, r.allowed, r.retry_after) for r in spark.table(f"limited_{part}").collect()})
    assert seen[0] == {x for x in batch if x[0] % 100 < 4}


def test_spend_as_a_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2025, 1, 1, 10), 1), (1, dt.datetime(2025, 1, 1, 10), 1), (2, dt.datetime(2025, 1, 1, 23), 2), (3, dt.datetime(2025, 1, 9), 5)]
    df = spark.createDataFrame(rows, "outcome_id long, created_at timestamp, c int").select("outcome_id", "created_at", F.col("c").cast("decimal(10,6)").alias("estimated_cost_usd"))
    df.write.parquet(str(tmp_path / "o"))
    q = jobs.spend_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "o"))).writeStream.format("memory").queryName("spend").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(str(r.day), float(r.spent), r.n_requests) for r in spark.table("spend").collect()] == [("2025-01-01", 3.0, 2)]


def test_files_arrive_once(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.md").write_text("# a")
    got = []
    for _ in range(2):
        jobs.ingest_stream(jobs.file_stream(spark, str(tmp_path / "f")), str(tmp_path / "ck"), lambda df, n: got.extend(r.path.rsplit("/", 1)[1] for r in df.collect())).awaitTermination()
        (tmp_path / "f" / "b.md").write_text("# b")
    assert got == ["a.md", "b.md"]


@pytest.fixture
def tables(spark, tmp_path):
    t = VersionedTables(spark, f"file://{tmp_path}/v")
    t.commit({
        "groups": spark.createDataFrame([(1, "all"), (2, "hr")], "group_id int, group_name string"),
        "users": spark.createDataFrame([(7, [1, 2]), (8, [])], "user_id long, group_ids array<int>"),
        "permissions": spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, group_id int"),
        "chunks": spark.createDataFrame([(10, 1, [1]), (11, 1, [1]), (20, 2, [2])], "chunk_id long, doc_id long, access_group_ids array<int>"),
        "audit": spark.createDataFrame([], pm.AUDIT),
    })
    return t


def test_permissions_move_together(tables):
    pm.set_document_groups(tables, 1, [" hr ", "hr", ""], "admin", NOW)
    assert {(r.chunk_id, tuple(r.access_group_ids)) for r in tables.table("chunks").collect()} == {(10, (2,)), (11, (2,)), (20, (2,))}
    a = tables.table("audit").collect()
    assert [(r.action, r.before, r.after) for r in a] == [("document_groups", ["all"], ["hr"])]
    pm.set_user_groups(tables, 7, [], "admin", NOW)
    assert {r.user_id: list(r.group_ids) for r in tables.table("users").collect()} == {7: [], 8: []}
    assert tables.table("audit").count() == 2
    pm.rebuild_acl(tables)
    assert {tuple(r.access_group_ids) for r in tables.table("chunks").collect()} == {(2,)}


def test_refused_changes_leave_everything(tables):
    before = tables.current()
    with pytest.raises(ValueError):
        pm.set_document_groups(tables, 1, [" "], "admin", NOW)
    with pytest.raises(pm.UnknownGroup):
        pm.set_user_groups(tables, 7, ["nobody"], "admin", NOW)
    assert tables.current() == before


def test_a_source_that_missed_a_delivery_is_synchronised_with_its_last(spark, tmp_path):
    rows = [(1, "s", "a", "1", "x"), (1, "s", "b", "1", "x"), (1, "t", "a", "1", "x"), (2, "t", "a", "2", "y"), (3, "s", "A ", "1", "z"), (3, "s", "c", "1", "x"), (3, "t", "a", "2", "y")]
    listed = spark.createDataFrame(rows, "snapshot_no int, source string, source_uri string, revision string, title string")
    listed.selectExpr("*", "timestamp'2025-01-01' AS delivered_at").write.parquet(f"{tmp_path}/source_snapshots.parquet")
    spark.createDataFrame([(3, "s", "c", "Failed")], "sync_no int, source string, source_uri string, status string").write.parquet(f"{tmp_path}/sync_outcomes.parquet")
    got = {tuple(r) for r in ingest_queries.sync_steps(spark, str(tmp_path)).where("snapshot_no > 1").collect()}
    assert got == {(2, "t", "a", "updated", 2), (3, "s", "a", "unchanged", 1), (3, "s", "b", "removed", 1), (3, "s", "c", "failed", None), (3, "t", "a", "unchanged", 1)}
    assert {tuple(r) for r in ingest_queries.sync_steps_prune(spark, str(tmp_path)).collect()} == {(3, "s", "b")}


def test_sync_plan(spark):
    old = spark.createDataFrame([("s", "a", 1, "1", "h", 1), ("s", "b", 2, "1", "h", 3), ("s", "c", 3, "1", "h", 1), ("s", "d", 4, "1", "h", 1), ("t", "z", 5, "1", "h", 1), ("s", "f", 6, None, "h", 1)], "source string, source_uri string, doc_id long, revision string, content_hash string, version int")
    new = spark.createDataFrame([("s", "a", "1", "x", False), ("s", "b", "2", "x", False), ("s", "c", "2", "h", False), ("s", "e", "1", "h", False), ("s", "f", None, None, True)], "source string, source_uri string, revision string, content_hash string, failed boolean")
    plan = sy.sync_plan(old, new)
    assert {(r.source_uri, r.status, r.version) for r in plan.collect()} == {("a", "unchanged", 1), ("b", "updated", 4), ("c", "unchanged", 1), ("d", "removed", 1), ("e", "ingested", 1), ("f", "failed", 1)}
    assert {r.source_uri for r in sy.to_read(plan).collect()} == {"b", "e"}
    assert {r.status for r in sy.sync_plan(old, new, force=True, prune=False).where("source_uri in ('a', 'd')").collect()} == {"updated"}
    chunks = spark.createDataFrame([(1, 1), (2, 2), (4, 4)], "chunk_id long, doc_id long")
    assert {r.chunk_id for r in sy.apply_chunks(chunks, plan, chunks.limit(0)).collect()} == {1}


def test_manifest_rules():
    ok = {"version": 1, "company": "c", "groups": ["all"], "documents": [{"path": "a/b.md", "title": "B", "source_type": "markdown", "access_groups": ["all", "all"]}]}
    assert ls.check_manifest(ok)["documents"][0]["access_groups"] == ["all"]
    for change in ({"path": "/a.md"}, {"path": "a.pdf"}, {"access_groups": []}, {"access_groups": ["x"]}, {"colour": "red"}, {"path": "../a.md"}):
        with pytest.raises(ls.ListingError):
            ls.check_manifest(ok | {"documents": [ok["documents"][0] | change]})
    with pytest.raises(ls.ListingError):
        ls.check_manifest(ok | {"documents": ok["documents"] * 2})


def test_folder_listing_and_changed_content(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "setup-guide.md").write_text("# Setup")
    m = ls.check_manifest({"groups": ["all"], "documents": [{"path": "docs/setup-guide.md", "source_type": "markdown", "access_groups": ["all"]}]})
    listing = ls.checked(ls.folder_listing(spark, str(tmp_path), m))
    row = listing.first()
    assert (row.title, row.source_type, row.size) == ("Setup Guide", "markdown", 7)
    plan = spark.createDataFrame([("local-corpus", "docs/setup-guide.md", "ingested")], "source string, source_uri string, status string")
    assert bytes(ls.fetch_changed(spark, listing, plan, str(tmp_path)).first().content) == b"# Setup"
    m["documents"].append(m["documents"][0] | {"path": "gone.md"})
    assert ls.missing_files(spark, str(tmp_path), m) == ["gone.md"]
    with pytest.raises(Exception, match="listed but missing"):
        ls.folder_listing(spark, str(tmp_path), m).collect()


def test_only_changed_files_are_opened(spark, tmp_path):
    for n in ("a [1].md", "b.md", "c.md"):
        (tmp_path / n).write_text(n)
    rows = [("s", n, "markdown", f"file:{tmp_path}/{n}") for n in ("a [1].md", "b.md", "c.md")]
    listing = spark.createDataFrame(rows, "source string, source_uri string, source_type string, content_path string")
    plan = spark.createDataFrame([("s", "a [1].md", "updated"), ("s", "b.md", "ingested"), ("s", "c.md", "unchanged")], "source string, source_uri string, status string")
    got = ls.fetch_changed(spark, listing, plan, str(tmp_path))
    assert {r.source_uri: bytes(r.content).decode() for r in got.collect()} == {"a [1].md": "a [1].md", "b.md": "b.md"}
    assert not any("c.md" in f for f in got.inputFiles())
    assert ls.fetch_changed(spark, listing, plan.limit(0), str(tmp_path)).count() == 0


def test_two_writers_from_one_version(spark, tmp_path):
    t = VersionedTables(spark, f"file://{tmp_path}/w")
    t.commit({"a": spark.range(1)})
    base = t._version()
    t.commit({"a": spark.range(2)}, base)
    with pytest.raises(RuntimeError, match="another writer"):
        t.commit({"a": spark.range(3)}, base)
    assert t.table("a").count() == 2 and t.current(base) != t.current()


def test_repository_listing(spark, tmp_path):
    tree = [{"path": "README.md", "type": "blob", "sha": "1", "size": 5}, {"path": "docs/readme.md", "type": "blob", "sha": "2", "size": 5}, {"path": "docs/big.txt", "type": "blob", "sha": "3", "size": 2_000_000}, {"path": "docs", "type": "tree", "sha": "4"}, {"path": "docs/x.py", "type": "blob", "sha": "5", "size": 1}]
    rec = tmp_path / "rec.json"
    rec.write_text(json.dumps({"/repos/o/r": {"default_branch": "main"}, "/repos/o/r/git/trees/main?recursive=1": {"tree": tree}}))
    spark.dataSource.register(ls.RepositoryTree)
    df = spark.read.format("repository_tree").option("repo", "o/r").option("recording", str(rec)).option("groups", "all").load()
    assert {(r.source_uri, r.title, r.revision) for r in df.collect()} == {("README.md", "Readme", "1"), ("docs/readme.md", "Docs", "2")}
    only = spark.read.format("repository_tree").option("repo", "o/r").option("recording", str(rec)).option("groups", "all").option("include", "docs/").load()
    assert only.count() == 1
    rec.write_text(json.dumps({"/repos/o/r": {"default_branch": "main"}, "/repos/o/r/git/trees/main?recursive=1": {"tree": tree, "truncated": True}}))
    with pytest.raises(Exception, match="cut short"):
        df.collect()
    assert ls.decode_blob({"encoding": "base64", "content": "aGk="}) == b"hi"


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "outcome_id long, answer string, cited_doc_ids array<long>")


def test_citations(spark):
    a = outcomes(spark, [(1, "Second [2] and first [1], fabricated [9] , again [2].", [10, 20]), (2, None, [1]), (3, "no marker", None)])
    r = {x.outcome_id: x for x in an.with_citations(a).collect()}
    assert r[1].ordered == [2, 1] and r[1].invalid == [9] and r[3].ordered == []
    clean = {x.outcome_id: x.clean_answer for x in an.renumbered(a).collect()}
    assert clean[1] == "Second [1] and first [2], fabricated, again [1]." and clean[3] == "no marker"


def test_grounding(spark):
    docs = spark.createDataFrame([(10, "Employees get twenty eight days of annual leave."), (20, "Unrelated text about payroll systems.")], "doc_id long, text string")
    a = outcomes(spark, [(1, "Employees get twenty eight days annual leave [1]. Payroll systems never handle moon rocket launches here [2].", [10, 20]), (2, "Short.", [10])])
    g = {r.outcome_id: r for r in an.grounding(an.claim_support(a, docs), a).collect()}
    assert (g[1].n_claims, g[1].n_supported, g[1].passed) == (2, 1, False) and g[2].grounding == 1.0


def test_bands(spark):
    df = spark.createDataFrame([(0.95, 0, 1), (0.95, 1, 1), (0.5, 0, 1), (0.95, 0, 0)], "g double, u int, c int")
    assert [r.b for r in df.select(an.band(F.col("g"), F.col("u"), F.col("c"), F.lit(1.0)).alias("b")).collect()] == ["HIGH", "MEDIUM", "LOW", "LOW"]


def test_context_is_cut_at_the_budget_and_drops_repeats(spark):
    text = lambda w: " ".join(f"{w}{i}long" for i in range(20))
    rows = [("q", 1, 1, text("a")), ("q", 2, 2, text("a")), ("q", 3, 3, text("b")), ("q", 4, 4, text("c") * 5), ("q", 5, 5, text("d"))]
    ranked = spark.createDataFrame(rows, "request_id string, position int, chunk_id long, content string").selectExpr("*", "'T' AS document_title", "'S' AS section_path", "'u' AS source_uri", "CAST(NULL AS timestamp) AS source_updated_at")
    got = an.build_context(ranked, 120).orderBy("number").collect()
    shown = "[passage 1] title: T section: S source: u " + text("a") + " [end]"
    assert [(r.chunk_id, r.number, r.tokens) for r in got] == [(1, 1, round(len(shown) / 3.8)), (3, 2, round(len(shown) / 3.8))]
    assert an.build_context(ranked, 2 * got[0].tokens).count() == 2 and an.build_context(ranked, 2 * got[0].tokens - 1).count() == 1
    assert an.build_context(ranked, 1).count() == 1  # the first is kept whatever its size


def test_a_made_up_marker_cites_nothing(spark):
    a = outcomes(spark, [(1, "Every desk gets a new chair this spring [7]. Every lamp gets a new bulb each year [1].", [10])])
    r = an.renumbered(a).select("clean_answer", an.uncited_count(F.col("clean_answer")).alias("n")).first()
    assert (r.clean_answer, r.n) == ("Every desk gets a new chair this spring. Every lamp gets a new bulb each year [1].", 1)


def test_the_flow_from_question_to_confidence(spark):
    requests = spark.createDataFrame([("a", "how long"), ("b", "how far"), ("c", "why")], "request_id string, question string")
    fused = spark.createDataFrame([("a", 1, 1, 0.9, 0.03), ("a", 2, 2, 0.7, 0.02), ("b", 1, 2, 0.3, 0.03)], "request_id string, position int, chunk_id long, vector_score double, rrf_score double")
    passages = spark.createDataFrame([(1, 10, "# Leave\nEveryone gets thirty days of leave a year. More on request."), (2, 20, "Distances vary.")], "chunk_id long, doc_id long, content string").selectExpr("*", "'T' AS document_title", "'S' AS section_path", "'u' AS source_uri", "CAST(NULL AS timestamp) AS source_updated_at")
    run = lambda **k: {r.request_id: r for r in an.answer_requests(requests, fused, passages, an.FirstPassageModel, **k).collect()}
    got = run()
    assert (got["a"].status, got["a"].answer, got["a"].cited_doc_ids, got["a"].n_uncited, got["a"].grounding, got["a"].confidence) == ("answered", "Everyone gets thirty days of leave a year [1].", [10], 0, 1.0, "HIGH")
    assert (got["b"].reason, got["c"].reason, got["b"].answer, got["b"].confidence) == ("no_relevant_candidates", "no_relevant_candidates", None, None)
    spent = run(spent=5.0, daily_budget=5.0)
    assert (spent["a"].reason, spent["a"].prompt_tokens, spent["b"].reason) == ("budget_exhausted", None, "no_relevant_candidates")


def test_unknown_groups_stop(spark):
    groups = spark.createDataFrame([(1, "all")], "group_id int, group_name string")
    names = spark.createDataFrame([(1, [" all", "x"]), (2, ["all", "all"])], "k int, names array<string>")
    r = gv.resolve_groups(names, groups, "k", "names")
    assert {(x.k, tuple(x.group_ids), tuple(x.unknown)) for x in r.collect()} == {(1, (1,), ("x",)), (2, (1,), ())}
    with pytest.raises(Exception, match="unknown groups: x"):
        gv.require_known(r).collect()


def test_budget(spark):
    o = spark.createDataFrame([(1, dt.datetime(2025, 1, 1, 1), 2.0), (2, dt.datetime(2025, 1, 1, 2), 1.0), (3, dt.datetime(2025, 1, 2, 1), 1.0)], "outcome_id long, created_at timestamp, estimated_cost_usd double")
    assert {r.outcome_id for r in gv.budget_exhausted(o, 2.0).where("refused").collect()} == {2}
    assert gv.budget_exhausted(o, None).where("refused").count() == 0
