"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per token of prose and code.
PROSE_RATIO, CODE_RATIO = 3.8, 2.9
#: Blanks of every script, written out because \s differs between engines.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words that carry no support for a claim.
CLAIM_STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the to was were will with which this these those they their our we you your not but if then than can may must should would could into over under".split()
#: Words that are not indexed.
INDEX_STOP_WORDS = "a about after all an and any are as at be been before but by can could did do does for from had has have how i if in into is it its me my no not of on once or our out over so than that the their them then there these they this to under until up was we were what when where which while who why will with you your".split()


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with every run of blanks made one."""
    return F.sha2(collapse(text), 256)


def token_count(text: Column, ratio: Column | float = PROSE_RATIO) -> Column:
    """Estimated tokens: 0 for blank text, else at least 1."""
    n = F.length(collapse(text))
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.round(n / (F.lit(ratio) if isinstance(ratio, float) else ratio)))).cast("int")


def sentences(text: Column) -> Column:
    """Split after . ! ? and blanks; trimmed, no blank parts."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.trim(x)), lambda s: s != "")


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, f"{SPACE}+", " "), " "), lambda w: w != "")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def lexemes(text: Column) -> Column:
    stop = F.array(*map(F.lit, INDEX_STOP_WORDS))
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w))


def content_words(text: Column) -> Column:
    """The distinct words of a claim that can support it."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9$%.:/-]+)"), 1)
    stop = F.array(*map(F.lit, CLAIM_STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(raw, lambda w: F.regexp_replace(w, r"^[.,:;/-]+|[.,:;/-]+$", "")), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def share_of(claim: Column, passage: Column) -> Column:
    """Part of the claim's words that the passage has; 0 for an empty claim."""
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, passage)) / F.size(claim)).otherwise(0.0)


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(collapse(text)), " "), lambda w: F.length(w) > 3))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def citation_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), 1), lambda x: x.cast("int"))


def source_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"\.(md|markdown)$"), "markdown").when(p.rlike(r"\.(txt|text)$"), "txt").when(p.endswith(".pdf"), "pdf").when(p.endswith(".docx"), "docx")


def title_from_path(path: Column) -> Column:
    """The file's name without extension, words apart and capitalised; a readme is named by its folder."""
    parts = F.split(path, "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    stem = F.when((F.lower(name) == "readme") & parent.isNotNull(), parent).otherwise(name)
    return F.initcap(F.trim(F.regexp_replace(stem, r"[-_ ]+", " ")))


def client_address(forwarded: Column, peer: Column, hops: int) -> Column:
    """The address `hops` from the right of a forwarding header; the peer where the header is shorter or unused."""
    if hops <= 0:
        return peer
    chain = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(chain) >= hops, F.element_at(chain, -hops)).otherwise(peer)


def parse_time(value: Column) -> Column:
    return F.try_to_timestamp(value)


def normal_email(email: Column) -> Column:
    return F.nullif(F.lower(F.trim(email)), F.lit(""))


def snippet(text: Column, size: int = 420) -> Column:
    """The beginning of a text, cut at a word."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, size), r" [^ ]*$", ""), F.lit(" …")))


def embed_text(trail: Column, content: Column) -> Column:
    """The heading trail before the content, without its last heading where the content begins with it."""
    parts = F.split(trail, " > ")
    leaf = F.element_at(parts, -1)
    first = F.trim(F.regexp_replace(F.element_at(F.split(content, "\n"), 1), r"^#+[ ]*", ""))
    kept = F.when(first == leaf, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > ")).otherwise(trail)
    return F.when(kept.isNull() | (kept == ""), content).otherwise(F.concat_ws("\n\n", kept, content))


def render_passage(number: Column, title: Column, section: Column, source: Column, updated: Column, body: Column) -> Column:
    """A numbered passage with the lines it has data for."""
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.concat(F.lit("[passage "), number.cast("string"), F.lit("]")), line("title: ", title), line("section: ", section), line("source: ", source), line("updated: ", F.date_format(updated, "yyyy-MM-dd")), body, F.lit("[end]"))


def render_block(kind: Column, text: Column, level: Column, lang: Column) -> Column:
    """A parsed block as markdown again."""
    return (
        F.when(kind == "code", F.concat(F.lit("```"), F.coalesce(lang, F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1)).cast("int")), F.lit(" "), text))
        .otherwise(text)
    )


def is_abstention(answer: Column, sentinel: str) -> Column:
    """The sentinel alone, outer dots aside, or inside a message little longer than it. Letter case counts."""
    bare = F.trim(F.regexp_replace(F.trim(answer), r"^\.+|\.+$", ""))
    s = F.lit(sentinel.strip("."))
    return (bare == s) | (answer.contains(s) & (F.length(answer) < len(sentinel) + 80))


def tidy_markers(text: Column) -> Column:
    """Blanks before punctuation, repeated and outer blanks dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" +([.,;:])", "$1"), r"[ \t]{2,}", " "), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
