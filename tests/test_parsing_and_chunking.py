import io
import zipfile

import pytest

from passagework.operators import chunking as ch
from passagework.operators import parsing as pa

DOC = """# Title

Intro line one
continues here.

## Setup ##

- first item
  more of it

  still the item
- second

```python title
x = 1
# no heading
```

| a | b |
| - | - |
| 1 | 2 |

> quoted
> text

---

Sub
---

1. one
2. two
"""


def test_markdown():
    got = [(b.kind, b.level, b.trail) for b in pa.markdown_blocks(DOC)]
    assert got == [("heading", 1, "Title"), ("paragraph", None, "Title"), ("heading", 2, "Title > Setup"), ("list", None, "Title > Setup"), ("code", None, "Title > Setup"), ("table", None, "Title > Setup"), ("quote", None, "Title > Setup"), ("rule", None, "Title > Setup"), ("heading", 2, "Title > Sub"), ("list", None, "Title > Sub")]
    blocks = pa.markdown_blocks(DOC)
    assert blocks[1].text == "Intro line one continues here." and blocks[4].lang == "python" and blocks[4].text == "x = 1\n# no heading"


@pytest.mark.parametrize("raw", ["```\nnever closed\ntext", "~~~~\na\n~~~\nb\n~~~~", "", "\n\n", "# ", "#nospace", " x", "| only", ">"])
def test_markdown_loses_nothing(raw):
    text = "".join(b.text for b in pa.markdown_blocks(raw))
    for word in raw.replace("`", " ").replace("~", " ").replace("#", " ").replace(">", " ").split():
        assert word in text


def test_a_fence_is_closed_by_its_own_kind_only():
    b = pa.markdown_blocks("````\n```\ninner\n```\n````\nafter")
    assert [(x.kind, x.text) for x in b] == [("code", "```\ninner\n```"), ("paragraph", "after")]


def test_plain_text():
    b = pa.text_blocks("OVERVIEW\n========\nfirst line\nsecond line\n\nTERMS AND FEES\nBody text.\nNOT A HEADING.\n- ITEM")
    assert [(x.kind, x.text) for x in b] == [("heading", "OVERVIEW"), ("paragraph", "first line\nsecond line"), ("heading", "TERMS AND FEES"), ("paragraph", "Body text.\nNOT A HEADING.\n- ITEM")]


def docx(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_processor_files():
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc><w:tc>" + p("2") + "</w:tc></w:tr></w:tbl>"
    b = pa.docx_blocks(docx(p("Top", "Title") + p("Part", "Heading2") + p("text") + p("x", "ListBullet") + table))
    assert [(x.kind, x.level, x.trail) for x in b] == [("heading", 1, "Top"), ("heading", 2, "Top > Part"), ("paragraph", None, "Top > Part"), ("list", None, "Top > Part"), ("table", None, "Top > Part")]
    with pytest.raises(pa.UnsupportedFile):
        pa.docx_blocks(b"no zip")


def test_a_bad_document_does_not_stop_the_others(spark):
    df = spark.createDataFrame([(1, b"# a\n\nb"), (2, b"\xff\xfe\xff"), (3, None)], "doc_id long, text binary")
    got = pa.parse_documents(df).orderBy("doc_id", "block_pos").collect()
    assert [(r.doc_id, r.block_type) for r in got] == [(1, "heading"), (1, "paragraph"), (2, None)] and got[2].error


def test_window_trails_are_the_scanner_s(spark):
    blocks = pa.markdown_blocks("# a\n## b\n#### c\n## d\ntext\n# e\n### f\n## g\n")
    df = spark.createDataFrame([(1, n, "heading" if b.is_heading else b.kind, b.text, b.level) for n, b in enumerate(blocks)], "doc_id long, block_pos int, block_type string, block_text string, block_level int")
    assert [r.trail for r in pa.heading_paths(df).orderBy("block_pos").collect()] == [list(b.path) for b in blocks]


def test_page_layout(spark):
    rows = [(1, 1, 1, 18.0, 10.0, "Big"), (1, 2, 1, 10.0, 40.0, "one two three"), (1, 3, 1, 10.0, 52.0, "four"), (1, 4, 1, 10.0, 90.0, "new paragraph"), (1, 5, 2, 10.0, 10.0, "next page")]
    got = pa.layout_blocks(spark.createDataFrame(rows, "doc_id long, line_no int, page int, size double, top double, text string")).orderBy("block_pos").collect()
    assert [(r.block_type, r.block_level, r.block_text) for r in got] == [("heading", 1, "Big"), ("paragraph", None, "one two three four"), ("paragraph", None, "new paragraph"), ("paragraph", None, "next page")]


def words(n, w="lorem"):
    return " ".join([w] * n)


LIMITS = ch.ChunkLimits(target=100, most=150, overlap=20, stub=10)


def test_chunks_stay_under_the_ceiling_and_lose_nothing():
    raw = "# T\n\n" + "\n\n".join(f"## S{i}\n\n" + "\n\n".join(words(30 + j, f"w{i}x{j}") + "." for j in range(6)) for i in range(4))
    blocks = pa.markdown_blocks(raw)
    chunks = ch.pack_blocks(blocks, LIMITS)
    assert all(c.tokens <= LIMITS.most for c in chunks)
    text = "\n".join(c.text for c in chunks)
    assert all(b.text in text for b in blocks)
    assert [c.path for c in chunks if c.path[-1] == "S2"]


def test_oversized_prose_code_and_tables_are_split():
    for raw in ("# T\n\n" + ". ".join("Sentence number " + words(12) for _ in range(40)) + ".", "# T\n\n```\n" + "\n".join(f"line_{i} = call({i})" for i in range(200)) + "\n```", "# T\n\n| h | k |\n| - | - |\n" + "\n".join(f"| {i} | {words(5)} |" for i in range(80))):
        got = ch.pack_blocks(pa.markdown_blocks(raw), LIMITS)
        assert len(got) > 1 and all(c.split for c in got) and all(c.tokens <= LIMITS.most for c in got)
        if "| h | k |" in raw:
            assert all("| h | k |" in c.text for c in got)


def test_a_lone_heading_waits_and_is_never_lost():
    got = ch.pack_blocks(pa.markdown_blocks("# A\n\n## B\n\ntext of b\n\n# Z"), LIMITS)
    assert "# A" in got[0].text and "text of b" in got[0].text and any("# Z" in c.text for c in got)


def test_overlap_repeats_whole_blocks_only_and_no_chunk_is_overlap_alone():
    raw = "# T\n\n" + "\n\n".join(words(7, f"p{i}") + "." for i in range(60))
    got = ch.pack_blocks(pa.markdown_blocks(raw), LIMITS)
    assert any(c.overlapped for c in got)
    seen = set()
    for c in got:
        own = [b.text for b in c.blocks]
        assert set(own) - seen
        seen |= set(own)


def test_nothing_gives_nothing():
    assert ch.pack_blocks([]) == [] and ch.pack_blocks(pa.markdown_blocks("---\n\n***")) == []


def test_chunk_index_is_contiguous(spark):
    df = spark.createDataFrame([(1, "# a\n\n" + words(2000)), (2, ""), (3, None)], "doc_id long, text string")
    got = ch.chunk_documents(df, LIMITS).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and {r.doc_id for r in got} == {1}
