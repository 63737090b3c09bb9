"""Parsing, chunking, evidence and citations."""

import pytest
from pyspark.sql import functions as F

from quillgrain.config import ChunkConfig, EvidenceConfig
from quillgrain.functions.tokens import approximate_tokens
from quillgrain.operators import chunking as c, citation, evidence as e, parsing as p

SMALL = ChunkConfig(parent_target_tokens=40, parent_max_tokens=50, child_target_tokens=12, child_max_tokens=16, embedding_budget=16)

MARKDOWN = """---
title: x
---
# One

Some *bold* text &amp; more.

```py
code = 1
```

## Two

| a | b |
|---|---|
| 1 | 2 |

- item

> quoted
"""


@pytest.mark.parametrize("text", ["没有标点的中文" * 100, "x" * 500, "cell | " * 300, "a b. " * 200, "\n\n a\n"])
def test_split_tiles_within_budget(text):
    ranges = c.split_text(text, 12, 16)
    assert "".join(text[a:b] for a, b in ranges) == text
    assert all(approximate_tokens(text[a:b]) <= 16 for a, b in ranges)


def test_budget_too_small():
    with pytest.raises(ValueError):
        c.split_text("abc", 1, 1, lambda t: 5 * len(t))


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_markdown_structures(newline):
    text = MARKDOWN.replace("\n", newline)
    blocks = p.parse_markdown(text)
    assert [b["block_type"] for b in blocks] == ["frontmatter", "heading", "paragraph", "code", "heading", "table", "list", "paragraph"]
    assert blocks[5]["section_path"] == ["One", "Two"] and [b["order"] for b in blocks] == list(range(1, 9))
    for b in blocks:
        if b["block_type"] in ("code", "table"):
            span = b["span"]
            assert span["accuracy"] == "exact" and text[span["start_char"] : span["end_char"]] == b["text"]
    assert blocks[2]["text"] == "Some bold text & more." and blocks[2]["span"]["accuracy"] == "line_only"


def test_html_and_text():
    blocks = p.parse_html("<h1>A</h1><script>no</script><p>x &lt; y</p><h2>B</h2><ul><li>i</ul><table><tr><td>1</td></tr></table><h1>C</h1>")
    assert [(b["block_type"], b["section_path"]) for b in blocks] == [("heading", ["A"]), ("paragraph", ["A"]), ("heading", ["A", "B"]), ("list", ["A", "B"]), ("table", ["A", "B"]), ("heading", ["C"])]
    plain = p.parse_text("one\n\ntwo\nlines")
    assert [b["span"]["accuracy"] for b in plain] == ["exact", "exact"] and plain[1]["span"]["start_line"] == 3


def test_places_are_those_the_parsers_read():
    source = "# One *two*\n\ntwo `two`\r\n> three\u3000four\n\nSet\next\n---\n- item two\n\nplain line\n"
    blocks = p.parse_markdown(source)
    assert [(b["text"], source[b["span"]["start_char"] : b["span"]["end_char"]], b["span"]["start_line"], b["span"]["end_line"], b["span"]["accuracy"]) for b in blocks] == [
        ("One two", "# One *two*", 1, 1, "line_only"),
        ("two two three\u3000four", "two `two`\r\n> three\u3000four", 3, 4, "line_only"),
        ("Set ext", "Set\next\n---", 6, 8, "line_only"),
        ("item two", "- item two", 9, 9, "line_only"),
        ("plain line", "plain line", 11, 11, "exact"),
    ]
    page = "<h1>A &amp; b</h1>\n<p>one <b>two</b>\n three</p><div>two</div> two <table>\n<tr><td>1</td></tr></table><p>two"
    said = [(b["text"], page[b["span"]["start_char"] : b["span"]["end_char"]], b["span"]["start_line"], b["span"]["accuracy"]) for b in p.parse_html(page)]
    assert said == [
        ("A & b", "A &amp; b", 1, "line_only"),
        ("one two three", "one <b>two</b>\n three", 2, "line_only"),
        ("two", "two", 3, "exact"),
        ("two", "two", 3, "exact"),
        ("<table>\n<tr><td>1</td></tr></table>", "<table>\n<tr><td>1</td></tr></table>", 3, "exact"),
        ("two", "two", 4, "exact"),
    ]
    plain = "\n a  b \n \n\nc\nd"
    assert [(b["text"], plain[b["span"]["start_char"] : b["span"]["end_char"]], b["span"]["start_line"], b["span"]["end_line"]) for b in p.parse_text(plain)] == [("a  b", "a  b", 2, 2), ("c\nd", "c\nd", 5, 6)]


def test_readers_take_further_types(spark):
    docs = spark.createDataFrame([("1", "pdf", b"%PDF page one"), ("2", "md", b"# Title"), ("3", "pdf", b"broken")], "doc_id string, file_type string, content binary")

    def text_layer(data):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return data[5:].decode()

    got = {r.doc_id: (r.blocks and r.blocks[0].text, r.error) for r in p.parse_documents(docs, {"pdf": text_layer}).collect()}
    assert got == {"1": ("page one", None), "2": ("Title", None), "3": (None, "ValueError: no PDF")}


def test_errors_are_rows(spark):
    docs = spark.createDataFrame([("1", "txt", "hi"), ("2", "exe", "x"), ("3", "md", " "), ("4", None, None)], "doc_id string, file_type string, content string")
    parsed = p.parse_documents(docs)
    assert {r.doc_id: r.error for r in parsed.collect()} == {"1": None, "2": "unsupported file type: exe", "3": "no parseable content found", "4": "unsupported file type: None"}
    assert {r.doc_id: r.source_length for r in p.exclusions(parsed, docs).collect()} == {"2": 1, "3": 1, "4": 0}


def test_chunks_keep_everything(spark):
    text = MARKDOWN + "\n\nlong words " * 60
    blocks = p.parse_markdown(text)
    rows = c.chunk_document("d", blocks, SMALL)
    assert [r["chunk_order"] for r in rows] == list(range(len(rows))) and rows == c.chunk_document("d", blocks, SMALL)
    kept = [r for r in rows if r["preserve_structure"] and r["chunk_role"] == "parent"]
    assert [r["block_types"] for r in kept] == [["code"], ["table"]]
    exact = [r for r in rows if r["accuracy"] == "exact" and r["chunk_role"] == "child"]
    assert exact and all(text[r["start_char"] : r["end_char"]] == r["content"] for r in exact)
    df = spark.createDataFrame([("d", blocks)], p.PARSED.names[:2] and p.T.StructType(p.PARSED.fields[:2]))
    chunks = c.chunk_documents(df, SMALL)
    assert chunks.count() == len(rows) and {r.violations for r in c.invariant_violations(chunks, SMALL).collect()} == {0}


def test_default_and_other_counters_chunk_alike():
    """The default counter measures without reading again; the same counter under another name reads every range."""
    other = lambda t: approximate_tokens(t)
    for text in (MARKDOWN, "word " * 900, "x" * 3000, "a.b;c\n\nd " * 300, "数据" * 300 + " ends", ""):
        blocks = p.parse_text(text)
        assert c.chunk_document("d", blocks, SMALL) == c.chunk_document("d", blocks, SMALL, other)


def test_embedding_checks(spark):
    rows = [("ok", "two words", False), ("blank", " ", False), ("long", "word " * 30, False), ("table", "word " * 30, True), ("huge", "word " * 99, True)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, preserve_structure boolean")
    got = {r.chunk_id: r.outcome for r in c.embedding_outcomes(df, 50, 20).collect()}
    assert got == {"ok": "ok", "blank": "blank", "long": "over_chunk_budget", "table": "ok", "huge": "over_model_limit"}
    assert c.check_embeddable(df.filter("chunk_id in ('ok', 'table')"), 50, 20).count() == 2
    with pytest.raises(Exception, match="over_chunk_budget"):
        c.check_embeddable(df.filter("chunk_id = 'long'"), 50, 20).count()


def test_image_stands_alone():
    blocks = [{"text": t, "block_type": k, "order": i, "section_path": [], "span": None} for i, (t, k) in enumerate([("a", "paragraph"), ("pic", "image"), ("b", "paragraph")], 1)]
    assert [r["content"] for r in c.chunk_document("d", blocks) if r["chunk_role"] == "parent"] == ["a", "pic", "b"]


def test_images(spark):
    text = "![a](x.png) ```\n```\n![no](y.png)\n```\n![b](<p q.jpg> \"t\")\n~~~\n![open](z.png)"
    assert [(r["alt"], r["path"], r["start_line"]) for r in p.image_refs(text)] == [("a", "x.png", 1), ("b", "p q.jpg", 5)]
    rows = [("", "empty_path"), ("http://x/a.png", "external_url"), ("#a", "anchor"), ("/a.png", "absolute_path"), ("../a.png", "path_traversal"), ("a.svg", "unsupported_type"), ("a.PNG", None)]
    df = spark.createDataFrame([(x,) for x, _ in rows], "p string")
    assert [r[0] for r in df.select(p.skip_reason(F.col("p"), F.lit(True))).collect()] == [y for _, y in rows]


def test_interleave(spark):
    blocks = spark.createDataFrame([("d", "head", ["A"], 1, 0, 5), ("d", "inside", ["A"], 2, 10, 12), ("d", "after", ["A"], 3, 20, 30), ("d", "lost", ["A"], 4, None, None)], "doc_id string, text string, section_path array<string>, order int, start_char int, end_char int")
    images = spark.createDataFrame([("d", "img", 8, 15), ("d", "img2", 20, 22)], "doc_id string, text string, start_char int, end_char int")
    rows = p.interleave_images(blocks, images).orderBy("order").collect()
    assert [(r.text, r.order) for r in rows] == [("head", 1), ("img", 2), ("img2", 3), ("after", 4), ("lost", 5)] and rows[1].section_path == ["A"]


def parent(words=200, at=(0, 150), size=10, **more):
    text = " ".join(f"w{i:03d}" for i in range(words))
    kids = tuple(e.Child(f"c{i}", (i * 5, (i + size) * 5 - 1), text[i * 5 : (i + size) * 5 - 1]) for i in at)
    return e.Parent("p", "d", text, kids, **more)


def test_two_windows_and_absolute_offsets():
    whole = parent()
    found = e.windows_of(whole, 40)
    assert len(found) == 2 and all(whole.content[slice(*w.span)] == w.content and approximate_tokens(w.content) <= 40 for w in found)
    again = e.narrow(found[1], 25)
    assert whole.content[slice(*again.span)] == again.content and found[1].span[0] <= again.span[0] <= again.match[0] and again.match[1] <= again.span[1]
    assert len(e.windows_of(parent(at=(0, 5)), 60)) == 1


def test_windows_against_trying_every_radius():
    """Of all symmetric windows around a match, the widest that fits; overlaps join while the union fits."""
    whole = parent(at=(3, 60, 75, 190))
    for budget in (11, 25, 60, 120, 199):
        best = []
        for c in whole.children:
            tries = [(max(0, c.span[0] - r), min(len(whole.content), c.span[1] + r)) for r in range(len(whole.content))]
            best.append(max((t for t in tries if approximate_tokens(whole.content[slice(*t)]) <= budget), key=lambda t: t[1] - t[0]))
        joined = []
        for span in best:
            union = (joined[-1][0], max(span[1], joined[-1][1])) if joined and span[0] <= joined[-1][1] else None
            if union and approximate_tokens(whole.content[slice(*union)]) <= budget:
                joined[-1] = union
            else:
                joined.append(span)
        assert [w.span for w in e.windows_of(whole, budget)] == joined


def test_windows_at_the_edges():
    lost = e.Parent("p", "d", "text", (e.Child("c", None, "snip"),))
    assert [(w.content, w.chunk_id) for w in e.windows_of(lost, 10)] == [("snip", "c")]
    with pytest.raises(e.OverBudget):
        e.narrow(e.windows_of(parent(whole=True), 10)[0], 10)
    with pytest.raises(ValueError):
        e.windows_of(parent(at=(500,)), 40)
    with pytest.raises(e.OverBudget):
        e.windows_of(parent(), 3)
    with pytest.raises(ValueError):
        e.windows_of(parent(at=()), 40)
    (kept,) = e.windows_of(parent(whole=True), 10)
    assert kept.content == parent().content and kept.whole and kept.children == ("c0", "c150")


def test_prompt_budget():
    config = EvidenceConfig(evidence_max_tokens=120)
    taken, dropped, used = e.fit_prompt(50, e.windows_of(parent(), 100), config)
    assert used == 50 + approximate_tokens(e.prompt_text(taken)) <= 170 and len(taken) + len(dropped) == 2
    whole = e.windows_of(parent(), 1000)
    assert e.fit_prompt(50, whole, EvidenceConfig(evidence_max_tokens=120, mode="child_only")) == ([], ["p"], 50)
    # Narrowed to the room there is, around the primary child.
    near_end = e.windows_of(parent(primary="c150"), 1000)
    (cut,), dropped, used = e.fit_prompt(50, near_end, config)
    assert not dropped and used <= 170 and "w155" in cut.content and "w000" not in cut.content


def test_best_evidence_goes_in_first(spark):
    """Rank decides, not the chunk's id; under a tight budget the worse evidence is what is dropped."""
    rows = [("q", 2, "a_worse", "d", "worse " * 30, [("c2", 0, 5, "worse")], "c2", False), ("q", 1, "z_best", "d", "best " * 30, [("c1", 0, 4, "best")], "c1", False)]
    results = spark.createDataFrame(rows, "qid string, rank int, chunk_id string, doc_id string, content string, children array<struct<chunk_id:string,start:int,end:int,snippet:string>>, primary_child string, preserve_structure boolean")
    windows = e.evidence_windows(results)
    assert [x.evidence for x in e.fit_prompts(windows, EvidenceConfig(evidence_max_tokens=500)).collect()] == [["z_best", "a_worse"]]
    (tight,) = e.fit_prompts(windows, EvidenceConfig(evidence_max_tokens=40)).collect()
    assert tight.evidence == ["z_best"] and tight.n_dropped == 1 and tight.used_tokens <= 140
    (first,) = e.evidence_windows(results, EvidenceConfig(context_top_k=1)).select("chunk_id").collect()
    assert first.chunk_id == "z_best"


def test_prompt_keeps_the_match_when_windows_shrink(spark):
    """A match near the end of its window is what stays."""
    text = "filler " * 200 + "needle in here"
    at = text.index("needle")
    rows = [("q", 1, "p", "d", text, [("c", at, len(text), "needle in here")], "c", False)]
    results = spark.createDataFrame(rows, "qid string, rank int, chunk_id string, doc_id string, content string, children array<struct<chunk_id:string,start:int,end:int,snippet:string>>, primary_child string, preserve_structure boolean")
    w = e.evidence_windows(results, EvidenceConfig(window_tokens=1000)).first()
    window = e.Window(w.chunk_id, w.doc_id, w.content, (w["first"], w["last"]), (w.match_first, w.match_last), tuple(w.children), w.whole)
    assert "needle" in e.narrow(window, 60).content and approximate_tokens(e.narrow(window, 60).content) <= 60


def test_citations(spark):
    df = spark.createDataFrame([("a [2] b [1] c [2] [9] [x]", ["p", "q"])], "a string, ev array<string>")
    cited = citation.cited_indexes(F.col("a"))
    row = df.select(cited.alias("i"), citation.citations(F.col("a"), F.col("ev")).alias("c"), citation.scrub_markers(F.col("a"), F.array(F.lit(2))).alias("s"), citation.average_score(F.array(F.lit(0.5), F.lit(0.25))).alias("m")).first()
    assert list(row.i) == [2, 1, 9] and [(x.citation_index, x.evidence) for x in row.c] == [(2, "q"), (1, "p")]
    assert row.s == "a  b [1] c  [9] [x]" and row.m == 0.375
