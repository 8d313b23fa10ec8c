import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.operators import extract as X
from loomspan.operators import markdown as M
from loomspan.operators import similarity as S

DOC = """---
title: x
---
# Guide

Intro text. More of it.

## Install

<!-- pages: 3-1,5 -->
Run this:

```sh
pip install x
```

| a | b |
| --- | --- |
| 1 | 2 |

> quoted
- item
  more

Setext
---

    code
<div>
raw
</div>
See [docs](http://x.y/z) and ![pic](a.png)."""


def test_blocks_and_spans():
    found = M.blocks(DOC)
    assert [b.kind for b in found] == ["front_matter", "heading", "text", "heading", "text", "fence", "table", "quote", "list", "heading", "indented", "html", "text"]
    assert all(DOC[b.start : b.stop] == b.text for b in found)
    assert found[4].path == ("Guide", "Install") and found[4].pages == (1, 2, 3, 5)
    assert found[9].path == ("Guide", "Setext")


def test_unclosed_fence_runs_to_the_end():
    assert [b.kind for b in M.blocks("a\n~~~\nb\n```\nc")] == ["text", "fence"]


@pytest.mark.parametrize("overlap", [0, 40])
def test_chunks_fit_and_cover(overlap):
    rng = random.Random(3)
    for _ in range(20):
        words = lambda n: " ".join("w" * rng.randrange(1, 9) + rng.choice(["", "", ".", "!"]) for _ in range(n))
        parts = [f"# H{i}\n\n{words(rng.randrange(1, 200))}\n\n- {words(30)}\n- {words(5)}\n\n| a | b |\n| --- | --- |\n" + "".join(f"| {words(3)} | y |\n" for _ in range(30)) + f"\n```\n{words(90)}\n```\n" for i in range(3)]
        text = "\n".join(parts)
        out = M.chunk(text, 260, overlap)
        assert [c["index"] for c in out] == list(range(len(out)))
        assert all(len(c["text"]) <= 260 for c in out)
        assert all(0 <= c["char_start"] < c["char_end"] <= len(text) for c in out)
        said = " ".join(c["text"] for c in out)
        assert set(text.split()) - {"```"} <= set(said.split()) | {w for w in text.split() if len(w) > 200}


def test_table_rows_repeat_the_header_and_fences_are_closed():
    table = "| k | v |\n| --- | --- |\n" + "".join(f"| key{i} | value{i} |\n" for i in range(40))
    fence = "```py\n" + "x = 1\n" * 80 + "```"
    out = M.chunk(f"{table}\n{fence}\n", 200, 0)
    tables = [c for c in out if c["kind"] == "table"]
    fences = [c for c in out if c["kind"] == "fence"]
    assert len(tables) > 2 and all(c["text"].startswith("| k | v |\n| --- | --- |\n") for c in tables)
    assert len(fences) > 1 and all(c["text"].startswith("```py\n") and c["text"].endswith("\n```") for c in fences)


def test_token_budget():
    count = lambda t: len(t.split())
    out = M.chunk("one two three four. " * 60, 1800, 0, max_tokens=16, count=count)
    assert len(out) > 5 and all(count(c["text"]) <= 16 for c in out)


def test_heading_goes_with_the_beginning_of_its_text():
    out = M.chunk("# Title\n\n" + "word " * 300, 300, 0)
    assert out[0]["text"].startswith("# Title\n\nword") and out[0]["heading_path"] == ["Title"]


def test_empty_texts():
    assert M.chunk(None) == M.chunk("") == M.chunk(" \n\n") == []


def test_retrieval_finds_the_right_section(spark):
    book = "\n\n".join(f"# {h}\n\n{t}" for h, t in [("Backups", "Snapshots run nightly and are kept for thirty days."), ("Access", "Passwords rotate every ninety days."), ("Billing", "Invoices are sent on the first day of a month.")])
    rows = [(c["index"], c["text"]) for c in M.chunk(book, 260, 0)]
    queries = [(1, "how long are nightly snapshots kept"), (2, "when do passwords rotate"), (3, "when are invoices sent")]
    got = S.retrieve(spark.createDataFrame(rows, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), "text").collect()
    text = dict(rows)
    assert {r.query_id: text[r.chunk_id].split("\n")[0] for r in got} == {1: "# Backups", 2: "# Access", 3: "# Billing"}


def test_html_spans_fill_a_grid():
    (t,) = X.html_tables("<table><caption>Cap &amp; x</caption><tr><th rowspan=2>A</th><th colspan=2>B<br>C</th></tr><tr><td>1</td><td>2</td></tr></table>")
    assert t == {"source": "html", "caption": "Cap & x", "headers": ["A", "B C", ""], "rows": [["", "1", "2"]]}


def test_pipe_tables_and_stitching():
    text = "Table 1: first\n| A | B |\n| --- | :-: |\n| 1 | x\\|y |\n\ntext\n\n| a | b |\n| --- | --- |\n| 2 |\n\n| other | b |\n| --- | --- |\n| 3 | 4 |"
    first, second = X.tables(text)
    assert first["rows"] == [["1", "x|y"], ["2", ""]] and first["multi_page"] and first["caption"] == "Table 1: first"
    assert second["headers"] == ["other", "b"] and not second["multi_page"]


def test_layout_tree_tables_have_pages():
    tree = '{"block_type": "Document", "children": [{"block_type": "Page", "children": []}, {"block_type": "Page", "children": [{"block_type": "Table", "html": "<table><tr><td>a</td></tr></table>"}]}]}'
    (t,) = X.tables(tree)
    assert t["page_number"] == 2 and t["headers"] == ["a"]


def test_html_to_markdown():
    title, text = X.html_to_markdown("<title>T &amp; u</title><body><script>x()</script><h2>Head</h2><p>One <b>two</b> <a href='/l'>link</a><br>next</p><ul><li>a<li>b</ul></body>")
    assert title == "T & u" and text.startswith("## Head\n\nOne **two** [link](/l)") and "- a\n- b" in text and "x()" not in text
    assert X.html_to_markdown("<p>just text", "stem") == ("stem", "# stem\n\njust text")


def test_html_elements_end_where_they_should():
    kinds = lambda t: [(b.kind, b.text) for b in M.blocks(t)]
    assert kinds("intro\n\n<hr>\n\n# Title\n\nmore") == [("text", "intro"), ("html", "<hr>"), ("heading", "# Title"), ("text", "more")]
    assert kinds("<video src='a' />\ntext after\n")[0] == ("html", "<video src='a' />")
    assert kinds("<div>\na\n</DIV >\nafter") == [("html", "<div>\na\n</DIV >"), ("text", "after")]
    assert kinds("<dd>x\n\n# T")[0] == ("text", "<dd>x")


def _messy(rng, n):
    word = lambda: "".join(rng.choice("abc de.|") for _ in range(rng.randrange(1, 30)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(0, 60)))
    made = [lambda: "# " + line(), lambda: "| a | b |\n| --- | --- |\n" + "\n".join(f"| {line()} | x |" for _ in range(rng.randrange(5))), lambda: "```py\n" + line() + "\n" + line() + "\n```", lambda: "- " + line() + "\n- " + line(), lambda: "> " + line(), line, lambda: "<div>" + line() + "</div>", lambda: "x" * rng.randrange(3000)]
    return "\n\n".join(rng.choice(made)() for _ in range(n))


def test_no_chunk_is_over_the_budget():
    import random

    rng = random.Random(5)
    for i in range(150):
        text, tokens = _messy(rng, rng.randrange(1, 12)), [None, 16, 50, 120][i % 4]
        count = [None, lambda t: len(t.split()) + len(t) // 7 + 1][i % 2] if tokens else None
        budget = M.Budget(300, tokens, count)
        got = M.chunk(text, max_chars=300, overlap=40 * (i % 3), max_tokens=tokens, count=count)
        assert all(not budget.over(c["text"]) for c in got), (i, tokens)
        kept = set("".join("".join(c["text"] for c in got).split()))
        assert set("".join(text.split())) - set("`|-") <= kept | set("`|-")


def test_start_lines_count_every_line_end():
    got = M.chunk("a b\r\n\r\n# T\n\nend")
    assert [(c["text"][:3], c["start_line"]) for c in got] == [("a b", 1), ("# T", 4)]


def test_spans_and_nested_html_tables():
    t = X.html_tables('<table><tr><td colspan="²">a<td rowspan=9>b</tr><tr><td>c</table>')
    assert [t[0]["headers"], *t[0]["rows"]] == [["a", "b"], ["c", ""]]
    t = X.html_tables("<table><tr><td>out<table><tr><td>in</td></tr></table>er</td><td>x</td></tr></table>")
    assert [(x["headers"], x["rows"]) for x in t] == [(["in"], []), (["outer", "x"], [])]
    wide = X.html_tables('<table><tr><td colspan="1000000000">a</td></tr><tr><td>b</td></tr></table>')[0]
    assert len(wide["headers"]) == X.MOST_COLUMNS and wide["rows"][0][0] == "b"
    assert X.html_tables("<table><td>alone</table>")[0]["headers"] == ["alone"] and X.html_tables("<table></table>") == [] == X.html_tables("<table><tr><td>open")


def test_texts_are_sent_on_in_pieces(spark, monkeypatch):
    """A task keeps what it makes of a few texts, whatever the table's size, and Spark sends it few rows at once."""
    seen = []
    monkeypatch.setattr(M, "PIECE", 3000)
    monkeypatch.setattr(X, "PIECE", 3000)
    one = spark.createDataFrame([(1, "t", "x")], "id long, name string, text string")
    texts = pa.array([f"# T{i}\n\n" + "word and more. " * 60 for i in range(40)])
    ids, names = pa.array(range(40), pa.int64()), pa.array(["n"] * 40)

    class Frame:
        sparkSession, schema = spark, one.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            seen.append(run)
            return one.withColumns({c: F.lit(None).cast(t) for c, t in (x.rsplit(" ", 1) for x in M.CHUNK.split(", "))}).withColumn("source_sha256", F.lit(""))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    M.chunks(Frame(), "id", "text", "name")
    X.pages_to_markdown(Frame(), "id", "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    chunked, pages = (list(run(iter([pa.RecordBatch.from_arrays(c, [str(i) for i in range(len(c))])]))) for run, c in zip(seen, ([ids, names, names, texts], [ids, texts]), strict=True))
    assert len(chunked) > 5 and len(pages) > 5
    assert [i for b in chunked for i in b.column(0).to_pylist()] == [i for i, t in enumerate(texts.to_pylist()) for _ in M.chunk(t)]
    assert [i for b in pages for i in b.column(0).to_pylist()] == list(range(40))
