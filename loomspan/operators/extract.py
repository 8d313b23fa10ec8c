"""Extraction: HTML to Markdown, tables of pipes and of HTML, stitching of continued tables, chart pivots."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.session import PIECE, ROWS, arrow_batches

HEADINGS = {f"h{i}": i for i in range(1, 7)}
BREAKS = frozenset("p div section article main header footer ul ol table tr blockquote pre nav aside figure form".split())
SKIPPED = frozenset(("script", "style", "noscript"))


class _Renderer(HTMLParser):
    """Markdown of a body: headings, paragraphs, lists, links, images, emphasis and line breaks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title, self.in_title, self.skip, self.body = "", False, 0, False
        self.links: list[str] = []
        self.lists: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        elif tag in SKIPPED:
            self.skip += 1
        elif tag in HEADINGS:
            self.out.append("\n\n" + "#" * HEADINGS[tag] + " ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else -1)
            self.out.append("\n\n" if len(self.lists) == 1 else "\n")
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1] >= 0:
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}. "
            else:
                mark = "- "
            self.out.append("\n" + "  " * depth + mark)
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in BREAKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag == "a":
            self.out.append(f"]({self.links.pop() if self.links else ''})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in HEADINGS or tag in BREAKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(source: str | None, stem: str = "document") -> tuple[str, str]:
    """Title and Markdown; the title opens the text unless that begins with a heading."""
    r = _Renderer()
    r.feed(source or "")
    r.close()
    text = re.sub(r"[ \t]+\n", lambda m: "  \n" if m[0].startswith("  ") else "\n", "".join(r.out))
    text = re.sub(r"\n[ \t]+(?=[^\s\-\d])", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    title = re.sub(r"\s+", " ", r.title).strip() or stem
    return title, text if text.startswith("#") else f"# {title}\n\n{text}".strip()


def pages_to_markdown(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("title", T.StringType()), T.StructField("markdown", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, made = 0, 0, []
            for i, x in enumerate(b.column(1), 1):
                made.append(html_to_markdown(x.as_py()))
                size += len(made[-1][1])
                if size >= PIECE or i == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0)[first:i], *[pa.array(c, pa.string()) for c in zip(*made, strict=True)]], schema.names)
                    first, size, made = i, 0, []

    arrow_batches(df.sparkSession, ROWS)
    return df.select(id_col, html_col).mapInArrow(run, schema)


def clean_cell(text: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", text, flags=re.I)))).strip()


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [clean_cell(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line)]


def pipe_tables(text: str) -> list[dict]:
    """Tables of two or more successive pipe rows; headers are the row before a separator, else the first row."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        end = i
        while end < len(lines) and lines[end].count("|") >= 2:
            end += 1
        if end - i >= 2:
            rows = [_cells(x) for x in lines[i:end]]
            if all(re.fullmatch(r":?-+:?", c) for c in rows[1]):
                del rows[1]
            if not any(rows[0]) and len(rows) > 1:
                del rows[0]
            width = max(map(len, rows))
            rows = [r + [""] * (width - len(r)) for r in rows]
            before = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
            caption = before if re.match(r"(?:table|figure)\s+\d+\s*[:.]", before, re.I) else ""
            out.append({"source": "markdown", "caption": caption, "headers": rows[0], "rows": rows[1:]})
        i = max(end, i + 1)
    return out


#: Columns that one cell may span, and rows (fixed values of the HTML standard).
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Table:
    """Rows of (text, rows spanned, columns spanned) as they are read."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: str | None = None
        self.caption: str | None = None
        self.said, self.span = "", (1, 1)

    def close_cell(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((clean_cell(self.cell), *self.span))
            self.cell = None

    def grid(self) -> list[list[str]]:
        """Cells in their places; a spanned place is empty, and no cell goes on below the last row."""
        out: list[dict[int, str]] = []
        taken: dict[int, int] = {}
        for cells in self.rows:
            row, col, below = dict.fromkeys(taken, ""), 0, {}
            for text, high, wide in cells:
                while col in taken:
                    col += 1
                for c in range(col, col + wide):
                    row[c] = text if c == col else ""
                    if high > 1:
                        below[c] = high - 1
                col += wide
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | below
            out.append(row)
        wide = max((c + 1 for row in out for c in row), default=0)
        return [[row.get(c, "") for c in range(wide)] for row in out] if wide else []


def _span(value: str | None, most: int) -> int:
    return min(most, max(1, int(value.strip()[:9]))) if value and re.fullmatch("[0-9]+", value.strip()) else 1


class _Tables(HTMLParser):
    """Tables of a page, in order of their ends; a table inside a cell is one of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[_Table] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append(_Table())
        if not self.open:
            return
        t = self.open[-1]
        if tag == "tr":
            t.close_cell()
            t.rows.append([])
        elif tag in ("td", "th"):
            t.close_cell()
            a = dict(attrs)
            t.cell, t.span = "", (_span(a.get("rowspan"), MOST_ROWS), _span(a.get("colspan"), MOST_COLUMNS))
        elif tag == "caption":
            t.caption = ""
        elif tag == "br" and t.cell is not None:
            t.cell += " "

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th", "tr", "table"):
            t.close_cell()
        if tag == "caption" and t.caption is not None:
            t.said, t.caption = clean_cell(t.caption), None
        elif tag == "table":
            self.open.pop()
            if rows := t.grid():
                self.found.append({"source": "html", "caption": t.said, "headers": rows[0], "rows": rows[1:]})

    def handle_data(self, data: str) -> None:
        if self.open:
            t = self.open[-1]
            if t.cell is not None:
                t.cell += data
            elif t.caption is not None:
                t.caption += data


def html_tables(source: str) -> list[dict]:
    p = _Tables()
    p.feed(source)
    p.close()
    return p.found


def json_tables(text: str) -> list[dict]:
    """Tables of a tree of layout blocks (block_type, html, children), with the number of the page they are on."""
    try:
        tree = json.loads(text)
    except ValueError:
        return []
    out: list[dict] = []

    def visit(node: object, page: int) -> int:
        if isinstance(node, list):
            for child in node:
                page = visit(child, page)
        elif isinstance(node, dict):
            kind = str(node.get("block_type", ""))
            page += kind.endswith("Page")
            if kind.endswith("Table"):
                out.extend({**t, "source": "json", "page_number": page} for t in html_tables(str(node.get("html") or "")))
            page = visit(node.get("children") or [], page)
        return page

    visit(tree, 0)
    return out


def stitched(tables: list[dict]) -> list[dict]:
    """Joins a table to the one before it of the same source, headers and width, unless both have captions that differ."""
    out: list[dict] = []
    for t in tables:
        last = out[-1] if out else None
        key = lambda x: [h.casefold() for h in x["headers"]]
        if last and last["source"] == t["source"] and key(last) == key(t) and (not t["caption"] or not last["caption"] or t["caption"] == last["caption"]):
            last["rows"] = last["rows"] + t["rows"]
            last["segment_count"] += 1
        else:
            out.append({**t, "segment_count": 1})
    return [{**t, "multi_page": t["segment_count"] > 1} for t in out]


def tables(text: str | None) -> list[dict]:
    """Tables of a document: those of a layout tree if it is one, else of Markdown, then of HTML."""
    text = text or ""
    return stitched(json_tables(text) or [*pipe_tables(text), *html_tables(text)])


CELL = "table_no bigint, source string, caption string, segment_count bigint, row bigint, col bigint, value string"


def table_cells(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per cell of every table, headers as row 0."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T._parse_datatype_string(CELL).fields])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, x in enumerate(b.column(1)):
                for n, t in enumerate(tables(x.as_py())):
                    for r, cells in enumerate([t["headers"], *t["rows"]]):
                        for c, v in enumerate(cells):
                            at.append(i)
                            rows.append((n, t["source"], t["caption"], t["segment_count"], r, c, v))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def html_links(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Distinct href targets of a page."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit('<a [^>]*href="([^"]*)"'), 1))).alias("target"))


def html_title(source: Column) -> Column:
    return F.trim(F.regexp_extract(source, r"<title>([^<]*)</title>", 1))


def caption_before(rows: DataFrame) -> DataFrame:
    """Adds caption to lines: the nearest line before that is not blank, if it is a caption."""
    w = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    near = F.last(F.when(F.trim("line") != "", F.trim("line")), ignorenulls=True).over(w)
    return rows.withColumn("caption", F.when(near.rlike(r"^(?i)(table|figure) +\d+ *[:.]"), near))


def stitch_segments(df: DataFrame) -> DataFrame:
    """Segments of tables (doc, pos, header, rows): successive ones of one header are one table."""
    w = W.partitionBy("doc").orderBy("pos")
    new = F.when(F.lower(F.lag("header").over(w)) == F.lower("header"), 0).otherwise(1)
    runs = df.withColumn("new", new).withColumn("table_no", F.sum("new").over(w))
    return runs.groupBy("doc", "table_no").agg(F.min_by("header", "pos").alias("header"), F.count("*").alias("segment_count"), F.sum("rows").alias("rows"), (F.count("*") > 1).alias("multi_page"))


def chart_pivot(points: DataFrame, series: list[str]) -> DataFrame:
    """Points (chart, pos, series, x, y) as rows of x with a column per series, x in order of first sight."""
    own = [F.first(F.when(F.col("series") == name, F.col("y")), ignorenulls=True).alias(name) for name in series]
    wide = points.groupBy("chart", "x").agg(*own, F.min("pos").alias("first"))
    return wide.withColumn("row", F.row_number().over(W.partitionBy("chart").orderBy("first"))).drop("first")


def local_context(blocks: DataFrame, before: int, after: int) -> DataFrame:
    """Text of the blocks around each one (id, pos, text)."""
    w = W.partitionBy("id").orderBy("pos")
    return blocks.withColumn("context_before", F.array_join(F.collect_list("text").over(w.rowsBetween(-before, -1)), " ")).withColumn("context_after", F.array_join(F.collect_list("text").over(w.rowsBetween(1, after)), " "))


REF = "array<struct<kind:string,target:string,label:string,title:string>>"
_AUTO = re.compile(r"<(https?://[^>]+)>")
_SOLID = re.compile(r"\S+")
_TAG = re.compile(r"<(img|a)\b([^>]*)>", re.I)
_END = re.compile(r"</a>", re.I)
_CLOSE = re.compile(r"(?:[^\\\]]|\\.)*\]", re.S)


class _Parentheses:
    """Where the parenthesis closes that opens before a place: not inside quotes or angle brackets, and not one that is escaped or opened inside; -1 where none does.

    Texts are read ahead as far as needed; once that has taken more steps than the text is long, all places are worked out from the right, so a text of
    nothing but openings takes time in proportion too.
    """

    def __init__(self, text: str):
        self.text, self.left, self.known = text, 4 * len(text) + 64, None

    def close(self, at: int) -> int:
        if self.known is None and self.left > 0:
            return self._ahead(at)
        if self.known is None:
            self.known = self._all()
        return self.known[min(at, len(self.text))]

    def _ahead(self, at: int) -> int:
        text, depth, inside, i = self.text, 0, "", at
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif inside:
                inside = "" if c == inside else inside
            elif c in "'\"<":
                inside = ">" if c == "<" else c
            elif c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            i += 1
        self.left -= i - at
        return i if i < len(text) else -1

    def _all(self) -> list[int]:
        text, n = self.text, len(self.text)
        found, after = [-1] * (n + 2), {q: -1 for q in "'\">"}
        later = dict(after)  # the same from one place further on
        for i in range(n - 1, -1, -1):
            c, j = text[i], -1
            if c == "\\":
                j = found[i + 2]
            elif c == ")":
                j = i
            elif c == "(":
                j = found[i + 1]
                j = found[j + 1] if j >= 0 else -1
            elif c in "'\"<":
                end = after[">" if c == "<" else c]
                j = found[end + 1] if end >= 0 else -1
            else:
                j = found[i + 1]
            found[i] = j
            here = later if c == "\\" else {**after, c: i} if c in after else after
            later, after = after, here
        return found


def _destination(raw: str) -> tuple[str, str]:
    raw = raw.strip()
    m = re.match(r"<([^>]*)>(.*)$", raw, re.S) or re.match(r"(\S*)(.*)$", raw, re.S)
    rest = m[2].strip()
    return m[1].strip(), rest[1:-1] if len(rest) > 1 and rest[0] in "'\"" and rest[-1] == rest[0] else ""


def asset_refs(text: str | None) -> list[tuple[str, str, str, str]]:
    """kind, target, label and title of inline links and images, autolinks, and the img and a elements of a Markdown text; each kind, target and label once."""
    text = text or ""
    out: dict[tuple[str, str, str], str] = {}
    parentheses, at = _Parentheses(text), 0
    end, last = -1, text.rfind("]")
    while 0 <= (opened := text.find("[", at)) < last:
        if end <= opened:  # the first end behind this opening, which later openings before it share
            found = _CLOSE.match(text, opened + 1)
            if not found:
                break
            end = found.end()
        at = end
        close = parentheses.close(at + 1) if text[at : at + 1] == "(" else -1
        if close >= 0:
            target, title = _destination(text[at + 1 : close])
            if target:
                out.setdefault(("image" if opened and text[opened - 1] == "!" else "link", target, text[opened + 1 : at - 1].strip()), title)
            at = close + 1
    for solid in _SOLID.finditer(text) if "<http" in text else ():
        for m in _AUTO.finditer(solid[0], 0, solid[0].rfind(">") + 1):
            out.setdefault(("link", m[1], ""), "")
    attribute = lambda tag, name: (m[1].strip() if (m := re.search(rf"\b{name}=[\"']([^\"']*)[\"']", tag, re.I)) else "")
    for wanted in ("img", "a"):
        stop = None
        for m in _TAG.finditer(text, 0, text.rfind(">") + 1):
            target = attribute(m[2], "src" if wanted == "img" else "href")
            if m[1].lower() != wanted or not target:
                continue
            if wanted == "a" and (stop is None or stop.start() < m.end()):
                stop = _END.search(text, m.end())
                if not stop:
                    break
            label = attribute(m[2], "alt") if wanted == "img" else re.sub(r"<[^>]+>", "", text[m.end() : stop.start()]).strip()
            out.setdefault(("html_image" if wanted == "img" else "html_link", target, label), attribute(m[2], "title"))
    return [(*k, t) for k, t in out.items()]


def assets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per reference of asset_refs: id, kind, target, label, title."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(n, T.StringType()) for n in ("kind", "target", "label", "title")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in enumerate(b.column(1)) for r in asset_refs(t.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, pa.string()) for c in columns[1:]]], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
