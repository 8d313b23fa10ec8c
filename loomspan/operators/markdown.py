"""Markdown structure: a line scanner that yields blocks, and a chunker that splits and packs them.

A document is scanned once. Blocks keep their span in the source, their heading path and the pages named by
page-marker comments. Blocks over the budget are split by rules of their kind, then pieces are packed in order. Documents are
independent, so they are scanned where they are read; everything that follows from a chunk's text is a Spark column.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import scalars as S
from loomspan.session import PIECE, ROWS, arrow_batches

MAX_CHARS, OVERLAP, LEAST_CHARS, LEAST_TOKENS = 1800, 160, 200, 16
#: HTML elements that begin a block (fixed values).
BLOCK_TAGS = "address article aside blockquote canvas details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul video".split()
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
PAGES = re.compile(r"\s*<!--\s*pages?:\s*([0-9,\s-]+?)\s*-->\s*$", re.I)
SEPARATOR = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")
LIST = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
QUOTE = re.compile(r" {0,3}>")
INDENTED = re.compile(r"(?: {4}|\t)\s*\S")
HTML = re.compile(r" {0,3}<(?:!--|!\[CDATA\[|\?|/?(" + "|".join(BLOCK_TAGS) + r")(?=[\s/>]|$))", re.I)
LINE_ENDS = "\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SENTENCE = re.compile(r"(?<=[.!?])\s+")
ASSET = re.compile(r"(!?)\[([^\]\n]*)\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)")


@dataclass(frozen=True)
class Block:
    kind: str
    text: str
    start: int
    stop: int
    path: tuple[str, ...] = ()
    pages: tuple[int, ...] = ()
    alone: bool = False


def page_numbers(spec: str) -> tuple[int, ...]:
    """Pages of a marker like 1-3,5; a range written backwards is turned round."""
    found: set[int] = set()
    for part in spec.split(","):
        ends = [int(v) for v in re.findall(r"\d+", part)]
        if len(ends) == 2:
            found.update(range(min(ends), max(ends) + 1))
        else:
            found.update(ends)
    return tuple(sorted(p for p in found if p > 0))


class _Scanner:
    def __init__(self, text: str):
        self.text = text
        self.lines: list[tuple[int, int]] = []
        at = 0
        for line in text.splitlines(keepends=True):
            self.lines.append((at, at + len(line.rstrip(LINE_ENDS))))
            at += len(line)
        self.path: list[tuple[int, str]] = []
        self.pages: tuple[int, ...] = ()
        self.blocks: list[Block] = []

    def line(self, i: int) -> str:
        a, b = self.lines[i]
        return self.text[a:b]

    def put(self, kind: str, first: int, last: int) -> None:
        start, stop = self.lines[first][0], self.lines[last][1]
        own = self.text[start:stop]
        kept = own.rstrip() if kind in ("quote", "fence", "indented", "list", "table") else own.strip()
        if not kept.strip():
            return
        start += len(own) - len(own.lstrip()) if kept == own.strip() and kind not in ("quote", "fence", "indented", "list", "table") else 0
        self.blocks.append(Block(kind, kept, start, start + len(kept), tuple(t for _, t in self.path), self.pages))

    def heading(self, level: int, title: str, first: int, last: int) -> None:
        while self.path and self.path[-1][0] >= level:
            self.path.pop()
        self.path.append((level, title.strip()))
        self.put("heading", first, last)

    def run(self) -> list[Block]:
        i, n, held = 0, len(self.lines), -1

        def flush(upto: int) -> None:
            nonlocal held
            if held >= 0:
                self.put("text", held, upto - 1)
            held = -1

        if n and self.line(0).strip() == "---":
            end = next((k for k in range(1, n) if self.line(k).strip() in ("---", "...")), 0)
            if end:
                self.put("front_matter", 0, end)
                i = end + 1
        while i < n:
            line = self.line(i)
            if m := PAGES.match(line):
                flush(i)
                self.pages = page_numbers(m[1])
                i += 1
            elif m := HEADING.match(line):
                flush(i)
                self.heading(len(m[1]), m[2] or "", i, i)
                i += 1
            elif held == i - 1 and held >= 0 and (m := UNDERLINE.match(line)):
                title, held = self.line(held), -1
                self.heading(1 if m[1][0] == "=" else 2, title, i - 1, i)
                i += 1
            elif m := FENCE.match(line):
                flush(i)
                mark = m[1]
                end = next((k for k in range(i + 1, n) if re.fullmatch(r" {0,3}" + re.escape(mark[0]) + "{" + str(len(mark)) + r",}\s*", self.line(k))), n - 1)
                self.put("fence", i, end)
                i = end + 1
            elif m := HTML.match(line):
                flush(i)
                close = "-->" if "<!--" in m[0] else "]]>" if "CDATA" in m[0] else re.escape("?>") if "<?" in m[0] else rf"</{m[1]}\s*>"
                # An empty element is a block by itself.
                empty = bool(m[1]) and (m[1].lower() == "hr" or line.rstrip().endswith("/>"))
                end = i if empty else next((k for k in range(i, n) if re.search(close, self.line(k), re.I)), n - 1)
                self.put("html", i, end)
                i = end + 1
            elif "|" in line and i + 1 < n and "|" in self.line(i + 1) and SEPARATOR.match(self.line(i + 1)):
                flush(i)
                end = self._while(i + 2, lambda x: "|" in x and bool(x.strip()))
                self.put("table", i, end)
                i = end + 1
            elif QUOTE.match(line):
                flush(i)
                end = self._while(i + 1, lambda x: bool(QUOTE.match(x)))
                self.put("quote", i, end)
                i = end + 1
            elif held < 0 and INDENTED.match(line):
                end = self._while(i + 1, lambda x: bool(INDENTED.match(x)))
                self.put("indented", i, end)
                i = end + 1
            elif LIST.match(line):
                flush(i)
                end = self._while(i + 1, lambda x: bool(LIST.match(x)) or bool(re.match(r"\s+\S", x)))
                self.put("list", i, end)
                i = end + 1
            elif not line.strip():
                flush(i)
                i += 1
            else:
                held = i if held < 0 else held
                i += 1
        flush(n)
        return self.blocks

    def _while(self, at: int, fits: Callable[[str], bool]) -> int:
        while at < len(self.lines) and fits(self.line(at)):
            at += 1
        return at - 1


def blocks(text: str) -> list[Block]:
    return _Scanner(text).run()


class Budget:
    def __init__(self, chars: int, tokens: int | None = None, count: Callable[[str], int] | None = None):
        self.chars, self.tokens = chars, tokens
        self.count = count or (lambda t: max(1, (len(t) + 3) // 4))

    def over(self, text: str) -> bool:
        return len(text) > self.chars or self.tokens is not None and self.count(text) > self.tokens

    def less(self, text: str) -> Budget:
        return Budget(self.chars - len(text) - 2, None if self.tokens is None else self.tokens - self.count(text + "\n\n"), self.count)

    def cut(self, text: str) -> tuple[str, str]:
        """The longest beginning that fits, up to a space in its second half where there is one, and the rest."""
        if not self.over(text):
            return text, ""
        size = min(len(text), max(1, self.chars))
        if self.tokens is not None and self.count(text[:size]) > self.tokens:
            lo, hi = 1, size
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if self.count(text[:mid]) <= self.tokens else (lo, mid - 1)
            size = lo
        at = text.rfind(" ", 0, size + 1)
        at = size if at < max(1, size // 2) else at
        head = text[:at].rstrip()
        return (head, text[at:].lstrip()) if head else (text[:1], text[1:].lstrip())


def _piece(block: Block, text: str, start: int) -> Block:
    return replace(block, text=text, start=start, stop=min(block.stop, start + len(text)), alone=True)


def _prose(block: Block, budget: Budget, overlap: int) -> list[Block]:
    texts, now = [], ""
    for sentence in SENTENCE.split(block.text):
        if not sentence:
            continue
        joined = f"{now} {sentence}" if now else sentence
        if now and budget.over(joined):
            texts.append(now)
            carried = now[-overlap:].strip() if overlap else ""
            joined = f"{carried} {sentence}" if carried else sentence
        now = joined
        while budget.over(now):
            head, tail = budget.cut(now)
            texts.append(head)
            carried = head[-overlap:].strip() if overlap and budget.tokens is None else ""
            now = f"{carried} {tail}".strip() if carried else tail
    if now:
        texts.append(now)
    # Sentences are joined by one space whatever stood between them.
    flat = re.sub(r"\s", " ", block.text)
    out, at = [], 0
    for text in texts:
        found = flat.find(re.sub(r"\s", " ", text), max(0, at - overlap - 1))
        found = at if found < 0 else found
        out.append(_piece(block, text, block.start + found))
        at = found + len(text)
    return out


def _by_lines(block: Block, budget: Budget, head: str = "", foot: str = "", skip: int = 0, drop: int = 0) -> list[Block]:
    """Whole lines, as many as fit between head and foot; a line that alone is too long is cut in characters.

    Where head and foot leave no room, all lines are cut without them.
    """
    lines = block.text.split("\n")
    if (head or foot) and budget.over(f"{head}x{foot}"):
        head, foot, skip, drop = "", "", 0, 0
    at = block.start + sum(len(x) + 1 for x in lines[:skip])
    lines = lines[skip : len(lines) - drop]
    room = max(1, budget.chars - len(head) - len(foot))
    fits = lambda body: not budget.over(f"{head}{body}{foot}")
    out: list[Block] = []
    held, start = "", at

    def send() -> None:
        nonlocal held
        if held.strip():
            out.append(replace(block, text=f"{head}{held}{foot}", start=start, stop=start + len(held), alone=True))
        held = ""

    for line in lines:
        if held and not fits(f"{held}\n{line}"):
            send()
        if not held:
            start = at
        if not fits(line):
            k = 0
            while k < len(line):
                lo, size = 1, min(room, len(line) - k)
                while lo < size and not fits(line[k : k + size]):
                    mid = (lo + size) // 2
                    lo, size = (mid + 1, size) if fits(line[k : k + mid + 1]) else (lo, mid)
                start, held = at + k, line[k : k + size].strip()
                send()
                k += size
        else:
            held = f"{held}\n{line}" if held else line
        at += len(line) + 1
    send()
    return out


def split(block: Block, budget: Budget, overlap: int) -> list[Block]:
    if not budget.over(block.text):
        return [block]
    lines = block.text.split("\n")
    if block.kind == "table":
        return _by_lines(block, budget, head="\n".join(lines[:2]) + "\n", skip=2)
    if block.kind == "fence":
        mark = FENCE.match(lines[0])[1]
        closed = len(lines) > 1 and lines[-1].strip().startswith(mark)
        return _by_lines(block, budget, head=lines[0] + "\n", foot="\n" + mark, skip=1, drop=int(closed))
    if block.kind in ("quote", "front_matter", "html", "indented", "list"):
        return _by_lines(block, budget)
    return _prose(block, budget, overlap)


def _common(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    out = []
    for parts in zip(*paths, strict=False):
        if len(set(parts)) > 1:
            break
        out.append(parts[0])
    return tuple(out)


def _merged(held: list[Block]) -> Block:
    return Block(held[0].kind if len(held) == 1 else "mixed", "\n\n".join(b.text for b in held).strip(), held[0].start, held[-1].stop, _common([b.path for b in held]), tuple(sorted({p for b in held for p in b.pages})), False)


def pack(pieces: list[Block], budget: Budget) -> list[tuple[Block, tuple[str, ...]]]:
    """Chunks, and the kinds of the blocks in each. A chunk ends before a heading, at a change of pages, around pieces of split
    blocks, after a table or fence, and where the budget is full; a heading takes the beginning of its text with it."""
    out: list[tuple[Block, tuple[str, ...]]] = []
    held: list[Block] = []
    size = 0

    def over(text: str) -> bool:
        return size + len(text) > budget.chars or budget.tokens is not None and budget.over("\n\n".join([*(x.text for x in held), text]))

    def flush() -> None:
        nonlocal size
        if held and (made := _merged(held)).text:
            out.append((made, tuple(dict.fromkeys(b.kind for b in held))))
        held.clear()
        size = 0

    waiting = list(reversed(pieces))
    while waiting:
        b = waiting.pop()
        title = len(held) == 1 and held[0].kind == "heading"
        if held and (b.kind == "heading" or b.pages != held[-1].pages or b.alone and not title):
            flush()
            title = False
        if held and over(b.text):
            room = budget.less(held[0].text)
            if title and b.kind == "text" and room.chars > 0 and (room.tokens is None or room.tokens > 0):
                head, tail = room.cut(b.text)
                if not over(head):
                    held.append(_piece(b, head, b.start))
                    if tail.strip() and not (b.alone and waiting and tail in waiting[-1].text):
                        waiting.append(_piece(b, tail, b.start + max(0, b.text.find(tail, len(head)))))
                    flush()
                    continue
            flush()
        held.append(b)
        size += len(b.text) + 2
        if b.kind in ("fence", "table") or b.alone:
            flush()
    flush()
    return out


def chunk(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, max_tokens: int | None = None, count: Callable[[str], int] | None = None) -> list[dict]:
    """Chunks of one Markdown text as rows of CHUNK."""
    text = text or ""
    max_chars = max(LEAST_CHARS, max_chars)
    overlap = max(0, min(overlap, max_chars // 3))
    budget = Budget(max_chars, None if max_tokens is None else max(LEAST_TOKENS, max_tokens), count)
    pieces = [p for b in blocks(text) for p in split(b, budget, overlap)]
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    if len(starts) > 1 and text[-1] not in LINE_ENDS:
        starts.pop()
    out = []
    for i, (b, kinds) in enumerate(pack(pieces, budget)):
        assets = [f"{'image' if m[1] else 'link'}:{m[3]}" for m in ASSET.finditer(b.text)]
        out.append({"index": i, "text": b.text, "kind": b.kind, "heading_path": list(b.path), "char_start": b.start, "char_end": b.stop, "start_line": bisect_right(starts, b.start), "end_line": bisect_right(starts, max(b.start, b.stop - 1)), "pages": list(b.pages), "content_types": list(kinds), "assets": list(dict.fromkeys(assets))})
    return out


CHUNK = "index bigint, text string, kind string, heading_path array<string>, char_start bigint, char_end bigint, start_line bigint, end_line bigint, pages array<int>, content_types array<string>, assets array<string>"
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def chunks(df: DataFrame, id_col: str, text_col: str, name_col: str, **options) -> DataFrame:
    """A row per chunk: id, the columns of CHUNK, and ids, hashes, token estimate and contextual text derived from them."""
    spec = [c.rsplit(" ", 1) for c in CHUNK.split(", ")]
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("name", T.StringType()), T.StructField("source_sha256", T.StringType()), *T._parse_datatype_string(CHUNK).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, size = [], [], 0
            for i, t in enumerate(b.column(3), 1):
                own = chunk(t.as_py(), **options)
                at += [i - 1] * len(own)
                rows += own
                size += sum(len(r["text"]) for r in own)
                if size >= PIECE or i == len(b):
                    taken = [c.take(pa.array(at, pa.int64())) for c in b.columns[:3]]
                    yield pa.RecordBatch.from_arrays([*taken, *[pa.array([r[n] for r in rows], _KINDS[k]) for n, k in spec]], schema.names)
                    at, rows, size = [], [], 0

    arrow_batches(df.sparkSession, ROWS)
    out = df.select(F.col(id_col).alias("id"), F.col(name_col).cast("string").alias("name"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("source_sha256"), text_col).mapInArrow(run, schema)
    lines, chars = F.concat_ws("-", "start_line", "end_line"), F.concat_ws("-", "char_start", "char_end")
    path = F.array_join("heading_path", " > ")
    return out.select("*", S.chunk_id(F.col("name"), F.col("index"), F.col("text")).alias("chunk_id"), S.stable_id(F.col("source_sha256"), lines, chars, F.col("text")).alias("stable_id"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), F.length("text").cast("long").alias("char_count"), S.token_estimate(F.col("text")).alias("token_estimate"), F.when(path == "", F.col("text")).otherwise(F.concat(path, F.lit("\n\n"), F.col("text"))).alias("contextual_text"))


def with_neighbours(df: DataFrame, id_col: str = "id", order_col: str = "index", own: str = "chunk_id") -> DataFrame:
    w = W.partitionBy(id_col).orderBy(order_col)
    return df.withColumn("previous_id", F.lag(own).over(w)).withColumn("next_id", F.lead(own).over(w))


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 1), line, and its span in characters."""
    each = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    end = F.sum(F.length("line") + 1).over(W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)) - 1
    return each.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.length("line")).select("id", F.col("line_no").cast("long").alias("line_no"), "line", "char_start", "char_end")


def line_kinds(rows: DataFrame) -> DataFrame:
    """Adds kind to lines (id, line_no, line), by the patterns of the scanner: heading, table_start, quote, list, indented or text."""
    line = F.col("line")
    follows = F.lead("line").over(W.partitionBy("id").orderBy("line_no"))
    begins = lambda p: line.rlike("^" + p.pattern)
    table = line.contains("|") & F.coalesce(follows.contains("|") & follows.rlike("^" + SEPARATOR.pattern), F.lit(False))
    return rows.withColumn("kind", F.when(line.rlike("^#{1,6} "), "heading").when(table, "table_start").when(begins(QUOTE), "quote").when(begins(LIST), "list").when(begins(INDENTED), "indented").otherwise("text"))


def heading_paths(rows: DataFrame) -> DataFrame:
    """Adds heading_path to lines: the last heading of each level that no later heading of a lower level ended."""
    w = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("level", F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)))
    parts = []
    for n in range(1, 7):
        last = F.max(F.when(F.col("level") == n, F.col("line_no"))).over(w)
        over = F.max(F.when((F.col("level") > 0) & (F.col("level") < n), F.col("line_no"))).over(w) if n > 1 else F.lit(0)
        title = F.max_by(F.when(F.col("level") == n, F.regexp_replace("line", "^#{1,6} +", "")), F.when(F.col("level") == n, F.col("line_no"))).over(w)
        out = out.withColumn(f"_h{n}", F.when(last > F.coalesce(over, F.lit(0)), title))
        parts.append(f"_h{n}")
    return out.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop("level", *parts)


def carried_pages(rows: DataFrame) -> DataFrame:
    """Adds pages: the last page marker at or before a line."""
    w = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    mark = F.regexp_extract("line", r"^<!-- pages: ([0-9,-]+) -->$", 1)
    return rows.withColumn("pages", F.last(F.when(mark != "", mark), ignorenulls=True).over(w))
