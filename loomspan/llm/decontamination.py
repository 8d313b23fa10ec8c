"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ten words (an item of fewer words is one window). A window is contained in a document
only if all its words are, so at a containment of 1 the necessary prefix of its words, in order of rarity in the documents, is
the rarest one. Documents are joined with windows on that word alone; the word's place in the window and
the window's length bound where it can lie; what is left is compared word for word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, arrow_batches, put_aside, take_back

WINDOW = 10
#: Words of benchmark items held by a task at a time; a larger benchmark is taken in blocks, each against all documents.
BLOCK_WORDS = 200_000
#: Digits, a-z and all bytes of characters beyond ASCII (fixed value).
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def windows(item: list[bytes], length: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    length = min(length, len(item))
    return [tuple(item[i : i + length]) for i in range(len(item) - length + 1)]


class Block:
    """The windows of some items, found by their rarest word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], frequency: dict[bytes, int], length: int):
        self.items: dict[tuple[bytes, ...], list[str | None]] = {}
        self.places: dict[bytes, set[tuple[int, int]]] = {}
        for name, item in items:
            for window in windows(item, length):
                owners = self.items.setdefault(window, [])
                if name not in owners:
                    owners.append(name)
        for window in self.items:
            at = min(range(len(window)), key=lambda i: (frequency.get(window[i], 0), window[i], i))
            if frequency.get(window[at], 0):
                self.places.setdefault(window[at], set()).add((at, len(window)))
        self.places = {word: sorted(found) for word, found in self.places.items()}

    def find(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Occurrences of windows (first word, word after the last), and the items they belong to."""
        places, items, spans, found = self.places, self.items, [], set()
        for i in [i for i, w in enumerate(doc) if w in places]:
            for at, length in places[doc[i]]:
                start = i - at
                if start >= 0 and start + length <= len(doc):
                    owners = items.get(tuple(doc[start : start + length]))
                    if owners is not None:
                        spans.append((start, start + length))
                        found.update(owners)
        return spans, found


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most limit words (or one item), read a partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        item = words(row[1])
        if not item:
            continue
        if block and size + len(item) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    if block:
        yield block


def _frequency(df: DataFrame, text_col: str, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the wanted words is. As many rows as wanted words come back at most."""
    held = df.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(held.value.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = df.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


FOUND = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, name: str = "found") -> DataFrame:
    """df with a column name (in place of one that has it): struct(n_words, spans of hit words [start, stop), item ids as strings, sorted).

    Null and empty texts have no words and are never hit; items without words have no windows. Repeated items count once;
    an item without an id hits words and is listed as null. Repeated documents get equal results. Every block of the benchmark is a pass over the documents,
    and the words' rarities are counted over all documents.
    """
    spark = df.sparkSession
    df = df.drop(name)
    scratch = Scratch(spark, "decontamination")
    arrow_batches(spark, 500)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(FOUND))])
    place, k = df.columns.index(text_col), 0
    result = None
    for k, items in enumerate(_blocks(benchmark, item_id, item_text, block_words)):
        frequency = _frequency(df, text_col, {w for _, item in items for w in item})
        held = spark.sparkContext.broadcast(Block(items, frequency, window))
        source = df if result is None else scratch.write(result, f"block-{k}")
        result = source.mapInArrow(_search(held, place, result is None), schema)
    if result is None:
        result = df.mapInArrow(_search(None, place, True), schema)
    return result


def _search(held, place: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
        block = held.value if held is not None else None
        for b in batches:
            old = None if first else b.column(b.num_columns - 1).to_pylist()
            out = []
            for i, t in enumerate(b.column(place)):
                doc = words(t.as_py())
                spans, items = block.find(doc) if block else ([], set())
                if old:
                    spans += [(s["start"], s["stop"]) for s in old[i]["spans"]]
                    items |= set(old[i]["items"])
                out.append({"n_words": len(doc), "spans": [{"start": s, "stop": e} for s, e in _joined(spans)], "items": sorted(items, key=lambda x: (x is None, x))})
            columns = b.columns if first else b.columns[:-1]
            names = [f"c{i}" for i in range(len(columns) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names)

    return run


def report(found: DataFrame, name: str = "found") -> DataFrame:
    """Replaces the struct, and columns that have these names, by n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate(F.col(f"{name}.spans"), F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    added = (name, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c not in added], F.col(f"{name}.n_words").alias("n_words"), hit.alias("n_hit"), F.size(f"{name}.items").cast("long").alias("n_items"), F.sha2(F.array_join(f"{name}.items", ",", "").cast("binary"), 256).alias("items_sha256"), (F.size(f"{name}.spans") > 0).alias("contaminated"))


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of df in which no window of the benchmark occurs; texts stay where they are read.

    Null and empty texts stay, however long texts are read whole, repeated rows go or stay alike, and df's columns stay as they are, whatever their names.
    """
    found = contamination(put_aside(df), benchmark, f"own_{text_col}", name="found", **options)
    return found.where(F.size("found.spans") == 0).select(*take_back(found, df.columns))


SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from ({rows})),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
starts as (select item_id, w, least(len(w), 10) as l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from items where len(w) > 0),
wins as (select distinct item_id, l, array_to_string(w[s:s + l - 1], ' ') as gram from starts),
lens as (select distinct l from wins),
places as (select rid, w, l, unnest(range(1, len(w) - l + 2)) as s from docs cross join lens where len(w) >= l),
grams as (select rid, l, s, array_to_string(w[s:s + l - 1], ' ') as gram from places),
found as (select g.rid, g.s, g.l, i.item_id from grams g join wins i on g.gram = i.gram and g.l = i.l),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + l)) as p from found) group by rid),
named as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct rid, item_id from found) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
  sha256(coalesce(n.ids, '')) as items_sha256, h.n_hit is not null as contaminated
from docs d left join hits h using (rid) left join named n using (rid)
"""
