"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Suffixes are sampled: of the ``KEY``-byte strings inside a window of ``LENGTH`` bytes the one of least hash is the window's anchor, so
equal windows have their anchor at the same place and only suffixes that start at anchors (one in 76 bytes) are indexed.
A suffix array here is a table of such suffixes in order of the fingerprint of their first KEY
bytes and then of the fingerprint of the whole neighbourhood that the anchor's windows cover; the order serves only to bring
equal suffixes together, so fingerprints of 64 bits each stand for the strings.

Documents come in batches. Each gets its suffix array, which is merge-scanned against the existing levels; then levels of
equal size are merged, so a suffix is rewritten a logarithmic number of times. The levels are tables of a folder, with a list of
them beside, and can be opened again for a later batch. A scan tells which anchors have an
equal neighbourhood elsewhere (all their windows repeat) and which share a key with another neighbourhood;
for the latter the windows themselves are compared: byte by byte where their hashes agree, or, for keys that more than NEIGHBOURS
neighbourhoods share, by 128-bit BLAKE2 digests of their bytes, dealt out to all tasks. Keys that very many suffixes
share are not scanned in one task but counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, arrow_batches, partitions
from loomspan.llm.hashing import mix64

LENGTH = 200
KEY = 50
BATCHES = 4
#: Rows of one key that a scan holds; the rest of a larger group is judged against what went before.
HELD = 200_000
#: Neighbourhoods of one key whose windows are compared in one task; windows of more are dealt out by their digest.
NEIGHBOURS = 50_000
_SPREAD = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
INDEX = "key bigint, full bigint, t1 bigint, t2 bigint, place bigint"


class _Powers:
    """Powers of the hash's base and of its inverse, as far as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_P, m, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(_P_INVERSE, m, 1 << 64))))


_POWERS = _Powers()


def _sums(data: np.ndarray) -> np.ndarray:
    _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SPREAD[data] * _POWERS.down[: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    """Fingerprints of the strings from start to stop, which do not depend on where they lie."""
    return mix64((sums[stop] - sums[start]) * _POWERS.up[start])


def _window_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    n = len(sums) - 1
    return _hashes(sums, slice(0, n - length + 1), slice(length, n + 1))


def anchors(data: np.ndarray, length: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: fingerprint of its key, of its neighbourhood, first and last window start."""
    sums = _sums(data)
    best = _window_hashes(sums, key)
    found, at, width, span = best, np.arange(len(best), dtype=np.int32), 1, length - key + 1
    while width < span:
        step = min(width, span - width)
        left, right = found[: len(found) - step], found[step:]
        less = right < left
        at = np.where(less, at[step:], at[: len(at) - step])
        found = np.where(less, right, left)
        width += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    around = _hashes(sums, first, last + length)
    shape = (place - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
    return best[place], mix64(around ^ mix64(shape + np.uint64(1))), first, last


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    said = F.coalesce(text, F.lit(""))
    return [F.xxhash64(said).alias("t1"), F.xxhash64(F.lit(7), said).alias("t2")]


def _index_rows(texts: DataFrame, length: int, key: int) -> DataFrame:
    """INDEX rows of a table of t1, t2, text; copies of a text within a task are indexed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            rows = [[], [], [], [], []]
            for t1, t2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                data = np.frombuffer(_bytes(text.as_py()), np.uint8)
                if len(data) < length:
                    continue
                k, full, lo, hi = anchors(data, length, key)
                for to, v in zip(rows, (k.view(np.int64), full.view(np.int64), np.full(len(k), t1), np.full(len(k), t2), (lo << 16) | (hi - lo)), strict=True):
                    to.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r).astype(np.int64)) for r in rows], ["key", "full", "t1", "t2", "place"])

    return texts.where(F.octet_length("text") >= length).select("t1", "t2", "text").mapInArrow(run, INDEX)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of INDEX with a mark on those of the new batch: yields the rows that have a match that the batch takes part in.

    repeated: the same neighbourhood is elsewhere too. lead: first row of a neighbourhood whose key has others.
    """

    def judge(rows: list[np.ndarray], before: tuple | None, then: tuple | None) -> tuple[pa.RecordBatch | None, tuple | None]:
        key, full, t1, t2, place, new = rows
        n = len(key)
        if not n:
            return None, before
        same_key = np.concatenate(([before is not None and before[0] == key[0]], key[1:] == key[:-1]))
        same_full = same_key & np.concatenate(([before is not None and before[1] == full[0]], full[1:] == full[:-1]))
        after = np.append(same_full[1:], then == (key[-1], full[-1]))
        group = np.cumsum(np.concatenate(([False], ~same_key[1:])))
        first = np.flatnonzero(np.concatenate(([True], ~same_key[1:])))
        fresh = np.logical_or.reduceat(new, first)
        classes = np.add.reduceat((~same_full).astype(np.int64), first)
        if same_key[0]:
            fresh[0], classes[0] = True, 2  # what went before is not known: judge the group in full
        if then is not None:
            fresh[-1], classes[-1] = True, 2
        fresh, many = fresh[group], (classes > 1)[group]
        repeated, lead = same_full | after, many & ~same_full
        out = np.flatnonzero(fresh & (repeated | lead))
        batch = pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (key, full, t1, t2, place, repeated, lead)], ["key", "full", "t1", "t2", "place", "repeated", "lead"]) if len(out) else None
        return batch, (key[-1], full[-1])

    held: list[np.ndarray] | None = None
    before = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if held is not None:
            now = [np.concatenate(p) for p in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        # Copies of one text, indexed by several tasks, count as one.
        twin = np.concatenate(([False], np.logical_and.reduce([c[1:] == c[:-1] for c in now[:5]])))
        if twin.any():
            new = np.logical_or.reduceat(now[5], np.flatnonzero(~twin))
            now = [c[~twin] for c in now[:5]] + [new]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if len(now[0]) - cut > HELD:
            # The very last row stays, so that its copies are seen.
            batch, before = judge([c[:-1] for c in now], before, (now[0][-1], now[1][-1]))
            held = [c[-1:] for c in now]
        else:
            batch, end = judge([c[:cut] for c in now], before, None)
            before = end if cut else before
            held = [c[cut:] for c in now]
        if batch is not None:
            yield batch
    if held is not None:
        batch, _ = judge(held, before, None)
        if batch is not None:
            yield batch


HITS = INDEX + ", repeated boolean, lead boolean"


def _crowded(rows: DataFrame, held: int) -> DataFrame:
    """Keys that seem to have more than held rows, by a sample; at most a few for each `held` rows of the table."""
    part = 64 / held
    return rows.sample(part, seed=7).groupBy("key").count().where(F.col("count") > 32).select("key") if part < 1 else rows.groupBy("key").count().where(F.col("count") > held).select("key")


def _counted(rows: DataFrame) -> DataFrame:
    """HITS of crowded keys: neighbourhoods are counted before they are shuffled, and the counts joined with the rows, a join that Spark splits where a key is common."""
    single = rows.groupBy("key", "full", "t1", "t2", "place").agg(F.max("new").alias("new"))
    classes = single.groupBy("key", "full").agg(F.count("*").alias("n"), F.max("new").alias("any_new"), F.min(F.struct("t1", "t2", "place")).alias("first"))
    keys = classes.groupBy("key").agg(F.count("*").alias("classes"), F.max("any_new").alias("fresh"))
    classes = classes.join(keys, "key").where("fresh and (n > 1 or classes > 1)")
    out = single.join(classes, ["key", "full"])
    lead = (F.col("classes") > 1) & (F.struct("t1", "t2", "place") == F.col("first"))
    return out.select("key", "full", "t1", "t2", "place", (F.col("n") > 1).alias("repeated"), lead.alias("lead")).where("repeated or lead")


class SuffixIndex:
    """Levels of suffix arrays, each a table in the shared folder with twice the batches of the one before.

    The list of levels is a small table of the folder, written anew after each batch, from which open takes the index up again. An
    index that is to outlive the application needs a Scratch with keep.
    """

    LEVELS = "number bigint, rank bigint, name string"

    def __init__(self, spark: SparkSession, scratch: Scratch, held: int = HELD):
        self.spark, self.scratch, self.held = spark, scratch, held
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.count = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> SuffixIndex:
        """The index whose folder (scratch.root) this is, as its last batch left it."""
        scratch = Scratch(spark, "suffixes", keep=True)
        scratch.root = root
        out = cls(spark, scratch)
        numbers = [r["number"] for r in spark.read.schema("number bigint").parquet(scratch.path("levels")).distinct().collect()]
        out.count = max(numbers)
        rows = spark.read.schema(cls.LEVELS).parquet(f"{scratch.path('levels')}/number={out.count}").where("name is not null").orderBy(F.desc("rank")).collect()
        out.levels = [(r["rank"], r["name"], spark.read.schema(INDEX).parquet(scratch.path(r["name"]))) for r in rows]
        return out

    def _save(self) -> None:
        rows = [(self.count, rank, name) for rank, name, _ in self.levels] or [(self.count, None, None)]
        self.spark.createDataFrame(rows, self.LEVELS).coalesce(1).write.mode("overwrite").parquet(f"{self.scratch.path('levels')}/number={self.count}")

    def add(self, rows: DataFrame, last: bool = False) -> DataFrame:
        """Scans a batch (INDEX rows) against itself and all levels, returns the matches of both sides, and takes the batch in.

        last: no other batch follows, so levels need not be merged or kept.
        """
        self.count += 1
        name = f"level-{self.count}"
        both = rows.withColumn("new", F.lit(True))
        for _, _, level in self.levels:
            both = both.union(level.withColumn("new", F.lit(False)))
        crowded = self.scratch.write(_crowded(both, self.held), f"crowded-{self.count}")
        usual = both if crowded.isEmpty() else both.join(F.broadcast(crowded), "key", "left_anti")
        usual = usual.repartition(partitions(self.spark), "key").sortWithinPartitions("key", "full", "t1", "t2", "place").mapInArrow(_scan, HITS)
        if not crowded.isEmpty():
            usual = usual.union(_counted(both.join(F.broadcast(crowded), "key", "left_semi")))
        hits = self.scratch.write(usual, f"hits-{self.count}")
        del both, usual
        self.scratch.release()
        if last:
            return hits
        rank, merged, gone = 0, rows, []
        while self.levels and self.levels[-1][0] == rank:
            _, old, level = self.levels.pop()
            merged, rank = merged.union(level), rank + 1
            gone.append(old)
        merged = merged.repartition(partitions(self.spark), "key").sortWithinPartitions("key", "full", "t1", "t2", "place")
        self.levels.append((rank, name, self.scratch.write(merged, name)))
        self._save()
        del merged
        for old in gone:
            self.scratch.drop(old)
        self.scratch.release()
        return hits


def _neighbourhoods(length: int):
    """From text and the list of its leads: a row per lead with the bytes its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for t1, t2, text, leads in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                data = _bytes(text.as_py())
                for x in leads.as_py():
                    lo, wide = x["place"] >> 16, x["place"] & 0xFFFF
                    for to, v in zip(out, (x["key"], x["full"], t1, t2, lo, x["repeated"], data[lo : lo + wide + length]), strict=True):
                        to.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:5]], pa.array(out[5], pa.bool_()), pa.array(out[6], pa.binary())], ["key", "full", "t1", "t2", "lo", "repeated", "data"])

    return run


NEAR = "key bigint, full bigint, t1 bigint, t2 bigint, lo bigint, repeated boolean, data binary"


def _hash_rows(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of all strings in turn, and the row of each."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data])
    sums = _sums(joined)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(data)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.cumsum(sizes) - sizes, counts)
    return _hashes(sums, start, start + length), row


def _runs(flags: np.ndarray, row: np.ndarray, first: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and stops of the bytes covered by runs of flagged windows; first: number of each row's first window."""
    at = np.flatnonzero(flags)
    begin = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    end = np.append(begin[1:], True)
    rows = row[at[begin]]
    return rows, lo[rows] + at[begin] - first[rows], lo[rows] + at[end] - first[rows] + length


def _same_bytes(rows: list[tuple], row: np.ndarray, one: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows of two lists (numbers as in _hash_rows) are the same bytes."""
    joined = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    # Each row before takes length - 1 more bytes than it has windows.
    start = np.arange(len(row)) + (length - 1) * row
    windows = np.lib.stride_tricks.sliding_window_view(joined, length)
    return np.concatenate([(windows[start[one[i : i + 20_000]]] == windows[start[other[i : i + 20_000]]]).all(1) for i in range(0, len(one), 20_000)] or [np.zeros(0, bool)])


def _compare(length: int):
    """Neighbourhoods in order of key: yields the byte runs covered by windows that another neighbourhood of the key has too."""

    def judge(rows: list[tuple]) -> pa.RecordBatch | None:
        if not rows:
            return None
        key = np.array([r[0] for r in rows], np.int64)
        hashes, row = _hash_rows([r[6] for r in rows], length)
        marked = hashes ^ mix64(key.view(np.uint64))[row]
        order = np.argsort(marked, kind="stable")
        same = marked[order[1:]] == marked[order[:-1]]
        same[same] = _same_bytes(rows, row, order[1:][same], order[:-1][same], length)
        twice = np.zeros(len(marked), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        once = ~np.array([r[5] for r in rows], bool)
        twice &= once[row]
        if not twice.any():
            return None
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(rows)))[:-1]))
        which, start, stop = _runs(twice, row, first, np.array([r[4] for r in rows], np.int64), length)
        t1, t2 = np.array([r[2] for r in rows], np.int64)[which], np.array([r[3] for r in rows], np.int64)[which]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (t1, t2, start.astype(np.int64), stop.astype(np.int64))], ["t1", "t2", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += list(zip(*(b.column(i).to_pylist() for i in range(7)), strict=True))
            if len(held) < 2000:
                continue
            cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
            batch = judge(held[:cut])
            held = held[cut:]
            if batch is not None:
                yield batch
        batch = judge(held)
        if batch is not None:
            yield batch

    return run


MARKS = "t1 bigint, t2 bigint, start bigint, stop bigint"


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t1, t2, lo, repeated, data in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                n = len(data) - length + 1
                if n > 0:
                    digests = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                    same = lambda v, kind, n=n: pa.array(np.full(n, v, kind))
                    yield pa.RecordBatch.from_arrays([same(key, np.int64), pa.array(digests, pa.binary()), same(t1, np.int64), same(t2, np.int64), pa.array(np.arange(lo, lo + n)), same(repeated, bool)], ["key", "window", "t1", "t2", "start", "repeated"])

    return run


def _busy_marks(near: DataFrame, busy: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many neighbourhoods: windows are rows and are counted by a cryptographic digest of their bytes, which stands for these."""
    rows = near.join(busy, "key", "left_semi").mapInArrow(_window_rows(length), "key bigint, window binary, t1 bigint, t2 bigint, start bigint, repeated boolean")
    twice = rows.groupBy("key", "window").agg(F.count("*").alias("n")).where("n > 1").select("key", "window")
    return rows.where("not repeated").join(twice, ["key", "window"], "left_semi").select("t1", "t2", "start", (F.col("start") + length).alias("stop"))


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(*text_key(F.col("text")), "text")


def _marks(texts: DataFrame, found: DataFrame, scratch: Scratch, length: int, neighbours: int) -> DataFrame:
    """MARKS of the matches that scans found; texts: all texts they come from."""
    spark = scratch.spark
    leads = found.groupBy("key", "full").agg(F.max("repeated").alias("repeated"), F.max("lead").alias("lead"), F.min(F.struct("t1", "t2", "place")).alias("at"))
    leads = leads.where("lead").groupBy("at.t1", "at.t2").agg(F.collect_list(F.struct("key", "full", F.col("at.place").alias("place"), "repeated")).alias("leads"))
    arrow_batches(spark, 500)
    near = texts.where(F.octet_length("text") >= length).join(leads, ["t1", "t2"]).select("t1", "t2", "text", "leads").mapInArrow(_neighbourhoods(length), NEAR)
    near = scratch.write(near.dropDuplicates(["key", "full"]), "neighbourhoods")
    scratch.release()
    busy = scratch.write(near.groupBy("key").count().where(F.col("count") > neighbours).select("key"), "busy")
    usual = near if busy.isEmpty() else near.join(busy, "key", "left_anti")
    partial = usual.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_compare(length), MARKS)
    if not busy.isEmpty():
        partial = partial.union(_busy_marks(near, busy, length))
    whole = found.where("repeated").select("t1", "t2", F.shiftright("place", 16).alias("start"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(0xFFFF) + length).alias("stop"))
    copies = texts.select("t1", "t2", F.octet_length("text").cast("long").alias("stop")).where(F.col("stop") >= length).groupBy("t1", "t2", "stop").count().where("count > 1")
    marks = scratch.write(whole.union(partial).union(copies.select("t1", "t2", F.lit(0).cast("long"), "stop")).distinct(), "marks")
    scratch.drop("neighbourhoods")
    scratch.drop("busy")
    return marks


def _spans(marks: DataFrame) -> DataFrame:
    return marks.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def repeated_bytes(df: DataFrame, text_col: str = "text", length: int = LENGTH, key: int = KEY, batches: int = BATCHES, neighbours: int = NEIGHBOURS, held: int = HELD) -> DataFrame:
    """t1, t2 (see text_key) and spans: sorted, disjoint runs of bytes covered by strings of length bytes that also start elsewhere.

    One row per distinct text that has any; null texts count as empty. The documents are indexed in the given number of batches.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffixes")
    arrow_batches(spark, 500)
    texts = _texts(df, text_col)
    rows = _index_rows(texts, length, key).withColumn("batch", F.pmod("t1", F.lit(batches)))
    all_rows = scratch.write(rows, "suffixes")
    arrow_batches(spark, 10_000)
    index, hits = SuffixIndex(spark, scratch, held), []
    for k in range(batches):
        hits.append(index.add(all_rows.where(F.col("batch") == k).drop("batch"), last=k == batches - 1))
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    scratch.drop("suffixes")
    for _, name, _ in index.levels:
        scratch.drop(name)
    scratch.release()
    marks = _marks(texts, found, scratch, length, neighbours)
    for k in range(1, batches + 1):
        scratch.drop(f"hits-{k}")
        scratch.drop(f"crowded-{k}")
    scratch.release()
    return _spans(marks)


def add_batch(index: SuffixIndex, batch: DataFrame, before: DataFrame, text_col: str = "text", length: int = LENGTH, key: int = KEY, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Takes a batch into an index that is kept, and returns t1, t2 and spans of all strings that the batch repeats, in its own texts and in those before.

    before: the documents that the index holds, whose texts are compared where a suffix of the batch meets them. What
    they repeat among themselves was found when they came.
    """
    arrow_batches(index.spark, 500)
    found = index.add(index.scratch.write(_index_rows(_texts(batch, text_col), length, key), f"batch-{index.count + 1}"))
    work = Scratch(index.spark, "suffixes-batch")
    marks = _marks(_texts(batch, text_col).union(_texts(before, text_col)), found, work, length, neighbours)
    for name in ("batch", "hits", "crowded"):
        index.scratch.drop(f"{name}-{index.count}")
    return _spans(marks)


def _cut(data: bytes, spans: list[dict] | None) -> tuple[list[bytes], int, int]:
    """What is left, bytes removed, and maximal runs removed."""
    left, at, removed, runs, end = [], 0, 0, 0, -1
    for s in spans or ():
        start, stop = s["start"], s["stop"]
        if start > end:
            left.append(data[at:start])
            runs += 1
            removed += stop - start
            at = end = stop
        elif stop > end:
            removed += stop - end
            at = end = stop
    left.append(data[at:])
    return left, removed, runs


def _joined(df: DataFrame, own: Column, text_col: str, options: dict) -> DataFrame:
    """own, text and the spans to be removed from it."""
    marks = repeated_bytes(df.select(text_col), text_col, **options)
    arrow_batches(df.sparkSession, 500)
    rows = df.select(own.alias("own"), *text_key(F.col(text_col)), F.col(text_col).alias("text"))
    return rows.join(marks, ["t1", "t2"], "left").select("own", "text", "spans")


def removal_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of df.

    Null and empty texts have no bytes and nothing removed; texts shorter than length keep everything; copies of a text of at least length
    bytes lose everything, the first one too. An empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                data = _bytes(text.as_py())
                left, removed, runs = _cut(data, spans.as_py())
                for to, v in zip(out, (len(data), removed, runs, hashlib.sha256(b"".join(left)).hexdigest()), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _joined(df, F.col(id_col), text_col, options)
    return joined.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """df with the repeated bytes cut out of its texts; what is left of a character cut in half goes too. Null texts stay null.

    Rows are never dropped, those whose text is gone have an empty one; all copies of a text are cut alike; however long texts are read whole; df's other columns stay
    as they are, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [None if t is None else b"".join(_cut(_bytes(t), s)[0]).decode("utf-8", "ignore") for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], ["own", "kept"])

    others = [c for c in df.columns if c != text_col]
    joined = _joined(df, F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]), text_col, options)
    out = joined.mapInArrow(run, T.StructType([joined.schema["own"], T.StructField("kept", T.StringType())]))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"own.c{others.index(c)}").alias(c) for c in df.columns])
