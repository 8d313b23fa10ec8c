"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into three parts. Two fingerprints that differ in at most
``BITS`` = 4 bits differ in at most one bit in one of the parts. In each part the anchors are the
words of a covering code: the perfect [15,11] Hamming code (covering radius 1) on fifteen
bits and every word on the others. A fingerprint is at home at its nearest anchor and visits every anchor
within its distance to that (at most the covering radius) plus the threshold of one bit. If a is not
farther from its home than b from its own, b is within that of a's home; so each close pair meets at the
home of one of the two, and comparing homes with visitors anchor by anchor finds all links.
One code over all 64 bits has to allow four bits at once: measured with first-order Reed-Muller
codes, that takes 105 copies of a fingerprint and compares it with 1/40 of all others; three
parts take 44 copies and 1/3000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, arrow_batches, connected_components, partitions, put_aside, take_back

BITS = 4
SHINGLE = 4
SEED = 42
#: First bit and length of the three parts.
PARTS = ((0, 22), (22, 21), (43, 21))
CODED = 15
#: Fingerprints at home at one anchor that a task holds; more are dealt out to several tasks, which all see every visitor.
HOMES = 50_000
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) text; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_digest
    if n <= shingle:
        return int.from_bytes(digest(joined, seed), "big")
    ends = np.cumsum([len(w) for w in words]) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    ones, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, CHUNK):
        found = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)])
        ones += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns id, text_hash (XXH64 of the text) and fingerprint (64 bits, as a signed long), one row per row of df.

    Null and word-less texts get fingerprint zero. Texts are hashed whole, in one pass without a shuffle.
    """
    arrow_batches(df.sparkSession, 500)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.int64())], ["id", "text_hash", "fingerprint"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return source.mapInArrow(run, f"id {id_type.simpleString()}, text_hash bigint, fingerprint bigint")


def _nearest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 15-bit word: its distance from the Hamming code, the nearest code word, and those at distance two."""
    words = np.arange(1 << CODED, dtype=np.int64)
    syndrome = np.zeros(1 << CODED, np.int64)
    for i in range(CODED):
        syndrome ^= np.where(words >> i & 1, i + 1, 0)
    flip = np.concatenate(([0], 1 << np.arange(CODED, dtype=np.int64)))
    second = np.zeros((1 << CODED, 7), np.int64)
    for s in range(1, CODED + 1):
        pairs = [(i, s ^ i) for i in range(1, CODED + 1) if i < s ^ i and 1 <= s ^ i <= CODED]
        rows = syndrome == s
        second[rows] = words[rows, None] ^ np.array([flip[i] ^ flip[j] for i, j in pairs])[None, :]
    return (syndrome > 0).astype(np.int64), words ^ flip[syndrome], second


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchors and whether at home there, for each anchor that a fingerprint is replicated to."""
    far, near, second = _TABLES
    rows, found, homes = [], [], []
    n = np.arange(len(prints))
    for part, (first, length) in enumerate(PARTS):
        bits = ((prints >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.int64)
        coded, rest = bits & ((1 << CODED) - 1), bits >> CODED
        of = lambda code, free: (np.int64(part) << 32) | (free << CODED) | code
        rows.append(n)
        found.append(of(near[coded], rest))
        homes.append(np.ones(len(n), bool))
        for i in range(length - CODED):
            rows.append(n)
            found.append(of(near[coded], rest ^ (1 << i)))
            homes.append(np.zeros(len(n), bool))
        off = n[far[coded] > 0]
        for i in range(second.shape[1]):
            rows.append(off)
            found.append(of(second[coded[off], i], rest[off]))
            homes.append(np.zeros(len(off), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(homes)


_TABLES = _nearest()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component: as few edges as nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor and chunk, homes first: links homes with all later rows of their anchor.

    Between batches only the homes of the anchor at the end are kept.
    """
    kept_key, kept = None, np.zeros(0, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        anchor, chunk, home = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        prints = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        n = len(anchor)
        starts = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])))
        first = np.flatnonzero(starts)
        stop = np.append(first[1:], n)
        end = np.repeat(stop, stop - first)
        xs, ys = [], []
        if kept_key == (anchor[0], chunk[0]):
            now = prints[: stop[0]]
            for at in range(0, len(kept), 256):
                i, j = np.nonzero(_close(kept[at : at + 256, None], now[None, :], bits))
                xs.append(kept[at : at + 256][i])
                ys.append(now[j])
                if sum(map(len, xs)) > 1 << 20:
                    x, y = _forest(np.concatenate(xs), np.concatenate(ys))
                    xs, ys = [x], [y]
        else:
            kept = np.zeros(0, np.uint64)
        at, step = np.flatnonzero(home), 1
        while len(at := at[at + step < end[at]]):
            linked = _close(prints[at], prints[at + step], bits)
            if linked.any():
                xs.append(prints[at[linked]])
                ys.append(prints[at[linked] + step])
                if sum(map(len, xs)) > 1 << 20:
                    x, y = _forest(np.concatenate(xs), np.concatenate(ys))
                    xs, ys = [x], [y]
            step += 1
        last = slice(first[-1], n)
        own = prints[last][home[last].astype(bool)]
        kept = np.concatenate((kept, own)) if len(first) == 1 else own
        kept_key = (anchor[-1], chunk[-1])
        if xs:
            x, y = _forest(np.concatenate(xs), np.concatenate(ys))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])


def links(prints: DataFrame, scratch: Scratch, bits: int = BITS, homes: int = HOMES) -> DataFrame:
    """Edges a, b that connect all fingerprints within bits of each other (a spanning set, not all pairs).

    prints: distinct values in column fingerprint. bits: 4 at most, as the three parts allow one bit each.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be between 0 and {BITS}")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, anchor, home = anchors(own)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(own[row].view(np.int64))], ["anchor", "home", "fingerprint"])

    spark = prints.sparkSession
    copies = prints.select("fingerprint").mapInArrow(cover, "anchor bigint, home boolean, fingerprint bigint")
    busy = copies.where("home").groupBy("anchor").count().where(F.col("count") > homes)
    busy = scratch.write(busy.select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("chunks")), "busy")
    if busy.isEmpty():
        dealt = copies.withColumn("chunk", F.lit(0))
    else:
        dealt = copies.join(busy, "anchor", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
        dealt = dealt.withColumn("chunk", F.explode(F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
        # A home is also a visitor of the anchor's other chunks.
        more = copies.where("home").join(busy, "anchor").withColumn("chunk", F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != own)))
        dealt = dealt.select("anchor", "chunk", "home", "fingerprint").union(more.select("anchor", "chunk", F.lit(False), "fingerprint"))
    dealt = dealt.select("anchor", "chunk", "home", "fingerprint").repartition(partitions(spark), "anchor", "chunk")
    return dealt.sortWithinPartitions("anchor", "chunk", F.desc("home")).mapInArrow(lambda it: _compare(it, bits), "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of df: id, text_hash, fingerprint (long) and component_id.

    component_id is the smallest id that can be reached over links, the row's own included; where no row of a
    component has an id it is null. Null and empty texts have fingerprint zero and link like any other;
    repeated rows are repeated. An empty table gives an empty table. Rows of one fingerprint are counted as one before
    any comparison, so a group of exact copies costs nothing.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    all_prints = scratch.write(fingerprints(df, id_col, text_col, shingle), "prints")
    arrow_batches(spark, 10_000)
    each = scratch.write(all_prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    found = links(each, scratch, bits)
    label = connected_components(scratch.write(found, "edges"), scratch)
    named = each.join(label, each.fingerprint == label.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    named = scratch.write(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "component").select("fingerprint", "component_id")
    return all_prints.join(of_print, "fingerprint").select("id", "text_hash", "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """df with one row of each component: that with the smallest id (rows without an id last, then by text hash).

    Null, empty and very long texts are treated as in near_duplicates; of rows repeated with their id and text one stays, and its other columns are those of any of
    them. df's columns stay as they are, whatever their names. An empty table gives an empty table.
    """
    found = near_duplicates(df, id_col, text_col, **options)
    # Every row of a component without ids has component_id null; those are told apart by fingerprint.
    with_id = found.where("id = component_id").groupBy("id").agg(F.min("text_hash").alias("text_hash"))
    without = found.where("component_id is null").groupBy("fingerprint").agg(F.min("text_hash").alias("text_hash")).select(F.lit(None).cast(df.schema[id_col].dataType).alias("id"), "text_hash")
    keep = with_id.union(without.distinct()).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = put_aside(df).withColumn("_text_hash", F.xxhash64(f"own_{text_col}"))
    stay = rows.join(keep, rows[f"own_{id_col}"].eqNullSafe(keep["_id"]) & (rows["_text_hash"] == keep["_hash"]), "left_semi")
    return stay.dropDuplicates([f"own_{id_col}", "_text_hash"]).select(*take_back(stay, df.columns))
