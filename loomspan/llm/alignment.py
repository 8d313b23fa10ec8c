r"""Cross-tokenizer alignment by an event sweep.

Each text is encoded with two public tokenizers. A token's end is an event at a byte offset of space+text. Events travel in blocks of
one side's consecutive tokens: where the block begins, and its token ids; token lengths follow from the vocabularies. Blocks of both sides
are united, dealt out by document and sorted by offset within partitions. A machine reads them in order and holds the open group and at most a
block a side: where both sides end it closes a group, and between any two neighbouring events it gives out the link of the two tokens that cover
the bytes between.

Encoding remembers short chunks. A chunk begins with a space between two characters that are not white space; neither tokenizer merges across such
a place: the byte-level one cuts words there, and no piece of the other has a space after another character, which is checked when the model is read. Other
models are given whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, arrow_batches, partitions, spread

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of an event block.
BLOCK = 8192
#: Chunks that a worker remembers, and the longest of them.
REMEMBERED, SHORT = 200_000, 48
#: Links after which the pairs of a long document are given out in a row of their own.
PART = 1 << 20
#: Pairs of ids up to which their counts are broadcast (some 20 bytes each); beyond, they are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
CUT = re.compile(r"(?<=\S)(?= \S)")
A, B = 0, 1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: token bytes by id, and encoding of chunks."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]], cuts: bool):
        self.tokens, self.encode, self.cuts = tokens, encode, cuts
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.code = "H" if len(tokens) <= 1 << 16 else "I"


@lru_cache(maxsize=2)
def byte_level(definition: bytes) -> Side:
    """A byte-level BPE from its JSON; strings of special tokens inside texts are plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(definition.decode())
    own.encode_special_tokens = True
    alphabet, spec = byte_alphabet(), json.loads(definition)
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    tokens = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        tokens[i] = special[i] if i in special else bytes(alphabet[c] for c in token)
    splits = spec["pre_tokenizer"] or {}
    cuts = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and spec["normalizer"] is None
    return Side(tokens, lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)], cuts)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Side:
    """A piece model; it puts a space before each text by itself, so chunks are given without theirs."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    cuts = not any(re.search("[^▁]▁", p) for p in names)
    return Side(tokens, lambda texts: own.encode([t[1:] for t in texts], num_threads=1), cuts)


class _Encoder:
    """Token ids of both sides for space+text; chunks already seen are looked up."""

    def __init__(self, a: Side, b: Side):
        self.sides = a, b
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.cuts = a.cuts and b.cuts

    def _look_up(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        a, b = self.sides
        both = zip(chunks, a.encode(chunks), b.encode(chunks), strict=True)
        return {c: (array(a.code, x).tobytes(), array(b.code, y).tobytes()) for c, x, y in both}

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each text, as bytes."""
        parts = [CUT.split(f" {t}") if self.cuts else [f" {t}"] for t in texts]
        new = {c for chunks in parts for c in chunks if c not in self.known}
        found = self._look_up(sorted(new))
        if len(self.known) + len(found) > REMEMBERED:
            found = {c: self.known[c] for chunks in parts for c in chunks if c in self.known} | found
            self.known = {}
        for chunks in parts:
            both = [self.known.get(c) or found[c] for c in chunks]
            yield b"".join([x for x, _ in both]), b"".join([y for _, y in both])
        for c, v in found.items():
            if len(c) <= SHORT and len(self.known) < REMEMBERED:
                self.known[c] = v

    def joined(self, side: int, ids: bytes) -> bytes:
        return b"".join(map(self.sides[side].tokens.__getitem__, memoryview(ids).cast(self.sides[side].code)))


EVENTS = "text_key binary, at bigint, side int, ids binary"


def _sides(spark, byte_bpe: str, piece_model: str) -> Callable[[], tuple[Side, Side]]:
    """Both tokenizers for workers. Their files are read by the driver, so workers need not have them."""
    with open(byte_bpe, "rb") as f, open(piece_model, "rb") as g:
        held = spark.sparkContext.broadcast((f.read(), g.read()))
    return lambda: (byte_level(held.value[0]), pieces(held.value[1]))


def events(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_model: str = PIECES) -> DataFrame:
    """Event blocks of both sides: id, text_key (half of the text's SHA-256), at (byte offset in space+text), side (0: A, 1: B), ids.

    A text that is null, empty or not given back byte by byte by both tokenizers has one row with side null. Rows that repeat an
    id with another text are documents of their own; fully repeated rows give repeated blocks.
    """
    spark = df.sparkSession
    arrow_batches(spark, 1000)
    load = _sides(spark, byte_bpe, piece_model)
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T._parse_datatype_string(EVENTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = load()
        encoder = _Encoder(*sides)
        for b in batches:
            ids, out = b.column(0), []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, (text, both) in enumerate(zip(texts, encoder.batch(texts), strict=True)):
                raw = f" {text}".encode("utf-8", "surrogatepass")
                if not text or any(encoder.joined(s, both[s]) != raw for s in (A, B)):
                    out.append((i, hashlib.sha256(raw).digest()[:16], -1, None, None))
                    continue
                key = hashlib.sha256(raw).digest()[:16]
                for s in (A, B):
                    wide = array(sides[s].code).itemsize
                    n, at = len(both[s]) // wide, 0
                    for k in range(0, n, BLOCK):
                        block = both[s][k * wide : (k + BLOCK) * wide]
                        out.append((i, key, at, s, block))
                        if n > BLOCK:
                            at += int(sides[s].lengths[np.frombuffer(block, sides[s].code)].sum())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], schema.names)

    return rows.mapInArrow(run, schema)


class Swept:
    """A stretch of text that ends where tokens of both sides end; all of its groups and links."""

    def __init__(self, base: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
        (self.a_ids, a_ends), (self.b_ids, b_ends) = a, b
        size = int(a_ends[-1]) - base
        is_a, is_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        is_a[a_ends - base] = True
        is_b[b_ends - base] = True
        at = np.flatnonzero(is_a | is_b)
        on_a, on_b = is_a[at], is_b[at]
        #: Link i joins tokens a_no[i] and b_no[i] of this stretch; both cover the bytes up to ends[i].
        self.a_no, self.b_no = np.cumsum(on_a) - on_a, np.cumsum(on_b) - on_b
        self.ends = at + base
        self.stops = self.ends[on_a & on_b]
        #: Whether a token of a side closes a group.
        self.a_last, self.b_last = on_b[on_a], on_a[on_b]


class _Machine:
    """Takes one text's blocks in order of offset and gives out stretches as soon as their groups are closed."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        none = np.zeros(0, np.int64)
        self.open = [(none, none), (none, none)]
        self.base = 0

    def take(self, side: int, at: int, ids: np.ndarray) -> Iterator[Swept]:
        yield from self.close(at)
        held, ends = self.open[side]
        more = at + np.cumsum(self.lengths[side][ids])
        self.open[side] = (np.concatenate([held, ids]), np.concatenate([ends, more])) if len(held) else (ids, more)

    def close(self, upto: int | None = None) -> Iterator[Swept]:
        """Everything up to the last place, not after upto, where both sides end. No later block has an event there or before."""
        (_, a), (_, b) = self.open
        if not len(a) or not len(b):
            return
        if upto is None:
            last = int(a[-1])
        else:
            ends = a[: np.searchsorted(a, upto, "right")]
            where = np.searchsorted(b, ends)
            common = ends[(where < len(b)) & (b[np.minimum(where, len(b) - 1)] == ends)]
            if not len(common):
                return
            last = int(common[-1])
        cut = [int(np.searchsorted(e, last, "right")) for _, e in self.open]
        yield Swept(self.base, *[(ids[:k], ends[:k]) for (ids, ends), k in zip(self.open, cut, strict=True)])
        self.open = [(ids[k:], ends[k:]) for (ids, ends), k in zip(self.open, cut, strict=True)]
        self.base = last


def _numbers(n: int) -> np.ndarray:
    """Decimal ids followed by a comma, a bar or a semicolon, as rows of bytes padded with zeros; row id + n * mark."""
    wide = len(str(n - 1)) + 1
    rows = [f"{i}{mark}".encode().ljust(wide, b"\0") for mark in ",|;" for i in range(n)]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, wide)


def group_text(s: Swept, numbers: np.ndarray) -> bytes:
    """The stretch's groups as ``a1,a2|b1;`` and so on, with a semicolon behind each."""
    n = len(numbers) // 3
    a_group, b_group = np.cumsum(s.a_last) - s.a_last, np.cumsum(s.b_last) - s.b_last
    b_before = np.concatenate([[0], np.flatnonzero(s.b_last) + 1])
    a_before = np.flatnonzero(s.a_last) + 1
    order = np.empty(len(s.a_ids) + len(s.b_ids), np.int64)
    order[np.arange(len(s.a_ids)) + b_before[a_group]] = s.a_ids + n * s.a_last
    order[np.arange(len(s.b_ids)) + a_before[b_group]] = s.b_ids + 2 * n * s.b_last
    flat = numbers[order].reshape(-1)
    return flat[flat != 0].tobytes()


class _Digest:
    """Counts, the groups' digest and the links by pair of ids; a row now and then, and one at the end."""

    COLUMNS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, counts array<bigint>"

    def __init__(self, width: int, numbers: np.ndarray):
        self.width, self.numbers = width, numbers
        self.hash, self.held, self.links, self.sums = hashlib.sha256(), [], 0, [0, 0, 0, 0]
        self.tail = b""

    def add(self, s: Swept) -> Iterator[tuple]:
        text = self.tail + group_text(s, self.numbers)
        self.hash.update(text[:-1])
        self.tail = text[-1:]
        self.held.append(s.a_ids[s.a_no] * self.width + s.b_ids[s.b_no])
        self.links += len(s.ends)
        for i, n in enumerate((len(s.a_ids), len(s.b_ids), int(s.a_last.sum()), len(s.ends))):
            self.sums[i] += n
        if self.links >= PART:
            yield (0, 0, 0, 0, None, *self._pairs())

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.held[0] if len(self.held) == 1 else np.concatenate([np.zeros(0, np.int64), *self.held])
        self.held, self.links = [], 0
        return np.unique(held, return_counts=True)

    def end(self) -> Iterator[tuple]:
        yield (*self.sums, self.hash.hexdigest() if self.sums[0] else "", *self._pairs())


class _Groups:
    COLUMNS = "group_no bigint, start bigint, stop bigint, a_ids array<bigint>, b_ids array<bigint>"

    def __init__(self):
        self.no = self.at = 0

    def add(self, s: Swept) -> Iterator[tuple]:
        a, b = (np.split(ids, np.flatnonzero(last)[:-1] + 1) for ids, last in ((s.a_ids, s.a_last), (s.b_ids, s.b_last)))
        for x, y, stop in zip(a, b, s.stops.tolist(), strict=True):
            yield self.no, self.at, stop, x, y
            self.no, self.at = self.no + 1, stop

    def end(self) -> Iterator[tuple]:
        return iter(())


class _Links:
    COLUMNS = "a_no bigint, b_no bigint, a_id bigint, b_id bigint, start bigint, stop bigint"

    def __init__(self):
        self.a = self.b = self.at = 0

    def add(self, s: Swept) -> Iterator[tuple]:
        starts = np.concatenate([[self.at], s.ends[:-1]])
        yield from zip(*(x.tolist() for x in (s.a_no + self.a, s.b_no + self.b, s.a_ids[s.a_no], s.b_ids[s.b_no], starts, s.ends)), strict=True)
        self.a, self.b, self.at = self.a + len(s.a_ids), self.b + len(s.b_ids), int(s.ends[-1])

    def end(self) -> Iterator[tuple]:
        return iter(())


def sweep(blocks: DataFrame, kind: str = "groups", byte_bpe: str = BYTE_BPE, piece_model: str = PIECES) -> DataFrame:
    """Sweeps the blocks of :func:`events`: id, text_key, copies (of the whole row) and

    * ``groups``: group_no, start, stop (bytes of space+text), a_ids, b_ids;
    * ``links``: a_no, b_no (token numbers in the text), a_id, b_id, start, stop of the bytes that both cover;
    * ``digest``: n_a, n_b, n_groups, n_links, groups_sha256 and the links counted by pair of ids (a * size of B's vocabulary + b). Every
      document has one row with a groups_sha256, empty for those without tokens; very long ones have further rows with pairs only.
    """
    spark = blocks.sparkSession
    load = _sides(spark, byte_bpe, piece_model)
    made = {"groups": _Groups, "links": _Links, "digest": _Digest}[kind]
    own = T._parse_datatype_string(made.COLUMNS).fields
    schema = T.StructType([blocks.schema["id"], *T._parse_datatype_string("text_key binary, copies bigint").fields, *own])
    rows = blocks.repartition(partitions(spark), "id", "text_key").sortWithinPartitions("id", "text_key", "at", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = load()
        lengths, codes = tuple(s.lengths for s in sides), [s.code for s in sides]
        new = made if made is not _Digest else lambda n=_numbers(max(len(s.tokens) for s in sides)): _Digest(len(sides[B].tokens), n)
        doc, out, kinds = None, [], None
        machine = sink = first = last = None
        copies = 0

        def put(parts: Iterator[Swept]) -> None:
            for s in parts:
                waiting.extend(sink.add(s))

        def done() -> None:
            if doc is not None:
                put(machine.close())
                waiting.extend(sink.end())
                out.extend((*doc, copies, *row) for row in waiting)
                waiting.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        waiting: list[tuple] = []
        for b in batches:
            kinds = kinds or [b.schema.field(0).type, pa.binary(), pa.int64(), *[pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.string() if f.name == "groups_sha256" else pa.int64() for f in own]]
            for i, key, at, side, ids in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if doc != (i, key):
                    done()
                    doc, machine, sink, first, last, copies = (i, key), _Machine(lengths), new(), (at, side), None, 0
                copies += (at, side) == first
                if (at, side) != last and side is not None:
                    put(machine.take(side, at, np.frombuffer(ids, codes[side]).astype(np.int64)))
                last = at, side
                if copies and last != first and waiting:  # all copies of the first block have been read
                    out.extend((*doc, copies, *row) for row in waiting)
                    waiting.clear()
                if len(out) >= 2000:
                    yield batch()
            if out:
                yield batch()
        done()
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_model: str = PIECES) -> DataFrame:
    """One row per row of df: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is how many links of all documents join its two ids, copies included. n_best counts the links whose pair's count is the highest of its
    B id, ties included; count_sum adds the counts of all links. Texts that are null, empty or not given back by both tokenizers
    have zeros and an empty groups_sha256. Pairs are counted within documents first, so a pair that every document holds is one row
    of each. The table of pairs grows with the vocabularies; it is broadcast only up to BROADCAST_PAIRS of them, and joins by a shuffle beyond.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = scratch.write(sweep(events(df, id_col, text_col, byte_bpe, piece_model), "digest", byte_bpe, piece_model), "rows")
    scratch.release()
    width = len(_sides(spark, byte_bpe, piece_model)()[B].tokens)
    linked = rows.select("id", "text_key", "copies", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("id", "text_key", "copies", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counted = linked.groupBy("pair").agg(F.sum(F.col("n") * F.col("copies")).alias("total"))
    of_b = Window.partitionBy(F.col("pair") % width)
    pairs = scratch.write(counted.withColumn("best", F.col("total") == F.max("total").over(of_b)), "pairs")
    few = pairs.count() <= BROADCAST_PAIRS
    sums = linked.join(F.broadcast(pairs) if few else pairs, "pair").groupBy("id", "text_key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    whole = rows.where(F.col("groups_sha256").isNotNull()).drop("pairs", "counts")
    sums = sums.select(F.col("id").alias("s_id"), F.col("text_key").alias("s_key"), "n_best", "count_sum")
    found = whole.join(sums, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
