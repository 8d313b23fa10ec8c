"""Interpolated modified Kneser-Ney model of order three, counted in Spark and looked up in memory-mapped sorted hash arrays.

Counting: every task numbers the words it meets, sums up equal word triples in sorted arrays and sends them on packed. Triples are
dealt by their middle word, so one bucket has all triples (u, v, w) of a word v: the counts of the triples, the sums over the contexts
(u, v), the number of different words before each pair (v, w), and the counts of v itself are all complete in it and need no further
shuffle. Triples whose middle word is so common that it would fill a bucket alone are dealt by (u, v), and their pairs are merged in a
second, small step. Each bucket is written as sorted arrays in the shared folder, with a header that tells its rows. Scoring maps the
files into memory, a bounded number at a time, and searches them for many tokens at once.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, arrow_batches, ascii_lower, word_array
from loomspan.llm.hashing import mix64

#: Neither can be a word, as words hold no spaces.
_BEGIN, _END = b" begin", b" end"
BEGIN, END = (xxhash.xxh64_intdigest(w) for w in (_BEGIN, _END))
#: Tokens that a task holds before it sums their triples up and sends them on.
HELD = 1 << 21
#: Tokens that a bucket has about; a task merges one bucket, so the number of tasks grows with the input.
BUCKET = 3 << 19
#: Occurrences of a word from which its triples are dealt to all buckets.
CROWD = 1 << 19
#: Words that a task remembers, and tokens of one text that are numbered at once; the sum stays below 2 ** 21.
REMEMBERED, PIECE = 1 << 19, 1 << 19
#: Tokens that are scored at once, and bytes of files that a worker keeps mapped.
SCORED, MAPPED = 1 << 19, 1 << 30
_BITS = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)


class _Words(dict):
    """Numbers of words in the order in which they are met; hashes has the hash of each."""

    def __init__(self) -> None:
        super().__init__({_BEGIN: 0, _END: 1})
        self.hashes = [BEGIN, END]

    def __missing__(self, w: bytes) -> int:
        self[w] = i = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(w))
        return i

    def numbers(self, piece: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, piece), np.uint64, len(piece))


def _pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The text's tokens between two beginnings and its end, in pieces that overlap by two."""
    tokens = [_BEGIN, _BEGIN, *(text or b"").lower().split(), _END]
    if len(tokens) <= PIECE + 2:
        yield tokens
    else:
        for s in range(0, len(tokens) - 2, PIECE):
            yield tokens[s : s + PIECE + 2]


def short(h: np.ndarray) -> np.ndarray:
    """The 40 bits of a word's hash that stand for it beside another word, which has all of its own."""
    return h >> np.uint64(24)


def context_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """u: short."""
    return mix64(mix64(v) + u)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w: short."""
    return mix64(mix64(v ^ np.uint64(0x5851F42D4C957F2D)) + w)


def triple_key(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w: short."""
    return mix64(context + w)


@dataclass(frozen=True)
class Deal:
    """Which bucket a triple and a pair belong to."""

    buckets: int
    crowd: np.ndarray

    def crowded(self, v: np.ndarray) -> np.ndarray:
        return np.isin(v, self.crowd) if len(self.crowd) else np.zeros(len(v), bool)

    def _prefix(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def word(self, v: np.ndarray) -> np.ndarray:
        return self._prefix(mix64(v))

    def triple(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """u: short."""
        out = self.word(v)
        if len(self.crowd) and (hot := self.crowded(v)).any():
            out[hot] = self._prefix(context_key(u[hot], v[hot]))
        return out

    def pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Pairs of a crowded word are dealt by both words, others by the first; w: short."""
        return self.triple(w, v)


def _bits(buckets: int) -> int:
    return (buckets - 1).bit_length() if buckets > 1 else 0


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the numbers of its rows, in order."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    dealt = bucket[order]
    first = _starts(dealt)
    for lo, hi in zip(first, np.append(first[1:], len(dealt)), strict=True):
        yield int(dealt[lo]), order[lo:hi]


def _planes(values: np.ndarray, size: int) -> bytes:
    """The lower bytes of the numbers, all first ones, then all second ones, ..."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :size].T).tobytes()


def _from_planes(raw: np.ndarray, n: int, size: int, kind: type) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :size] = raw.reshape(size, n).T
    return out.view(kind).reshape(n)


def _pack(hashes: np.ndarray, first: np.ndarray, others: list[np.ndarray], n: np.ndarray, place: np.ndarray) -> bytes:
    """Columns of word numbers, sorted by the first, as a list of the block's words and places in it; place: room for a number per word.

    All words are listed by their short hashes, those of the first column by the rest of theirs, too.
    """
    used = np.unique(np.concatenate((first, *others)))
    place[used] = np.arange(len(used), dtype=np.uint32)
    own = [place[c] for c in (first, *others)]
    own[0][1:] -= own[0][:-1].copy()
    rest = hashes[first[_starts(first)]]
    planes = b"".join(_planes(c, 4) for c in (*own, n.astype(np.uint32)))
    sizes = np.array([len(n), len(used), len(rest)], np.uint64)
    return sizes.tobytes() + _planes(short(hashes[used]), 5) + _planes(rest, 3) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """The first column's hashes, the others' short ones, and the counts."""
    n, d, m = (int(v) for v in np.frombuffer(blob, np.uint64, 3))
    raw = np.frombuffer(blob, np.uint8)
    words = _from_planes(raw[24 : 24 + 5 * d], d, 5, np.uint64)
    rest = _from_planes(raw[24 + 5 * d : 24 + 5 * d + 3 * m], m, 3, np.uint64)
    planes = np.frombuffer(pa.decompress(blob[24 + 5 * d + 3 * m :], decompressed_size=4 * n * (columns + 1), codec="zstd", asbytes=True), np.uint8).reshape(columns + 1, 4 * n)
    out = [_from_planes(p, n, 4, np.uint32) for p in planes]
    at = np.cumsum(out[0], dtype=np.uint32)
    first = _starts(at)
    whole = words[at[first]] << np.uint64(24) | rest
    return [np.repeat(whole, np.diff(np.append(first, n))), *(words[c] for c in out[1:columns]), out[columns].astype(np.int64)]


def _count(deal: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = _Words(), [], 0

        def send() -> pa.RecordBatch:
            key = np.sort(np.concatenate(held))
            first = _starts(key)
            n, key = np.diff(np.append(first, len(key))), key[first]
            v, u, w = key >> (_BITS + _BITS), (key >> _BITS) & _MASK, key & _MASK
            hashes = np.array(words.hashes, np.uint64)
            place = np.zeros(len(hashes), np.uint32)
            out: tuple[list, list] = ([], [])
            for bucket, rows in _by_bucket(deal.triple(short(hashes[u]), hashes[v]), deal.buckets):
                out[0].append(bucket)
                out[1].append(_pack(hashes, v[rows], [u[rows], w[rows]], n[rows], place))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["bucket", "triples"])

        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                for piece in _pieces(text.as_py()):
                    at = words.numbers(piece)
                    held.append(at[1:-1] << (_BITS + _BITS) | at[:-2] << _BITS | at[2:])
                    size += len(piece) - 2
                    if size >= HELD or len(words.hashes) >= REMEMBERED:
                        yield send()
                        size = 0
                        if len(words.hashes) >= REMEMBERED:
                            words = _Words()
        if held:
            yield send()

    return run


def _mounted(folder: str) -> str | None:
    """The path of a folder of the file: scheme; other file systems are reached through a library. Folders have a scheme, see Scratch.url."""
    return "/" + folder[5:].lstrip("/") if folder.startswith("file:") else None


def _put(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Writes arrays one after the other; the file appears whole, so a task that is run again does no harm."""
    path = _mounted(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for a in parts:
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        for a in parts:
            f.write(np.ascontiguousarray(a).tobytes())
    files.move(part, f"{path}/{name}")


def _map(folder: str, name: str) -> np.ndarray:
    """The file's bytes, mapped. From a store that can't be mapped the file is copied; the copy has no name and goes with its mapping."""
    path = _mounted(folder)
    if path is not None:
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile() as copy, files.open_input_stream(f"{path}/{name}") as f:
        while block := f.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r")


class HashArray:
    """Keys (the upper 48 bits of a hash) in order, with columns of counts.

    A list of starts by the keys' first bits stands for those bits, so that a key takes four bytes. A count takes one; rows with a count of 255 or more are listed apart.
    """

    MAGIC, SMALL = 0x4C4F4F4D, 255

    @staticmethod
    def parts(hashes: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
        """What a file holds; hashes are distinct but in any order."""
        values = [np.asarray(c) for c in columns]
        if not (hashes[1:] > hashes[:-1]).all():
            order = np.argsort(hashes)
            hashes, values = hashes[order], [v[order] for v in values]
        key = hashes >> np.uint64(16)
        bits = max(16, _bits(len(key)) - 2)
        slots = np.searchsorted(key >> np.uint64(48 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
        large = np.flatnonzero(np.logical_or.reduce([v >= HashArray.SMALL for v in values]))
        head = np.array([HashArray.MAGIC, len(key), len(columns), bits, len(large)], np.uint64)
        return [head, *(v[large].astype(np.uint64) for v in values), large.astype(np.uint64), slots, key.astype(np.uint32), *(np.minimum(v, HashArray.SMALL).astype(np.uint8) for v in values)]

    def __init__(self, raw: np.ndarray, name: str):
        head = raw[:40].view(np.uint64) if len(raw) >= 40 else np.zeros(5, np.uint64)
        magic, self.n, m, self.bits, k = (int(v) for v in head)
        sizes = [40, *[8 * k] * (m + 1), 4 * ((1 << self.bits) + 1), 4 * self.n, *[self.n] * m]
        if magic != self.MAGIC or sum(sizes) != len(raw):
            raise OSError(f"{name} is not a whole array of the model")
        kinds = [np.uint64, *[np.uint64] * (m + 1), np.uint32, np.uint32, *[np.uint8] * m]
        at, cuts = 0, []
        for size, kind in zip(sizes, kinds, strict=True):
            cuts.append(raw[at : at + size].view(kind))
            at += size
        self.large, self.where, self.slots, self.low, self.small = cuts[1 : m + 1], cuts[m + 1], cuts[m + 2], cuts[m + 3], cuts[m + 4 :]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none: from where it should be in its slot, if keys are spread evenly, step by step to where it must be."""
        if not self.n:
            return np.full(len(hashes), -1, np.int64)
        key = hashes >> np.uint64(16)
        bits = np.uint64(48 - self.bits)
        slot = (key >> bits).astype(np.int64)
        start, stop = self.slots[slot].astype(np.int64), self.slots[slot + 1].astype(np.int64)
        share = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(float) / float(1 << int(bits))
        low = key.astype(np.uint32)
        at = np.minimum(start + ((stop - start) * share).astype(np.int64), self.n - 1)
        for ahead in (False, True):
            live = np.flatnonzero((self.low[at] < low) & (at + 1 < stop) if ahead else (self.low[at] > low) & (at > start))
            while len(live):
                here = at[live] + (1 if ahead else -1)
                at[live] = here
                seen = self.low[here]
                live = live[(seen < low[live]) & (here + 1 < stop[live]) if ahead else (seen > low[live]) & (here > start[live])]
        return np.where((start < stop) & (self.low[at] == low), at, -1)

    def counts(self, rows: np.ndarray) -> list[np.ndarray]:
        out = [c[rows].astype(float) for c in self.small]
        if len(self.where):
            over = np.flatnonzero(np.logical_or.reduce([c == self.SMALL for c in out]))
            if len(over):
                place = np.searchsorted(self.where, rows[over].astype(np.uint64))
                for c, v in zip(out, self.large, strict=True):
                    c[over] = v[place]
        return out


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where each distinct key begins in it."""
    order = np.argsort(key)
    return order, _starts(key[order])


def _sums(first: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c.astype(np.int64), first) for c in columns]


_WORD = ["word", "total", "n1", "n2", "n3", "count", "before"]
#: Sums over all buckets: tokens, words, pairs, words with one, two, ... words before, triples and pairs of count one to four, pairs with the end, texts.
_TALLY = ["tokens", "distinct", "pairs", "b1", "b2", "b3", "b4", "more", "t1", "t2", "t3", "t4", "y1", "y2", "y3", "y4", "ends", "texts"]
_ROWS = ", ".join(f"{c} bigint" for c in (*_WORD, "bucket", *_TALLY)) + ", packed binary"


def _ones(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _made(words: list[np.ndarray], bucket: int, tally: dict[str, int], blobs: tuple[list, list] = ([], [])) -> pa.RecordBatch:
    """A row for the bucket, which tells that its files are written; one for each crowded word in it; and the crowded words' pairs, to be merged."""
    n, m = len(words[0]), len(blobs[0])
    columns = [pa.array([None, *c.tolist(), *[None] * m], pa.int64()) for c in (words[0].view(np.int64), *words[1:])]
    columns.append(pa.array([bucket, *[None] * n, *blobs[0]], pa.int64()))
    columns += [pa.array([tally.get(k, 0), *[None] * (n + m)], pa.int64()) for k in _TALLY]
    return pa.RecordBatch.from_arrays([*columns, pa.array([*[None] * (n + 1), *blobs[1]], pa.binary())], [*_WORD, "bucket", *_TALLY, "packed"])


def _by(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, and the sums of the columns."""
    order, first = _grouped(key)
    return key[order][first], _sums(first, *(c[order] for c in columns))


def _pair_sums(folder: str, name: str, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], dict[str, int]]:
    """Writes distinct pairs and the words before them; contexts v, sums over each, and sums over all."""
    _put(folder, name, HashArray.parts(pair_key(v, w), [n]))
    tally = {"pairs": len(n), "ends": int((w == short(np.uint64(END))).sum())} | dict(zip(_TALLY[12:16], _ones(n), strict=True))
    if not len(v):
        return v, [n] * 4, tally
    return *_by(v, n, n == 1, n == 2, n > 2), tally


def _collected(finish, columns: int):
    """Calls finish(bucket, columns of its blobs put together) for each bucket of rows in order of bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is not None and bucket != now:
                    yield finish(now, [np.concatenate(c) for c in zip(*(_unpack(h, columns) for h in held), strict=True)])
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield finish(now, [np.concatenate(c) for c in zip(*(_unpack(h, columns) for h in held), strict=True)])

    return run


def _merge(folder: str, deal: Deal):
    def finish(bucket: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        v, u, w, n = columns
        columns.clear()
        key = triple_key(context_key(u, v), w)
        order, first = _grouped(key)
        (n,) = _sums(first, n[order])
        order = order[first]
        u, v, w = u[order], v[order], w[order]
        _put(folder, f"triples-{bucket}", HashArray.parts(key[order], [n]))
        del key
        context = context_key(u, v)
        del u
        order, first = _grouped(context)
        by = n[order]
        total, *ns = _sums(first, by, by == 1, by == 2, by > 2)
        context, cv = context[order][first], v[order][first]
        # A context with one occurrence needs no row: it is known as a pair. The beginning of a text is none.
        keep = (total > 1) | (cv == BEGIN)
        _put(folder, f"contexts-{bucket}", HashArray.parts(context[keep], [c[keep] for c in (total, *ns)]))
        del context, by, total, ns, keep
        order, first = _grouped(pair_key(v, w))
        # Words before a pair; where nothing but the beginning can be before it, its occurrences.
        (before,) = _sums(first, np.where(v == BEGIN, n, 1)[order])
        pv, pw = v[order][first], w[order][first]
        hot = deal.crowded(pv)
        _, sums, tally = _pair_sums(folder, f"pairs-{bucket}", pv[~hot], pw[~hot], before[~hot])
        # The words of the bucket: as contexts, and as words, each of which but the end is followed by another.
        word, (count,) = _by(v, n)
        _, (left,) = _by(cv, np.ones(len(cv), np.int64))
        count[word == BEGIN] = left[word == BEGIN] = 0
        usual = ~deal.crowded(word)
        _put(folder, f"words-{bucket}", HashArray.parts(word[usual], [*sums, count[usual], left[usual]]))
        tally |= {"tokens": int(n.sum()), "distinct": int((count[usual] > 0).sum()), "more": int((left[usual] > 2).sum()), "texts": int(n[v == BEGIN].sum())}
        tally |= dict(zip(_TALLY[3:7], _ones(left[usual]), strict=True)) | dict(zip(_TALLY[8:12], _ones(n), strict=True))
        blobs: tuple[list, list] = ([], [])
        if hot.any():
            known, at = np.unique(np.concatenate((pv[hot], pw[hot] << np.uint64(24))), return_inverse=True)
            a, b = np.split(at.astype(np.uint64), 2)
            for to, rows in _by_bucket(deal.pair(pv[hot], pw[hot]), deal.buckets):
                by = rows[np.argsort(a[rows], kind="stable")]
                blobs[0].append(to)
                blobs[1].append(_pack(known, a[by], [b[by]], before[hot][by], np.zeros(len(known), np.uint32)))
        none = np.zeros(int((~usual).sum()), np.int64)
        return _made([word[~usual], none, none, none, none, count[~usual], left[~usual]], bucket, tally, blobs)

    return _collected(finish, 3)


def _merge_crowded(folder: str):
    def finish(bucket: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        v, w, n = columns
        order, first = _grouped(pair_key(v, w))
        (n,) = _sums(first, n[order])
        word, sums, tally = _pair_sums(folder, f"crowded-{bucket}", v[order][first], w[order][first], n)
        none = np.zeros(len(word), np.int64)
        return _made([word, *sums, none, none], bucket, tally)

    return _collected(finish, 2)


def _empty_files(folder: str, kinds: list[str]):
    """Files without rows, so that a file that is not there is always an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column(0).to_pylist():
                for kind in kinds:
                    _put(folder, f"{kind}-{bucket}", HashArray.parts(np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * _COLUMNS[kind]))
            yield b

    return run


_COLUMNS = {"triples": 1, "contexts": 4, "pairs": 1, "crowded": 1, "words": 6}


def discounts(y: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from the numbers of counts 1 to 4; where one of these is zero, one is added to each."""
    y1, y2, y3, y4 = y if min(y) else (v + 1 for v in y)
    base = y1 / (y1 + 2 * y2)
    clip = lambda d, most: min(max(d, 0.05), most)
    return clip(1 - 2 * base * y2 / y1, 0.95), clip(2 - 3 * base * y3 / y2, 1.95), clip(3 - 4 * base * y4 / y3, 2.95)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, how they are dealt, and the few numbers that hold for all words."""

    folder: str
    deal: Deal
    #: Hashes, in order, and counts (as in the files of words) of the end and of the crowded words.
    apart: tuple[np.ndarray, np.ndarray]
    tokens: int
    distinct: int
    triple_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pairs: int
    word_counts: tuple[int, int, int]

    @property
    def unknown(self) -> float:
        """Probability of any word that the model doesn't know."""
        if not self.pairs:
            return 1.0
        return sum(a * b for a, b in zip(self.word_discounts, self.word_counts, strict=True)) / self.pairs / (self.distinct + 1)


def is_training(id_col: Column, folds: int = 7, left_out: int = 2) -> Column:
    """crc32 of the id as text, modulo folds, is not left_out; a null id is for training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds != left_out, F.lit(True))


def _crowd(df: DataFrame, text_col: str, size: int, tokens: int, least: int) -> np.ndarray:
    """Hashes of words that seem to occur least times or more, by a bounded sample. They decide where counts are kept, never what they are."""
    if tokens < least:
        return np.zeros(0, np.uint64)
    sampled = max(1 << 24, size >> 20)
    part = df.sample(fraction=min(1.0, sampled / size), seed=5) if sampled < size else df
    words = part.select(F.explode(word_array(ascii_lower(F.col(text_col)))).alias("w")).groupBy("w").count()
    share = max(least / tokens, 8 * 6 / sampled)
    found = words.where(F.col("count") >= share * min(sampled, size) / 6).select(F.col("w").cast("binary")).collect()
    return np.sort(np.array([xxhash.xxh64_intdigest(bytes(r[0])) for r in found], np.uint64))


def train(df: DataFrame, text_col: str = "text", bucket: int = BUCKET, crowd: int | None = None) -> Model:
    """Counts all rows of df. Null texts are empty and count one end; repeated rows count again. An empty table gives a model that knows nothing.

    The arrays stay in the shared folder, where lazily computed scores read them.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "kneserney")
    size = df.agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit("")))).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // (6 * bucket)))
    arrow_batches(spark, 1000)
    deal = Deal(buckets, _crowd(df, text_col, size, size // 6, CROWD if crowd is None else crowd))
    folder = scratch.url("arrays")
    packed = df.select(text_col).mapInArrow(_count(deal), "bucket bigint, triples binary")
    arrow_batches(spark, 64)
    rows = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(folder, deal), _ROWS)
    rows = scratch.write(rows, "rows")
    del packed
    scratch.release()
    usual = ["triples", "contexts", "pairs", "words"]
    _fill(_missing(rows, buckets), folder, usual)
    if len(deal.crowd):
        again = rows.where("packed is not null").select("bucket", "packed").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        again = scratch.write(again.mapInArrow(_merge_crowded(folder), _ROWS), "crowded")
        _fill(_missing(again, buckets), folder, ["crowded"])
        rows = rows.union(again)
    s = {k: v or 0 for k, v in rows.agg(*[F.sum(c).alias(c) for c in _TALLY]).first().asDict().items()}
    # As many rows as there are crowded words, whose number the sample bounds.
    found = rows.where("word is not null").groupBy("word").agg(*[F.sum(c).alias(c) for c in _WORD[1:]]).collect() if len(deal.crowd) else []
    apart = {int(np.int64(r[0]).view(np.uint64)): list(r[1:]) for r in found} | ({END: [0, 0, 0, 0, s["texts"], s["ends"]]} if s["texts"] else {})
    for *_, count, left in apart.values():
        s["distinct"] += count > 0
        s["more"] += left > 2
        if 1 <= left <= 4:
            s[f"b{left}"] += 1
    hashes = np.array(sorted(apart), np.uint64)
    table = np.array([apart[int(h)] for h in hashes], float).reshape(len(hashes), 6).T
    scratch.drop("rows")
    scratch.drop("crowded")
    four = lambda k: discounts([s[f"{k}{i}"] for i in (1, 2, 3, 4)])
    return Model(folder, deal, (hashes, table), s["tokens"], s["distinct"], four("t"), four("y"), four("b"), s["pairs"], (s["b1"], s["b2"], s["more"]))


def _missing(rows: DataFrame, buckets: int) -> DataFrame:
    made = rows.where("tokens is not null").select("bucket")
    return rows.sparkSession.range(buckets).toDF("bucket").join(made, "bucket", "left_anti")


def _fill(missing: DataFrame, folder: str, kinds: list[str]) -> None:
    missing.mapInArrow(_empty_files(folder, kinds), "bucket bigint").write.format("noop").mode("overwrite").save()


class Reader:
    """Looks words, pairs and triples up in the mapped arrays; the files used least lately are let go."""

    def __init__(self, model: Model, mapped: int = MAPPED):
        self.model, self.mapped, self.size = model, mapped, 0
        self.files: OrderedDict[str, tuple[int, HashArray]] = OrderedDict()

    def _open(self, name: str) -> HashArray:
        if name in self.files:
            self.files.move_to_end(name)
            return self.files[name][1]
        raw = _map(self.model.folder, name)
        found = HashArray(raw, name)
        self.files[name] = (len(raw), found)
        self.size += len(raw)
        while self.size > self.mapped and len(self.files) > 1:
            self.size -= self.files.popitem(last=False)[1][0]
        return found

    def find(self, kind: str, bucket: np.ndarray, buckets: int, hashes: np.ndarray) -> np.ndarray:
        """Counts of each hash, zero where it is not known."""
        out = np.zeros((_COLUMNS[kind], len(hashes)))
        for b, rows in _by_bucket(bucket, buckets):
            array = self._open(f"{kind}-{b}")
            place = array.find(hashes[rows])
            known = np.flatnonzero(place >= 0)
            if len(known):
                for to, c in zip(out, array.counts(place[known]), strict=True):
                    to[rows[known]] = c
        return out

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Rows total, n1, n2, n3 (as context), count and before (contexts it follows)."""
        deal, (apart, table) = self.model.deal, self.model.apart
        out = self.find("words", deal.word(hashes), deal.buckets, hashes)
        if len(apart):
            place = np.minimum(np.searchsorted(apart, hashes), len(apart) - 1)
            at = np.flatnonzero(apart[place] == hashes)
            out[:, at] = table[:, place[at]]
        return out

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        deal, w = self.model.deal, short(w)
        key, bucket, hot = pair_key(v, w), deal.pair(v, w), deal.crowded(v)
        out = np.zeros(len(key))
        for kind, part in (("pairs", np.flatnonzero(~hot)), ("crowded", np.flatnonzero(hot))):
            if len(part):
                out[part] = self.find(kind, bucket[part], deal.buckets, key[part])[0]
        return out

    def probabilities(self, numbers: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a row of words (numbers into hashes): the model's probability of each but the first two, and its training count."""
        m = self.model
        used, at = np.unique(numbers, return_inverse=True)
        own, size = hashes[used], np.int64(len(used))
        table = self.words(own)
        # Equal pairs are looked up once, as pairs and as contexts.
        code, back = np.unique(at[:-1] * size + at[1:], return_inverse=True)
        a, b = own[code // size], own[code % size]
        before = self.pairs(a, b)
        key, bucket = context_key(short(a), b), m.deal.triple(short(a), b)
        context = self.find("contexts", bucket, m.deal.buckets, key)
        once = (context[0] == 0) & (before > 0)
        context[:2, once] = 1.0
        pair = back[:-1]
        n = self.find("triples", bucket[pair], m.deal.buckets, triple_key(key[pair], short(own[at[2:]])))[0]
        context = context[:, pair]
        share = lambda d, c: sum(a * b for a, b in zip(d, c[1:4], strict=True)) / np.maximum(c[0], 1)
        off = lambda d, c: np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3).astype(int)], 0)
        left = table[5][at[2:]]
        p = np.full(len(at) - 2, m.unknown)
        if m.pairs:
            p += off(m.word_discounts, left) / m.pairs
        middle = table[:, at[1:-1]]
        p = np.where(middle[0] > 0, off(m.pair_discounts, before[back[1:]]) / np.maximum(middle[0], 1) + share(m.pair_discounts, middle) * p, p)
        p = np.where(context[0] > 0, off(m.triple_discounts, n) / np.maximum(context[0], 1) + share(m.triple_discounts, context) * p, p)
        return p, table[4][at[2:]]


_READER: list[Reader] = []


def _reader(model: Model) -> Reader:
    """The worker process's reader of this model; a worker serves many tasks."""
    if not _READER or _READER[0].model.folder != model.folder:
        _READER[:] = [Reader(model)]
    return _READER[0]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score (add-one unigram), score (log10 of the model's probability), perplexity.

    One row per row of df, repeated rows and null ids included; null and empty texts are one end token. A file of the model
    that is missing or cut short is an error. Every worker process maps the arrays and reads the pages it needs.
    """
    arrow_batches(df.sparkSession, 1000)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, reader = _Words(), _reader(model)
        for b in batches:
            if not b.num_rows:
                continue
            sizes, known = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            base, total = np.zeros(b.num_rows), np.zeros(b.num_rows)
            held, rows, size = [], [], 0

            def judge() -> None:
                p, count = reader.probabilities(np.concatenate(held).astype(np.int64), np.array(words.hashes, np.uint64))  # noqa: B023
                own = np.repeat(np.array(rows), [len(h) for h in held])[2:]  # noqa: B023
                # The two words before a piece are not scored, nor what lies over the border of two pieces.
                ends = np.cumsum([len(h) for h in held])[:-1]  # noqa: B023
                ok = np.ones(len(own), bool)
                ok[ends - 2] = ok[ends - 1] = False
                own, p, count = own[ok], p[ok], count[ok]
                add = lambda to, v: np.add(to, np.bincount(own, v, len(to)), out=to, casting="unsafe")
                add(sizes, None)  # noqa: B023
                add(known, count > 0)  # noqa: B023
                add(base, np.log10((count + 1) / (model.tokens + 1 * (model.distinct + 1))))  # noqa: B023
                add(total, np.log10(p))  # noqa: B023

            for row, text in enumerate(b.column(1).cast(pa.binary())):
                for piece in _pieces(text.as_py()):
                    held.append(words.numbers(piece))
                    rows.append(row)
                    size += len(piece)
                    if size >= SCORED or len(words.hashes) >= REMEMBERED:
                        judge()
                        held, rows, size = [], [], 0
                        if len(words.hashes) >= REMEMBERED:
                            words = _Words()
            if held:
                judge()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(known), pa.array(base), pa.array(total), pa.array(10 ** (-total / sizes))], ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
