import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from loomspan.llm import suffixes

SCHEMA = "doc_id long, text string"


def brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in suffixes.removal_report(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, rows = [text(70), text(45), text(33)], []
    for i in range(60):
        t = text(rng.randrange(5, 150))
        for p in rng.sample(passage, rng.randrange(3)):
            cut = sorted(rng.sample(range(len(p) + 1), 2))
            at = rng.randrange(len(t) + 1)
            t = t[:at] + p[cut[0] : cut[1]] + t[at:]
        rows.append((i, t))
    for i in range(30):
        t = list(rows[i][1])
        t[rng.randrange(len(t))] = "X"
        rows.append((100 + i, "".join(t)))
    return rows + rows[:3] + [(None, None), (200, ""), (201, "a" * 199), (202, "a" * 450), (203, "ab" * 300), (204, rows[5][1][:150] * 3), (None, rows[7][1])]


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 7}, {"neighbours": 0}, {"held": 2}, {"held": 40}])
def test_against_brute_force(spark, options):
    rows = made(1)
    assert run(spark, rows, **options) == brute(rows)


def test_small_holds_and_other_lengths(spark, monkeypatch):
    rows = made(2)
    assert run(spark, rows, length=60, key=20) == brute(rows, 60)


def test_documents_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "é" * 150 + "tail", "x"), (2, "b" + "é" * 150, "y"), (3, None, None)]
    out = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    assert out.columns == ["doc_id", "text", "spans"]
    assert sorted((r.doc_id, r.text, r.spans) for r in out.collect()) == [(1, "tail", "x"), (2, "b", "y"), (3, None, None)]


def test_scan_of_a_group_larger_than_it_holds(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "HELD", 3)
    key = [1] * 9 + [2, 3, 3]
    full = [5] * 5 + [6, 7, 7, 8] + [1, 4, 4]
    rows = [np.array(c, np.int64) for c in (key, full, range(12), [0] * 12, [0] * 12)]
    batches = [pa.RecordBatch.from_arrays([*[pa.array(c[i : i + 2]) for c in rows], pa.array([True] * 2)], list("abcdef")) for i in range(0, 12, 2)]
    out = [tuple(r.values()) for b in suffixes._scan(iter(batches)) for r in b.to_pylist()]
    repeated = {r[2] for r in out if r[5]}
    lead = {r[2] for r in out if r[6]}
    assert repeated == {0, 1, 2, 3, 4, 6, 7, 10, 11} and {0, 5, 6, 8} <= lead and not lead & {9, 10}


def test_a_batch_for_an_index_opened_again(spark):
    """The spans of three batches, added to an index that is opened anew for each, are together those of all documents."""
    rows = [r for r in made(3)]
    random.Random(8).shuffle(rows)
    frame = lambda v: spark.createDataFrame(v, SCHEMA)
    parts = [rows[:30], rows[30:60], rows[60:]]
    index = suffixes.SuffixIndex(spark, suffixes.Scratch(spark, "kept", keep=True))
    root, spans = index.scratch.root, []
    for i, part in enumerate(parts):
        if i:
            index = suffixes.SuffixIndex.open(spark, root)
            assert index.count == i and [rank for rank, _, _ in index.levels] == [[0], [1]][i - 1]
        before = [r for p in parts[:i] for r in p]
        spans.append(suffixes.add_batch(index, frame(part), frame(before)).collect())
    left = {f.name.rsplit("-", 1)[0] for f in Path(root.removeprefix("file://").removeprefix("file:")).iterdir()}
    assert not left & {"batch", "hits", "crowded"}
    gone = {}
    for r in (r for found in spans for r in found):
        for s in r.spans:
            gone.setdefault((r.t1, r.t2), set()).update(range(s["start"], s["stop"]))
    keys = frame(rows).select("doc_id", *suffixes.text_key(F.col("text"))).collect()
    got = sorted((str(r.doc_id), len(gone.get((r.t1, r.t2), ()))) for r in keys)
    assert got == sorted((str(i), n) for i, _, n, _, _ in brute(rows))


def test_equal_hashes_are_compared_byte_by_byte():
    import numpy as np

    rows = [(1, 0, 0, 0, 0, False, b"abcdefgh"), (1, 0, 0, 0, 0, False, b"xabcdefy")]
    row = np.repeat([0, 1], 4)
    assert suffixes._same_bytes(rows, row, np.array([0, 0]), np.array([5, 4]), 5).tolist() == [True, False]


def test_windows_of_busy_keys_are_told_apart_by_their_bytes():
    import pyarrow as pa

    data = [b"abcabcab", b"xabcabz", b"abc"]
    columns = [[1] * 3, [0] * 3, [7, 8, 9], [0] * 3, [10, 20, 30], [False, True, False], data]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "full", "t1", "t2", "lo", "repeated", "data"])
    by = {}
    for b in suffixes._window_rows(4)(iter([batch])):
        for r in b.to_pylist():
            i = r["t1"] - 7
            at = r["start"] - 10 * (i + 1)
            by.setdefault(r["window"], set()).add(data[i][at : at + 4])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({d[i : i + 4] for d in data for i in range(len(d) - 3)})
