import hashlib
import re

import pytest

from loomspan.llm import mixing


def plan(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    """Targets by sharing out again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * left / total > cap * sizes[s]}
        if not over:
            target |= {s: w[s] * left / total for s in open_}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + n_words(t)
    target, out = plan(sizes), []
    for s, size in sizes.items():
        ratio = min(target[s] / size, 3.0) if size else 0.0
        whole, p, rest = int(ratio), ratio - int(ratio), target[s] - int(ratio) * size
        keyed = {}
        for i, t, x in rows:
            if x != s:
                continue
            said = f"{'' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}|42"
            u = (int(hashlib.md5(said.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k = ((u / (1 - u)) / (p / (1 - p)) if p else 0.0, -1 if i is None else i, n_words(t))
            keyed[k] = keyed.get(k, 0) + 1
        upto, once = 0, set()
        for k in sorted(keyed):
            if p and upto + keyed[k] * k[2] / 2 <= rest:
                once.add(k)
            upto += keyed[k] * k[2]
        for k, n in keyed.items():
            out += [(None if k[1] == -1 else k[1], k[2], size, round(target[s], 6), k[2] * (whole + (k in once)))] * n
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).select("id", "size", "source_size", "target", "taken").collect()
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in out), key=str)


def test_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "a", None), (3, "k " * 500, "big"), (4, "k " * 20, "big"), (5, "", "empty"), (6, "s", "small"), (None, "t u", "x")]
    got = run(spark, rows)
    assert got == brute(rows) and all(t[4] <= 3 * t[1] for t in got)


def test_empty_table(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(df).count() == 0


def test_sources_come_near_their_targets(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    by = {}
    for r in mixing.mix(df).collect():
        t = by.setdefault(r.source, [r.target, 0, r.source_size])
        t[1] += r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for target, taken, _ in by.values():
        assert taken == pytest.approx(target, rel=0.05)


def test_mixed_rows_agree_with_the_plan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("lang", "target")
    want = {r.id: r.copies for r in mixing.mix(df).collect() if r.copies and r.size}
    out = mixing.mixed(df)
    assert {r.doc_id: r.copies for r in out.collect()} == want
    assert out.columns == ["doc_id", "text", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]
