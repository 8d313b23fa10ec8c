"""Scans over ranges, transforms, shared budgets and long edit distances against plain versions."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions.distance import distance
from loomspan.operators import metrics as M
from loomspan.operators import scan as S
from loomspan.operators import transcript as T
from loomspan.operators import transforms as P
from loomspan.session import Cuts


@pytest.fixture
def ranges(spark):
    """Small tables are dealt into eight ranges too, so that groups lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums(ranges):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", "c", None]), i, draw.randrange(9)) for i in range(400)]
    df = ranges.createDataFrame(rows, "g string, at int, n int")
    got = S.running_sums(df, "g", ["at"], {"before": F.col("n"), "place": F.lit(1)}, Cuts(ranges), "x")
    want, sums = set(), {}
    for g, at, n in sorted(rows, key=lambda r: r[1]):
        s, k = sums.get(g, (0, 0))
        want.add((g, at, n, s, k))
        sums[g] = s + n, k + 1
    assert set(map(tuple, got.collect())) == want


def test_open_depths(ranges):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), i, draw.choice("((())))x")) for i in range(500)]
    got = S.open_depths(ranges.createDataFrame(rows, "g string, at int, c string"), "g", ["at"], F.col("c") == "(", F.col("c") == ")", Cuts(ranges), "x")
    want, depth = {}, {}
    for g, at, c in rows:
        d = depth.get(g, 0)
        want[at] = (d, c == ")" and d == 0)
        depth[g] = d + 1 if c == "(" else max(0, d - 1) if c == ")" else d
    assert {r["at"]: (r.depth, r.unmatched) for r in got.collect()} == want and len({r._part for r in got.collect()}) > 4


def plain_boxes(ops):
    out, stacks = {}, {}
    for page, seq, op, m, image in sorted(ops, key=lambda r: r[:2]):
        stack = stacks.setdefault(page, [P.UNIT])
        if op == "q":
            stack.append(stack[-1])
        elif op == "Q" and len(stack) > 1:
            stack.pop()
        elif op == "cm" and m and len(m) == 6:
            stack[-1] = P.times(tuple(m), stack[-1])
        elif op == "Do" and image:
            points = [P.times((1, 0, 0, 1, x, y), stack[-1])[4:] for x in (0, 1) for y in (0, 1)]
            out[page, seq] = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points))
    return out


def operators(draw, n, pages):
    ops = []
    for i in range(n):
        op = draw.choice(["q", "q", "Q", "cm", "cm", "Do", "Do", "other"])
        turn, size = draw.randrange(4), draw.choice([0.5, 1.0, 2.0])
        c, s = [(size, 0.0), (0.0, size), (-size, 0.0), (0.0, -size)][turn]
        m = [c, s, -s, c, float(draw.randrange(-9, 90)), float(draw.randrange(-9, 90))] if op == "cm" and draw.random() < 0.95 else None
        ops.append((draw.randrange(pages), i, op, m, draw.random() < 0.9))
    return ops


OPS = "page int, seq int, op string, m array<double>, image boolean"


@pytest.mark.parametrize("pages", [1, 3, 60])
def test_image_boxes(ranges, pages):
    """One page over all ranges, few pages, many; nested, rotated, and restored more often than saved."""
    ops = operators(random.Random(pages), 600, pages)
    got = {(r.page, r.seq): (r.x0, r.y0, r.x1, r.y1) for r in P.image_boxes(ranges.createDataFrame(ops, OPS), Cuts(ranges)).collect()}
    want = plain_boxes(ops)
    assert set(got) == set(want) and all(abs(x - y) <= 1e-9 * max(1, abs(y)) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_sandwich(ranges):
    draw = random.Random(8)
    ops = operators(draw, 300, 6)
    pages = [(p, 100.0, 150.0) for p in range(8)]
    texts = [(draw.randrange(9), draw.uniform(-30, 140), draw.uniform(-30, 180), draw.randrange(5)) for _ in range(500)]
    want, boxes = {}, plain_boxes(ops)
    for p, w, h in pages:
        own = [b for (q, _), b in boxes.items() if q == p]
        share = [(b[2] - b[0]) * (b[3] - b[1]) / (w * h) for b in own]
        large = [b for b, s in zip(own, share, strict=True) if s >= 0.4]
        said = [t for t in texts if t[0] == p]
        total = sum(t[3] for t in said)
        on = sum(n for _, x, y, n in said if any(b[0] - 5 <= x <= b[2] + 5 and b[1] - 5 <= y <= b[3] + 5 for b in large))
        want[p] = (len(own), sum(s >= 0.7 for s in share), round(on / total, 6) if total else 0.0)
    frames = ranges.createDataFrame(ops, OPS), ranges.createDataFrame(texts, "page int, x double, y double, chars int"), ranges.createDataFrame(pages, "page int, width double, height double")
    assert {r.page: tuple(r)[1:] for r in P.sandwich(*frames).collect()} == want


def test_batch_budget(ranges):
    draw = random.Random(4)
    rows = [(b, s, i, None if draw.random() < 0.1 else "w " * draw.randrange(40)) for b in range(3) for s in range(30) for i in range(draw.randrange(1, 25))]
    want = {}
    for b in range(3):
        remaining = 200
        for s in range(30):
            own = [t for x, y, _, t in rows if (x, y) == (b, s)]
            kept = own[: max(0, remaining)]
            words = [len((t or "").split()) for t in kept]
            want[b, s] = (len(own), len(kept), len(own) > len(kept), sum(min(20, n) for n in words), sum(n > 20 for n in words), remaining)
            remaining -= min(len(own), max(0, remaining))
    got = T.batch_compacted(ranges.createDataFrame(rows, "batch int, source_id int, segment_index int, text string"))
    assert {(r.batch, r.source_id): tuple(r)[2:] for r in got.collect()} == want


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@given(st.text("abü", max_size=90), st.text("abü", max_size=90))
@settings(max_examples=500, deadline=None)
def test_distance(a, b):
    assert distance(a, b) == plain_distance(a, b) == distance(list(b), list(a))


def test_distance_of_long_texts():
    draw = random.Random(3)
    a = "".join(draw.choice("abcdefgh ") for _ in range(100_000))
    b = list(a)
    for _ in range(500):
        b[draw.randrange(1000, 99_000)] = "Z"
    began = time.time()
    assert distance(a, "".join(b)) == sum(x != y for x, y in zip(a, b, strict=True))
    assert time.time() - began < 30


def test_error_rates_of_long_and_short_pairs(spark):
    draw = random.Random(6)
    say = lambda n: " ".join(draw.choice(["one", "two", "three", "ü"]) for _ in range(n))
    rows = [(say(n), say(n + 3)) for n in (0, 1, 5, 50, 400, 1500)] + [("", ""), ("x", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", M.cer(F.col("a"), F.col("b")).alias("c"), M.wer(F.col("a"), F.col("b")).alias("w")).collect():
        n, m = len(r.a), len(r.a.split())
        assert abs(r.c - (min(1.0, distance(r.a, r.b) / n) if n else float(bool(r.b)))) < 1e-9
        assert abs(r.w - (min(1.0, distance(r.a.split(), r.b.split()) / m) if m else float(bool(r.b.split())))) < 1e-9
