"""Pairs of images and texts, and pairings of tables, against plain versions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L
from loomspan.operators import images as I
from loomspan.operators import metrics as M
from loomspan.operators import similarity as S
from loomspan.operators import transcript as T


def test_near_hashes(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(160):
        h = rng.choice(base)
        for _ in range(rng.randrange(6)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, "ab"[i % 2], f"{h:016x}"))
    rows += [(900, "a", None), (901, "a", "xyz"), (902, "a", rows[0][2].upper())]
    first = {}
    for i, g, h in rows[:160] + rows[162:]:
        first.setdefault((g, h.lower()), i)
    items = [(g, i, int(h, 16)) for (g, h), i in first.items()]
    want = {(g, i, j, (x ^ y).bit_count()) for g, i, x in items for k, j, y in items if g == k and i < j and (x ^ y).bit_count() <= 7}
    got = {tuple(r) for r in I.near_hashes(spark.createDataFrame(rows, "id int, g string, h string"), "g", "id", "h", 7).collect()}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("find", [I.near_hashes, I.first_match])
def test_images_are_joined_without_a_broadcast(spark, find):
    """Spark takes sides for as small as they are before their parts are written out; one that looks like 10 MB fills the driver."""
    rows = [(i, "ab"[i % 2], f"{random.Random(i // 4).getrandbits(64) ^ (i % 4):016x}") for i in range(200)]
    found = find(spark.createDataFrame(rows, "id int, g string, h string"), "g", "id", "h", 7)
    assert found.collect() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 3, 7])
def test_first_match_equals_the_fold(spark, most):
    """Chains of near hashes, equal ones, malformed ones; rows are judged in order, each by those stored before."""
    rng = random.Random(most)
    rows, h = [], 0
    for i in range(300):
        h = rng.getrandbits(64) if rng.random() < 0.05 else h
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(64)
        rows.append((rng.randrange(10_000) * 300 + i, "abc"[i % 3], f"{h:016x}" if i % 2 else f"{h:016X}"))
    rows += [(-3, "a", None), (-2, "a", "xyz"), (-1, "b", rows[1][2][:15]), (4_000_000, "d", "0" * 16)]
    want, kept = {}, {}
    for i, g, x in sorted(rows):
        value = int(x, 16) if x and len(x) == 16 else None
        own = kept.setdefault(g, [])
        hit = next((j for j, v in own if value is not None and (v ^ value).bit_count() <= most), None)
        if hit is None and value is not None:
            own.append((i, value))
        want[g, i] = i if hit is None else hit
    got = I.first_match(spark.createDataFrame(rows, "id long, grp string, h string"), "grp", "id", "h", most)
    assert {(r.grp, r.id): r.matched for r in got.collect()} == want and len(set(want.values())) < 290


def test_contradictions_are_all_found(spark):
    rng = random.Random(7)
    say = lambda: " ".join(rng.choice(["yes", "no", "term1", "term2", "term3", "term4", "plan", "budget", "the", "of"]) for _ in range(rng.randrange(1, 7)))
    rows = [(f"s{i % 3}", i, say()) for i in range(150)] + [("s0", 900, ""), ("s0", 901, None), (None, 1, "no term1 term2"), (None, 2, "yes term1 term2")]
    left_out = {*L.NEGATION, *L.AFFIRMATION, *L.STOP}
    classes = {}
    for s, i, text in rows:
        words = set((text or "").split())
        side = "negative" if words & set(L.NEGATION) else "positive" if words & set(L.AFFIRMATION) else None
        if s and side:
            classes.setdefault((s, side, frozenset(w for w in words - left_out if len(w) > 2)), []).append(i)
    want = set()
    for (s, p, x), own in classes.items():
        for (t, q, y), other in classes.items():
            if s == t and p != q and len(x & y) >= 2 and own[0] < other[0]:
                want.add((s, own[0], other[0], ",".join(sorted(x & y)[:8]), len(own), len(other)))
    got = [tuple(r) for r in T.contradictions(spark.createDataFrame(rows, "source_id string, segment_index int, text string")).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


@pytest.mark.parametrize("block", [1, 2000])
@pytest.mark.parametrize("share", [0.25, 0.5, 0.8, 1.0])
def test_overlaps_are_all_found(spark, monkeypatch, share, block):
    """All pairs against every pair, hot words in one block or in many."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(9)
    base = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 30))] for _ in range(14)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append(("ab"[i % 2], i, " ".join(["the", *words])))
    rows += [("a", 500, None), ("a", 501, ""), ("a", None, "the w1"), (None, 502, rows[0][2]), (None, 503, rows[0][2])]
    sets = {}
    for g, i, text in rows:
        if g and i is not None and text:
            sets.setdefault((g, frozenset(text.split())), []).append(i)
    want = {}
    items = [(g, own[0], s, len(own)) for (g, s), own in sets.items()]
    for g, i, x, m in items:
        for k, j, y, n in items:
            if g == k and i < j and len(x & y) / len(x | y) >= share - 1e-12:
                want[g, i, j] = (round(len(x & y) / len(x | y), 6), m, n)
    for (g, _), own in sets.items():
        want |= {(g, own[0], j): (1.0, 1, 1) for j in own[1:]}
    got = {(r.grp, r.left_id, r.right_id): (r.overlap, r.left_copies, r.right_copies) for r in T.pairwise_overlap(spark.createDataFrame(rows, "grp string, id int, text string"), share).where("grp is not null").collect()}
    assert got == want and (len(got) > 20 or share == 1.0)


@pytest.mark.parametrize("head", [0, 3, 1024])
def test_blocks_and_tiles_lose_no_overlap(spark, monkeypatch, head):
    """Sets of one group over many blocks and tiles, few words counted as common; no pair is written that does not share enough."""
    for name, value in (("SIDE", 9), ("BLOCKS", 5), ("TILE", 4), ("HEAD", head)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(head)
    sets = [{f"w{int(rng.paretovariate(0.5)) % 200}" for _ in range(rng.randrange(1, 40))} for _ in range(90)]
    sets = sorted({tuple(sorted(s)) for s in sets})
    rows = [("g", f"d{i:03d}", list(s)) for i, s in enumerate(sets)]
    want = {(f"d{i:03d}", f"d{j:03d}") for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len({*x} & {*y}) / len({*x} | {*y}) >= 0.25 - 1e-12}
    frame = spark.createDataFrame(rows, "grp string, id string, own array<string>")
    assert {(r.left_id, r.right_id) for r in S.set_links(frame, 0.25).collect()} == want and len(want) > 20
    assert {(r.left_id, r.right_id) for r in S._close(frame, 0.25, 1).collect()} == want


def test_blocks_are_compared_in_pieces(monkeypatch):
    """One block is held while the other passes by; no batch of pairs, and no meeting of words, is larger than a piece."""
    monkeypatch.setattr(S, "PIECE", 7)
    monkeypatch.setattr(S, "MEETINGS", 5)
    rng = random.Random(4)
    sets = sorted(({rng.randrange(60) for _ in range(rng.randrange(1, 40))} for _ in range(90)), key=len)
    rows = [{"grp": "g", "low": 0, "high": high, "at_right": right, "id": i, "n": len(x), "lost": 0, "codes": sorted(x)} for high in (0, 1) for right in (0, 1)[: high + 1] for i, x in enumerate(sets) if i % 2 == right or not high and i % 2 == 0]
    schema = pa.schema([("grp", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("at_right", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("lost", pa.int32()), ("codes", pa.list_(pa.int32()))])
    out = pa.schema([("grp", pa.string()), ("a_id", pa.int64()), ("b_id", pa.int64())])
    parts = list(S._near(0.25, 1, 8, 3, out)(iter(pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=11))))
    got = sorted(tuple(sorted((r["a_id"], r["b_id"]))) for b in parts for r in b.to_pylist())
    want = sorted((i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and not (i % 2 and j % 2) and len(x & y) / len(x | y) >= 0.25)
    assert got == want and len(want) > 100 and max(map(len, parts)) <= 7


def test_long_texts_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "WORDS", 100)
    monkeypatch.setattr(S, "_near", lambda *a: lambda batches: (pa.RecordBatch.from_arrays([b["grp"], b["id"], pa.array([low * 1000 + high for low, high in zip(b["low"].to_pylist(), b["high"].to_pylist(), strict=True)], pa.int64())], ["grp", "a_id", "b_id"]) for b in batches))
    frame = spark.createDataFrame([("g", i, [f"w{i}-{k}" for k in range(50)]) for i in range(40)], "grp string, id long, own array<string>")
    held = {r.left_id if r.left_id >= 40 else r.right_id for r in S._close(frame, 0.25, 1).collect()}
    assert len(held) > 100


def test_words_are_taken_out_of_texts_once(spark, monkeypatch):
    """What counts words and looks them up gets written sets, not texts."""
    given, plain = [], S.by_rarity
    monkeypatch.setattr(S, "by_rarity", lambda classes: given.append(classes._jdf.queryExecution().toString()) or plain(classes))
    rows = [("g", i, f"{'no' if i % 2 else 'yes'} term{i % 3} term{i % 5} plan budget") for i in range(20)]
    assert T.contradictions(spark.createDataFrame(rows, "source_id string, segment_index int, text string")).count()
    assert len(given) == 1 and "Aggregate" not in given[0] and "regexp" not in given[0]


def test_relationships_do_no_more_than_the_largest_overlap_needs(spark, monkeypatch):
    """Groups whose largest overlap is at each level, against every pair; the blocks of all pairs only get groups that nothing before settles."""
    rng = random.Random(12)
    word = lambda g, k: f"{g}w{k}"
    rows = [(g, i, " ".join(word(g, rng.randrange(400)) for _ in range(30))) for g in ("same", "near", "half", "some", "none") for i in range(12)]
    rows += [("same", 50, "a b c"), ("same", 51, "c b a a"), ("one", 1, "a b"), (None, 1, "a b"), (None, 2, "a b"), ("empty", 1, ""), ("empty", 2, None), ("twice", 1, "a b"), ("twice", 1, "b a"), ("twice", 2, "c")]
    for g, n in (("near", 1), ("half", 6), ("some", 16)):
        rows += [(g, 60, " ".join(f"x{k}" for k in range(30))), (g, 61, " ".join(f"x{k}" for k in range(n, 30 + n)))]
    given = []
    close = S._close
    monkeypatch.setattr(S, "_close", lambda classes, *a: given.extend(r.grp for r in classes.select("grp").distinct().collect()) or close(classes, *a))
    want = {}
    for g in {r[0] for r in rows}:
        own = [(i, {*(t or "").split()}) for h, i, t in rows if h == g]
        best = max((len(x & y) / len(x | y) for k, (i, x) in enumerate(own) for j, y in own[k + 1 :] if g and i != j and x and y), default=0)
        want[g] = 1.0 if len(own) <= 1 else round(best, 6) if best >= L.RELATED_OVERLAP else 0.0
    got = {r.grp: r.overlap for r in T.relationships(spark.createDataFrame(rows, "grp string, id int, text string")).collect()}
    assert got == want and want["same"] == 1 and 0.8 <= want["near"] < 1 and 0.5 <= want["half"] < 0.8 and 0.25 <= want["some"] < 0.5
    assert {*given} == {"some", "none", "one", "twice"}


@pytest.mark.parametrize("block", [2, 2000])
@pytest.mark.parametrize("top", [1, 3, 40])
def test_retrieval_equals_full_ranking(spark, monkeypatch, top, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(top)
    say = lambda n: " ".join(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(n))
    chunks = [(i, say(rng.randrange(40))) for i in range(200)] + [(900, None), (901, "never asked")]
    asked = [(q, say(rng.randrange(1, 25))) for q in range(30)] + [(90, ""), (91, None), (92, "nowhere"), (93, "w1 w1 W1")]
    want = []
    for q, text in asked:
        words = set((text or "").lower().split())
        scored = sorted((-len(words & set((t or "").split())), c) for c, t in chunks)
        want += [(q, c, -n, k) for k, (n, c) in enumerate(scored[:top], 1) if n]
    frames = spark.createDataFrame(chunks, "chunk_id int, text string"), spark.createDataFrame(asked, "query_id int, query string")
    assert sorted(tuple(r) for r in S.retrieve(*frames, "text", top).collect()) == sorted(want)


def test_word_error_rate(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["a", "b", "ü", "日本", "c", " d"]) for _ in range(n))
    rows = [(say(rng.randrange(12)), say(rng.randrange(20))) for _ in range(60)] + [(None, None), ("", "x"), ("x", None), ("a b", "A b")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for r in spark.createDataFrame(rows, "r string, h string").select("r", "h", M.wer(F.col("r"), F.col("h")).alias("w")).collect():
        a, b = (r.r or "").split(), (r.h or "").split()
        assert abs(r.w - ((1.0 if b else 0.0) if not a else min(1.0, distance(a, b) / len(a)))) < 1e-9


def test_best_assignment(spark):
    rng = random.Random(3)
    rows = [(k, r, h, rng.randrange(4) / 4) for k in range(20) for r in range(rng.randrange(1, 5)) for h in range(rng.randrange(1, 6))]
    want = set()
    for k in range(20):
        free = {h for q, _, h, _ in rows if q == k}
        for ref in sorted({r for q, r, _, _ in rows if q == k}):
            own = [(s, h) for q, r, h, s in rows if q == k and r == ref and h in free]
            if own:
                s, h = max(own)
                free.discard(h)
                want.add((k, ref, h, s))
    assert {tuple(r) for r in M.best_assignment(spark.createDataFrame(rows, "k int, ref int, hyp int, score double"), "k").collect()} == want


@pytest.mark.parametrize("most", [1, 2, 6, 7])
def test_near_hashes_of_any_distance(spark, most):
    """Pairs at most and just beyond the distance, bits of every part, the highest bit too; each comes once."""
    rng = random.Random(most)
    rows = []
    for i in range(40):
        h = rng.getrandbits(64)
        rows += [(3 * i, "a", f"{h:016x}")]
        for k, n in enumerate((most, most + 1)):
            x = h
            for b in rng.sample(range(63), n - 1) + [63]:
                x ^= 1 << b
            rows.append((3 * i + 1 + k, "a", f"{x:016x}"))
    want = sorted((i, j, (int(x, 16) ^ int(y, 16)).bit_count()) for i, _, x in rows for j, _, y in rows if i < j and (int(x, 16) ^ int(y, 16)).bit_count() <= most)
    found = I.near_hashes(spark.createDataFrame(rows, "id int, g string, h string"), "g", "id", "h", most)
    assert sorted((r.left_id, r.right_id, r.distance) for r in found.collect()) == want and len(want) >= 40


def test_asked_texts_contradict_all_of_their_source(spark):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["yes", "no", "term1", "term2", "term3", "plan", "budget", "the"]) for _ in range(rng.randrange(1, 7)))
    rows = [(f"s{i % 2}", i, say()) for i in range(120)] + [("s0", 900, None), (None, 910, "no term1 term2")]
    left_out = {*L.NEGATION, *L.AFFIRMATION, *L.STOP}
    side = lambda w: "negative" if w & set(L.NEGATION) else "positive" if w & set(L.AFFIRMATION) else None
    items = [(s, i, side({*t.split()}), {w for w in {*t.split()} - left_out if len(w) > 2}) for s, i, t in rows if s and t]
    want = sorted((s, i, j, ",".join(sorted(x & y)[:8])) for s, i, p, x in items for t, j, q, y in items if s == t and p and q and p != q and i % 10 == 0 and (i < j or (i > j and j % 10)) and len(x & y) >= 2)
    found = T.contradicting(spark.createDataFrame(rows, "source_id string, segment_index int, text string"), F.col("segment_index") % 10 == 0, 3)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 5


def test_asked_texts_meet_their_source_without_a_join_of_pairs(spark):
    """All pairs against every pair, over several blocks; texts are compared by numbers of their words, and no pair is a row before it qualifies."""
    rng = random.Random(23)
    rows = [(f"s{i % 2}", i, " ".join([rng.choice(["yes", "no", "maybe"]), *rng.sample([f"term{k:02}" for k in range(30)], rng.randrange(1, 20))])) for i in range(120)] + [("s0", 500, ""), (None, 10, "no term01 term02"), (None, 11, "yes term01 term02")]
    sets = [(s, i, t.split()[0], {w for w in t.split()[1:]}) for s, i, t in rows if s and t and not t.startswith("maybe")]
    want = [(s, i, j, ",".join(sorted(x & y)[:8])) for s, i, p, x in sets for r, j, q, y in sets if s == r and p != q and i % 10 == 0 and (i < j or (i > j and j % 10)) and len(x & y) >= 2]
    out = T.contradicting(spark.createDataFrame(rows, "source_id string, segment_index long, text string"), F.col("segment_index") % 10 == 0)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) > 50
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
