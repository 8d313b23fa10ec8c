import functools
import math
import os
import zlib
from collections import Counter, defaultdict

import pytest

from loomspan.llm import kneserney as K


def tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


def plain(train, texts):
    """The same model from dictionaries."""
    uni, tri = Counter(), Counter()
    begin = b" begin"
    rows = lambda t: (lambda w: (w, list(zip([begin, begin] + w, [begin] + w, w))))(tokens(t))
    for t in train:
        w, found = rows(t)
        uni.update(w)
        tri.update(found)
    n, v = sum(uni.values()), len(uni)
    bi = Counter()
    for (_, b, c), k in tri.items():
        bi[b, c] += k if b == begin else 1
    before, after, follow = Counter(w for _, w in bi), defaultdict(Counter), defaultdict(Counter)
    for (a, b), c in bi.items():
        after[a][b] = c
    for (a, b, w), c in tri.items():
        follow[a, b][w] = c
    tally = lambda c: [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
    dt, dp, dw = K.discounts(tally(tri)), K.discounts(tally(bi)), K.discounts(tally(before))
    off = lambda d, c: 0.0 if not c else d[min(c, 3) - 1]

    @functools.cache
    def sums(name, key, d):
        counts = (follow, after)[name][key]
        return sum(counts.values()), sum(off(d, c) for c in counts.values())

    def level(name, key, d, w, low):
        if key not in (follow, after)[name]:
            return low
        total, cut = sums(name, key, d)
        c = (follow, after)[name][key][w]
        return max(c - off(d, c), 0) / total + cut / total * low

    unseen = sum(off(dw, c) for c in before.values()) / len(bi) / (v + 1) if bi else 1.0

    def p(a, b, w):
        low = unseen
        if before[w]:
            low += (before[w] - off(dw, before[w])) / len(bi)
        return level(0, (a, b), dt, w, level(1, b, dp, w, low))

    out = []
    for t in texts:
        w, found = rows(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(*f)) for f in found)))
    return n, v, p, uni, out


@pytest.mark.parametrize(("bucket", "crowd"), [(K.BUCKET, None), (4000, None), (4000, 400)])
def test_against_plain_model(spark, sf_dir, bucket, crowd):
    """With small buckets and with words that count as crowded, too."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [(None, None), (None, "A b a"), (900, ""), (901, "never seen words " * 3), (902, "the " * 700)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    train = [t for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    model = K.train(df.where(K.is_training(df.doc_id)), bucket=bucket, crowd=crowd)
    assert (crowd is not None) == (len(model.deal.crowd) > 0)
    n, v, _, _, want = plain(train, [t for _, t in docs])
    assert (model.tokens, model.distinct) == (n, v)
    got = sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in K.score(df, model).collect())
    assert got == sorted((str(i), *w[:2], round(w[2], 6), round(w[3], 6)) for (i, _), w in zip(docs, want))


def test_probabilities_sum_to_one():
    _, _, p, uni, _ = plain(["a b a b c", "b c", "", "d"], [])
    for context in [(b" begin", b" begin"), (b" begin", b"a"), (b"a", b"b"), (b"c", b"b"), (b"b", b"zzz")]:
        assert sum(p(*context, w) for w in uni) + p(*context, b"unknown") == pytest.approx(1.0)


def test_better_than_unigrams_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = K.train(docs.where(K.is_training(docs.doc_id)))
    rows = [r for r in K.score(docs, model).collect() if zlib.crc32(str(r.id).encode()) % 7 == 2]
    assert len(rows) > 100 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = K.train(df)
    assert model.tokens == 0 and K.score(df, model).count() == 0
    assert K.score(spark.createDataFrame([(1, "x")], df.schema), model).first().score == 0.0


def test_missing_and_cut_files_are_errors(spark):
    """A worker that can't see a file of the model must fail, not take its words for unknown."""
    df = spark.createDataFrame([(i, f"some words of text {i % 7} and more {i % 5}") for i in range(50)], "doc_id long, text string")
    for damage in (os.remove, lambda f: os.truncate(f, os.path.getsize(f) - 1)):
        for kind in ("triples", "words"):
            model = K.train(df, bucket=100)
            assert model.folder.startswith("file:")
            folder = K._mounted(model.folder)
            for name in os.listdir(folder):
                if name.startswith(kind):
                    damage(f"{folder}/{name}")
            with pytest.raises(Exception, match="No such file|not a whole array"):
                K.score(df, model).select("score").collect()


def test_words_of_very_long_texts_and_hash_arrays():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    counts = [rng.integers(0, 600, len(keys)), rng.integers(0, 3, len(keys))]
    parts = K.HashArray.parts(keys, counts)
    array = K.HashArray(np.frombuffer(b"".join(np.ascontiguousarray(p).tobytes() for p in parts), np.uint8), "x")
    place = array.find(keys)
    assert (place >= 0).all() and [c.astype(int).tolist() for c in array.counts(place)] == [c.tolist() for c in counts]
    assert (array.find(keys ^ np.uint64(1 << 20)) < 0).mean() > 0.99
