import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.llm import ensemble, rules, textstats

TEXTS = [
    None, "", " \n\t\x0b\x0c\r", "one", "a b c", "a b c a b c", "a b c d a b c d e", "a a a a a", "x y\nx y\n\n \nx y\nz", "é#*$%&|<>!! É b",
    "the cat sat " * 40, "w " * 3 + "\n" + "w " * 3, " ".join(f"t{i}" for i in range(60)), "a b c d " + " ".join(f"u{i % 7}" for i in range(5000)),
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cov)


def test_base_statistics_against_brute_force(spark, sf_dir):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")
    out = rules.judged(df, []).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)


def test_learned_list_is_ordered_and_precise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = rules.learned(docs, labels)
    assert 1 <= len(found) <= rules.RULES and all(1 <= len(r) <= rules.CONDITIONS for r in found)
    out = rules.judged(docs, found).join(labels, "doc_id")
    clean = out.where("quality = 1 and not base_failed")
    assert clean.where("not kept").count() <= 0.02 * clean.count()
    bad = out.where("quality = 0")
    assert bad.where("kept").count() <= 0.1 * bad.count()
    kept = rules.keep(docs, found)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


@pytest.mark.parametrize("sample", [[], [([0.0] * 12, 1)] * 5, [([0.0] * 12, 0)] * 5])
def test_learning_from_nothing(sample):
    assert rules.learn(sample) in ([],) or all(rules.learn(sample))
    model = ensemble.train(sample)
    assert model.rules == ()


def test_prunes_noise():
    sample = [([float(i), float(i * 7919 % 101)], int(i < 50)) for i in range(100)]
    (rule,) = rules.learn(sample, ("a", "b"))
    assert [c.feature for c in rule] == ["a"] and rule[0].at_least and 48 < rule[0].cut < 53


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = ensemble.fit(docs, labels)
    assert model.rules and len(model.rules) < 200
    out = ensemble.scored(docs, model).select("doc_id", "score", "predicted", ensemble.held_out(F.col("doc_id")).alias("held_out"))
    rows = out.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_scores_agree_with_the_model_row_by_row(spark):
    model = ensemble.Ensemble(0.25, (((rules.Condition("log_words", True, 1.0), rules.Condition("symbol_ratio", False, 0.5)), 1.5), ((rules.Condition("mean_word", True, 2.0),), -2.0)))
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, "# #")], "doc_id long, text string")
    out = {r.doc_id: r.score for r in ensemble.scored(df, model).collect()}
    import math

    s = lambda v: 1 / (1 + math.exp(-v))
    assert out[1] == pytest.approx(s(0.25 + 1.5 - 2.0)) and out[2] == pytest.approx(s(0.25)) and out[3] == pytest.approx(s(0.25))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.learned(docs, labels) == []
    assert ensemble.scored(docs, ensemble.fit(docs, labels)).count() == 0
    assert textstats.base_stats(docs).count() == 0
