"""Quality metrics, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.distance import edit_distance, list_distance
from loomspan.functions.scalars import facts

GATE = 0.80


def cer(reference: Column, hypothesis: Column) -> Column:
    n = F.length(reference)
    return F.when((n == 0) & (F.length(hypothesis) == 0), 0.0).when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), edit_distance(reference, hypothesis) / n))


def _as_text(words: Column, known: Column) -> Column:
    """A character per word: the word's place among the known ones, the first for all others."""
    code = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate on words between Unicode white space.

    Words are mapped to characters, so the distance is Spark's own; words that the reference lacks never match and share one. Long pairs are compared word by word, bit-parallel.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    a, b = words(reference), words(hypothesis)
    known = F.array_distinct(a)
    n = F.size(a)
    return F.when((n == 0) & (F.size(b) == 0), 0.0).when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), list_distance(a, b, F.levenshtein(_as_text(a, known), _as_text(b, known))) / n))


def fact_recall(reference: Column, hypothesis: Column) -> Column:
    want = facts(reference)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, facts(hypothesis))) / F.size(want))


def combined(cer_col: Column, wer_col: Column, facts_col: Column, table_col: Column) -> Column:
    text = (1 - cer_col + 1 - wer_col + facts_col) / 3
    return F.round(F.when(table_col.isNotNull(), (table_col + facts_col) / 2).otherwise(text), 6)


def cell_recall(reference: DataFrame, hypothesis: DataFrame, key: str) -> DataFrame:
    """Share of a reference table's cells (key, row, col, value) that the hypothesis has in the same place."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    h = hypothesis.select(F.col(key).alias("_k"), F.col("row").alias("_r"), F.col("col").alias("_c"), norm(F.col("value")).alias("_v"))
    joined = reference.join(h, (F.col(key) == F.col("_k")) & (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "left")
    return joined.groupBy(key).agg(F.count("*").alias("cells"), F.round(F.avg(F.when(norm(F.col("value")) == F.col("_v"), 1.0).otherwise(0.0)), 6).alias("recall"))


def best_assignment(scores: DataFrame, key: str) -> DataFrame:
    """Greedy pairing of a sample's tables, reference by reference: of the free hypotheses that with the best score, of equal scores the highest; rows key, ref, hyp, score.

    Each choice hangs on those before, so the pairs of a sample, which has few tables, are folded in one row.
    """
    pairs = F.array_sort(F.collect_list(F.struct("ref", (-F.col("score").cast("double")).alias("s"), (-F.col("hyp").cast("bigint")).alias("h"))))
    taken = F.array().cast("array<struct<ref:bigint,s:double,h:bigint>>")
    free = lambda out, p: ~F.exists(out, lambda o: (o["ref"] == p["ref"]) | (o["h"] == p["h"]))
    kept = F.aggregate(F.col("pairs").cast("array<struct<ref:bigint,s:double,h:bigint>>"), taken, lambda out, p: F.when(free(out, p), F.array_append(out, p)).otherwise(out))
    each = scores.groupBy(key).agg(pairs.alias("pairs")).select(key, F.explode(kept).alias("p"))
    return each.select(key, "p.ref", (-F.col("p.h")).alias("hyp"), (-F.col("p.s")).alias("score"))


def report(scores: DataFrame) -> DataFrame:
    """samples, mean combined, whether it passes, and the samples under the gate."""
    under = F.sort_array(F.collect_list(F.when(F.col("combined") < GATE, F.col("sample_id"))))
    return scores.groupBy("config").agg(F.count("*").alias("samples"), F.round(F.avg("combined"), 6).alias("mean_combined"), (F.avg("combined") >= GATE).alias("passing"), F.size(under).cast("long").alias("regressions"), F.sha2(F.array_join(under, ","), 256).alias("regression_ids"))


def compare(reports: DataFrame, baseline: str, candidate: str) -> DataFrame:
    b = reports.where(F.col("config") == baseline).select(F.col("mean_combined").alias("baseline"))
    c = reports.where(F.col("config") == candidate).select(F.col("mean_combined").alias("candidate"), "passing")
    delta = F.round(F.col("candidate") - F.col("baseline"), 6)
    return b.crossJoin(c).select("baseline", "candidate", delta.alias("delta"), (F.col("passing") & (delta > 0)).alias("should_swap"))


def class_gate(scores: DataFrame, required: list[str]) -> DataFrame:
    """Per required class: samples, whether all are over the gate; classes without samples are missing."""
    want = scores.sparkSession.createDataFrame([(c,) for c in required], "class string")
    own = scores.groupBy("class").agg(F.count("*").alias("samples"), F.bool_and(F.col("combined") >= GATE).alias("ok"))
    return want.join(own, "class", "left").select("class", F.coalesce("samples", F.lit(0)).alias("samples"), F.when(F.col("samples").isNull(), "missing").when(F.col("ok"), "ok").otherwise("regression").alias("state"))


def ocr_checks(text: Column) -> Column:
    """struct(accepted, score, repeat_ratio) of a recognised text."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    own = F.regexp_extract_all(F.lower(clean), F.lit(r"[\p{L}\p{N}_]+"), 0)
    n = F.size(own)
    same = F.size(F.filter(F.zip_with(F.slice(own, 1, F.greatest(n - 1, F.lit(0))), F.slice(own, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda v: v))
    repeat = F.when(n < 6, 0.0).otherwise(same / F.greatest(n - 1, F.lit(1)))
    bad = F.regexp_count(clean, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f�]"))
    gibberish = F.when(F.length(clean) == 0, 1.0).otherwise(bad / F.length(clean))
    checks = [F.length(clean) > 0, repeat < 0.25, gibberish < 0.05, F.lit(True)]
    score = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int")) / 4
    return F.struct((score >= 1.0).alias("accepted"), score.alias("score"), F.round(repeat, 6).alias("repeat_ratio"))
