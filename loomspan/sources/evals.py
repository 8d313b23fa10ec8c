"""Evaluation manifests: samples with texts inline or in files beside the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.records import eval_samples


def read_evals(spark: SparkSession, path: str) -> DataFrame:
    """manifest, name, sample_id, golden_text, candidate_text, problem: one row per sample, or one with the problem of a manifest that can't be used.

    Texts are read from files named relative to their manifest where they are not given. A file that is not there gives the problem missing_file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("path").alias("manifest"), eval_samples(F.col("content").cast("string")).alias("m"))
    each = rows.select("manifest", "m.name", "m.problem", F.explode_outer("m.samples").alias("s"))
    folder = F.regexp_replace("manifest", "/[^/]*$", "/")
    at = lambda k: F.when(F.col(f"s.{k}_text").isNull(), F.when(F.col(f"s.{k}_path").rlike("^([a-z]+:|/)"), F.col(f"s.{k}_path")).otherwise(F.concat(folder, f"s.{k}_path")))
    each = each.select("manifest", "name", "problem", F.trim("s.sample_id").alias("sample_id"), F.col("s.golden_text").alias("g"), F.col("s.candidate_text").alias("c"), at("golden").alias("gp"), at("candidate").alias("cp"))
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("at"), F.col("content").cast("string").alias("text"))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    for k in ("g", "c"):
        each = each.join(texts.select(F.col("at").alias(f"{k}_at"), F.col("text").alias(f"{k}_read")), plain(F.col(f"{k}p")) == F.col(f"{k}_at"), "left")
    lost = F.col("gp").isNotNull() & F.col("g_read").isNull() | F.col("cp").isNotNull() & F.col("c_read").isNull()
    return each.select("manifest", "name", "sample_id", F.coalesce("g", "g_read").alias("golden_text"), F.coalesce("c", "c_read").alias("candidate_text"), F.coalesce("problem", F.when(lost & F.col("sample_id").isNotNull(), "missing_file")).alias("problem"))
