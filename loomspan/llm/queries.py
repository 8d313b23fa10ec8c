"""Registered queries of the training-data operators, and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import alignment, chaining, chat, decontamination, disclosure, ensemble, kneserney, licences, mixing, rules, simhash, suffixes, trie
from loomspan.llm.common import Scratch, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.per_document(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


#: A conversation whose texts look like the template of common chat formats (fixed values).
TRICKY = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_windows(rows)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows", "max_tokens")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.report(found).drop("text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneserney.train(docs.where(kneserney.is_training(F.col("doc_id"))))
    found = kneserney.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (~kneserney.is_training(F.col("id"))).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rules.learned(docs, table(spark, sf_dir, "labels"))
    return rules.judged(docs, found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ensemble.fit(docs, table(spark, sf_dir, "labels"))
    return ensemble.scored(docs, model).select("doc_id", ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.removal_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return trie.prefix_trie(*trie.share_openings(trie.turns(rows, scratch), scratch), scratch).drop("words")


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = disclosure.spans(docs, disclosure.disclosing_terms(docs))
    return disclosure.report(found).withColumnRenamed("id", "doc_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


DOCUMENTS = "select doc_id, text, source from documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_licences": op3_licences,
        "op4_chat_format": op4_chat_format,
        "op5_decontamination": op5_decontamination,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_quality_rules": op7_quality_rules,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_mixing": op9_mixing,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_disclosure": op12_disclosure,
        "op13_alignment": op13_alignment,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontamination": decontamination.SQL.replace("{rows}", DOCUMENTS),
        "op9_mixing": mixing.SQL.replace("{rows}", DOCUMENTS),
        "op11_prefix_trie": trie.SQL,
    }
