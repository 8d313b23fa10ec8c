"""Statistics of whole texts as Spark columns, without Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import SPACES, word_array

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The statistics that learned rules may use; each is a ratio or a mean, so it means the same for short and long texts.
FEATURES = ("log_words", "mean_word", "symbol_ratio", "pipe_ratio", "bang_ratio", "upper_ratio", "digit_ratio", "stop_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "words_per_line")


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def count_of(text: Column, characters: str) -> Column:
    """How many of these ASCII characters the text has."""
    return (F.octet_length(text) - F.octet_length(_without(text, characters))).cast("long")


def base_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts (names beginning with _c_).

    Null texts count as empty: all counts are zero. Repeated word windows are found by sorting the hashes of a text's three-word
    windows (XXH64), in the row, without a shuffle. Columns of df that have these names are replaced.
    """
    stage = df.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    stage = stage.withColumn("_w", word_array(F.col("_t"))).withColumn("_n", F.size("_w"))
    triples = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))
    stage = stage.withColumn("_s", F.when(F.col("_n") >= 4, F.sort_array(triples)))
    same = lambda i, j: F.coalesce(F.get(F.col("_s"), i)["h"] == F.get(F.col("_s"), j)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    stage = stage.withColumn("_r", F.when(F.col("_s").isNotNull(), F.transform(twice, lambda i: F.get(F.col("_s"), i)["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_r", lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.filter(F.split("_t", "\n"), lambda x: _without(x, SPACES) != "")
    stage = stage.withColumn("_l", lines)
    made = {
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(_without(F.col("_t"), SPACES)).cast("long"),
        "n_symbols": count_of(F.col("_t"), SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.when(F.col("_r").isNotNull(), covered).otherwise(0).cast("long"),
        "_c_lines": F.size("_l"),
        "_c_distinct": F.size(F.array_distinct("_w")),
        "_c_pipes": count_of(F.col("_t"), "|"),
        "_c_bangs": count_of(F.col("_t"), "!"),
        "_c_digits": count_of(F.col("_t"), "0123456789"),
        "_c_stops": count_of(F.col("_t"), ".,;:?"),
        "_c_upper": F.octet_length("_t") - F.octet_length(F.translate("_t", UPPER, "")),
    }
    # A generator of one row: a filter on a count is not pushed below it, where the optimizer would
    # put the arrays' expressions into each other and into the functions applied to their elements.
    own = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return stage.select(*own, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def features(stats: DataFrame) -> DataFrame:
    """stats of base_stats with the columns of FEATURES, each finite for every text."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    made = {
        "log_words": F.log1p("n_words"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "pipe_ratio": per("_c_pipes", "n_words"),
        "bang_ratio": per("_c_bangs", "n_words"),
        "upper_ratio": per("_c_upper", "word_chars"),
        "digit_ratio": per("_c_digits", "word_chars"),
        "stop_ratio": per("_c_stops", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "_c_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "distinct_ratio": per("_c_distinct", "n_words"),
        "words_per_line": F.log1p(per("n_words", "_c_lines")),
    }
    return stats.withColumns(made)


def labelled_sample(df: DataFrame, labels: DataFrame, target: str, limit: int, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> list[tuple[list[float], int]]:
    """At most limit labelled rows as (values of FEATURES, label): those of smallest id hash, a bounded, documented sample.

    Only the sampled documents' statistics are computed. Rows without id or label are left out; a document labelled twice counts twice.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).select(F.col(id_col).alias("_id"), F.col(target).cast("int").alias("_y"))
    if where is not None:
        chosen = chosen.where(where)
    total = chosen.count()
    if total > 2 * limit:
        # Rows under a bound of the hash hold the sample, so no task sorts more than about its share of it.
        part = limit / total
        bound = lambda share: chosen.where(F.xxhash64("_id") < int(-(2.0**63) + share * 2.0**64))
        while part < 0.5 and bound(part := min(0.5, 1.5 * part)).limit(limit).count() < limit:
            pass
        chosen = bound(part) if part < 0.5 else chosen
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(limit)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    return [([float(v) for v in r[:-2]], int(r[-2])) for r in features(base_stats(rows, "_text")).select(*FEATURES, "_y", "_id").orderBy("_id", "_y", *FEATURES).collect()]
