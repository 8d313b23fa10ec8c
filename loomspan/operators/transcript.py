"""Transcript analytics: segments, warnings, risk, speakers, polarity, contradictions, overlap, notes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import lexicons as L
from loomspan.operators.scan import running_sums
from loomspan.operators.similarity import members, set_links, twins
from loomspan.session import Cuts

WORDS = "[A-Za-z0-9]+"


def lexicon(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column) -> Column:
    """ASCII words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def to_ms(seconds: Column) -> Column:
    """Milliseconds, halves to even."""
    return F.bround(seconds * 1000).cast("long")


def normalize_segments(raw: DataFrame, low: float = L.LOW_CONFIDENCE, gap_ms: int = L.LONG_GAP_MS) -> DataFrame:
    """Segments of each source in order of start, then position, with ids, times in milliseconds and warnings.

    raw: source_id, pos, start, end (seconds), text, confidence, no_speech_prob, avg_logprob, compression_ratio, overlap_warning, speaker.
    """
    order = W.partitionBy("source_id").orderBy(F.coalesce("start", F.lit(0.0)), "pos")
    out = raw.withColumn("segment_index", F.row_number().over(order).cast("long"))
    out = out.withColumn("start_ms", F.greatest(F.lit(0), to_ms(F.coalesce("start", F.lit(0.0)))))
    out = out.withColumn("end_ms", F.greatest("start_ms", to_ms(F.coalesce("end", F.lit(0.0)))))
    out = out.withColumn("previous_end", F.coalesce(F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    clamp = lambda c: F.when(c.isNull() | F.isnan(c.cast("double")), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    out = out.withColumn("confidence", clamp(F.col("confidence"))).withColumn("no_speech_prob", clamp(F.col("no_speech_prob")))
    overlaps = F.col("start_ms") < F.col("previous_end")
    rules = [
        (F.col("text") == "", "empty_text"),
        (F.col("end_ms") <= F.col("start_ms"), "zero_duration"),
        (F.col("confidence") < low, "low_confidence"),
        (overlaps, "overlaps_previous"),
        (F.coalesce("overlap_warning", F.lit(False)) & ~overlaps, "overlap_warning"),
        (F.col("start_ms") > F.col("previous_end") + gap_ms, "long_gap_before_segment"),
        (F.col("no_speech_prob") >= L.HIGH_NO_SPEECH, "high_no_speech_probability"),
        (F.col("avg_logprob") <= L.LOW_LOGPROB, "low_avg_logprob"),
        (F.col("compression_ratio") >= L.HIGH_COMPRESSION, "high_compression_ratio"),
    ]
    out = out.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])))
    return out.withColumn("segment_id", F.format_string("%s_seg_%04d", "source_id", "segment_index")).withColumn("speaker", F.coalesce(F.when(F.col("speaker") != "", F.col("speaker")), F.lit("speaker_0")))


def risk_summary(segments: DataFrame) -> DataFrame:
    """One row per source: counts of warnings, level, speech time and whether review is required."""
    has = lambda n: F.array_contains("warnings", n)
    out = segments.groupBy("source_id").agg(
        F.count("*").alias("segments"),
        F.count_if(F.size("warnings") > 0).alias("segment_warning_count"),
        F.count_if(has("low_confidence")).alias("low_confidence_count"),
        F.count_if(F.col("confidence").isNull()).alias("unknown_confidence_count"),
        F.count_if(has("empty_text")).alias("empty_segment_count"),
        F.count_if(has("overlaps_previous") | has("overlap_warning")).alias("overlap_count"),
        F.count_if(has("long_gap_before_segment")).alias("long_gap_count"),
        F.count_if(has("high_no_speech_probability")).alias("no_speech_probability_flags"),
        F.count_if(has("low_avg_logprob")).alias("avg_logprob_flags"),
        F.count_if(has("high_compression_ratio")).alias("compression_ratio_flags"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.sum(F.size(F.regexp_extract_all("text", F.lit(WORDS), 0))).alias("word_count"),
        F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speech_ms"),
        F.max("end_ms").alias("duration_ms"),
    )
    flags = F.col("no_speech_probability_flags") + F.col("avg_logprob_flags") + F.col("compression_ratio_flags")
    out = out.withColumn("level", F.when(F.col("low_confidence_count") + F.col("empty_segment_count") + flags > 0, "review").otherwise("clean"))
    review = (F.col("overlap_count") + F.col("long_gap_count") + F.col("empty_segment_count") + flags > 0) | (F.col("unknown_confidence_count") > F.floor(F.col("segments") / 2))
    out = out.withColumn("review_required", review).withColumn("speech_seconds", F.round(F.col("speech_ms") / 1000.0, 3))
    out = out.withColumn("words_per_minute", F.when(F.col("speech_ms") > 0, F.round(F.col("word_count") / (F.col("speech_ms") / 60000.0), 3)))
    return out.withColumn("speech_coverage", F.when(F.col("duration_ms") > 0, F.round(F.col("speech_ms") / F.col("duration_ms"), 6)))


def batch_risk(risk: DataFrame) -> DataFrame:
    return risk.agg(F.count("*").alias("source_count"), F.count_if(F.col("level") == "review").alias("review_sources"), F.sum("segments").alias("total_segments"), F.sum("word_count").alias("total_words"))


def speaker_timeline(segments: DataFrame) -> DataFrame:
    """Speakers of each source in order of first appearance, with their segments and speaking time."""
    by = segments.groupBy("source_id", "speaker").agg(F.min("segment_index").alias("first_index"), F.count("*").alias("segment_count"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speaking_ms"), F.min_by("segment_id", "segment_index").alias("first_segment_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "segment_id"))), lambda s: s["segment_id"]), ",").alias("segment_ids"))
    return by.withColumn("position", F.row_number().over(W.partitionBy("source_id").orderBy("first_index")).cast("long"))


def speaker_summary(segments: DataFrame) -> DataFrame:
    labels = segments.groupBy("source_id").agg(F.sort_array(F.collect_set("speaker")).alias("labels"))
    return labels.select("source_id", F.size("labels").cast("long").alias("speakers"), F.array_join("labels", ",").alias("labels"), ((F.size("labels") > 1) | ~F.array_contains("labels", "speaker_0")).alias("diarized"))


def with_aliases(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Renames the speakers that the alias table (speaker, alias) maps; empty aliases map nothing."""
    named = aliases.where("alias is not null and alias <> ''").select(F.col("speaker").alias("_s"), F.col("alias").alias("_a"))
    joined = segments.join(named, segments.speaker == named["_s"], "left")
    return joined.withColumn("speaker", F.coalesce("_a", "speaker")).withColumn("user_confirmed", F.col("_a").isNotNull()).drop("_s", "_a")


def polarity(text: Column) -> Column:
    own = tokens(text)
    return F.when(F.arrays_overlap(own, lexicon(L.NEGATION)), "negative").when(F.arrays_overlap(own, lexicon(L.AFFIRMATION)), "positive").otherwise("neutral")


def meaningful_tokens(text: Column) -> Column:
    left_out = lexicon(tuple(sorted({*L.NEGATION, *L.AFFIRMATION, *L.STOP})))
    return F.sort_array(F.array_except(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 2)), left_out))


def contradictions(segments: DataFrame) -> DataFrame:
    """Pairs of segments of one source, of opposite polarity and with two or more meaningful tokens in common: source_id, left_index, right_index (in order),
    shared_terms (the first eight by name), left_copies, right_copies.

    All pairs of the table are found, by a join over rare tokens. Segments of a source with the same polarity and the same meaningful tokens are one, named by the first
    and counted. Segments without a text are neutral.
    """
    said = polarity(F.col("text"))
    sets = segments.where("text <> ''").select(F.col("source_id").alias("grp"), F.when(said == "negative", 0).when(said == "positive", 1).alias("side"), F.col("segment_index").alias("id"), meaningful_tokens(F.col("text")).alias("own"))
    found = set_links(sets.where("side is not null"), least=2, two_sides=True)
    ahead = F.col("left_id") < F.col("right_id")
    turned = {f"{at}_{what}": F.when(ahead if at == "left" else ~ahead, F.col(f"left_{what}")).otherwise(F.col(f"right_{what}")) for at in ("left", "right") for what in ("id", "copies")}
    found = found.select("grp", "common", *[v.alias(k) for k, v in turned.items()])
    return found.select(F.col("grp").alias("source_id"), F.col("left_id").alias("left_index"), F.col("right_id").alias("right_index"), F.array_join(F.slice(F.sort_array("common"), 1, 8), ",").alias("shared_terms"), "left_copies", "right_copies")


def _shared(texts: pa.Table, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of contradicting for one block: each text that is asked for (own copies of a block's are marked by left) against the others, which are looked up at once by numbers of their words in order of name."""
    at_left = texts["left"].combine_chunks()
    left, right = (texts.filter(m).combine_chunks() for m in (at_left, pc.invert(at_left)))
    if not len(left) or not len(right):
        return
    words = right["own"].combine_chunks()
    names = pc.unique(words.flatten())
    names = names.take(pc.sort_indices(names))
    codes = pc.index_in(words.flatten(), names).to_numpy()
    starts = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    row = np.repeat(np.arange(len(right)), np.diff(starts))
    side, index, asked = (right[c].to_numpy() for c in ("negative", "segment_index", "asked"))
    mask = np.zeros(len(names), bool)
    for own, index_of, side_of in zip(left["own"].combine_chunks(), left["segment_index"].to_pylist(), left["negative"].to_pylist(), strict=True):
        mine = pc.drop_null(pc.index_in(own.values, names)).to_numpy()
        mask[mine] = True
        hits = np.flatnonzero(mask[codes])
        mask[mine] = False
        common = np.bincount(row[hits], minlength=len(right))
        good = (common >= 2) & (side != side_of) & ((index > index_of) | ((index < index_of) & ~asked))
        first = np.cumsum(common) - common
        hits = hits[good[row[hits]] & (np.arange(len(hits)) - first[row[hits]] < 8)]
        kept = np.flatnonzero(good)
        if not len(kept):
            continue
        offsets = np.concatenate(([0], np.cumsum(np.minimum(common[kept], 8)))).astype(np.int32)
        terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(codes[hits]))), ",")
        source = right["source_id"].combine_chunks().take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([source, pa.array(np.full(len(kept), index_of), right["segment_index"].type), pa.array(index[kept], right["segment_index"].type), terms], schema.names)


def contradicting(texts: DataFrame, asked: Column, blocks: int = 16) -> DataFrame:
    """Texts that are asked for (asked, over source_id and segment_index) against all of their source: pairs of opposite polarity with two or more meaningful tokens in common, in the columns of source_id,
    left_index (asked for), right_index and shared_terms. A pair of two that are asked for comes once, in order.

    Most pairs of long texts qualify, so no index helps: each asked one is sent to every block of its source and compared with all others there. Of a large table there are more blocks than `blocks`, as a
    task holds one.
    """
    spark = texts.sparkSession
    said = polarity(F.col("text"))
    own = Cuts(spark).write(texts.where("text <> ''").select("source_id", "segment_index", asked.alias("asked"), said.alias("polarity"), meaningful_tokens(F.col("text")).alias("own")), "texts")
    own = own.where("polarity <> 'neutral' and size(own) >= 2 and source_id is not null and segment_index is not null")
    blocks = max(blocks, -(-own.count() // 100_000))
    own = own.select("source_id", "segment_index", F.coalesce("asked", F.lit(False)).alias("asked"), (F.col("polarity") == "negative").alias("negative"), "own")
    left = own.where("asked").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("left", F.lit(True))
    right = own.withColumn("block", F.pmod(F.xxhash64("segment_index"), F.lit(blocks)).cast("int")).withColumn("left", F.lit(False))
    types = own.schema
    schema = T.StructType([T.StructField("source_id", types["source_id"].dataType), *[T.StructField(c, types["segment_index"].dataType) for c in ("left_index", "right_index")], T.StructField("shared_terms", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            keys = list(zip(b["source_id"].to_pylist(), b["block"].to_pylist(), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y and keys[x] != now:
                    if held:
                        yield from _shared(pa.Table.from_batches(held), schema)
                    now, held = keys[x], []
                held.append(b.slice(x, y - x))
        if held:
            yield from _shared(pa.Table.from_batches(held), schema)

    # Whole blocks are few rows but much work.
    rows = left.unionByName(right).repartition(8 * blocks, "source_id", "block").sortWithinPartitions("source_id", "block")
    return rows.mapInArrow(run, schema)


def _overlap(a: Column, b: Column, common: Column) -> list[Column]:
    share = common / (a + b - common)
    label = F.when(share >= L.DUPLICATE_OVERLAP, "duplicate_or_retake").when(share >= L.RELATED_OVERLAP, "related_or_follow_up").otherwise("unrelated_or_low_overlap")
    return [F.round(share, 6).alias("overlap"), label.alias("label")]


def pairwise_overlap(texts: DataFrame, least: float = L.RELATED_OVERLAP) -> DataFrame:
    """Jaccard overlap of the word sets of texts (grp, id, text) of one group, for all pairs of at least `least`: grp, left_id, right_id, overlap, label, left_copies, right_copies.

    Texts of the same words are one, named by the smallest id and counted, and each other of them has a row with that one. Pairs below `least`, which are unrelated
    by the default, have no row; texts without words have none.
    """
    # Written, as taking words out of texts is most of the work.
    sets = Cuts(texts.sparkSession).write(texts.select("grp", "id", F.array_distinct(tokens(F.col("text"))).alias("own")), "sets")
    found = set_links(sets, share=least)
    found = found.select("grp", "left_id", "right_id", *_overlap(F.col("a"), F.col("b"), F.size("common")), "left_copies", "right_copies")
    one = F.lit(1)
    return found.unionByName(members(sets).select("grp", "left_id", "right_id", *_overlap(one, one, one), one.cast("long").alias("left_copies"), one.cast("long").alias("right_copies")))


def relationships(texts: DataFrame) -> DataFrame:
    """How the texts of a group are related, by the largest overlap of any two: grp, texts, overlap (0 where no two reach the related level), label, strategy.

    Groups of one text are single. Only pairs that reach the related level are looked for, as the label of all others is the same. No overlap is larger than that of two texts of the same words, so
    groups that have such are settled; of the others, pairs are looked for from a high level down, and a group is settled at the first level that any of its pairs reaches, as all pairs from there on are found.
    """
    cuts = Cuts(texts.sparkSession)
    sets = cuts.write(texts.where("grp is not null").select("grp", "id", F.array_distinct(tokens(F.col("text"))).alias("own")).where("size(own) > 0"), "sets-0")
    best = cuts.write(twins(sets).select("grp", F.lit(1.0).alias("overlap")), "best-0")
    for k, level in enumerate((L.DUPLICATE_OVERLAP, 0.5, L.RELATED_OVERLAP), 1):
        sets = cuts.write(sets.join(best.select("grp"), "grp", "left_anti"), f"sets-{k}")
        cuts.drop(f"sets-{k - 1}")
        if not sets.limit(1).count():
            break
        found = set_links(sets, share=level).groupBy("grp").agg(F.max(F.size("common") / (F.col("a") + F.col("b") - F.size("common"))).alias("overlap"))
        best = cuts.write(best.unionByName(found.select("grp", F.round("overlap", 6).alias("overlap"))), f"best-{k}")
    size = texts.groupBy("grp").agg(F.count("*").alias("texts"))
    single = F.col("texts") <= 1
    overlap = F.when(single, 1.0).otherwise(F.coalesce("overlap", F.lit(0.0)))
    label = F.when(single, "single_audio").when(overlap >= L.DUPLICATE_OVERLAP, "duplicate_or_retake").when(overlap >= L.RELATED_OVERLAP, "related_or_follow_up").otherwise("unrelated_or_low_overlap")
    strategy = F.create_map(*[F.lit(x) for pair in L.STRATEGIES.items() for x in pair])
    return size.join(best, "grp", "left").select("grp", "texts", overlap.alias("overlap"), label.alias("label")).withColumn("strategy", strategy[F.col("label")])


def near_frames(segments: DataFrame, frames: DataFrame, within_ms: int = 1500) -> DataFrame:
    """Frames (source_id, frame_id, ts_ms) joined with the segments that they lie in or near.

    Times are cut into buckets as wide as the margin; a segment is in every bucket it touches, so the join is on equal keys.
    """
    wide = max(1, within_ms)
    bucket = lambda c: F.floor(c / wide)
    spread = segments.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start_ms") - within_ms), bucket(F.col("end_ms") + within_ms))))
    cut = frames.withColumn("bucket", bucket(F.col("ts_ms")))
    return cut.join(spread, ["source_id", "bucket"]).where((F.col("ts_ms") >= F.col("start_ms") - within_ms) & (F.col("ts_ms") <= F.col("end_ms") + within_ms)).drop("bucket")


def is_action(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for m in L.ACTION_MARKERS:
        out = out | F.contains(low, F.lit(m))
    return out


def is_question(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = F.endswith(low, F.lit("?"))
    for m in L.QUESTION_STARTS:
        out = out | F.startswith(low, F.lit(m))
    return out


def extractive_notes(segments: DataFrame) -> DataFrame:
    """Per source: first three texts, and the numbers of key points, actions and questions."""
    said = segments.where("text <> ''").withColumn("place", F.row_number().over(W.partitionBy("source_id").orderBy("segment_index")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "text")))), lambda s: s["text"])
    return said.groupBy("source_id").agg(F.array_join(first, " / ").alias("summary"), F.count("*").alias("key_points"), F.count_if(is_action(F.col("text"))).alias("actions"), F.count_if(is_question(F.col("text"))).alias("questions"))


def cleaned(text: Column) -> Column:
    """One line, first letter upper case, ending in punctuation."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " "))
    upper = F.concat(F.upper(F.substring(flat, 1, 1)), flat.substr(F.lit(2), F.length(flat)))
    return F.when(flat == "", "").when(upper.rlike("[.!?:;]$"), upper).otherwise(F.concat(upper, F.lit(".")))


def timestamp_label(ms: Column) -> Column:
    """[HH:]MM:SS.mmm"""
    ms = F.greatest(F.lit(0), ms)
    h, m, s, f = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    return F.when(h > 0, F.format_string("%02d:%02d:%02d.%03d", h, m, s, f)).otherwise(F.format_string("%02d:%02d.%03d", m, s, f))


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "audio").otherwise(out)


def parse_terms(df: DataFrame, id_col: str, text_col: str, limit: int = 100) -> DataFrame:
    """Terms between commas, semicolons and line ends: trimmed, first spelling of each kept, at most limit per row."""
    each = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "[,;\n]")).alias("pos", "term")).withColumn("term", F.trim("term")).where("term <> ''")
    first = each.groupBy("id", F.lower("term").alias("low")).agg(F.min(F.struct("pos", "term")).alias("at"))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("at.pos")))
    return ranked.where(F.col("place") <= limit).select("id", "place", F.col("at.term").alias("term"))


def vocabulary_report(segments: DataFrame, terms: list[str]) -> DataFrame:
    """Per source and term: whether the source's text holds it, and how many segments do."""
    held = segments.select("source_id", F.lower("text").alias("low"), F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    return held.groupBy("source_id", "term").agg(F.count_if(F.contains("low", F.lower("term"))).alias("segments_with_term")).withColumn("hit", F.col("segments_with_term") > 0)


def vocabulary_prompt(terms: DataFrame, limit: int = 1000) -> DataFrame:
    """Per id: the terms in order, comma-joined, cut to limit characters."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]), ", ")
    return terms.groupBy("id").agg(F.substring(said, 1, limit).alias("prompt"))


def compacted(segments: DataFrame, most: int = 200) -> DataFrame:
    """First `most` segments of each source, with how many were left out."""
    w = W.partitionBy("source_id")
    kept = segments.withColumn("place", F.row_number().over(w.orderBy("segment_index"))).withColumn("total", F.count("*").over(w)).where(F.col("place") <= most)
    return kept.groupBy("source_id").agg(F.count("*").alias("kept"), (F.first("total") - F.count("*")).alias("omitted"), F.sum(F.length("text")).cast("long").alias("kept_chars"))


def batch_compacted(segments: DataFrame, most: int = 200, words: int = 20) -> DataFrame:
    """What a batch's budget of segments leaves of each source, in order of sources: batch, source_id, segments, kept, truncated, kept_words (at most `words` a segment), cut_segments (whose
    words were cut), remaining (the budget before the source).

    segments: batch, source_id, segment_index, text. Earlier sources use up the budget; their running sum is taken over ranges of the table, so a batch may be of any size. Null texts have no words; sources tie
    by nothing, as they are unique in a batch.
    """
    cuts = Cuts(segments.sparkSession)
    own = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    rows = running_sums(segments.select("batch", "source_id", "segment_index", own.alias("n")), "batch", ["source_id", "segment_index"], {"place": F.lit(1)}, cuts, "places")
    kept = F.col("place") < most
    made = rows.groupBy("batch", "source_id").agg(F.count("*").alias("segments"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.least("n", F.lit(words)))), F.lit(0)).alias("kept_words"), F.count_if(kept & (F.col("n") > words)).alias("cut_segments"), F.min("place").alias("_first"))
    return made.select("batch", "source_id", "segments", "kept", (F.col("segments") > F.col("kept")).alias("truncated"), "kept_words", "cut_segments", F.greatest(F.lit(most) - F.col("_first"), F.lit(0)).alias("remaining"))


def brief(segments: DataFrame) -> DataFrame:
    """Per source: first text that is not empty, the whole text in order, and segment numbers."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda s: s["text"])
    return segments.groupBy("source_id").agg(F.min_by(F.when(F.col("text") != "", F.col("text")), F.when(F.col("text") != "", F.col("segment_index"))).alias("brief"), F.sha2(F.array_join(said, "\n"), 256).alias("timeline_sha256"), F.count("*").alias("segments"))


def missing_provenance(segments: DataFrame, output: DataFrame) -> DataFrame:
    """Segments with a text whose id is not found in their source's output (source_id, output)."""
    joined = segments.where("text <> ''").join(output, "source_id", "left")
    return joined.where(~F.coalesce(F.contains("output", F.col("segment_id")), F.lit(False))).select("source_id", "segment_id")


def rendered(segments: DataFrame) -> DataFrame:
    """Markdown of each transcript: a line per segment with its times, speaker and warnings, then a table for review."""
    line = F.concat(F.lit("- ["), timestamp_label(F.col("start_ms")), F.lit(" - "), timestamp_label(F.col("end_ms")), F.lit("] **"), F.col("speaker"), F.lit(":** "), F.when(F.col("text") == "", "_(no speech)_").otherwise(F.col("text")))
    cell = F.trim(F.replace(F.replace(F.col("text"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    audit = F.concat(F.lit("| "), F.col("segment_id"), F.lit(" | "), F.array_join("warnings", ", "), F.lit(" | "), cell, F.lit(" |"))
    rows = segments.select("source_id", "segment_index", line.alias("line"), F.when(F.size("warnings") > 0, audit).alias("audit"))
    both = F.array_sort(F.collect_list(F.struct("segment_index", "line", "audit")))
    of = lambda name: F.array_join(F.transform(F.filter("rows", lambda r: r[name].isNotNull()), lambda r: r[name]), "\n")
    head = F.concat(F.lit("# Transcript "), F.col("source_id"), F.lit("\n\n"))
    return rows.groupBy("source_id").agg(both.alias("rows")).select("source_id", F.concat(head, of("line"), F.when(of("audit") != "", F.concat(F.lit("\n\n## Review\n\n| segment | warnings | text |\n| --- | --- | --- |\n"), of("audit"))).otherwise("")).alias("markdown"))
