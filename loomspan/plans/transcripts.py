"""Queries of the transcript operators, on turns of conversations and on events as timed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import lexicons as L
from loomspan.operators import transcript as T
from loomspan.session import table

TERMS = ["the", "and", "ing", "tion", "Un"]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as raw segments: a turn lasts as many milliseconds as its text has characters."""
    rows = table(spark, sf_dir, "conversations")
    stop = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    none = F.lit(None).cast("double")
    return rows.withColumn("stop", stop).select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("pos"), ((F.col("stop") - F.length("text")) / 1000.0).alias("start"), (F.col("stop") / 1000.0).alias("end"), "text", none.alias("confidence"), none.alias("no_speech_prob"), none.alias("avg_logprob"), none.alias("compression_ratio"), F.lit(False).alias("overlap_warning"), F.col("role").alias("speaker"))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw segments of their user; scores follow from the event's number."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - 1704067200.0
    k = F.col("event_id")
    return e.select(F.col("user_id").cast("string").alias("source_id"), k.alias("pos"), start.alias("start"), (start + F.col("value") * 100).alias("end"), F.when(k % 11 == 0, "").otherwise(F.col("event_type")).alias("text"), F.when(k % 7 != 0, (k % 100) / 100.0).alias("confidence"), ((k % 10) / 10.0).alias("no_speech_prob"), (-(k % 25) / 10.0).alias("avg_logprob"), ((k % 30) / 10.0).alias("compression_ratio"), (k % 13 == 0).alias("overlap_warning"), F.col("event_type").alias("speaker"))


TURNS = """
turns as (
  select conv_id::varchar as source_id, turn, role, text, length(text) as n,
    sum(length(text)) over (partition by conv_id order by turn)::bigint as stop,
    row_number() over (partition by conv_id order by turn) as segment_index from conversations),
segs as (
  select source_id, segment_index, case when role = '' then 'speaker_0' else role end as speaker, trim(text) as text, (stop - n) as start_ms, stop as end_ms,
    source_id || '_seg_' || lpad(segment_index::varchar, 4, '0') as segment_id from turns)
"""
EVENT_SEGS = """
raw as (
  select user_id::varchar as source_id, event_id as pos, epoch_us(ts) / 1000000.0::double - 1704067200.0::double as s, value, case when event_id % 11 = 0 then '' else event_type end as text,
    case when event_id % 7 <> 0 then (event_id % 100) / 100.0::double end as confidence, (event_id % 10) / 10.0::double as no_speech, -(event_id % 25) / 10.0::double as logprob, (event_id % 30) / 10.0::double as compression, event_id % 13 = 0 as overlap, event_type as speaker from events),
timed as (
  select *, greatest(0, round_even(s * 1000, 0))::bigint as start_ms, round_even((s + value * 100) * 1000, 0)::bigint as e_ms, row_number() over (partition by source_id order by s, pos) as segment_index from raw),
ends as (select *, greatest(start_ms, e_ms) as end_ms from timed),
prev as (select *, coalesce(max(end_ms) over (partition by source_id order by segment_index rows between unbounded preceding and 1 preceding), 0) as previous_end from ends),
segs as (
  select *, source_id || '_seg_' || lpad(segment_index::varchar, 4, '0') as segment_id,
    list_filter([case when text = '' then 'empty_text' end, case when end_ms <= start_ms then 'zero_duration' end, case when confidence < 0.65 then 'low_confidence' end,
      case when start_ms < previous_end then 'overlaps_previous' end, case when overlap and not start_ms < previous_end then 'overlap_warning' end,
      case when start_ms > previous_end + 30000 then 'long_gap_before_segment' end, case when no_speech >= 0.6 then 'high_no_speech_probability' end,
      case when logprob <= -1.0 then 'low_avg_logprob' end, case when compression >= 2.4 then 'high_compression_ratio' end], lambda x: x is not null) as warnings from prev)
"""
RISK = EVENT_SEGS + """, risk as (
  select source_id, count(*) as segments, count(*) filter (len(warnings) > 0) as segment_warning_count, count(*) filter (list_contains(warnings, 'low_confidence')) as low_confidence_count,
    count(*) filter (confidence is null) as unknown_confidence_count, count(*) filter (list_contains(warnings, 'empty_text')) as empty_segment_count,
    count(*) filter (list_contains(warnings, 'overlaps_previous') or list_contains(warnings, 'overlap_warning')) as overlap_count, count(*) filter (list_contains(warnings, 'long_gap_before_segment')) as long_gap_count,
    count(*) filter (list_contains(warnings, 'high_no_speech_probability')) as no_speech_probability_flags, count(*) filter (list_contains(warnings, 'low_avg_logprob')) as avg_logprob_flags,
    count(*) filter (list_contains(warnings, 'high_compression_ratio')) as compression_ratio_flags, sum(len(regexp_extract_all(text, '[A-Za-z0-9]+')))::bigint as word_count,
    sum(end_ms - start_ms)::bigint as speech_ms, max(end_ms) as duration_ms from segs group by source_id)
"""


def q(name):
    return lambda s, d: name(s, d)


def _segs(s, d):
    return T.normalize_segments(turns(s, d))


def _esegs(s, d):
    return T.normalize_segments(event_segments(s, d))


def normalize_segments(s, d):
    return _esegs(s, d).select("segment_id", "source_id", "start_ms", "end_ms", "previous_end", "text", "confidence", F.array_join("warnings", ",").alias("warnings"))


def risk_summary(s, d):
    keep = ["source_id", "segments", "segment_warning_count", "low_confidence_count", "unknown_confidence_count", "empty_segment_count", "overlap_count", "long_gap_count", "no_speech_probability_flags", "avg_logprob_flags", "compression_ratio_flags", "word_count", "speech_ms", "duration_ms", "level", "review_required", "speech_seconds"]
    return T.risk_summary(_esegs(s, d)).select(*keep)


def batch_risk(s, d):
    return T.batch_risk(T.risk_summary(_esegs(s, d)))


def language_mismatch(s, d):
    docs = table(s, d, "documents")
    expected = F.when(F.col("doc_id") % 2 == 0, "en-GB").otherwise("fr")
    return docs.select("doc_id", (F.split_part(expected, F.lit("-"), F.lit(1)) != F.split_part("lang", F.lit("-"), F.lit(1))).alias("language_mismatch"))


def word_confidence(s, d):
    e = event_segments(s, d)
    given = F.col("confidence").isNotNull()
    derived = F.when(F.col("pos") % 2 == 0, 1 - F.col("no_speech_prob")).otherwise((F.col("avg_logprob") + 2) / 2)
    value = F.when(given, F.col("confidence")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), derived)))
    source = F.when(given, "provider").when(F.col("pos") % 2 == 0, "derived_no_speech").otherwise("derived_logprob")
    return e.select(F.col("pos").alias("event_id"), F.round(value, 6).alias("confidence"), source.alias("confidence_source"))


def speaker_timeline(s, d):
    return T.speaker_timeline(_segs(s, d)).select("source_id", "speaker", "position", "segment_count", "speaking_ms", "first_segment_id", "segment_ids")


def speaker_aliases(s, d):
    names = s.createDataFrame([("user", "Customer"), ("assistant", ""), ("nobody", "X")], "speaker string, alias string")
    return T.with_aliases(_segs(s, d), names).groupBy("speaker", "user_confirmed").agg(F.count("*").alias("segments"))


def polarity_counts(s, d):
    return _segs(s, d).select("source_id", T.polarity(F.col("text")).alias("polarity")).groupBy("source_id", "polarity").agg(F.count("*").alias("segments"))


def meaningful_tokens(s, d):
    return _segs(s, d).select("segment_id", F.size(T.meaningful_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.array_join(T.meaningful_tokens(F.col("text")), " ").alias("tokens"))


def pairwise_overlap(s, d):
    """All pairs of documents of a source whose words overlap at least as related ones do."""
    return T.pairwise_overlap(_by_source(s, d))


def relationships(s, d):
    return T.relationships(_by_source(s, d))


def _by_source(s, d):
    return table(s, d, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), "text")


def frame_segments(s, d):
    e = table(s, d, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    seg = e.where("event_type = 'purchase'").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("segment_id"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.floor(F.col("value") * 1000)).alias("end_ms"))
    frames = e.where("event_type = 'click'").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("frame_id"), "ts_ms")
    return T.near_frames(seg, frames, 600_000).select("source_id", "frame_id", "segment_id")


def extractive_notes(s, d):
    return T.extractive_notes(_segs(s, d))


def text_cleanup(s, d):
    return _segs(s, d).select("segment_id", F.sha2(T.cleaned(F.col("text")), 256).alias("sha256"), F.length(T.cleaned(F.col("text"))).cast("long").alias("n"))


def timestamps(s, d):
    return _esegs(s, d).select("segment_id", T.timestamp_label(F.col("start_ms")).alias("start_label"), T.timestamp_label(F.col("end_ms")).alias("end_label"))


def source_slugs(s, d):
    return table(s, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def vocabulary_terms(s, d):
    terms = T.parse_terms(table(s, d, "documents"), "doc_id", "text")
    return terms.groupBy("id").agg(F.count("*").alias("terms"), F.max("place").cast("long").alias("last"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), "|"), 256).alias("sha256"))


def vocabulary_prompt(s, d):
    return T.vocabulary_prompt(T.parse_terms(table(s, d, "documents"), "doc_id", "text"))


def vocabulary_report(s, d):
    return T.vocabulary_report(_segs(s, d), TERMS)


def metadata_compaction(s, d):
    return T.compacted(_esegs(s, d), 20).select("source_id", "kept", "omitted", "kept_chars")


def batch_compaction(s, d):
    """Conversations in batches of a hundred as sources that share a budget of segments."""
    turns_ = table(s, d, "conversations").select(F.floor(F.col("conv_id") / 100).alias("batch"), F.col("conv_id").alias("source_id"), F.col("turn").alias("segment_index"), "text")
    return T.batch_compacted(turns_)


def multi_source_brief(s, d):
    return T.brief(_segs(s, d))


def provenance_gaps(s, d):
    segs = _segs(s, d)
    out = segs.where("segment_index % 3 <> 0").groupBy("source_id").agg(F.array_join(F.collect_list("segment_id"), " ").alias("output"))
    return T.missing_provenance(segs, out)


def frame_labels(s, d):
    e = table(s, d, "events").select("event_id", F.floor(F.col("value") / 2).alias("v"))
    r, g, b = F.col("v"), F.pmod(F.col("v") * 7, F.lit(256)), F.pmod(F.col("v") * 3, F.lit(256))
    bright = (r * 299 + g * 587 + b * 114) / 1000.0
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    colour = F.when(spread < 20, "neutral").when((r >= g) & (r >= b), "red").when(g >= b, "green").otherwise("blue")
    return e.select("event_id", F.when(bright < 64, "dark").when(bright > 192, "bright").otherwise("medium").alias("brightness"), colour.alias("colour"))


def transcript_markdown(s, d):
    return T.rendered(_esegs(s, d)).select("source_id", F.sha2("markdown", 256).alias("markdown_sha256"), F.length("markdown").cast("long").alias("n_chars"))


def word_rows(s, d):
    """Words of a segment: empty ones go, times are in milliseconds and never run backwards."""
    e = table(s, d, "events")
    words = F.array(*[F.struct(F.trim(w).alias("word"), (F.col("value") + k).alias("start"), (F.col("value") + k - 0.5 * (F.col("event_id") % 3)).alias("end")) for k, w in enumerate((F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")))])
    own = F.transform(F.filter(words, lambda w: w["word"] != ""), lambda w: F.struct(w["word"].alias("word"), T.to_ms(w["start"]).alias("start_ms"), F.greatest(T.to_ms(w["start"]), T.to_ms(w["end"])).alias("end_ms")))
    return e.select("event_id", F.explode(own).alias("w")).select("event_id", "w.word", "w.start_ms", "w.end_ms")


QUERIES = {f.__name__: f for f in (normalize_segments, risk_summary, batch_risk, language_mismatch, word_confidence, speaker_timeline, speaker_aliases, polarity_counts, meaningful_tokens, pairwise_overlap, relationships, frame_segments, extractive_notes, text_cleanup, timestamps, source_slugs, vocabulary_terms, vocabulary_prompt, vocabulary_report, metadata_compaction, batch_compaction, multi_source_brief, provenance_gaps, frame_labels, transcript_markdown, word_rows)}
QUERIES["speaker_summary"] = lambda s, d: T.speaker_summary(_segs(s, d))


def contradictions(s, d):
    """All pairs of sentences of a document that deny and affirm, and documents whose id is divisible by 100 against all of their source, each document being made to agree or to deny."""
    docs = table(s, d, "documents")
    said = docs.select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "[.!?\n]")).alias("segment_index", "text"))
    own = T.contradictions(said).select(F.lit("sentence").alias("of"), F.col("source_id").cast("string"), F.col("left_index").cast("long"), F.col("right_index").cast("long"), "shared_terms", "left_copies", "right_copies")
    made = F.concat(F.when(F.col("doc_id") % 3 == 0, "No, never. ").otherwise("Yes, agreed. "), "text")
    whole = T.contradicting(docs.select(F.col("source").alias("source_id"), F.col("doc_id").alias("segment_index"), made.alias("text")), F.col("segment_index") % 100 == 0)
    one = F.lit(1).cast("long")
    return own.unionByName(whole.select(F.lit("document").alias("of"), "source_id", "left_index", "right_index", "shared_terms", one.alias("left_copies"), one.alias("right_copies")))


QUERIES["contradictions"] = contradictions


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
POL = f"case when list_has_any({TOK}, {_list(L.NEGATION)}) then 'negative' when list_has_any({TOK}, {_list(L.AFFIRMATION)}) then 'positive' else 'neutral' end"
MEAN = f"list_sort(list_filter(list_distinct({TOK}), lambda t: length(t) > 2 and not list_contains({_list(tuple(sorted({*L.NEGATION, *L.AFFIRMATION, *L.STOP})))}, t)))"
LABEL = "case when {ms} >= 3600000 then printf('%02d:', {ms} // 3600000) else '' end || printf('%02d:%02d.%03d', ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"
PARSED = """
each as (select doc_id as id, generate_subscripts(string_split_regex(text, '[,;\n]'), 1) as pos, unnest(string_split_regex(text, '[,;\n]')) as term from documents),
trimmed as (select id, pos, trim(term) as term from each where trim(term) <> ''),
firsts as (select id, lower(term) as low, min(pos) as pos, arg_min(term, pos) as term from trimmed group by id, lower(term)),
terms as (select * from (select id, row_number() over (partition by id order by pos) as place, term from firsts) where place <= 100)
"""
OVERLAPS = f"""
w as (select source as grp, doc_id as id, list_sort(list_distinct({TOK})) as own from documents),
c as (select grp, own, min(id) as id, count(*) as copies from w where len(own) > 0 group by 1, 2),
p as (select a.grp, a.id as left_id, b.id as right_id, len(list_intersect(a.own, b.own)) as c, len(a.own) as x, len(b.own) as y, a.copies as left_copies, b.copies as right_copies from c a join c b on a.grp = b.grp and a.id < b.id),
links as (
  select grp, left_id, right_id, round(c / (x + y - c)::double, 6) as overlap, case when c / (x + y - c)::double >= 0.8 then 'duplicate_or_retake' else 'related_or_follow_up' end as label, left_copies, right_copies from p where c / (x + y - c)::double >= 0.25
  union all select c.grp, c.id, w.id, 1.0::double, 'duplicate_or_retake', 1, 1 from c join w on c.grp = w.grp and c.own = w.own and w.id > c.id)
"""
FLAT = "trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))"

SQL = {
    "normalize_segments": f"with {EVENT_SEGS} select segment_id, source_id, start_ms, end_ms, previous_end, text, confidence, array_to_string(warnings, ',') as warnings from segs",
    "risk_summary": f"with {RISK} select *, case when low_confidence_count + empty_segment_count + no_speech_probability_flags + avg_logprob_flags + compression_ratio_flags > 0 then 'review' else 'clean' end as level, (overlap_count + long_gap_count + empty_segment_count + no_speech_probability_flags + avg_logprob_flags + compression_ratio_flags > 0 or unknown_confidence_count > segments // 2) as review_required, round(speech_ms / 1000.0::double, 3) as speech_seconds from risk",
    "batch_risk": f"with {RISK} select count(*) as source_count, count(*) filter (low_confidence_count + empty_segment_count + no_speech_probability_flags + avg_logprob_flags + compression_ratio_flags > 0) as review_sources, sum(segments)::bigint as total_segments, sum(word_count)::bigint as total_words from risk",
    "language_mismatch": "select doc_id, (case when doc_id % 2 = 0 then 'en' else 'fr' end) <> split_part(lang, '-', 1) as language_mismatch from documents",
    "word_confidence": "select event_id, round(case when event_id % 7 <> 0 then (event_id % 100) / 100.0::double else least(1.0, greatest(0.0, case when event_id % 2 = 0 then 1 - (event_id % 10) / 10.0::double else (-(event_id % 25) / 10.0::double + 2) / 2 end)) end, 6) as confidence, case when event_id % 7 <> 0 then 'provider' when event_id % 2 = 0 then 'derived_no_speech' else 'derived_logprob' end as confidence_source from events",
    "speaker_timeline": f"with {TURNS} select source_id, speaker, row_number() over (partition by source_id order by min(segment_index)) as position, count(*) as segment_count, sum(end_ms - start_ms)::bigint as speaking_ms, arg_min(segment_id, segment_index) as first_segment_id, string_agg(segment_id, ',' order by segment_index) as segment_ids from segs group by source_id, speaker",
    "speaker_summary": f"with {TURNS} select source_id, count(distinct speaker) as speakers, array_to_string(list_sort(list(distinct speaker)), ',') as labels, count(distinct speaker) > 1 or not bool_or(speaker = 'speaker_0') as diarized from segs group by source_id",
    "speaker_aliases": f"with {TURNS} select case when speaker = 'user' then 'Customer' else speaker end as speaker, speaker = 'user' as user_confirmed, count(*) as segments from segs group by 1, 2",
    "polarity_counts": f"with {TURNS} select source_id, {POL} as polarity, count(*) as segments from segs group by 1, 2",
    "meaningful_tokens": f"with {TURNS} select segment_id, len({MEAN})::bigint as n_tokens, array_to_string({MEAN}, ' ') as tokens from segs",
    "contradictions": f"with d as (select doc_id as source_id, unnest(string_split_regex(text, '[.!?\\n]')) as text, generate_subscripts(string_split_regex(text, '[.!?\\n]'), 1) - 1 as i from documents), w as (select source as source_id, doc_id as segment_index, case when doc_id % 3 = 0 then 'No, never. ' else 'Yes, agreed. ' end || text as text from documents), v as (select source_id, segment_index, {POL} as pol, {MEAN} as own from w), p as (select source_id, {POL} as pol, {MEAN} as own, min(i) as i, count(*) as copies from d where text <> '' group by 1, 2, 3) select 'sentence' as \"of\", a.source_id::varchar as source_id, a.i::bigint as left_index, b.i::bigint as right_index, array_to_string(list_sort(list_intersect(a.own, b.own))[1:8], ',') as shared_terms, a.copies as left_copies, b.copies as right_copies from p a join p b on a.source_id = b.source_id and a.i < b.i and a.pol <> b.pol and a.pol <> 'neutral' and b.pol <> 'neutral' where len(list_intersect(a.own, b.own)) >= 2 union all select 'document', a.source_id, a.segment_index, b.segment_index, array_to_string(list_sort(list_intersect(a.own, b.own))[1:8], ','), 1, 1 from v a join v b on a.source_id = b.source_id and a.segment_index % 100 = 0 and (a.segment_index < b.segment_index or a.segment_index > b.segment_index and b.segment_index % 100 <> 0) and a.pol <> b.pol and a.pol <> 'neutral' and b.pol <> 'neutral' where len(list_intersect(a.own, b.own)) >= 2",
    "pairwise_overlap": f"with {OVERLAPS} select * from links",
    "relationships": f"with {OVERLAPS}, m as (select grp, max(overlap) as overlap from links group by 1), g as (select source as grp, count(*) as texts from documents group by 1), r as (select grp, texts, case when texts <= 1 then 1.0 else coalesce(overlap, 0.0) end::double as overlap from g left join m using (grp)), l as (select *, case when texts <= 1 then 'single_audio' when overlap >= 0.8 then 'duplicate_or_retake' when overlap >= 0.25 then 'related_or_follow_up' else 'unrelated_or_low_overlap' end as label from r) select *, case label when 'single_audio' then 'single_transcript' when 'duplicate_or_retake' then 'keep_separate_with_duplicate_warning' when 'related_or_follow_up' then 'merged_chronological_with_source_refs' else 'separate_sections_no_forced_narrative' end as strategy from l",
    "frame_segments": "with e as (select *, epoch_ms(ts) as ms from events) select f.user_id as source_id, f.event_id as frame_id, s.event_id as segment_id from e f join e s on f.user_id = s.user_id and f.event_type = 'click' and s.event_type = 'purchase' and f.ms between s.ms - 600000 and s.ms + floor(s.value * 1000)::bigint + 600000",
    "extractive_notes": f"with {TURNS}, t as (select *, row_number() over (partition by source_id order by segment_index) as place, lower(text) as low from segs where text <> '') select source_id, string_agg(text, ' / ' order by place) filter (place <= 3) as summary, count(*) as key_points, count(*) filter ({' or '.join(f'''contains(low, '{m}')''' for m in L.ACTION_MARKERS)}) as actions, count(*) filter (ends_with(trim(low), '?') or {' or '.join(f'''starts_with(trim(low), '{m}')''' for m in L.QUESTION_STARTS)}) as questions from t group by source_id",
    "text_cleanup": f"with {TURNS}, c as (select segment_id, {FLAT} as flat from segs), d as (select segment_id, flat || case when flat = '' or regexp_matches(flat, '[.!?:;]$') then '' else '.' end as done from c) select segment_id, sha256(upper(substr(done, 1, 1)) || substr(done, 2)) as sha256, length(done) as n from d",
    "timestamps": f"with {EVENT_SEGS} select segment_id, {LABEL.format(ms='start_ms')} as start_label, {LABEL.format(ms='end_ms')} as end_label from segs",
    "source_slugs": "select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') as slug from pages",
    "vocabulary_terms": f"with {PARSED} select id, count(*) as terms, max(place) as last, sha256(string_agg(term, '|' order by place)) as sha256 from terms group by id",
    "vocabulary_prompt": f"with {PARSED} select id, substr(string_agg(term, ', ' order by place), 1, 1000) as prompt from terms group by id",
    "vocabulary_report": f"with {TURNS}, t as (select source_id, lower(text) as low, unnest({_list(tuple(TERMS))}) as term from segs) select source_id, term, count(*) filter (contains(low, lower(term))) as segments_with_term, count(*) filter (contains(low, lower(term))) > 0 as hit from t group by 1, 2",
    "metadata_compaction": f"with {EVENT_SEGS} select source_id, count(*) filter (segment_index <= 20) as kept, count(*) filter (segment_index > 20) as omitted, sum(length(text)) filter (segment_index <= 20)::bigint as kept_chars from segs group by source_id",
    "batch_compaction": "with t as (select conv_id // 100 as batch, conv_id as source_id, turn, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) as n, row_number() over (partition by conv_id // 100 order by conv_id, turn) - 1 as place from conversations) select batch, source_id, count(*) as segments, count(*) filter (place < 200) as kept, count(*) filter (place < 200) < count(*) as truncated, coalesce(sum(least(n, 20)) filter (place < 200), 0)::bigint as kept_words, count(*) filter (place < 200 and n > 20) as cut_segments, greatest(200 - min(place), 0) as remaining from t group by 1, 2",
    "multi_source_brief": f"with {TURNS} select source_id, arg_min(text, segment_index) filter (text <> '') as brief, sha256(string_agg(text, chr(10) order by segment_index)) as timeline_sha256, count(*) as segments from segs group by source_id",
    "transcript_markdown": f"with {EVENT_SEGS}, l as (select source_id, segment_index, '- [' || {LABEL.format(ms='start_ms')} || ' - ' || {LABEL.format(ms='end_ms')} || '] **' || speaker || ':** ' || case when text = '' then '_(no speech)_' else text end as line, case when len(warnings) > 0 then '| ' || segment_id || ' | ' || array_to_string(warnings, ', ') || ' | ' || text || ' |' end as audit from segs), m as (select source_id, '# Transcript ' || source_id || chr(10) || chr(10) || string_agg(line, chr(10) order by segment_index) || coalesce(chr(10) || chr(10) || '## Review' || chr(10) || chr(10) || '| segment | warnings | text |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(audit, chr(10) order by segment_index) filter (audit is not null), '') as markdown from l group by 1) select source_id, sha256(markdown) as markdown_sha256, length(markdown) as n_chars from m",
    "word_rows": "with w as (select event_id, event_type as word, value as s, value - 0.5::double * (event_id % 3) as e from events union all select event_id, user_id::varchar, value + 2, value + 2 - 0.5::double * (event_id % 3) from events) select event_id, word, round_even(s * 1000, 0)::bigint as start_ms, greatest(round_even(s * 1000, 0), round_even(e * 1000, 0))::bigint as end_ms from w",
    "provenance_gaps": f"with {TURNS} select source_id, segment_id from segs where text <> '' and segment_index % 3 = 0",
    "frame_labels": "with e as (select event_id, floor(value / 2)::bigint as r from events), c as (select event_id, r, (r * 7) % 256 as g, (r * 3) % 256 as b from e), x as (select *, (r * 299 + g * 587 + b * 114) / 1000.0::double as l, greatest(r, g, b) - least(r, g, b) as spread from c) select event_id, case when l < 64 then 'dark' when l > 192 then 'bright' else 'medium' end as brightness, case when spread < 20 then 'neutral' when r >= g and r >= b then 'red' when g >= b then 'green' else 'blue' end as colour from x",
}
