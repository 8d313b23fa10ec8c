import os
import shutil

from pyspark.sql import functions as F

from loomspan.operators import images as I
from loomspan.operators import jobs as J
from loomspan.operators import metrics as M
from loomspan.operators import routing as R
from loomspan.operators import transcript as T
from loomspan.streaming import events as E


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_segments_are_sorted_and_warned(spark):
    rows = [("s", 1, 5.0, 9.0, " second ", 0.9, None, None, None, False, ""), ("s", 2, 0.0, 6.0, "first one", 0.5, 0.7, -1.5, 2.4, False, "A"), ("s", 3, 60.0, 60.0, None, None, None, None, None, True, "A")]
    df = spark.createDataFrame(rows, "source_id string, pos int, start double, end double, text string, confidence double, no_speech_prob double, avg_logprob double, compression_ratio double, overlap_warning boolean, speaker string")
    out = T.normalize_segments(df).orderBy("segment_index").collect()
    assert [r.segment_id for r in out] == ["s_seg_0001", "s_seg_0002", "s_seg_0003"]
    assert out[0].warnings == ["low_confidence", "high_no_speech_probability", "low_avg_logprob", "high_compression_ratio"]
    assert out[1].warnings == ["overlaps_previous"] and out[1].speaker == "speaker_0"
    assert out[2].warnings == ["empty_text", "zero_duration", "overlap_warning", "long_gap_before_segment"]


def test_contradictions_need_two_shared_terms(spark):
    rows = [("s", 1, "The budget plan is approved"), ("s", 2, "The budget plan was not approved"), ("s", 3, "Weather is fine"), ("s", 4, "The budget failed")]
    df = spark.createDataFrame(rows, "source_id string, segment_index long, text string")
    assert [tuple(r) for r in T.contradictions(df).collect()] == [("s", 1, 2, "budget,plan", 1, 1)]


def test_notes_and_labels(spark):
    r = one(spark, a=T.is_action(F.lit("We should SHIP it")), q=T.is_question(F.lit(" Why now")), c=T.cleaned(F.lit("  some  text\nhere")), t=T.timestamp_label(F.lit(3_723_004)), s=T.slug(F.lit("  My File.mp3")))
    assert tuple(r) == (True, True, "Some text here.", "01:02:03.004", "my_file_mp3")


def test_page_rules(spark):
    r = one(spark, empty=R.text_quality(F.lit("")), runs=R.text_quality(F.lit("a" * 40)), good=R.text_quality(F.lit("plain words that look like text. " * 9)), few=R.layout_complexity(F.array(F.lit(1.0)), F.array(F.lit(5))), plan=R.plan_pdf(F.lit(True), F.lit(True), F.lit("auto"), F.lit(False)))
    assert r.empty == 0.0 and r.runs < 0.7 < r.good and r.few == 0.0 and tuple(r.plan) == ("fast_pdf", 0.92)


def test_segments_and_ranges_of_pages(spark):
    df = spark.createDataFrame([("d", 1, "f"), ("d", 2, "f"), ("d", 3, "m"), ("d", 4, "f"), ("d", 9, "f")], "doc string, page int, engine string")
    assert sorted((r.first_page, r.last_page, r.engine) for r in R.segments(df).collect()) == [(1, 2, "f"), (3, 3, "m"), (4, 4, "f"), (9, 9, "f")]
    assert R.page_ranges(df).first().page_range == "1-4,9"


def test_hashes(spark):
    grid = F.array(*[F.lit(float(i < 8)) for i in range(64)])
    r = one(spark, h=I.average_hash(grid), d=I.hamming(F.lit("ff00000000000000"), F.lit("0f00000000000001")), bad=I.hamming(F.lit("xyz"), F.lit("00")))
    assert tuple(r) == ("ff00000000000000", 5, 9999)


def test_first_match_is_greedy(spark):
    df = spark.createDataFrame([("g", 1, "0" * 16), ("g", 2, "0" * 15 + "3"), ("g", 3, "0" * 15 + "f"), ("g", 4, None)], "grp string, id long, h string")
    assert {r.id: r.matched for r in I.first_match(df, "grp", "id", "h", 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_diagrams_and_polygons(spark):
    r = one(spark, ok=I.is_mermaid(F.lit("graph TD; A[one] --> B(two)")), no=I.is_mermaid(F.lit("graph TD; A[one --> B(two)")), none=I.is_mermaid(F.lit(None).cast("string")), area=I.polygon_area(F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0)))))
    assert tuple(r) == (True, False, False, 12.0)


def test_error_rates(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("", "x"), ("one two three", "one too three four")], "r string, h string")
    rows = df.select(F.round(M.cer(F.col("r"), F.col("h")), 4), F.round(M.wer("r", "h"), 4)).collect()
    assert [tuple(r) for r in rows] == [(0.3333, 1.0), (0.0, 0.0), (1.0, 1.0), (0.4615, 0.6667)]


def test_assignment_takes_the_higher_of_equal_tables(spark):
    df = spark.createDataFrame([("s", 0, 0, 0.5), ("s", 0, 1, 0.5), ("s", 1, 0, 0.9), ("s", 1, 1, 1.0)], "k string, ref long, hyp long, score double")
    assert sorted((r.ref, r.hyp) for r in M.best_assignment(df, "k").collect()) == [(0, 1), (1, 0)]


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, "a_b", "pending"), (2, "axb", "pending"), (3, "100%", "completed")], "id long, name string, status string")
    assert [r.id for r in J.history(df, "A_B", ["name"], "queued", [F.desc("id")], 1, 10).collect()] == [1]
    assert [r.id for r in J.history(df, "%", ["name"], None, [F.desc("id")], 1, 10).collect()] == [3]


def test_streams_over_two_files_keep_their_state(spark, tmp_path):
    rows = [(i, 7, "view" if i % 4 < 2 else "click") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 20 * event_id)")).withColumn("value", F.lit(1.0)).withColumn("props", F.lit("{}"))
    df = df.select("event_id", "ts", "user_id", "event_type", "value", "props")
    df.where("event_id < 5").coalesce(1).write.parquet(str(tmp_path / "a"))
    df.where("event_id >= 5").coalesce(1).write.parquet(str(tmp_path / "b"))
    (tmp_path / "in").mkdir()
    for i, k in enumerate("ab"):
        shutil.copy(next((tmp_path / k).glob("part-*.parquet")), tmp_path / f"in/{k}.parquet")
        os.utime(tmp_path / f"in/{k}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = E.read_events(spark, str(tmp_path / "in"), "*.parquet")
    assert sorted(r.event_id for r in E.drained(E.change_feed(stream)).collect()) == [0, 2, 4, 6, 8, 10]
    counts = E.drained(E.windowed_counts(E.read_events(spark, str(tmp_path / "in"), "*.parquet"), "1 hour", "1 minute")).collect()
    assert sum(r.n for r in counts) in (9, 12)
    seen = []
    E.for_each_batch(stream, lambda batch, n: seen.append(batch.count()))
    assert sorted(seen) == [5, 7]
