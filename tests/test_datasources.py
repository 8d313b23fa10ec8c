"""The output sink and the event log: failures, reruns and restarts."""

import hashlib
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspan.operators.markdown import chunk
from loomspan.sources import eventlog as L
from loomspan.sources import outputs as O
from loomspan.streaming import events as E

TEXTS = {f"doc-{i}": f"# Title {i}\n\nSome text ünd more.\n" * (i + 1) for i in range(9)}


def frame(spark, texts):
    rows = [(n, f"/in/{n}", t, json.dumps({"n": n})) for n, t in texts.items()]
    return spark.createDataFrame(rows, "name string, source string, text string, metadata string").repartition(3, "name")


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc")}


def test_formats_from_one_parse(spark, tmp_path):
    out = str(tmp_path)
    O.write_formats(frame(spark, TEXTS), out, ["chunks", "markdown", "json"])
    rows = O.read_outputs(spark, out).collect()
    assert len(rows) == 27 and O.read_manifest(out)["formats"] == ["chunks", "markdown", "json"]
    for r in rows:
        data = (tmp_path / r.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes and r.source == f"/in/{r.name}"
        if r.format == "markdown":
            assert data.decode() == TEXTS[r.name]
        elif r.format == "json":
            assert json.loads(data) == {"markdown": TEXTS[r.name], "metadata": {"n": r.name}}
        else:
            assert [c["text"] for c in json.loads(data)["chunks"]] == [c["text"] for c in chunk(TEXTS[r.name])]


def test_reruns_agree_and_append_adds(spark, tmp_path):
    out = f"file://{tmp_path}"
    O.write_formats(frame(spark, TEXTS), out, ["markdown"])
    first = tree(tmp_path)
    O.write_formats(frame(spark, TEXTS), out, ["markdown"])
    O.clean(out)
    assert tree(tmp_path) == first
    O.write_formats(frame(spark, {"more": "x"}), out, ["markdown"], "append")
    assert {r.name for r in O.read_outputs(spark, out).collect()} == {*TEXTS, "more"}


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    out = str(tmp_path)
    O.write_formats(frame(spark, {"old": "stays"}), out, ["markdown"])
    before = tree(tmp_path)
    broken = frame(spark, TEXTS).withColumn("text", F.when(F.col("name") != "doc-4", F.col("text")))
    with pytest.raises(Exception, match="no text to write"):
        O.write_formats(broken, out, ["markdown"])
    assert [r.name for r in O.read_outputs(spark, out).collect()] == ["old"]
    O.clean(out)
    assert tree(tmp_path) == before
    with pytest.raises(Exception, match="no such output format"):
        O.write_formats(frame(spark, TEXTS), out, ["markdown", "docx"])
    with pytest.raises(Exception, match="not a file name"):
        O.write_formats(frame(spark, {"../up": "x"}), out, ["markdown"])
    O.clean(out)
    assert tree(tmp_path) == before


def test_a_killed_task_leaves_nothing_seen(spark, tmp_path):
    """Half a folder of a task that died beside a published one."""
    out = str(tmp_path)
    O.write_formats(frame(spark, TEXTS), out, ["markdown"])
    (tmp_path / "_task-dead").mkdir()
    (tmp_path / "_task-dead" / "doc-1.md").write_text("half")
    (tmp_path / "part-00007-dead").mkdir()
    assert O.read_outputs(spark, out).count() == 9
    O.clean(out)
    assert not (tmp_path / "_task-dead").exists() and O.read_outputs(spark, out).count() == 9


def test_an_empty_table(spark, tmp_path):
    O.write_formats(frame(spark, TEXTS).where("false"), str(tmp_path), ["markdown"])
    assert O.read_outputs(spark, str(tmp_path)).count() == 0


def log(path, first, n, groups=3):
    ids = list(range(first, first + n))
    columns = {"event_id": ids, "ts": pa.array([i * 1_000_000 for i in ids], pa.timestamp("us")), "user_id": [i % 5 for i in ids], "event_type": [f"t{i % 3}" for i in ids], "value": [i / 2 for i in ids], "props": ["{}" for _ in ids]}
    pq.write_table(pa.table(columns), f"{path}/log-{first:06d}.parquet", row_group_size=max(1, n // groups))


def test_replay_reads_ranges(spark, tmp_path):
    log(tmp_path, 0, 100)
    log(tmp_path, 100, 50)
    assert sorted(r.event_id for r in L.replay(spark, str(tmp_path)).collect()) == list(range(150))
    assert sorted(r.event_id for r in L.replay(spark, f"file://{tmp_path}", 95, 120).collect()) == list(range(96, 121))
    assert L.replay(spark, str(tmp_path), 149).count() == 0
    plan = L._Log({"path": str(tmp_path)}).slices(95, 120)
    assert {(os.path.basename(s.path), s.group) for s in plan} == {("log-000000.parquet", 2), ("log-000000.parquet", 3), ("log-000100.parquet", 0), ("log-000100.parquet", 1)}


def run(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_restarted_stream_loses_and_doubles_nothing(spark, tmp_path):
    source, folder = tmp_path / "log", tmp_path / "q"
    source.mkdir()
    want = []
    for k, (first, n) in enumerate([(0, 40), (40, 7), (47, 33)]):
        log(source, first, n)
        want += range(first, first + n)
        run(L.follow(spark, str(source)), folder)
        assert sorted(r.event_id for r in spark.read.parquet(f"{folder}/out").collect()) == want, k
    run(L.follow(spark, str(source)), folder)
    assert spark.read.parquet(f"{folder}/out").count() == 80


def test_a_batch_that_failed_is_repeated(spark, tmp_path):
    """A batch whose sink fails is read again with the same events after the restart."""
    source, seen = tmp_path / "log", []
    source.mkdir()
    log(source, 0, 20)

    def use(fail):
        def batch(df, number):
            seen.append((number, sorted(r.event_id for r in df.collect())))
            if fail:
                raise RuntimeError("sink is down")

        q = L.follow(spark, str(source), 4).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="sink is down"):
        use(True)
    log(source, 20, 5)
    use(False)
    use(False)
    assert seen[0] == seen[1] == (0, list(range(5, 20))) and seen[2:] == [(1, list(range(20, 25)))]


def test_change_feed_over_the_log(spark, tmp_path):
    log(tmp_path, 0, 30)
    found = E.drained(E.change_feed(L.follow(spark, str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))))
    assert found.count() == 30
