"""Structured Streaming over event files: change feeds, idempotent events, windowed counts with late data, latest state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.session import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
TERMINAL = ("completed", "failed", "cancelled")


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """Event files as a stream, in UTC; zone-less times are cast, as watermarks need an instant."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into a table in the shared folder, and reads that table."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def idempotent(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of each key within the watermark; repeated deliveries are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type. Windows come out when the watermark passes them; events later than that are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def drained_windows(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """All windows of a stream that is read to its end: those the watermark has not passed come from a last update of each."""
    folder = shared_folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    counts = windowed_counts(stream, width, late)
    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField("number", T.IntegerType())])).parquet(f"{folder}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "number").alias("n"), F.max_by("value", "number").alias("value"))


def change_feed(stream: DataFrame) -> DataFrame:
    """Events whose type is another than the user's event before, by one value of state per user."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_id")
        before = [last, *rows["event_type"].tolist()[:-1]]
        state.update((rows["event_type"].iloc[-1],))
        yield rows[[a != b for a, b in zip(before, rows["event_type"], strict=True)]][["event_id", "user_id", "event_type"]]

    kept = stream.select("user_id", "event_id", "event_type")
    return kept.groupBy("user_id").applyInPandasWithState(fold, "event_id bigint, user_id bigint, event_type string", "last string", "append", GroupStateTimeout.NoTimeout)


def leases(stream: DataFrame, limit_ms: int = 600_000) -> DataFrame:
    """A row when a user's events resume after more than the limit, that is when a lease had run out: event-time analogue of a stale job."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_id")
        at = (rows["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        before = [last, *at[:-1]]
        state.update((at[-1],))
        gap = [0 if b is None else a - b for a, b in zip(at, before, strict=True)]
        out = rows[["event_id", "user_id"]].assign(gap_ms=gap)
        yield out[out["gap_ms"] > limit_ms]

    return stream.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(fold, "event_id bigint, user_id bigint, gap_ms bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def for_each_batch(stream: DataFrame, use: Callable[[DataFrame, int], None]) -> None:
    """Drains a queue of events batch by batch."""
    q = stream.writeStream.foreachBatch(use).option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/state").trigger(availableNow=True).start()
    q.awaitTermination()
