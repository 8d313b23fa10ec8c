"""The event log as a Spark data source, for batches and for streams with offsets and replay.

The log is a folder of Parquet files, or one such file, whose event ids grow in the order in which files are added, as a database sequence
gives them; a file appears whole. An offset is the last event id that was read. Batches are planned from the statistics of row groups: only groups that hold ids of the range are read,
each as a partition of its own. Spark keeps the offsets in the query's checkpoint, so a query that is started again goes on behind the last batch that it finished and
repeats the one that it did not, with the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Slice(InputPartition):
    """Events after `after` up to `upto` of one row group."""

    path: str
    group: int
    after: int
    upto: int


class _Log:
    def __init__(self, options: dict[str, str]):
        self.path, self.first = options["path"], int(options.get("after", -1))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(path, row group, least id, largest id) of all files, from their footers."""
        files, root = self._store()
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            meta = pq.ParquetFile(files.open_input_file(f.path)).metadata
            at = [meta.schema.column(i).path for i in range(meta.num_columns)].index("event_id")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                if meta.row_group(g).num_rows:
                    yield (f.path, g, stats.min, stats.max) if stats is not None and stats.has_min_max else (f.path, g, -(2**63), 2**63 - 1)

    def last(self) -> int:
        return max((most for *_, most in self.groups()), default=self.first)

    def slices(self, after: int, upto: int) -> list[Slice]:
        return [Slice(path, g, after, upto) for path, g, least, most in self.groups() if most > after and least <= upto]

    def rows(self, s: Slice | None) -> Iterator[pa.RecordBatch]:
        """Spark gives no slice to the one task of a batch that has none."""
        if s is None:
            return
        files, _ = self._store()
        for batch in pq.ParquetFile(files.open_input_file(s.path)).iter_batches(row_groups=[s.group], columns=NAMES):
            ids = batch.column(NAMES.index("event_id"))
            kept = batch.filter(pc.and_(pc.greater(ids, s.after), pc.less_equal(ids, s.upto)))
            if kept.num_rows:
                yield kept.select(NAMES)


class LogStream(_Log, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"event_id": self.first}

    def latestOffset(self) -> dict:
        return {"event_id": self.last()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.slices(start["event_id"], end["event_id"])

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """The log keeps its events, so that readers can be replayed."""


class LogReader(_Log, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.upto = int(options["upto"]) if "upto" in options else None

    def partitions(self) -> list[Slice]:
        return self.slices(self.first, self.last() if self.upto is None else self.upto)

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class EventLog(DataSource):
    """Format loomspan_events; options path, after (the last id not to be read), and for batches upto."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema: StructType) -> LogStream:
        return LogStream(dict(self.options))


def replay(spark: SparkSession, path: str, after: int = -1, upto: int | None = None) -> DataFrame:
    """Events of the log with ids after `after` and, if given, up to `upto`."""
    spark.dataSource.register(EventLog)
    reader = spark.read.format(EventLog.name()).option("path", path).option("after", after)
    return (reader if upto is None else reader.option("upto", upto)).load()


def follow(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """The log as a stream that begins behind `after`."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format(EventLog.name()).option("path", path).option("after", after).load()
