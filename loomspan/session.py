"""Session settings and table loading shared by the queries, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of long texts in an Arrow batch, and characters of texts that a task makes before it sends them on.
ROWS, PIECE = 200, 1 << 20

#: Settings that hold for every run; partition counts and memory are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "loomspan", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from spark-submit."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; zone-less timestamps stay zone-less."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int) -> None:
    """Bounds the rows of an Arrow batch, as single texts may be long.

    This is a setting of the session, which a lazily read result takes from whoever set it last. It bounds memory only: no
    operator's result depends on where batches end.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a local one where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/') if named else tempfile.mkdtemp(prefix='loomspan-')}/loomspan-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over as many partitions as its files fill, sixteen for each that they are read by, so that a task's share does not grow with the table."""
    return df.repartition(16 * max(1, df.rdd.getNumPartitions()), *keys)


class Cuts:
    """Written tables that cut the lineage of a job of many rounds; they outlive lost executors and go when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_folder(spark)

    def _files(self, path: str) -> tuple:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        path, files = self._files(self.root)
        files.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path, files = self._files(f"{self.root}/{name}")
        files.delete(path, True)
