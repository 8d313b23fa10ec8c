"""What the training-data operators share: the shared folder, table cuts, words and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import arrow_batches  # noqa: F401

#: ASCII white space, which alone separates words (fixed values).
SPACES = " \t\n\x0b\x0c\r"
#: The same class for Java regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table outlives the executors that made it. Tables that later steps no longer
    read are dropped with :meth:`drop`; those a lazily read result needs stay, and go when the application ends, unless keep is set.
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        self.spark, self.keep = spark, keep
        self.root = f"{shared_dir(spark)}/loomspan-{name}-{uuid.uuid4().hex}"

    def _hadoop(self, path: str) -> tuple:
        """The path and its file system, as Hadoop's objects."""
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def url(self, name: str) -> str:
        """The path with its file system's scheme, so that workers reach the same files as the driver or fail."""
        path, files = self._hadoop(self.path(name))
        return files.makeQualified(path).toString()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        if not self.keep:
            path, files = self._hadoop(self.root)
            files.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path, files = self._hadoop(self.path(name))
        files.delete(path, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished steps, which nothing refers to any more."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def put_aside(df: DataFrame) -> DataFrame:
    """df with own_ before each of its names, so that they can't clash with an operator's."""
    return df.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in df.columns])


def take_back(df: DataFrame, columns: list[str]) -> list[Column]:
    """These columns of a table made of one put aside, under their names."""
    return [F.col(f"`own_{c}`").alias(c) for c in columns]


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where its scan has fewer splits than that, for costly work on single rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.size(word_array(text)).cast("long")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b of one type. Returns node, component (the smallest node of its
    component) for every node that has an edge. Each step is a grouped minimum with map-side
    combination and a join on the node. A hub's edges stream through one task of that join, unless Spark's adaptive
    execution splits them; they are never held in memory. The
    rounds grow with the logarithm of the number of nodes. Every round is written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = scratch.write(now, f"{name}-0")
    print_of = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before, k = print_of(now), 0
    while before["n"]:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        k += 1
        now = scratch.write(small, f"{name}-{k}")
        after = print_of(now)
        scratch.drop(f"{name}-{k - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
