"""What the operators of this folder share: tables, written intermediates, components of a link graph."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where a local session, as in tests, names none, a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def batched(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in batches of BATCH_BYTES at most, however long they are. Sets the session's bound if it is higher."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(2**31 - 1))) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


#: Rows of a file where a table's size is known beforehand.
ROWS_A_FILE = 20_000


class Scratch:
    """Intermediates written as Parquet to the shared folder, which cuts lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df as a table that is read again. rows: how many it has at most, so that few rows don't lie in many files."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, step: int) -> None:
        """Delete the table of an earlier step that no later one reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{step}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the links (a, b), as rows (id, component): the smallest id reachable.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until the links no longer
    change; only a count and a checksum of them reach the driver. Ids without a link have no row.
    """
    first, second = F.least("a", "b"), F.greatest("a", "b")
    links = scratch.write(edges.where("a <> b").select(second.alias("a"), first.alias("b")).distinct())
    mark = (links.count(), None)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = scratch.write(small, mark[0])  # links never get more
        scratch.drop(scratch.n - 1)
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = now
