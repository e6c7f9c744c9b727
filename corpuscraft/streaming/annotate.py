"""Documents annotated as they arrive, and running hit rates of a lookup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def annotate_stream(stream: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The stream through stateless steps: column functions and joins with static lexicons."""
    for step in steps:
        stream = stream.transform(step)
    return stream


def cluster_step(clusters: DataFrame, word: str = "word") -> Callable[[DataFrame], DataFrame]:
    """A step that looks up each word's cluster in a static table."""
    known = clusters.select(F.col("word").alias("_w"), "cluster")
    return lambda df: df.join(known, F.col(word) == F.col("_w"), "left").withColumn("hit", F.col("cluster").isNotNull()).withColumn("cluster", F.coalesce("cluster", F.lit("UNK"))).drop("_w")


def stream_hit_rate(stream: DataFrame, hit: str = "hit", time: str = "ts", window: str = "1 hour", delay: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Per window of arrival: how many lookups and which share hit. State of windows older than ``delay`` is dropped."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), *by)
        .agg(F.count("*").alias("n"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))
        .select(F.col("w.start").alias("window_start"), *by, "n", "hit_rate")
    )


def running_counts(stream: DataFrame, by: Sequence[str], hit: str = "hit") -> DataFrame:
    """How many lookups there were so far, and how many hit, by key, whenever documents arrive: for update mode. State is a row a key and outlives a restart from the checkpoint."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(hit), F.lit(False))).alias("n_hit"))


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes what each batch changed as ``path``/batch=N; a batch that runs again writes the same place. It takes what is there and stops."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """The counts that write_updates wrote last for each key."""
    rows = spark.read.parquet(path)
    value = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*value), "batch").alias("x")).select(*by, "x.*")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends Parquet files; it takes what is there and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
