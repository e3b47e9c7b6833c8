"""Streams (an extension): interval counts of arriving vehicles, and upserts by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.universe import latest


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Event files as a stream."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def interval_volume(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Rows, speeders and mean speed of each 15-minute interval; rows later than ``late`` are left out."""
    window = F.window("ts", "15 minutes")
    return events.withWatermark("ts", late).groupBy(window).agg(F.count("*").alias("volume"), F.count_if(F.col("value") >= 70).alias("speeders"), F.avg("value").alias("mean_velocity")).select(F.col("window.start").alias("datetime"), "volume", "speeders", "mean_velocity")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], time: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key, by ``time``, in a table under ``path``.

    The table is partitioned by a bucket of the keys; a batch reads and replaces only the buckets that it touches. A batch that runs again gives the same table; rows that
    arrive late do not replace later ones.
    """

    def apply(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        try:
            old = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(*touched))
        except AnalysisException:  # no table yet
            old = batch.limit(0)
        rows = latest(old.unionByName(batch), keys, time)
        rows.repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
