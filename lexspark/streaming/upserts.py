"""Loads as a stream: new files are upserted by key, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bundle import last_wins, upsert


def watch(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """A file source over a directory."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str, order: str):
    """Keep in table (versions v=0, 1, ...) the last row of each key. A batch
    writes version batch_id + 1 from version batch_id, so a batch that is run
    again writes the same; the query that is returned has ended."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = last_wins(batch, key, order)
        old = spark.read.parquet(f"{table}/v={batch_id}") if batch_id else None
        both = new if old is None else last_wins(upsert(old, new, key).unionByName(old), key, order)
        both.write.mode("overwrite").parquet(f"{table}/v={batch_id + 1}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of a table that upsert_stream keeps."""
    rows = spark.read.parquet(table)
    newest = rows.agg(F.max("v")).first()[0]
    return rows.filter(F.col("v") == newest).drop("v")


def deduplicated(stream: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
