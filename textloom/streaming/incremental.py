"""Incremental import: new files become batches as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Mapping, normalize


def import_stream(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, mapping: Mapping, source_id: int, src_lang: str, tgt_lang: str) -> StreamingQuery:
    """Each micro-batch of new Parquet files is normalised and written to its own partition; a batch that is replayed
    after a failure overwrites itself, so rows are there exactly once."""
    rows = spark.readStream.schema(schema).parquet(folder)

    def write(df: DataFrame, epoch: int) -> None:
        normalize(df, mapping, int(epoch), source_id, src_lang, tgt_lang).drop("_position").write.mode("overwrite").parquet(f"{target.rstrip('/')}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per key in tumbling windows; rows later than the watermark are out."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
