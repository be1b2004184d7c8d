"""Structured Streaming twins: sources, tumbling windows, dedup, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fieldlark.operators.clean import with_reason
from fieldlark.session import dimension as small
from fieldlark.sources.readers import MESSAGE


def message_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """(raw, message) of NDJSON files that land in ``path``, ``files`` a micro-batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.col("value").alias("raw"), F.from_json("value", MESSAGE).alias("message"))


def parquet_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*", files: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def tumbling(stream: DataFrame, ts: str, width: str, wait: str, aggregates: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bucket, aggregates) by event time; a window is final once the watermark, ``wait`` behind the newest row, has passed it.

    The watermark moves between micro-batches, so this is laxer than the
    per-arrival watermark of ``operators.lateness``.
    """
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, wait)
    out = rows.groupBy(*keys, F.window(ts, width).alias("_w")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(*keys, F.col("_w.start").alias("bucket"), *aggregates)


def first_measurements(stream: DataFrame, tag: str = "tag", at: str = "event_time", wait: str = "3 hours") -> DataFrame:
    """One row a measurement; state is forgotten ``wait`` after it."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, wait)
    return rows.dropDuplicatesWithinWatermark([tag, at])


def with_dimension(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream-static left join against a dimension of a few rows, such as the contract."""
    return stream.join(small(dimension), key, "left")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is, written as Parquet to ``out`` and read back. ``complete`` results replace the last batch's."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def route(stream: DataFrame, kept: str, quarantined: str, checkpoint: str) -> None:
    """Each micro-batch to two Parquet directories: rows to keep, and the others with their reason.

    A batch that is run again after a failure replaces its own directory, so
    nothing is written twice.
    """

    def both(df: DataFrame, batch: int) -> None:
        judged = with_reason(df).persist()
        try:
            judged.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{kept}/batch={batch}")
            judged.where("reason is not null").write.mode("overwrite").parquet(f"{quarantined}/batch={batch}")
        finally:
            judged.unpersist()

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(both).start().awaitTermination()
