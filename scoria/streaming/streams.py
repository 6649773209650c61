"""The stateless transforms over a stream of report texts, deduplication with a watermark, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoria.functions.text import normalize_name
from scoria.session import is_folder, ship_package


def text_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """A folder of parquet files as a stream; ``glob``: only files of that name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``, a file or a folder of files, as a stream."""
    ship_package(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return text_stream(spark, path, schema) if is_folder(spark, path) else text_stream(spark, sf_dir, schema, glob=f"{name}.parquet")


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events per window and type, with the sum of value; on a stream, events later than ``late`` are dropped. Also works on a table."""
    # watermarks need a timestamp of the session's zone
    frame = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    counted = frame.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def distinct_findings(records: DataFrame, time: str = "extracted_at", late: str = "7 days") -> DataFrame:
    """The first record of each (name, port, protocol) within ``late`` of it; state is kept no longer than that."""
    keyed = records.withColumns({"__n": normalize_name(F.col("Name")), "__p": F.coalesce("port", F.lit("")), "__q": F.lower(F.coalesce("protocol", F.lit("")))})
    if records.isStreaming:
        out = keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["__n", "__p", "__q"])
    else:
        out = keyed.dropDuplicates(["__n", "__p", "__q"])
    return out.drop("__n", "__p", "__q")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there to parquet and ends; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def whole_result(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregating stream over what is there; after each batch ``path`` holds the whole result so far."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
