"""Windowed counts over an event stream, as plain Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import workspace


def events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The events of a directory (or a file, which a stream takes only by a pattern) as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def tumbling(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(key, start, n) of each window; events that come later than ``late`` after the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n")


def sliding(stream: DataFrame, time: str, key: str, width: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(key, start, n) of each window of ``width``; one begins every ``step``, so an event counts in several."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, step), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(key, start, n) of each run of events with no longer gap than ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, through a checkpointed parquet sink.

    In ``append`` mode groups that the watermark has not passed are not given. In ``complete`` mode all are, and
    no late event is dropped: each micro-batch sets off the whole result by its number, and the last one counts.
    """
    spark = stream.sparkSession
    root = workspace(spark, label)
    if mode == "complete":
        last = []

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
            last[:] = [number]

        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out/batch={last[0]}") if last else spark.createDataFrame([], stream.schema)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def counted(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Exact running totals by key after all that is there: each micro-batch is summed up and set off by batch
    number, so a batch that is run again replaces itself; the parts are added on reading."""
    spark = stream.sparkSession
    root = workspace(spark, label)

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy(*keys).agg(F.sum("n").alias("n"))
