"""Structured Streaming forms of the daily rules: late data, repeats, and the latest value of each quarter of an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_late(events: DataFrame, ts: str = "ts", delay: str = "3 days") -> DataFrame:
    """Events behind a watermark; with a stateful operator after it, later ones are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def once(events: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "7 days") -> DataFrame:
    """The first event of each key, remembered for ttl of event time. Within one micro-batch it may differ from the batch rule, which is exact."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def latest_values(events: DataFrame, keys: list[str], ts: str = "ts", id: str = "event_id", value: str = "value", width: str = "15 minutes", delay: str | None = "1 hour") -> DataFrame:
    """keys, start, value: the last value of each window; ties on time by id."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay and own.isStreaming:
        own = own.withWatermark(ts, delay)
    one = own.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.max(F.struct(ts, id, value)).alias("m"))
    return one.select(*keys, F.col("w.start").alias("start"), F.col(f"m.{value}").alias(value))


def write_last_good(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update"):
    """Each batch that has rows is added to folder under its number, written again whole if the batch is repeated; empty batches leave it as it is."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def write_with_late(stream: DataFrame, folder: str, checkpoint: str, ts: str = "ts", days: int = 3):
    """Each batch goes to folder under its number, rows that are more than days behind the latest time of all batches before to late=true, the others to late=false.

    A batch that is run again replaces its own rows, and is judged by the same batches as before. Rows without a time are not late.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = None
        if number:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                latest = spark.read.option("basePath", folder).parquet(folder).where(F.col("batch") < number).agg(F.max(ts)).first()[0]
        late = F.lit(False) if latest is None else F.coalesce(F.col(ts) < F.lit(latest) - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{folder}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
