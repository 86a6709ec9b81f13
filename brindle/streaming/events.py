"""Event-time windows on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import shared_root


def event_stream(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """The event log as a file stream; times are instants (watermarks take no zone-less time)."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    # a table is a folder of part files, or one file, which only its folder can stream
    one = [f.rstrip("/").rsplit("/", 1)[-1] for f in table.inputFiles()] == ["events.parquet"]
    s = s.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one else s.parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, kind: str) -> DataFrame:
    w = {"tumbling": lambda: F.window("ts", "1 day"), "sliding": lambda: F.window("ts", "2 days", "1 day"), "session": lambda: F.session_window("ts", "30 minutes")}[kind]()
    keys = [w.alias("w"), "event_type"] if kind != "session" else [w.alias("w"), "user_id"]
    return stream.withWatermark("ts", "1 day").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_complete(df: DataFrame) -> DataFrame:
    """Runs a windowed stream over what there is (AvailableNow) and returns its result as a table in the shared folder. Each micro-batch writes all windows so far from the executors; none comes to the driver."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last.append(number)

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/batch-{max(last)}") if last else spark.createDataFrame([], df.schema)
