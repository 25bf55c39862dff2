"""Structured Streaming jobs over the events table, read as a file stream and run until all that is there is processed.

Each job writes to a table in the shared folder and returns it as a DataFrame, so the same code serves a trigger that
goes on: only `once` differs.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions.scratch import ensure_checkpoints


def _source(spark: SparkSession, path: str) -> DataFrame:
    """The event file as a stream; times become TIMESTAMP, which watermarks ask for."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet")
    one_file = name.endswith(".parquet") and spark.read.format("binaryFile").load(path).limit(1).select("path").first()[0].endswith(name)
    rows = stream.parquet(folder if one_file else path) if one_file else spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    ensure_checkpoints(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
    else:
        # each micro-batch holds the whole result so far, or the keys that changed: the newest version of a key counts
        writer.foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{at}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """hourly_counts of an event file."""
    return hourly_counts(spark, _source(spark, path))


def hourly_counts(spark: SparkSession, events: DataFrame) -> DataFrame:
    """event_type, hour, n, total: tumbling hours of a stream with a watermark of two hours; late rows within it still count."""
    rows = events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = _run(spark, rows, "hourly", "update")
    newest = out.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("x"))
    return newest.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "x.n", "x.total")


def delivered_once(spark: SparkSession, path: str) -> DataFrame:
    """user_id, event_type, day, seen: repeats of a (user, kind, day) are dropped as long as the watermark remembers the day."""
    rows = _source(spark, path).withColumn("day", F.to_date("ts")).withWatermark("ts", "14 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])
    return _run(spark, rows.select("user_id", "event_type", "day", F.lit(True).alias("seen")), "delivered", "append")


def user_state(spark: SparkSession, path: str) -> DataFrame:
    """user_id, failures, seen: arbitrary state per user, folded batch by batch."""
    out = T.StructType().add("user_id", T.LongType()).add("failures", T.LongType()).add("seen", T.LongType())
    kept = T.StructType().add("failures", T.LongType()).add("seen", T.LongType())

    def fold(key, batches, state: GroupState):
        failures, seen = state.get if state.exists else (0, 0)
        for pdf in batches:
            failures, seen = failures + int((pdf.event_type == "error").sum()), seen + len(pdf)
        state.update((failures, seen))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "seen": [seen]})

    rows = _source(spark, path).select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.NoTimeout)
    got = _run(spark, rows, "users", "update")
    return got.groupBy("user_id").agg(F.max_by(F.struct("failures", "seen"), "_batch").alias("x")).select("user_id", "x.failures", "x.seen")
