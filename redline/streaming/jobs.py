"""Structured Streaming jobs. Each takes a stream and returns a stream; sinks are at the end of the file.

State is bounded by watermarks, and every job gives the same rows as its batch counterpart over the same events.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from redline import vocab as V
from redline.functions.text import cost_e8
from redline.session import checkpoint_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")  # as a glob: a file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


# --- jobs ----------------------------------------------------------------------------------------------


def stalls(events: DataFrame, key: str = "user_id", gap_seconds: int = V.STALL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Activity sessions per key; a session that closed is a stall of more than ``gap_seconds``."""
    gap = f"{gap_seconds} seconds"
    return (
        events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("events"), F.max("ts").alias("last_seen"))
        .select(key, F.col("w.start").alias("started_at"), "last_seen", F.col("w.end").alias("stalled_at"), "events")
    )


class Throttle(StatefulProcessor):
    """Lets a row pass when ``interval`` seconds went by since the last one passed; stage starts always pass."""

    def __init__(self, interval: float):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        state = self.last.get() if self.last.exists() else None
        last = state[0] if state else None
        keep = []
        for row in frame.itertuples():
            if row.is_start or last is None or row.at - last >= self.interval * 1_000_000:
                keep.append((key[0], key[1], row.event_id, row.at))
                last = row.at
        if last is not None:
            self.last.update((int(last),))
        yield pd.DataFrame(keep, columns=["doc_id", "stage", "event_id", "at"])

    def close(self) -> None:
        pass


def throttled(events: DataFrame, interval: float = 5.0) -> DataFrame:
    """At most one update per interval and (document, stage). Needs doc_id, stage, event_id, ts, is_start."""
    rows = events.select("doc_id", "stage", "event_id", F.unix_micros("ts").alias("at"), "is_start")
    return rows.groupBy("doc_id", "stage").transformWithStateInPandas(
        statefulProcessor=Throttle(interval), outputStructType="doc_id long, stage string, event_id long, at long",
        outputMode="append", timeMode="none",
    )


class StallTimer(StatefulProcessor):
    """Low-latency stalls: a gap between two events of a key is reported at once, and the silence after the last
    one by an event-time timer."""

    def __init__(self, gap: float):
        self.gap = int(gap * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        latest, stalled = before, []
        for at in sorted(int(v) for frame in rows for v in frame["at"]):
            if latest is not None and at - latest >= self.gap:
                stalled.append(latest + self.gap)
            latest = at if latest is None else max(latest, at)
        if latest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.last.update((latest,))
            self.handle.registerTimer(latest + self.gap)
        yield pd.DataFrame({"user_id": [key[0]] * len(stalled), "at": stalled}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.last.clear()
        yield pd.DataFrame({"user_id": [key[0]], "at": [at]}, dtype="int64")

    def close(self) -> None:
        pass


def stall_alerts(events: DataFrame, gap_seconds: float = V.STALL_SECONDS, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("at"))
    out = rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=StallTimer(gap_seconds), outputStructType="user_id long, at long", outputMode="append", timeMode="eventTime",
    )
    return out.select("user_id", F.timestamp_millis("at").alias("stalled_at"))


HOUR, SLIDE = 3600, 300
RATES = "doc_id long, from_ts timestamp, to_ts timestamp, requests long"


def request_rate(requests: DataFrame, folder: str, limit: int = 20, late: int = 600) -> DataFrame:
    """Documents over the hourly limit, on hours that slide by five minutes. Needs doc_id, ts.

    What is kept between micro-batches are requests per document and five minutes, not a count for each of the twelve
    hours that a request falls in; hours are added up only around five minutes where the limit can be passed. An hour is
    reported once, when the watermark (``late`` seconds behind the newest request) passes its end. A batch that is replayed
    writes the same counts and hours again.
    """
    spark = requests.sparkSession

    def watermark(newest: int) -> float:
        return newest / 1_000_000 - late

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("ts is not null").groupBy("doc_id", F.floor(F.unix_seconds("ts") / SLIDE).alias("slot")).agg(
            F.count("*").alias("requests"), F.max(F.unix_micros("ts")).alias("newest")
        )
        reported = float("-inf")
        if batch_id > 0:
            before = spark.read.parquet(f"{folder}/counts/v{batch_id - 1}")
            seen = before.agg(F.max("newest")).first()[0]
            if seen is not None:
                reported = watermark(seen)
                before = before.filter(F.col("slot") * SLIDE + HOUR > reported)
            rows = before.unionByName(rows).groupBy("doc_id", "slot").agg(
                F.sum("requests").alias("requests"), F.max("newest").alias("newest")
            )
        rows.write.mode("overwrite").parquet(f"{folder}/counts/v{batch_id}")
        counts = spark.read.parquet(f"{folder}/counts/v{batch_id}")
        seen = counts.agg(F.max("newest")).first()[0]
        reach = HOUR // SLIDE - 1
        around = F.sum("requests").over(Window.partitionBy("doc_id").orderBy("slot").rangeBetween(-reach, reach))
        hours = (
            counts.withColumn("_near", around).filter(F.col("_near") > limit)
            .select("doc_id", "requests", F.explode(F.sequence(F.col("slot") - reach, F.col("slot"))).alias("slot"))
            .filter((F.col("slot") * SLIDE + HOUR > reported) & (F.col("slot") * SLIDE + HOUR <= (reported if seen is None else watermark(seen))))
            .groupBy("doc_id", "slot").agg(F.sum("requests").alias("requests")).filter(F.col("requests") > limit)
        )
        hours.select(
            "doc_id", F.timestamp_seconds(F.col("slot") * SLIDE).alias("from_ts"),
            F.timestamp_seconds(F.col("slot") * SLIDE + HOUR).alias("to_ts"), "requests",
        ).write.mode("overwrite").parquet(f"{folder}/data/v{batch_id}")

    query = (
        requests.select("doc_id", "ts").writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], RATES)
    return spark.read.schema(RATES).option("recursiveFileLookup", True).parquet(f"{folder}/data")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """At-least-once delivery made once: repeats of an id within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def cost_rollup(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Cost per model and day. Needs ts, model_used, prompt_tokens, completion_tokens."""
    cost = cost_e8(F.col("prompt_tokens"), F.col("completion_tokens"))
    return (
        calls.withWatermark("ts", late).groupBy("model_used", F.window("ts", "1 day").alias("w"))
        .agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum(cost).alias("cost_e8"))
        .select("model_used", F.col("w.start").alias("day"), "calls", "tokens", "cost_e8")
    )


# --- sinks ---------------------------------------------------------------------------------------------


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is there, append to Parquet under ``folder``, and read the result back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema: StructType = stream.schema
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/data")


def merge_latest(stream: DataFrame, folder: str, key: str, order: list[str]) -> DataFrame:
    """Latest row per key kept as a Parquet snapshot; one new version per micro-batch.

    A batch that is replayed writes the same version again from the one before it, so a retry changes nothing.
    """
    spark = stream.sparkSession
    fields = [c for c in stream.columns if c != key]

    def latest(df: DataFrame) -> DataFrame:
        return df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_r")).select(key, "_r.*")

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/v{batch_id - 1}").select(*batch.columns))
        latest(rows).write.mode("overwrite").parquet(f"{folder}/v{batch_id}")

    query = (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{folder}/v{last}")
