"""Streams give the rows of their batch counterparts, also when the input arrives in several micro-batches."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from redline.operators import triage
from redline.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Events as five files in time order, read one per micro-batch."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    step = rows.agg((F.max("event_id") / 5 + 1).cast("long")).first()[0]
    for i in range(5):
        rows.filter((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step)).coalesce(1).write.parquet(f"{folder}/p{i}")
    return folder


def stream(spark, parts):
    rows = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{parts}/*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def batch(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id").collect()


def test_throttle_keeps_state_between_batches(spark, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    rows = stream(spark, parts).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), "event_id", "ts", (F.col("event_id") % 50 == 0).alias("is_start"))
    got = {r.event_id for r in jobs.run_available(jobs.throttled(rows, 7200.0), jobs.new_folder(spark, "t")).collect()}
    last, want = {}, set()
    for r in batch(spark):
        key = (r.user_id, r.event_type)
        if r.event_id % 50 == 0 or key not in last or (r.ts - last[key]).total_seconds() >= 7200:
            want.add(r.event_id)
            last[key] = r.ts
    assert got == want


def test_sessions_over_batches(spark, parts):
    got = jobs.run_available(jobs.stalls(stream(spark, parts), gap_seconds=3600), jobs.new_folder(spark, "s")).collect()
    want, open_ = [], {}
    rows = batch(spark)
    for r in rows:
        s = open_.get(r.user_id)
        if s and (r.ts - s[1]).total_seconds() < 3600:
            s[1], s[2] = r.ts, s[2] + 1
        else:
            if s:
                want.append((r.user_id, s[0], s[1], s[2]))
            open_[r.user_id] = [r.ts, r.ts, 1]
    limit = rows[-1].ts.timestamp() - 600
    want += [(u, *s) for u, s in open_.items() if s[1].timestamp() + 3600 <= limit]
    assert sorted((r.user_id, r.started_at, r.last_seen, r.events) for r in got) == sorted(want)


def test_duplicates_and_snapshot(spark, parts):
    twice = stream(spark, parts).unionByName(stream(spark, parts))
    got = jobs.run_available(jobs.deduplicated(twice).select("event_id"), jobs.new_folder(spark, "d"))
    assert got.count() == got.distinct().count() == len(batch(spark))
    rows = stream(spark, parts).select("user_id", "event_id", "ts")
    snap = jobs.merge_latest(rows, jobs.new_folder(spark, "m"), "user_id", ["ts", "event_id"]).collect()
    want = {r.user_id: r.event_id for r in batch(spark)}
    assert {r.user_id: r.event_id for r in snap} == want


def test_enrichment_equals_batch(spark, corpus):
    columns = ["doc_id", "paragraph_index", "paragraph_type", "route", "pass0_text"]
    arriving = jobs.event_stream(spark, f"{SMALL}/documents.parquet", jobs.DOCUMENTS)
    got = jobs.run_available(triage.prepared(arriving).select(*columns), jobs.new_folder(spark, "e"))
    want = corpus.prepared.select(*columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_stall_alerts_fire_once_per_gap(spark, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    got = jobs.run_available(jobs.stall_alerts(stream(spark, parts), 3600.0), jobs.new_folder(spark, "a")).collect()
    rows, last, want = batch(spark), {}, set()
    millis = lambda r: int(r.ts.timestamp() * 1_000_000) // 1000
    for r in rows:
        if r.user_id in last and millis(r) - last[r.user_id] >= 3_600_000:
            want.add((r.user_id, last[r.user_id] + 3_600_000))
        last[r.user_id] = millis(r)
    want |= {(u, at + 3_600_000) for u, at in last.items() if at + 3_600_000 <= millis(rows[-1]) - 600_000}
    assert sorted((r.user_id, round(r.stalled_at.timestamp() * 1000)) for r in got) == sorted(want)
