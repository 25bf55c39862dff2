"""Streams of several files: state across micro-batches, timers, late rows, against a loop over the same readings."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import jobs, progress

BEGIN = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "key long, ts timestamp, hash string, conflict boolean"


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of the given files, each a list of (key, seconds since BEGIN, hash, conflict), one per micro-batch."""

    def make(files):
        for i, rows in enumerate(files):
            df = spark.createDataFrame([(k, int(BEGIN.timestamp()) + s, h, c) for k, s, h, c in rows], "key long, s long, hash string, conflict boolean")
            df.select("key", F.timestamp_seconds("s").alias("ts"), "hash", "conflict").coalesce(1).write.mode("append").parquet(str(tmp_path / f"{i:03d}"))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "*"))

    return make


def reported(spark, rows):
    at = int(BEGIN.timestamp())
    return sorted((r.key, r["at"] - at, r.action, r.conflicts, r.until - at) for r in progress.reports(spark, rows).collect())


def brute(rows, watermark):
    out, states = [], {}
    for k, s, h, c in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        old = states.get(k)
        if old and s - old[3] >= progress.FORGET:
            if old[1] <= s:
                out.append((k, old[1], "due", old[2], old[1]))
            old = None
        elif old and s >= old[1]:
            out.append((k, old[1], "due", old[2], old[1]))
        if old and s < old[1] and h == old[0] and not c:
            states[k] = (*old[:3], s)
            continue
        n = min(4, (old[2] if old else 0) + 1) if c else 0
        states[k] = (h, s + progress.RESTS[n], n, s)
        out.append((k, s, "read", n, s + progress.RESTS[n]))
    return sorted(out + [(k, u, "due", n, u) for k, (_, u, n, _) in states.items() if u <= watermark])


H, D = 3600, 86400


def test_progress_over_micro_batches(spark, stream):
    """A row unchanged while it rests, one that changes, conflicts in a row, one that falls due by a timer, and a late row."""
    files = [
        [(1, 0, "a", False), (2, 0, "x", True), (3, 0, "q", False)],
        [(1, D, "a", False), (2, 20 * 60, "x", True), (2, 3 * H, "x", True), (1, D + 1, "b", False)],
        [(4, 12 * D, "z", False)],  # after this the watermark is beyond the rests of 1, 2 and 3
        [(4, 12 * D + 1, "z", False)],  # timers fire; what is older than the watermark of this batch's begin is late from the next one on
        [(3, 2 * D, "late", False), (4, 12 * D + 5, "z", False), (2, 12 * D, "x", False)],
    ]
    want = [
        (1, 0, "read", 0, 7 * D), (1, D + 1, "read", 0, 8 * D + 1), (1, 8 * D + 1, "due", 0, 8 * D + 1),
        (2, 0, "read", 1, 1800), (2, 1200, "read", 2, 1200 + 2 * H), (2, 1200 + 2 * H, "due", 2, 1200 + 2 * H), (2, 3 * H, "read", 3, 3 * H + D), (2, 3 * H + D, "due", 3, 3 * H + D), (2, 12 * D, "read", 0, 19 * D),
        (3, 0, "read", 0, 7 * D), (3, 7 * D, "due", 0, 7 * D), (4, 12 * D, "read", 0, 19 * D),
    ]
    assert reported(spark, stream(files)) == sorted(want)


def test_progress_is_that_of_one_batch(spark, stream):
    rnd = random.Random(2)
    rows = sorted(((rnd.randrange(6), int(rnd.random() * 60 * D), rnd.choice("ab"), rnd.random() < 0.3) for _ in range(120)), key=lambda r: r[1])
    rows = [*rows, (9, 70 * D, "a", False)]
    assert reported(spark, stream([rows[i : i + 40] for i in range(0, len(rows), 40)])) == brute(rows, 70 * D - H)


def test_hourly_counts_of_several_files_with_late_rows(spark, tmp_path):
    """Rows within the watermark count though they come late; those behind it are dropped."""
    files = [[(0, 1.0), (1800, 2.0)], [(3 * H, 4.0), (1900, 8.0)], [(9 * H, 16.0)], [(2000, 32.0), (8 * H, 64.0)]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(int(BEGIN.timestamp()) + s, v) for s, v in rows], "s long, value double").select(F.timestamp_seconds("s").alias("ts"), F.lit("view").alias("event_type"), "value")
        df.coalesce(1).write.parquet(str(tmp_path / "events.parquet" / f"{i:03d}"))
    schema = spark.read.parquet(str(tmp_path / "events.parquet" / "000")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet" / "*"))
    got = {(r.hour.hour, r.n, r.total) for r in jobs.hourly_counts(spark, stream).collect()}
    assert got == {(0, 3, 11.0), (3, 1, 4.0), (9, 1, 16.0), (8, 1, 64.0)}
