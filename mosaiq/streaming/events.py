"""Streams of events: windows, progress, deduplication, the state of tasks.

Every function takes a streaming or a batch table and means the same on both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.session import shared_dir

LATE = "1 hour"


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """``start, event_type, n, value``: events in event-time windows; later ones than ``LATE`` are dropped in a stream."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``user_id, start, end, n``: sessions of each user, apart by ``gap`` or more."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First delivery of each key; a stream remembers keys for ``LATE``."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def task_states(events: DataFrame) -> DataFrame:
    """``task_id, status, ts, changes``: the last event of each task and how many there were. The maximum is taken over
    (ts, event_id), so the order of arrival doesn't matter."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy(F.col("user_id").alias("task_id")).agg(last.getField("event_type").alias("status"), last.getField("ts").alias("ts"), F.count(F.lit(1)).alias("changes"))


#: How often a failed task is tried again.
RETRIES = 3


def next_state(status: str | None, retries: int, command: str | None) -> tuple[str | None, int]:
    """A task's state after a command; commands that don't fit the state change nothing."""
    if command == "enqueue" and status in (None, "completed", "failed", "cancelled"):
        return "pending", 0
    if command == "claim" and status == "pending":
        return "running", retries
    if command == "complete" and status == "running":
        return "completed", retries
    if command == "fail" and status == "running":
        return ("pending", retries + 1) if retries < RETRIES else ("failed", retries)
    if command == "cancel" and status in ("pending", "running"):
        return "cancelled", retries
    return status, retries


def run_tasks(commands: DataFrame) -> DataFrame:
    """``task_id, status, retries, events``: every task's state after its commands (task_id, ts, event_id, command) in the
    order of time. Rows are streamed in order, so a task may have any number of them. Rows without a task are left out."""
    rows = commands.select("task_id", "ts", "event_id", "command").where("task_id is not null").repartition("task_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, status, retries, n = None, None, 0, 0
        for b in batches:
            out = []
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t != task:
                    if n:
                        out.append((task, status, retries, n))
                    task, status, retries, n = t, None, 0, 0
                status, retries = next_state(status, retries, x)
                n += 1
            yield _states(out)
        if n:
            yield _states([(task, status, retries, n)])

    return rows.sortWithinPartitions("task_id", "ts", "event_id").select("task_id", "command").mapInArrow(fold, "task_id bigint, status string, retries int, events bigint")


def _states(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["task_id", "status", "retries", "events"])


def within(a: DataFrame, b: DataFrame, first: str, then: str, most: str = "1 hour") -> DataFrame:
    """``{first}_id, {then}_id``: events of one type and those of another of the same user that follow within a time. A
    stream forgets what can have no partner any more."""
    side = lambda e, kind, p: (e.withWatermark("ts", LATE) if e.isStreaming else e).where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"))
    on = F.expr(f"a_user = b_user and b_ts >= a_ts and b_ts < a_ts + interval {most}")
    return side(a, first, "a").join(side(b, then, "b"), on).select(f"{first}_id", f"{then}_id")


def kept_of_second_delivery(events: DataFrame) -> DataFrame:
    """``kept``: how many events of a second delivery a stream still takes after the first one."""
    spark = events.sparkSession
    root = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    out = f"{root}/out"
    for n in (1, 2):
        events.withColumn("delivery", F.lit(n)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        rows = stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id", "delivery"]).select("event_id", "delivery")
        rows.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.parquet(out).where("delivery = 2").agg(F.count(F.lit(1)).alias("kept"))


def progress(events: DataFrame) -> DataFrame:
    """Counters of tasks by state."""
    names = ["queued", "processing", "completed", "failed", "finished"]
    return events.agg(*[F.count_if(F.col("event_id") % 5 == k).alias(n) for k, n in enumerate(names)])


def upsert_batches(root: str, keys: list[str], version: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every micro-batch is written under its own number, so a repeated one replaces itself; the
    newest version of each key is taken on reading, by ``latest``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([*keys, *version]).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return write


def latest(spark: SparkSession, root: str, keys: list[str], version: list[str]) -> DataFrame:
    rows = spark.read.parquet(root).drop("batch")
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(*version, *[c for c in rest if c not in version]))
    g = rows.groupBy(*keys).agg(newest.alias("z"))
    return g.select(*keys, *[F.col(f"z.{c}").alias(c) for c in rest]).select(*rows.columns)


def run_available(stream: DataFrame, mode: str = "append", each: Callable | None = None, path: str | None = None) -> str:
    """Run a stream over what is there, into a table of the shared folder; its path."""
    root = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    out = path or f"{root}/out"
    w = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode(mode)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out
