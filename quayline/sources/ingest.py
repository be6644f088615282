"""The ingest job: receipts through gate, quarantine and upsert, with each run in a journal of events.

A run notes its start before it reads and its end after it wrote, whatever the end was. A run without an end
is running, or, after a while, abandoned: a driver that dies leaves a trace.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quayline import config
from quayline.sources.tables import UpsertResult, finished_runs, load_receipts, read_if_exists

EVENTS = (
    "run_id string, source_id string, event string, at timestamp, status string, rows_fetched long, rows_inserted long, "
    "rows_updated long, rows_unchanged long, rows_rejected long, error string"
)
COUNTS = ["rows_fetched", "rows_inserted", "rows_updated", "rows_unchanged", "rows_rejected"]


def note(spark: SparkSession, journal: str, run_id: str, source_id: str, event: str, at: datetime | None = None, **values) -> None:
    """Append an event of a run: `start`, or `end` with its status, counts or error."""
    row = {"run_id": run_id, "source_id": source_id, "event": event, "at": at} | values
    names = [column.split()[0] for column in EVENTS.split(", ")]
    df = spark.createDataFrame([tuple(row.get(name) for name in names)], EVENTS)
    df.withColumn("at", F.coalesce("at", F.current_timestamp())).coalesce(1).write.mode("append").parquet(journal)


def journal_events(spark: SparkSession, journal: str) -> DataFrame:
    found = read_if_exists(spark, journal)
    return spark.createDataFrame([], EVENTS) if found is None else found


def runs_of(events: DataFrame, now: Column | None = None, abandoned_after: str = config.RUN_ABANDONED_AFTER) -> DataFrame:
    """One row a run, as its events tell: running without an end, abandoned if that has been so for long."""
    now = F.current_timestamp() if now is None else now
    started, ended = F.col("event") == "start", F.col("event") == "end"
    last = lambda name: F.max_by(F.when(ended, F.col(name)), F.when(ended, F.col("at"))).alias(name)
    runs = events.groupBy("run_id").agg(
        F.min_by("source_id", "at").alias("source_id"),
        F.min(F.when(started, F.col("at"))).alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("finished_at"),
        *map(last, ["status", *COUNTS, "error"]),
    )
    old = F.col("started_at") < now - F.expr(f"INTERVAL {abandoned_after}")
    status = F.coalesce("status", F.when(old, "abandoned").otherwise("running"))
    return finished_runs(runs.withColumn("status", status))


def run_ingest(
    spark: SparkSession, journal: str, source_id: str, read: Callable[[], DataFrame], target: str,
    fetched_at: Column | None = None, run_id: str | None = None, **layout,
) -> UpsertResult | None:
    """Load what `read` gives into the target as a run of its own; None when it failed, which the journal tells.

    A run that is repeated changes nothing in table and quarantine, and is a run of its own in the journal.
    """
    run_id = run_id or uuid.uuid4().hex
    note(spark, journal, run_id, source_id, "start")
    try:
        result = load_receipts(spark, target, read(), F.current_timestamp() if fetched_at is None else fetched_at, **layout)
    except Exception as failure:
        note(spark, journal, run_id, source_id, "end", status="error", error=str(failure).splitlines()[0])
        return None
    counts = (result.fetched, result.inserted, result.updated, result.unchanged, result.rejected)
    note(spark, journal, run_id, source_id, "end", status="success", **dict(zip(COUNTS, counts)))
    return result
