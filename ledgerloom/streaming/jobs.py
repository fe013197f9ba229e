"""Structured Streaming forms of the append log, the re-run guard, polled statuses and paired extractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the Parquet files of a table, whose schema is read from it."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends all that is there now to a Parquet table (exactly once across restarts) and returns the table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def trace_log(events: DataFrame) -> DataFrame:
    """Append-only trace rows."""
    return events.select("event_id", F.col("event_type").alias("step"), F.col("ts").alias("at"), F.floor("value").alias("ms"))


def first_runs(runs: DataFrame, keys: list[str], at: str, within: str = "1 hour") -> DataFrame:
    """The first run of each key; a repeat within the watermark is dropped. Failed runs do not count and may come again."""
    return runs.where("status <> 'failed'").withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, at: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; a window is given out once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def latest_status(polls: DataFrame, key: str = "job_id", status: str = "status", at: str = "at") -> DataFrame:
    """The last status of each job (update mode); a terminal one is kept before any later one."""
    done = F.col(status).isin("DONE", "FAILED")
    return polls.groupBy(key).agg(F.coalesce(F.min_by(status, F.when(done, F.col(at))), F.max_by(status, at)).alias("status"))


POLL = "job string, status string, at timestamp, n_polls long"
HELD = "jobs array<string>, statuses array<string>, at_us array<long>, n_polls array<long>, over array<boolean>"
TERMINAL = ("DONE", "FAILED")
#: Groups of jobs whose state is held together: a call and a stored state for each job would cost more than the job's polls.
GROUPS = 4096


def polled(polls: DataFrame, patience: str = "6 hours", late: str = "10 days", groups: int = GROUPS) -> DataFrame:
    """A stream of POLL rows from a stream of polls (job, at, status): what a job's polls have come to whenever that changes.

    A job's polls count in order of time. The first terminal status stays, and later polls of the job are not looked at any more; a job
    of which nothing terminal has come within `patience` of its last poll is TIMEOUT, which is terminal as well. If no later poll
    tells so, a timer on event time does, once the watermark (`late` behind the newest poll) has passed. The last row of a job
    (most polls, then terminal) is its status. Null jobs, times and statuses are left out. Rows later than the watermark are dropped.

    Jobs are held in `groups` groups by a hash of the job, each with one state and the timer of the job that is due first. A stream that goes on
    from a checkpoint needs the number it began with.
    """
    wait = int(polls.sparkSession.sql(f"SELECT cast(INTERVAL {patience} AS INTERVAL SECOND) AS w").first()["w"].total_seconds() * 1_000_000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {job: rest for job, *rest in zip(*state.get)} if state.exists else {}
        found = []
        if not state.hasTimedOut:
            # A batch's polls of these jobs, as (job, time, status) alone, by job and time.
            said = {}
            for part in parts:
                for job, moment, status in zip(part["job"], part["at"], part["status"]):
                    said.setdefault(job, []).append((moment.value // 1000, status))
            for job, own in said.items():
                status, at, n, over = held.get(job, (None, None, 0, False))
                before = (status, n)
                for moment, now in sorted(own):
                    if over:
                        break
                    if at is not None and moment - at > wait:
                        status, at, over = "TIMEOUT", at + wait, True
                        break
                    status, at, n, over = now, moment, n + 1, now in TERMINAL
                held[job] = [status, at, n, over]
                if (status, n) != before:
                    found.append((job, status, at, n))
        passed, due = state.getCurrentWatermarkMs(), None
        for job, (_, at, n, over) in held.items():
            if not over:
                timer = (at + wait) // 1000 + 1
                if timer < passed:
                    held[job] = ["TIMEOUT", at + wait, n, True]
                    found.append((job, "TIMEOUT", at + wait, n))
                else:
                    due = timer if due is None else min(due, timer)
        state.update((list(held), *map(list, zip(*held.values()))))
        if due is not None:
            state.setTimeoutTimestamp(max(due, passed + 1))
        if found:
            rows = pd.DataFrame(found, columns=["job", "status", "at", "n_polls"])
            rows["at"] = pd.to_datetime(rows["at"], unit="us")
            yield rows

    known = polls.where("job is not null and at is not null and status is not null").select(F.pmod(F.xxhash64("job"), F.lit(groups)).alias("group"), "job", "at", "status")
    return known.withWatermark("at", late).groupBy("group").applyInPandasWithState(step, POLL, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def final_status(rows: DataFrame) -> DataFrame:
    """The last of polled()'s rows for each job."""
    ended = F.col("status").isin(*TERMINAL, "TIMEOUT")
    return rows.groupBy("job").agg(F.max_by(F.struct("status", "at", "n_polls"), F.struct("n_polls", ended)).alias("s")).select("job", "s.*")


def paired(first: DataFrame, second: DataFrame, key: str, fields: list[str], within: str = "10 minutes", late: str = "10 days") -> DataFrame:
    """Two extraction streams (key, at, fields) side by side: a row for each pair that comes within the interval, whichever is first, with
    the fields that differ, and a row for each extraction that the watermark has passed without an answer. verdict is
    AGREE, DISAGREE, LEFT_ONLY or RIGHT_ONLY; nulls of both sides agree."""
    side = lambda df, n: df.withWatermark("at", late).select(F.col(key).alias(f"k{n}"), F.col("at").alias(f"at{n}"), F.struct(*fields).alias(f"row{n}"))
    near = F.expr(f"k1 = k2 AND at2 BETWEEN at1 - INTERVAL {within} AND at1 + INTERVAL {within}")
    met = side(first, 1).join(side(second, 2), near, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"row1.{f}").eqNullSafe(F.col(f"row2.{f}")), f) for f in fields]))
    both = F.col("at1").isNotNull() & F.col("at2").isNotNull()
    verdict = F.when(F.col("at2").isNull(), "LEFT_ONLY").when(F.col("at1").isNull(), "RIGHT_ONLY").when(F.size(differ) > 0, "DISAGREE").otherwise("AGREE")
    return met.select(F.coalesce("k1", "k2").alias(key), "at1", "at2", verdict.alias("verdict"), F.when(both, F.array_join(differ, ",")).alias("differ"))
