"""Structured Streaming forms of the event operators: job lifecycle, bounded state, statistics, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import logs

_STATUS = {"job_submitted": "SUBMITTED", "job_started": "RUNNING", "job_finished": "COMPLETED", "job_error": "FAILED"}
STATE = "status string, last_ts double, last_seq long, start_time double, start_ts double, end_time double, end_ts double"
OUT = "workflow_id long, job_id long, status string, start_time double, end_time double, duration double, last_time double"


def _folding(ttl_ms: int | None):
    """The registry fold of one job; events may come in any order, within a batch and across batches."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        none = float("-inf")
        status, at, seq, start, start_at, end, end_at = state.get if state.exists else ("PENDING", none, -1, None, none, None, none)
        for p in parts:
            for kind, t, n in zip(p["event_type"], p["timestamp"], p["seq"], strict=True):
                if (t, n) >= (at, seq):
                    status, at, seq = _STATUS[kind], float(t), int(n)
                if kind == "job_started" and t >= start_at:
                    start, start_at = float(t), float(t)
                if kind in ("job_finished", "job_error") and t >= end_at:
                    end, end_at = float(t), float(t)
        state.update((status, at, seq, start, start_at, end, end_at))
        if ttl_ms and status in ("COMPLETED", "FAILED"):
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"workflow_id": [key[0]], "job_id": [key[1]], "status": [status], "start_time": [start], "end_time": [end], "duration": [end - start if start is not None and end is not None else None], "last_time": [at]})

    return fold


def job_lifecycle(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Update-mode stream of job states; state per (workflow, job).

    With ttl_ms, ended jobs leave the state after that time without events, which
    bounds it; use that with a trigger that keeps running (an availableNow query
    would wait for the timers).
    """
    e = events.where("job_id is not null").where(F.col("event_type").isin(*_STATUS)).select("workflow_id", "job_id", "event_type", "timestamp", "seq")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return e.groupBy("workflow_id", "job_id").applyInPandasWithState(_folding(ttl_ms), OUT, STATE, "update", timeout)


def throughput(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type with a watermark on event time."""
    e = events.withColumn("ts", F.timestamp_seconds("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "n")


def new_failures(failures: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (workflow, run, rule, job) failure once over all batches."""
    return failures.withColumn("ts", F.timestamp_seconds("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["workflow_id", "run_id", "rule", "job_id"])


def into_samples(events: DataFrame, path: str, checkpoint: str):
    """Appends each finished job once to a samples table (Parquet).

    A repeat that arrives more than a day after is appended again; readers drop it by (workflow_id, job_id).
    """
    done = events.where("event_type = 'job_finished' and duration is not null").withColumn("ts", F.timestamp_seconds("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["workflow_id", "job_id"])
    rows = done.select("workflow_id", "job_id", F.col("rule_name").alias("rule"), "duration", F.col("timestamp").alias("end_time"), "threads")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_sample_table(events: DataFrame, table: str, checkpoint: str, buckets: int = 64):
    """Merges each finished job once into a catalog table that is bucketed by workflow and job, whenever it comes.

    A batch adds what the table doesn't have, so replayed batches and late repeats change nothing. The table's side of that
    join is not shuffled, since it is bucketed by the keys.
    """
    spark, keys = events.sparkSession, ["workflow_id", "job_id"]
    done = events.where("event_type = 'job_finished' and duration is not null").select(*keys, F.col("rule_name").alias("rule"), "duration", F.col("timestamp").alias("end_time"), "threads", "seq")

    def merge(batch: DataFrame, _: int) -> None:
        first = batch.groupBy(*keys).agg(F.min_by(F.struct("rule", "duration", "end_time", "threads"), F.struct("end_time", "seq")).alias("s")).select(*keys, "s.*")
        if spark.catalog.tableExists(table):
            spark.catalog.refreshTable(table)  # batches are written by a session of their own
            first = first.join(batch.sparkSession.table(table).select(*keys), keys, "left_anti")
        first.write.bucketBy(buckets, *keys).sortBy(*keys).mode("append").saveAsTable(table)
        spark.catalog.refreshTable(table)

    return done.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Runs a batch operator, such as the comparison of two views, on every micro-batch."""
    return stream.writeStream.outputMode(mode).foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale_jobs(jobs: DataFrame, as_of: float, after: float = 1800.0) -> DataFrame:
    """Open jobs without activity since their last known time; a submitted job has that of its submission."""
    times = [c for c in ("last_time", "end_time", "start_time", "submit_time") if c in jobs.columns]
    last = F.array_max(F.array(*times))
    return jobs.where(F.col("status").isin("RUNNING", "SUBMITTED") & (F.lit(as_of) - last > after))


CONTEXT = "block long, error_block long, last_ts double, rule string, in_error boolean"
LINE = "workflow_id {w}, run_id string, line_no long, rule_start string, job_id long, finished long, error_rule string, ts double, wildcards string, threads int, log string"
CARRIED = "line_no long, block long, error_block long, last_ts double, rule string, in_error boolean"


def carry(p: pd.DataFrame, before: tuple) -> tuple[pd.DataFrame, tuple]:
    """Lines in order with their context, and the context after them; before is what `CARRIED` says of the lines before."""
    seen, block, error_block, last_ts, rule, in_error = before
    if not len(p):
        return p, before
    opens = p["error_rule"].notna()
    closes = (p["rule_start"].notna() | p["ts"].notna()) & ~opens
    p["block"] = block + p["rule_start"].notna().cumsum()
    p["error_block"] = error_block + (opens | closes).cumsum()
    p["last_ts"] = pd.concat([pd.Series([last_ts], dtype="float64"), p["ts"].astype("float64")]).ffill().iloc[1:].to_numpy()
    p["rule"] = pd.concat([pd.Series([rule], dtype="object"), p["rule_start"].astype("object")]).ffill().iloc[1:].to_numpy()
    open_ = pd.Series(float("nan"), index=p.index).mask(opens, 1.0).mask(closes, 0.0)
    p["in_error"] = open_.ffill().fillna(float(in_error)) == 1.0
    end = p.iloc[-1]
    ts = float(end["last_ts"])
    return p, (int(end["line_no"]), int(end["block"]), int(end["error_block"]), None if ts != ts else ts, end["rule"] if isinstance(end["rule"], str) else None, bool(end["in_error"]))


def _carry(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The context of a run's next lines; lines that were seen before are left out."""
    before = state.get if state.exists else (-1, 0, 0, None, None, False)
    p = pd.concat(list(parts)).sort_values("line_no").drop_duplicates("line_no")
    p, after = carry(p[p["line_no"] > before[0]].reset_index(drop=True), before)
    if len(p):
        state.update(after)
        yield p


def log_context(lines: DataFrame) -> DataFrame:
    """A stream of log lines with the context that batch parsing would give them, kept per run between micro-batches.

    Appended to a table, its rows are what `logs.facts` reads. Lines of a run must arrive in order of line_no;
    `stateful.ordered_log_context` takes them in any order.
    """
    p = logs.parsed(lines)
    kind = p.schema["workflow_id"].dataType.simpleString()
    columns = [c.split()[0] for c in LINE.split(", ")]
    rows = p.select(*columns).groupBy("workflow_id", "run_id")
    return rows.applyInPandasWithState(_carry, f"{LINE.format(w=kind)}, {CONTEXT}", CARRIED, "append", GroupStateTimeout.NoTimeout)
