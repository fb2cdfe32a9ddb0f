"""Job and run state from events, and set operations between the event and the log view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from .scans import carried

RUN = ["workflow_id", "run_id"]
DAY = 86400.0


def _order() -> Column:
    return F.struct("timestamp", "seq")


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _latest(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, _order()))


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when, _order()))


def registry_fold(events: DataFrame) -> DataFrame:
    """State of every job: the type of its last event; a start sets the start, a finish or error the end; duration is their difference."""
    status = {"job_submitted": "SUBMITTED", "job_started": "RUNNING", "job_finished": "COMPLETED", "job_error": "FAILED"}
    e = events.where(F.col("event_type").isin(*status)).withColumn("key", F.coalesce(F.col("job_id").cast("string"), F.concat_ws(":", F.coalesce("rule_name", F.lit("unknown")), F.col("timestamp").cast("string"))))
    kind = F.coalesce(*[F.when(_is(a), F.lit(b)) for a, b in status.items()])
    t = F.nullif(F.col("threads"), F.lit(0))
    started = _latest(t, _is("job_started") & t.isNotNull())
    out = e.groupBy("workflow_id", "key").agg(F.max_by(kind, _order()).alias("status"), _latest(F.col("timestamp"), _is("job_started")).alias("start_time"), _latest(F.col("timestamp"), _is("job_finished") | _is("job_error")).alias("end_time"), F.coalesce(started, _first(t, t.isNotNull())).alias("threads"), F.coalesce(F.min_by("rule_name", _order()), F.lit("unknown")).alias("rule"))
    return out.withColumn("duration", F.col("end_time") - F.col("start_time"))


def accumulator_fold(events: DataFrame) -> DataFrame:
    """State of every job where a submission replaces the job, and an explicit duration beats end - start."""
    e = events.where("job_id is not null and event_type in ('job_submitted', 'job_started', 'job_finished', 'job_error')")
    w = Window.partitionBy("workflow_id", "job_id").orderBy("timestamp", "seq")
    last_submit = F.max(F.when(_is("job_submitted"), _order())).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = e.withColumn("s", last_submit).where(F.col("s").isNull() | (_order() >= F.col("s")))
    end = _is("job_finished") | _is("job_error")
    status = F.when(_is("job_submitted"), "submitted").when(_is("job_started"), "running").when(_is("job_finished"), "finished").otherwise("error")
    out = e.groupBy("workflow_id", "job_id").agg(F.max_by(status, _order()).alias("status"), _latest(F.col("timestamp"), _is("job_submitted")).alias("submit_time"), _latest(F.col("timestamp"), _is("job_started")).alias("start_time"), _latest(F.col("timestamp"), end).alias("end_time"), _latest(F.col("duration"), _is("job_finished") & F.col("duration").isNotNull()).alias("explicit"))
    return out.withColumn("duration", F.coalesce("explicit", F.col("end_time") - F.col("start_time"))).drop("explicit")


def workflow_progress(events: DataFrame) -> DataFrame:
    """Last known progress of each workflow."""
    return events.groupBy("workflow_id").agg(_latest(F.col("completed_jobs"), F.col("completed_jobs").isNotNull()).alias("completed"), _latest(F.col("total_jobs"), F.col("total_jobs").isNotNull()).alias("total"))


def merge_jobs(state: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null fields of records(keys, rule, start_time, end_time, threads) overwrite; an end completes a job, a start runs it."""
    cols = ["rule", "start_time", "end_time", "threads"]
    new = records.select(*keys, *[F.col(c).alias(f"n_{c}") for c in cols])
    out = state.join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"n_{c}", c).alias(c) for c in cols], F.col("status").alias("old"), F.col("n_end_time").isNotNull().alias("e"), F.col("n_start_time").isNotNull().alias("s"))
    return out.withColumn("status", F.when(F.col("e"), "COMPLETED").when(F.col("s"), "RUNNING").otherwise(F.coalesce("old", F.lit("PENDING")))).drop("old", "e", "s")


def bounded(jobs: DataFrame, most: int = 10_000, width: float = DAY) -> DataFrame:
    """At most so many jobs a workflow: the oldest ended go first, active ones stay.

    Ended jobs are numbered in order of their end, day by day (width), those without an end last.
    """
    ended = F.col("status").isin("finished", "error")
    number = {"n": F.lit(1).cast("long"), "r": ended.cast("long")}
    keyed = jobs.withColumn("last", F.when(ended & F.col("end_time").isNotNull(), 0).when(ended, 1).otherwise(2))
    day = F.when(F.col("last") == 0, F.floor(F.col("end_time") / width)).otherwise(F.lit(2**61) + F.col("last"))
    rows = carried(keyed, ["workflow_id"], ["last", "end_time", "job_id"], day, sums=number)
    total = jobs.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("total"))
    return rows.join(total, "workflow_id").where(~ended | (F.col("r") > F.col("total") - most)).select(*jobs.columns)


def status_counts(jobs: DataFrame, statuses: tuple[str, ...] = ("SUBMITTED", "RUNNING", "COMPLETED", "FAILED")) -> DataFrame:
    return jobs.groupBy("workflow_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses])


def segment_runs(events: DataFrame, width: float = DAY) -> DataFrame:
    """A workflow_started event begins a new run; each day (width) of a workflow is counted for itself first."""
    started = {"run_no": _is("workflow_started").cast("long")}
    return carried(events, ["workflow_id"], ["timestamp", "seq"], F.floor(F.col("timestamp") / width), sums=started)


def next_runs(runs: DataFrame) -> DataFrame:
    """Each run's cutoff: the start of the next one."""
    return runs.withColumn("next_start", F.lead("run_start").over(Window.partitionBy("workflow_id").orderBy("run_start", "run_id")))


def frames(completions: DataFrame, runs: DataFrame, width: float = DAY) -> DataFrame:
    """frame_run, frame_start and the completions between a run's start and the next one's: an as-of match by a sort, not a range join.

    Each day (width) of a workflow is sorted for itself; the run that is open when it begins is
    found first, from the starts and the days that have completions.
    """
    row = completions.select(F.struct("*").alias("c")).schema["c"].dataType
    starts = runs.select("workflow_id", F.col("run_start").alias("t"), F.lit(0).alias("o"), F.struct("run_id", "run_start").alias("r"))
    run = starts.schema["r"].dataType
    begin = F.floor(F.col("end_time") / width) * width
    days = completions.select("workflow_id", begin.cast("double").alias("t"), F.lit(-1).alias("o"), F.lit(None).cast(run).alias("r")).distinct()
    before = lambda *by: Window.partitionBy(*by).orderBy("t", "o", F.col("r.run_id")).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda *by: F.last("r", True).over(before(*by))
    open_ = starts.unionByName(days).withColumn("r", last("workflow_id")).where("o = -1 and r is not null")
    no_row = F.lit(None).cast(row).alias("c")
    ends = completions.select("workflow_id", F.col("end_time").alias("t"), F.lit(1).alias("o"), F.lit(None).cast(run).alias("r"), F.struct("*").alias("c"))
    both = starts.unionByName(open_).select("*", no_row).unionByName(ends).withColumn("day", F.floor(F.col("t") / width))
    got = both.withColumn("r", last("workflow_id", "day")).where("c is not null and r is not null")
    return got.select(F.col("r.run_id").alias("frame_run"), F.col("r.run_start").alias("frame_start"), "c.*")


def in_time_frame(completions: DataFrame, runs: DataFrame, width: float = DAY) -> DataFrame:
    """Completions with frame_run: the run of their workflow that had begun last when they ended."""
    return frames(completions, runs, width).drop("frame_start")


def with_fallback(primary: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of primary; those of other for keys that have none."""
    return primary.unionByName(other.join(primary.select(*keys).distinct(), keys, "left_anti"))


def augment_threads(completions: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown threads from known(workflow_id, rule, end_time, threads) with the same whole second; the last known wins."""
    second = F.floor("end_time").alias("sec")
    by = known.where("threads is not null").groupBy("workflow_id", "rule", second).agg(F.max_by("threads", F.struct("end_time", "threads")).alias("t"))
    return completions.withColumn("sec", F.floor("end_time")).join(by, ["workflow_id", "rule", "sec"], "left").withColumn("threads", F.coalesce("threads", "t")).drop("sec", "t")


def is_running(locks: DataFrame, as_of: float, stale: float = DEFAULT.stale_seconds) -> DataFrame:
    """locks(workflow_id, has_locks, has_incomplete, log_mtime)."""
    fresh = F.when(F.col("log_mtime").isNull(), True).otherwise(F.lit(as_of) - F.col("log_mtime") < stale)
    return locks.select("workflow_id", F.when(~F.col("has_locks"), False).when(F.col("has_incomplete"), True).otherwise(fresh).alias("running"))


def status_of_log() -> Column:
    """From live, latest, n_running, n_failed, n_incomplete, completed, total."""
    live = F.col("live")
    return F.when((F.col("n_running") > 0) & F.col("latest") & live, "running").when(F.col("n_failed") > 0, "failed").when(F.col("n_incomplete") > 0, "incomplete").when((F.col("completed") < F.col("total")) & ~live, "incomplete").when(live, "running").otherwise("completed")


def status_of_registry(as_of: float, stale: float = DEFAULT.stale_seconds) -> Column:
    """From total, completed, failed, running, start_time. A job that runs decides first, an old start only if nothing runs and something is done."""
    total, done, failed, running = (F.col(c) for c in ("total", "completed", "failed", "running"))
    age = F.lit(as_of) - F.col("start_time")
    unknown = F.when(failed > 0, "failed").when(running > 0, "running").otherwise("unknown")
    begun = F.when(age > stale, "stale").when(age.isNotNull(), "running").otherwise("incomplete")
    known = (
        F.when(running > 0, "running")
        .when((failed > 0) & (done < total), "failed")
        .when(done >= total, "completed")
        .when(done == 0, "not_started")
        .otherwise(begun)
    )
    return F.when(total.isNull(), unknown).otherwise(known)


def registry_snapshot(jobs: DataFrame, progress: DataFrame, starts: DataFrame, as_of: float) -> DataFrame:
    """A row a workflow from its jobs(workflow_id, status), progress(workflow_id, completed, total) and starts(workflow_id, start_time).

    Submitted jobs are pending; a missing total is null for the status and 0 in the table.
    """
    counts = status_counts(jobs).withColumnRenamed("submitted", "pending")
    total = progress.select("workflow_id", "total")
    s = counts.join(total, "workflow_id", "full_outer").join(starts.select("workflow_id", "start_time"), "workflow_id", "left")
    s = s.na.fill(0, ["pending", "running", "completed", "failed"]).withColumn("status", status_of_registry(as_of))
    return s.withColumn("total", F.coalesce("total", F.lit(0)))


def overlay(log_jobs: DataFrame, event_jobs: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """One table of jobs from the log's view refined by events: workflow_id, job_id, state and what is known of the job.

    log_jobs(workflow_id, job_id, state, rule, threads, wildcards, start_time, end_time), state running,
    failed or completed; event_jobs the same columns with the registry's status. A job that events
    failed is failed; else a failure in the log counts; else the events' state, if they know it.
    What events know of a job beats the log. Submitted jobs are pending; in workflows without such,
    planned(workflow_id, job_id, rule, threads) jobs that neither view has seen are.
    """
    known = ["rule", "threads", "wildcards", "start_time", "end_time"]
    kinds = {"SUBMITTED": "pending", "RUNNING": "running", "COMPLETED": "completed", "FAILED": "failed"}
    state = F.coalesce(*[F.when(F.col("status") == a, F.lit(b)) for a, b in kinds.items()])
    e = event_jobs.select("workflow_id", "job_id", state.alias("e_state"), *[F.col(c).alias(f"e_{c}") for c in known])
    j = log_jobs.join(e, ["workflow_id", "job_id"], "full_outer")
    failed = (F.col("e_state") == "failed") | (F.col("state") == "failed")
    ahead = F.when((F.col("e_state") == "pending") & F.col("state").isNotNull(), F.col("state")).otherwise(F.col("e_state"))
    merged = F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise(F.coalesce(ahead, "state"))
    out = j.select("workflow_id", "job_id", merged.alias("state"), *[F.coalesce(f"e_{c}", c).alias(c) for c in known])
    if planned is None:
        return out
    waiting = out.where("state = 'pending'").select("workflow_id").distinct()
    rest = planned.join(waiting, "workflow_id", "left_anti").join(out, ["workflow_id", "job_id"], "left_anti")
    return out.unionByName(rest.select("workflow_id", "job_id", F.lit("pending").alias("state"), "rule", "threads"), allowMissingColumns=True)


def overlaid_counts(log_counts: DataFrame, progress: DataFrame, jobs: DataFrame) -> DataFrame:
    """Completed and total of the last progress event, or else of the log, and the numbers of overlaid jobs by state."""
    p = progress.select("workflow_id", F.col("completed").alias("e_completed"), F.col("total").alias("e_total"))
    states = ("running", "failed", "pending")
    n = jobs.groupBy("workflow_id").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states])
    s = log_counts.join(p, "workflow_id", "full_outer").join(n, "workflow_id", "full_outer")
    done = [F.coalesce(f"e_{c}", c).alias(c) for c in ("completed", "total")]
    return s.select("workflow_id", *done, *[F.coalesce(f"n_{x}", F.lit(0)).alias(f"n_{x}") for x in states])


def all_samples(profile: DataFrame, metadata: DataFrame, events: DataFrame, log_threads: DataFrame) -> DataFrame:
    """Samples of all sources with a column source: profile, metadata, events and log jobs with known threads.

    Each has rule, duration, end_time and what else it knows (threads, wildcards, input_size, k1..k4).
    """
    log_threads = log_threads.where("threads is not null and duration is not null")
    parts = (("profile", profile), ("metadata", metadata), ("events", events), ("log", log_threads))
    out = None
    for name, d in parts:
        d = d.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def pending_count() -> list[Column]:
    p = F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("n_failed") - F.col("n_running") - F.col("n_incomplete"))
    return [p.alias("pending"), F.when(F.col("total") > 0, F.least(F.lit(100.0), F.col("completed") / F.col("total") * 100)).otherwise(F.lit(0.0)).alias("percent")]


def reconcile(running: DataFrame, failed: DataFrame, live: DataFrame) -> DataFrame:
    """Running jobs of live runs that have not failed."""
    return running.join(failed.where("job_id is not null"), [*RUN, "job_id"], "left_anti").join(live.where("running"), "workflow_id", "left_semi")


def merged_failures(events_failed: DataFrame, log_failed: DataFrame, keys: list[str]) -> DataFrame:
    return events_failed.select(*keys).unionByName(log_failed.select(*keys).join(events_failed, keys, "left_anti"))


def new_completions(done: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    return done.dropDuplicates(keys).join(recorded, keys, "left_anti")


def compare_states(events_jobs: DataFrame, log_jobs: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Differences between the jobs (workflow_id, job_id, status, start_time) of two views: one row each."""
    a = events_jobs.select("workflow_id", "job_id", F.col("status").alias("a"), F.col("start_time").alias("sa"))
    b = log_jobs.select("workflow_id", "job_id", F.col("status").alias("b"), F.col("start_time").alias("sb"))
    j = a.join(b, ["workflow_id", "job_id"], "full_outer")
    run_a, run_b = F.coalesce(F.col("a") == "running", F.lit(False)), F.coalesce(F.col("b") == "running", F.lit(False))
    fail_a, fail_b = F.coalesce(F.col("a") == "error", F.lit(False)), F.coalesce(F.col("b") == "error", F.lit(False))
    row = lambda ok, category, severity: F.when(ok, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    found = F.array(row(run_a & ~run_b, "missing_running", "error"), row(run_b & ~run_a & F.col("sb").isNotNull(), "extra_running", "warning"), row(run_a & run_b & (F.abs(F.col("sa") - F.col("sb")) > tolerance), "start_mismatch", "info"), row(fail_a & ~fail_b, "missing_failed", "error"))
    return j.select("workflow_id", "job_id", F.inline(F.array_compact(found)))


def compare_counts(events_jobs: DataFrame, log_jobs: DataFrame) -> DataFrame:
    """Numbers of finished, running and failed jobs that differ."""
    agg = lambda d, p: d.groupBy("workflow_id").agg(*[F.count_if(F.col("status") == s).alias(f"{p}_{s}") for s in ("finished", "running", "error")])
    j = agg(events_jobs, "e").join(agg(log_jobs, "l"), "workflow_id", "full_outer").na.fill(0)
    rows = F.array(*[F.struct(F.lit(s).alias("what"), F.col(f"e_{s}").alias("event_value"), F.col(f"l_{s}").alias("parsed_value")) for s in ("finished", "running", "error")])
    return j.select("workflow_id", F.inline(rows)).where("event_value <> parsed_value")


def current_event_files(events: DataFrame, runs: DataFrame, slack: float = 60.0) -> DataFrame:
    """Workflows whose first event is a start no earlier than the log's, less the slack."""
    first = events.groupBy("workflow_id").agg(F.min_by(F.struct("event_type", "timestamp"), _order()).alias("f"))
    last = runs.groupBy("workflow_id").agg(F.max("run_start").alias("log_start"))
    return first.join(last, "workflow_id").select("workflow_id", ((F.col("f.event_type") == "workflow_started") & (F.col("f.timestamp") - F.col("log_start") >= -slack)).alias("current"))


def derive_events(records: DataFrame) -> DataFrame:
    """Runner records(workflow_id, kind, job_ids array, rule, timestamp, seq, done, total) to events; rule and start are remembered per job."""
    kinds = {"job_info": "job_submitted", "job_started": "job_started", "job_finished": "job_finished", "job_error": "job_error", "progress": "progress", "workflow_started": "workflow_started"}
    kind = F.coalesce(*[F.when(F.col("kind") == a, F.lit(b)) for a, b in kinds.items()])
    one = records.select("workflow_id", kind.alias("event_type"), F.explode_outer("job_ids").alias("job_id"), "rule", "timestamp", "seq", F.col("done").alias("completed_jobs"), F.col("total").alias("total_jobs")).where("event_type is not null and not (event_type = 'job_error' and job_id is null)")
    w = Window.partitionBy("workflow_id", "job_id").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(_is("job_started"), F.nullif(F.col("timestamp"), F.lit(0.0))), True).over(w)
    end = _is("job_finished") | _is("job_error")
    return one.withColumn("rule_name", F.when(F.col("job_id").isNotNull(), F.coalesce("rule", F.last("rule", True).over(w))).otherwise(F.col("rule"))).withColumn("duration", F.when(end & F.col("job_id").isNotNull(), F.col("timestamp") - start)).drop("rule")


def submitted_starts(events: DataFrame) -> DataFrame:
    """The variant in which a submission is also a start."""
    kinds = F.when(_is("job_submitted"), F.array(F.lit("job_submitted"), F.lit("job_started"))).otherwise(F.array("event_type"))
    return events.withColumn("event_type", F.explode(kinds))
