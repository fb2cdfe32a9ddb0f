"""Report queries: tables that a status page or a person reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import logs as L
from ..operators import state as D
from ..operators import stats as E
from ..operators.tables import stored

RUN = ["workflow_id", "run_id"]


def rules_like(jobs: DataFrame, text: str) -> DataFrame:
    return jobs.where(F.contains(F.lower("rule"), F.lit(text.lower()))).select("rule").distinct()


def running_table(jobs: DataFrame, order: str = "remaining", descending: bool = False) -> DataFrame:
    """Nulls of the order column come last either way."""
    c = F.col(order)
    return jobs.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "rule", "job_id")


def recent_completions(completed: DataFrame, failed: DataFrame, key: str = "end_time", descending: bool = True, k: int = 20) -> DataFrame:
    both = completed.withColumn("state", F.lit("completed")).unionByName(failed.withColumn("state", F.lit("failed")), allowMissingColumns=True)
    c, ties = F.col(key), ["rule", "job_id", *[x for x in RUN if x in both.columns]]
    return both.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties).limit(k)


def pending_table(pending: DataFrame, k: int = 10) -> DataFrame:
    """The k rules with most pending jobs, and how many rules follow."""
    per = pending.groupBy("rule").agg(F.sum("pending").alias("pending"))
    more = per.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - k).alias("more"))
    return per.orderBy(F.desc("pending"), "rule").limit(k).crossJoin(F.broadcast(more))


def stats_table(samples: DataFrame) -> DataFrame:
    """A row per (rule, threads), or per rule without known threads."""
    t = E.timing_stats(samples.where("threads is not null"), ["rule", "threads"]).withColumn("threads", F.col("threads").cast("string"))
    r = E.timing_stats(samples, ["rule"]).join(t, "rule", "left_anti").withColumn("threads", F.lit("-"))
    return t.unionByName(r).orderBy(F.desc("n"), "rule", "threads")


def top_with_overflow(jobs: DataFrame, k: int = 8) -> DataFrame:
    w = Window.partitionBy(*RUN)
    r = F.row_number().over(w.orderBy("rule", "job_id"))
    return jobs.withColumn("r", r).withColumn("more", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - k)).where(F.col("r") <= k)


def incomplete_files(markers: DataFrame, roots: DataFrame, k: int = 8) -> DataFrame:
    """The first k output files of markers(workflow_id, output_path) in each workflow, and how many more there are; paths are relative to
    roots(workflow_id, root) where they lie below it, and unknown where there is none."""
    below = F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"))
    j = markers.join(roots, "workflow_id", "left").withColumn("inside", F.startswith("output_path", below))
    path = F.when(F.col("output_path").isNull(), "unknown").when(F.col("inside"), F.expr("substring(output_path, length(concat(regexp_replace(root, '/+$', ''), '/')) + 1)")).otherwise(F.col("output_path"))
    j = j.select("workflow_id", path.alias("path"))
    more = j.groupBy("workflow_id").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - k).alias("more"))
    first = j.withColumn("r", F.row_number().over(Window.partitionBy("workflow_id").orderBy("path"))).where(F.col("r") <= k)
    return first.join(more, "workflow_id")


def page(rows: DataFrame, order: list, offset: int, n: int = 10) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(n)


def summary(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(*RUN, (F.col("completed") - F.lit(0)).alias("succeeded"), "n_failed", "n_running", "n_incomplete", *D.pending_count()[:1])


def shares(snapshot: DataFrame) -> DataFrame:
    """Percent succeeded, failed, incomplete and remaining; failed jobs count as done."""
    t = F.greatest(F.lit(1), F.col("total"))
    part = lambda c: F.col(c) / t * 100
    left = F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("n_failed") - F.col("n_incomplete"))
    return snapshot.select(*RUN, part("completed").alias("succeeded"), part("n_failed").alias("failed"), part("n_incomplete").alias("incomplete"), (left / t * 100).alias("remaining"), ((F.col("completed") + F.col("n_failed")) / t * 100).alias("percent_done"))


def snapshot(lines: DataFrame, live: DataFrame | None = None, incomplete: DataFrame | None = None, chunk_lines: int | None = L.CHUNK_LINES) -> DataFrame:
    """One row per run: counts, status, times. live(workflow_id, running) and incomplete(workflow_id, n) come from lock and marker files."""
    s = L.side_by_side(L.overview(lines), L.job_counts(L.facts(lines, chunk_lines, ())))
    s = s.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_running", "n_failed", "n_completed")})
    last = F.row_number().over(Window.partitionBy("workflow_id").orderBy(F.desc("run_start"), F.desc("run_id"))) == 1
    s = s.withColumn("latest", last)
    s = s.withColumn("live", F.lit(False)) if live is None else s.join(live.withColumnRenamed("running", "live"), "workflow_id", "left").withColumn("live", F.coalesce("live", F.lit(False)) & F.col("latest"))
    s = s.withColumn("n_incomplete", F.lit(0).cast("long")) if incomplete is None else s.join(incomplete.withColumnRenamed("n", "n_incomplete"), "workflow_id", "left").withColumn("n_incomplete", F.when(F.col("live") | ~F.col("latest"), 0).otherwise(F.coalesce("n_incomplete", F.lit(0))))
    s = s.withColumn("n_running", F.when(F.col("live"), F.col("n_running")).otherwise(0))
    return s.withColumn("status", D.status_of_log())


def run_completions(log_completed: DataFrame, metadata: DataFrame, runs: DataFrame) -> DataFrame:
    """Completions of runs(run, run_start): those of metadata(workflow_id, rule, start_time, end_time, ...) in a run's time frame, or else
    what its log says; source is metadata or log. Threads that are unknown come from the log's job of the same rule and second."""
    columns = [*RUN, "rule", "start_time", "end_time", "threads"]
    meta = metadata.withColumn("threads", F.col("threads") if "threads" in metadata.columns else F.lit(None).cast("int"))
    framed = D.in_time_frame(meta.drop("run_id"), runs).withColumnRenamed("frame_run", "run_id").select(*columns, F.lit("metadata").alias("source"))
    both = D.with_fallback(framed, log_completed.select(*columns, F.lit("log").alias("source")), RUN)
    return D.augment_threads(both, log_completed)


def whole_snapshot(lines: DataFrame, locks: DataFrame, markers: DataFrame, metadata: DataFrame, as_of: float, chunk_lines: int | None = L.CHUNK_LINES) -> DataFrame:
    """One row a run from all that a workflow leaves behind: counts and status from logs, locks, incomplete markers and metadata.

    locks(workflow_id, has_locks, has_incomplete, log_mtime) tell which workflows run; only a workflow's latest run can be live.
    Jobs run in live runs only; markers(workflow_id, start_time) since the start of the latest run are interrupted jobs
    unless it is live. n_completions counts those of `run_completions`, n_with_threads the ones whose threads are known.
    What the logs tell, a row a run and one a job, is written to a table, as several steps read it.
    """
    count = lambda d, *n: d.groupBy(*RUN).agg(*n)
    told = L.overview(lines).unionByName(L.outcomes(L.facts(lines, chunk_lines, ("threads",)), ("threads",)), allowMissingColumns=True)
    told = stored(told, "logs")
    runs = told.where("total is not null").select(*RUN, "completed", "total", "run_start", "cores")
    jobs = told.where("total is null").select(*RUN, "job_id", "running", "failed", "done")
    last = F.row_number().over(Window.partitionBy("workflow_id").orderBy(F.desc("run_start"), F.desc("run_id"))) == 1
    live = D.is_running(locks, as_of)
    s = runs.withColumn("latest", last).join(live, "workflow_id", "left").withColumn("live", F.coalesce("running", F.lit(False)) & F.col("latest")).drop("running")

    since = s.where("latest and not live").select(*RUN, "run_start")
    left = markers.join(since, "workflow_id").where("run_start is null or start_time >= run_start")
    one, known = F.count(F.lit(1)), F.count("threads")
    done = run_completions(jobs.where("done is not null").select(*RUN, "job_id", "done.*"), metadata, runs.where("run_start is not null").select(*RUN, "run_start"))
    # no job both runs and failed, so that running ones need no look at failures
    for d in (L.outcome_counts(jobs).drop("n_completed"), count(left, one.alias("n_incomplete")), count(done, one.alias("n_completions"), known.alias("n_with_threads"), F.first("source").alias("source"))):
        s = s.join(d, RUN, "left")
    s = s.na.fill(0, ["n_running", "n_failed", "n_incomplete", "n_completions", "n_with_threads"])
    s = s.withColumn("n_running", F.when(F.col("live"), F.col("n_running")).otherwise(0))
    return s.withColumn("status", D.status_of_log())


def status_report(snap: DataFrame, eta: DataFrame, as_of: float) -> DataFrame:
    j = snap.join(eta, RUN, "left")
    return j.select(*RUN, "status", S.count_text(F.col("completed"), F.col("total")).alias("progress"), S.duration_text(F.lit(as_of) - F.col("run_start")).alias("elapsed"), "n_running", "n_failed", "n_incomplete", S.eta_text(F.col("seconds_remaining"), F.col("lower"), F.col("upper"), F.col("confidence")).alias("eta"))
