"""Streams with state against batch results: more jobs than the bound, two views, lines out of order, replays."""

import random

import pytest
from pyspark.sql import functions as F

from runscope.operators import logs as L
from runscope.operators import state as D
from runscope.streaming import lifecycle as H
from runscope.streaming import stateful as T

EVENT = "workflow_id long, job_id long, rule_name string, event_type string, timestamp double, seq long, duration double, threads int"


@pytest.fixture(autouse=True, scope="module")
def rocksdb(spark):
    T.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, rows, schema, path, many):
    """A stream of the rows in so many batches, in the order given."""
    size = -(-len(rows) // many)
    for k in range(many):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(f"{path}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)


def run(stream, act, path, mode="update"):
    H.each_batch(stream, act, f"{path}-check", mode).awaitTermination(170)


def test_at_most_so_many_jobs_stay(spark, tmp_path):
    """As the batch fold and bound, with events in any order within batches and across them."""
    rnd = random.Random(6)
    rows, seq = [], 0
    for w in (1, 2):
        for job in range(30):
            t = job * 10.0
            kinds = ["job_submitted", "job_started"] + ([["job_finished"], ["job_error"], []][job % 3])
            for i, kind in enumerate(kinds):
                rows.append((w, job, "a", kind, t + 3 * i, seq, 50.0 if kind == "job_finished" and job % 2 else None, 1))
                seq += 1
    rnd.shuffle(rows)
    now = {}

    def take(batch, _):
        for r in batch.collect():
            if r["evicted"]:
                now.pop((r["workflow_id"], r["job_id"]), None)
            else:
                now[r["workflow_id"], r["job_id"]] = (r["status"], r["submit_time"], r["start_time"], r["end_time"], r["duration"])

    batch = spark.createDataFrame(rows, EVENT)
    run(T.bounded_jobs(streamed(spark, rows, EVENT, str(tmp_path / "all"), 3), 1000), take, str(tmp_path / "a"))
    fold = {(r["workflow_id"], r["job_id"]): (r["status"], r["submit_time"], r["start_time"], r["end_time"], r["duration"]) for r in D.accumulator_fold(batch).collect()}
    assert now == fold
    now.clear()
    rows.sort(key=lambda r: r[4])  # a job that has left doesn't come back
    run(T.bounded_jobs(streamed(spark, rows, EVENT, str(tmp_path / "in"), 4), 15), take, str(tmp_path / "b"))
    assert set(now) == {(r["workflow_id"], r["job_id"]) for r in D.bounded(D.accumulator_fold(batch), 15).collect()}
    assert len(now) == 30


def test_differences_appear_and_clear(spark, tmp_path):
    schema = "workflow_id long, job_id long, status string, start_time double, at double"
    events = [(1, 7, "error", 5.0, 9.0), (1, 8, "running", 5.0, 5.0), (1, 9, "running", 1.0, 1.0)]
    log = [(1, 8, "running", 5.0, 5.0), (1, 9, "running", 50.0, 2.0), (1, 7, "error", 5.0, 9.0)]
    e = streamed(spark, events, schema, str(tmp_path / "e"), 1)
    log_stream = streamed(spark, log, schema, str(tmp_path / "l"), 3)
    seen = []
    changes = T.validated(e, log_stream)
    run(changes, lambda b, _: seen.extend((r["job_id"], r["category"], r["change"]) for r in b.collect()), str(tmp_path / "c"), "append")
    assert (7, "missing_failed", "appears") in seen
    assert seen.index((7, "missing_failed", "clears")) > seen.index((7, "missing_failed", "appears"))
    assert {(9, "missing_running", "clears"), (9, "start_mismatch", "appears")} <= set(seen)
    T.into_report(changes, str(tmp_path / "report"), str(tmp_path / "c2")).awaitTermination(170)
    text = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "INFO | VALIDATION SESSION STARTED" in text
    assert "ERROR | [missing_failed] missing_failed appears | job_id=7 | events=error" in text
    assert "ERROR | [missing_failed] missing_failed clears | job_id=7 | events=error | parsed=error" in text
    states = lambda rows: spark.createDataFrame(rows, schema)
    open_ = {(j, c) for j, c, x in seen if x == "appears"} - {(j, c) for j, c, x in seen if x == "clears"}
    assert open_ == {(r["job_id"], r["category"]) for r in D.compare_states(states(events), states(log)).collect()}


LINES = "workflow_id long, run_id string, line_no long, line string"


def log_of(n):
    text = []
    for i in range(n):
        text += ["[Mon Jan  1 10:%02d:00 2024]" % i, f"rule r{i % 3}:", f"    jobid: {i}", "    threads: 2", "", "[Mon Jan  1 11:%02d:00 2024]" % i]
        text += [f"Finished job {i}."] if i % 3 else [f"Error in rule r{i % 3}:", f"    jobid: {i}"]
    return text


def test_swapped_batches_give_the_batch_result(spark, tmp_path):
    rows = [(1, "a", i, x) for i, x in enumerate(log_of(20))]
    size = len(rows) // 4
    parts = [rows[k * size : (k + 1) * size] for k in range(3)] + [rows[3 * size :]]
    swapped = parts[2] + parts[0] + parts[3] + parts[1]
    batch = spark.createDataFrame(rows, LINES)
    out = str(tmp_path / "out")
    stream = T.ordered_log_context(streamed(spark, swapped, LINES, str(tmp_path / "in"), 5))
    run(stream, lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "c"), "append")
    got = spark.read.parquet(out)
    assert got.where("late").count() == 0
    for f in (L.completed_jobs, L.failed_jobs, L.running_jobs):
        assert sorted(map(repr, f(got).collect())) == sorted(map(repr, f(L.facts(batch)).collect()))
    assert L.completed_jobs(got).count() == 13


def test_late_lines_are_reported(spark, tmp_path):
    """With room for ten lines only, gaps are given up, and what comes later is late."""
    rows = [(1, "a", i, x) for i, x in enumerate(log_of(20))]
    swapped = rows[30:] + rows[:30] + rows[:5]
    seen = []
    stream = T.ordered_log_context(streamed(spark, swapped, LINES, str(tmp_path / "in"), 6), most=10)
    run(stream, lambda b, _: seen.extend((r["line_no"], r["late"]) for r in b.collect()), str(tmp_path / "c"), "append")
    late = [n for n, x in seen if x]
    assert sorted(set(range(len(rows))) - {n for n, x in seen if not x}) == sorted(set(late) - {n for n, x in seen if not x})
    assert len(late) >= 30
    assert [n for n, x in seen if not x] == sorted({n for n, x in seen if not x})


def test_replays_and_late_repeats_change_nothing(spark, tmp_path):
    day = 86400.0
    rows = [(1, j, "a", "job_finished", 100.0 + j, j, 5.0, 2) for j in range(20)]
    later = [(1, j, "a", "job_finished", 2 * day + j, 100 + j, 9.0, 2) for j in range(25)]
    stream = streamed(spark, rows + rows + later, EVENT, str(tmp_path / "in"), 4)
    spark.sql("drop table if exists finished_jobs")
    H.into_sample_table(stream, "finished_jobs", str(tmp_path / "c"), 4).awaitTermination(170)
    table = {r["job_id"]: (r["duration"], r["end_time"]) for r in spark.table("finished_jobs").collect()}
    assert spark.table("finished_jobs").count() == len(table) == 25
    assert [table[j] for j in (0, 19)] == [(5.0, 100.0), (5.0, 119.0)]
    before = sorted(map(repr, spark.table("finished_jobs").collect()))
    H.into_sample_table(stream, "finished_jobs", str(tmp_path / "other"), 4).awaitTermination(170)  # all batches again
    assert sorted(map(repr, spark.table("finished_jobs").collect())) == before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.table("finished_jobs").select("workflow_id", "job_id")
        batch = spark.createDataFrame(rows, EVENT)
        plan = batch.join(t, ["workflow_id", "job_id"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the batch's side only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("drop table finished_jobs")


def test_report_lines(spark):
    from runscope.sources import readers as R

    d = spark.createDataFrame([("a", "warning", "m", 3, "r", {"s": "1", "b": "2"}, "x", None)], "category string, severity string, message string, job_id long, rule string, wildcards map<string,string>, event_value string, parsed_value string")
    assert R.discrepancy_lines(d).first()["value"] == "[a] m | job_id=3 | rule=r | wildcards={b=2,s=1} | events=x"
    counts = spark.createDataFrame([(9, 4, 2, 1)], "total int, completed int, n_running int, n_failed int")
    assert [r["value"] for r in R.summary_lines(counts, counts.withColumn("completed", F.lit(3))).collect()] == ["EVENT STATE: total=9, completed=4, running=2, failed=1", "PARSED STATE: total=9, completed=3, running=2, failed=1"]
