"""Status rules, views put together, incremental logs and helpers of the estimates."""

import pytest
from pyspark.sql import functions as F

from runscope.operators import estimate as X
from runscope.operators import logs as L
from runscope.operators import state as D
from runscope.sources import readers as R
from runscope.streaming import lifecycle as H

LOG = """Provided cores: 8
Job stats:
job      count
-----  -------
align        3
total        3

[Mon Jan  6 10:00:00 2026]
rule align:
    jobid: 1
    wildcards: sample=A
    threads: 4
[Mon Jan  6 10:00:05 2026]
Finished job 1.
1 of 3 steps (33%) done
[Mon Jan  6 10:00:07 2026]
localrule align:
    output: x
    jobid: 2
Error in rule align:
    log: logs/b.log (check log file(s) for error details)
some text of the tool
[Mon Jan  6 10:00:09 2026]
checkpoint sort:
    jobid: 3
    log: logs/3.log
Error in rule other:
    jobid: 9
[Mon Jan  6 10:00:11 2026]
rule align:
    jobid: 2
    threads: 2
Finished jobid: 2 (Rule: align)""".split("\n")


def log_lines(spark, runs=("r1", "r2")):
    rows = [("w", r, i, x) for r in runs for i, x in enumerate(LOG)]
    return spark.createDataFrame(rows, "workflow_id string, run_id string, line_no long, line string")


def key(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def test_log_operators_on_one_set_of_facts(spark):
    lines = log_lines(spark, ["r"])
    for x in (lines, L.facts(lines)):
        assert [(r["job_id"], r["rule"], r["log"]) for r in L.failed_jobs(x).orderBy("job_id").collect()] == [(2, "align", "logs/b.log"), (9, "other", None)]
        assert [(r["job_id"], r["rule"], r["log"]) for r in L.running_jobs(x).collect()] == [(3, "sort", "logs/3.log")]
        assert [(r["job_id"], r["duration"], r["threads"]) for r in L.completed_jobs(x).orderBy("job_id").collect()] == [(1, 5.0, 4), (2, 0.0, 2)]
        assert [(r["rule"], r["completed"]) for r in L.completions_per_rule(x).collect()] == [("align", 2)]
    life = {r["job_id"]: (r["status"], r["threads"], r["end_order"]) for r in L.lifecycle(lines).collect()}
    assert life == {1: ("completed", 4, 1), 2: ("completed", 2, 2), 3: ("running", None, None), 9: ("failed", None, None)}
    plan = L.run_plan(lines).first()
    assert (plan["cores"], plan["expected"], plan["n_scheduled"]) == (8, {"align": 3}, 3)
    planned = spark.createDataFrame([("w", "r", i) for i in range(1, 11)], "workflow_id string, run_id string, job_id long")
    assert sorted(r["job_id"] for r in L.pending_jobs(lines, planned).collect()) == [4, 5, 6, 7, 8, 10]


@pytest.mark.parametrize("step", [1, 5, 40])
def test_log_stream_equals_batch(spark, tmp_path, step):
    lines = log_lines(spark)
    for at in range(0, len(LOG), step):
        lines.where(F.col("line_no").between(at - 1, at + step - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # each overlaps the last
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = H.log_context(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert key(L.facts(rows)) == key(L.facts(lines))
    assert key(L.running_jobs(rows)) == key(L.running_jobs(lines))


@pytest.mark.parametrize(
    ("total", "completed", "failed", "running", "start", "status"),
    [
        (None, 0, 1, 1, None, "failed"), (None, 0, 0, 1, None, "running"), (None, 5, 0, 0, None, "unknown"), (5, 5, 0, 1, None, "running"), (5, 3, 1, 0, None, "failed"),
        (5, 5, 1, 0, None, "completed"), (5, 0, 0, 0, 1.0, "not_started"), (5, 2, 0, 0, 1.0, "stale"), (5, 2, 0, 0, 9_000.0, "running"), (5, 2, 0, 0, None, "incomplete"), (0, 0, 0, 0, None, "completed"),
    ],
)
def test_status_of_registry(spark, total, completed, failed, running, start, status):
    d = spark.createDataFrame([(total, completed, failed, running, start)], "total int, completed long, failed long, running long, start_time double")
    assert d.select(D.status_of_registry(10_000.0)).first()[0] == status


def test_overlay(spark):
    cols = "workflow_id string, job_id long, {} string, rule string, threads int, wildcards map<string,string>, start_time double, end_time double"
    log = spark.createDataFrame([("w", 1, "running", "a", None, None, 5.0, None), ("w", 2, "failed", "a", 2, None, 5.0, None), ("w", 3, "running", "b", None, None, 5.0, None), ("v", 1, "running", "c", 1, None, 1.0, None)], cols.format("state"))
    events = spark.createDataFrame([("w", 1, "COMPLETED", "a", 4, {"s": "A"}, 4.0, 9.0), ("w", 2, "RUNNING", "a", None, None, 4.5, None), ("w", 3, "FAILED", "b", None, None, None, 8.0), ("w", 4, "SUBMITTED", "b", 1, None, None, None)], cols.format("status"))
    planned = spark.createDataFrame([("w", 5, "b", 1), ("v", 1, "c", 1), ("v", 2, "c", 3)], "workflow_id string, job_id long, rule string, threads int")
    got = D.overlay(log, events, planned)
    jobs = {(r["workflow_id"], r["job_id"]): (r["state"], r["threads"], r["start_time"]) for r in got.collect()}
    assert jobs == {("w", 1): ("completed", 4, 4.0), ("w", 2): ("failed", 2, 4.5), ("w", 3): ("failed", None, 5.0), ("w", 4): ("pending", 1, None), ("v", 1): ("running", 1, 1.0), ("v", 2): ("pending", 3, None)}
    counts = spark.createDataFrame([("w", 0, 9), ("v", 2, 5)], "workflow_id string, completed int, total int")
    progress = spark.createDataFrame([("w", 1, 6)], "workflow_id string, completed int, total int")
    assert {r["workflow_id"]: tuple(r)[1:] for r in D.overlaid_counts(counts, progress, got).collect()} == {"w": (1, 6, 0, 2, 1), "v": (2, 5, 1, 0, 1)}


def test_stale_jobs(spark):
    jobs = spark.createDataFrame([("w", 1, "SUBMITTED", None, 10.0), ("w", 2, "RUNNING", 20.0, 20.0), ("w", 3, "RUNNING", 9_000.0, 9_000.0), ("w", 4, "COMPLETED", 1.0, 2.0)], "workflow_id string, job_id long, status string, start_time double, last_time double")
    assert sorted(r["job_id"] for r in H.stale_jobs(jobs, 10_000.0).collect()) == [1, 2]


def test_estimate_helpers(spark):
    d = spark.createDataFrame([(100.0, 10.0, 5, 0.5), (0.0, 0.0, 1, 0.0)], "mean double, std double, n int, c double")
    var = X.scenario_variance(F.col("mean"), F.col("std"), F.col("n"), "single_sample")
    assert [r[0] for r in d.select(var).collect()] == [100.0, pytest.approx(324.0)]
    assert [r[0] for r in d.select(X.adjusted_variance(F.lit(8.0), F.col("c"))).collect()] == [6.0, 8.0]
    assert tuple(d.select(*X.bounds(F.col("mean"), F.col("std"))).first()) == (80.0, 120.0)
    run = spark.createDataFrame([(100.0, 25.0, 40.0, None), (100.0, 25.0, 105.0, None), (100.0, 25.0, 300.0, None), (100.0, 25.0, 50.0, 25.0)], "expected double, variance double, elapsed double, tool_percent double")
    assert [r["remaining"] for r in X.running_remaining(run).collect()] == [60.0, 0.0, pytest.approx(201.0), 150.0]
    cores = spark.createDataFrame([(8, 3), (None, 3), (None, None), (0, 2)], "p int, k int")
    assert [r[0] for r in cores.select(X.estimated_cores(F.col("p"), F.col("k"))).collect()] == [8.0, 3.0, 1.0, 2.0]
    done = spark.createDataFrame([("w", "r", "a", 3), ("w", "r", "gone", 3)], "workflow_id string, run_id string, rule string, n long")
    pending = spark.createDataFrame([("w", "r", 4)], "workflow_id string, run_id string, pending long")
    current = spark.createDataFrame([("w", "r", "a")], "workflow_id string, run_id string, rule string")
    assert [(r["rule"], r["pending"]) for r in X.pending_proportional(done, pending, current).collect()] == [("a", 4)]


def test_database_rows(spark):
    rows = [("ns", "t", "a", '["x"]', "f()", 1.0, 2.0, 0, 5), ("ns", "u", "b", None, None, 1.0, None, 1, 5), ("other", "t", "a", None, None, 1.0, 2.0, 0, 5), ("ns", "v", None, None, None, 1.0, 2.0, 0, 5), ("ns", "w", "a", None, None, 1.0, 2.0, 0, 0)]
    d = spark.createDataFrame(rows, "namespace string, target string, rule string, input string, code string, starttime double, endtime double, incomplete int, record_format_version int").withColumn("workflow_id", F.lit("w1"))
    m = R.database_metadata(d, "ns")
    assert [(r["workflow_id"], r["rule"], r["input"]) for r in m.collect()] == [("w1", "a", ["x"])]
    assert R.incomplete_rows(d).count() == 1
    assert R.incomplete_rows(d, 1.5).count() == 0
    files = m.select("workflow_id", "rule").unionByName(spark.createDataFrame([("w2", "z")], "workflow_id string, rule string"))
    assert sorted(r["rule"] for r in R.prefer_database(files, m).collect()) == ["a", "z"]
