"""Two-level scans: chunks of any size give what one scan gives, and long files and runs are many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runscope.functions import scalars as S
from runscope.operators import estimate as X
from runscope.operators import logs as L
from runscope.operators import scans
from runscope.operators import state as D
from runscope.plans import catalog
from runscope.plans import reports as P
from runscope.sources import adapters as A
from runscope.sources import readers as R

RUN = ["workflow_id", "run_id"]


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr([r[c] for c in cols]) for r in df.select(*cols).collect())


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_equals_one_window(spark, size):
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice([None, 1, 2, 5]), rnd.choice([None, None, "a", "b"])) for k in "ab" for i in range(60)]
    d = spark.createDataFrame([*rows, ("c", 7, None, None), (None, 1, 1, "a"), (None, 2, 1, None), (None, 50, 3, None)], "k string, i long, n long, s string").repartition(3)
    got = scans.carried(d, ["k"], ["i"], F.floor(F.col("i") / size), {"sum": F.col("n")}, {"last": F.col("s")}, {"most": F.col("n")})
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    one = d.select("*", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("sum"), F.last("s", True).over(w).alias("last"), F.max("n").over(w).alias("most"))
    assert rows_of(got) == rows_of(one)


def test_null_chunks_come_first(spark):
    d = spark.createDataFrame([("a", None, 1), ("a", 5.0, 2), ("a", 9.0, 3)], "k string, t double, n long")
    assert [r["s"] for r in scans.carried(d, ["k"], ["t"], F.floor("t"), {"s": F.col("n")}).orderBy("t").collect()] == [1, 3, 6]


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    path = str(sf_dir) and A.log_lines(spark, sf_dir).where("workflow_id < 3")
    return path.cache()


@pytest.mark.parametrize("size", [1, 4, 7])
def test_logs_in_chunks(lines, size):
    """Blocks, error blocks, times and rules that are open where a chunk ends go on in the next one."""
    small, whole = L.facts(lines, size), L.facts(lines, 1 << 40)
    assert rows_of(small) == rows_of(whole)
    if size == 7:
        for f in (L.completed_jobs, L.failed_jobs, L.running_jobs, L.completions_per_rule, L.lifecycle):
            assert rows_of(f(small)) == rows_of(f(whole))
        assert rows_of(L.expected_counts(lines, size)) == rows_of(L.expected_counts(lines))


def test_a_run_is_many_tasks(spark):
    text = []
    for i in range(3000):
        text += ["[Mon Jan  1 10:00:00 2024]", f"rule r{i % 7}:", f"    jobid: {i}", "[Mon Jan  1 10:05:00 2024]", f"Finished job {i}."]
    d = spark.createDataFrame([(1, "a", i, x) for i, x in enumerate(text)], "workflow_id long, run_id string, line_no long, line string")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = L.with_context(L.parsed(d), 1000).select("line_no", "block", F.spark_partition_id().alias("p"))
        assert got.select("p").distinct().count() > 2
        assert got.agg(F.max("block")).first()[0] == 3000
        plan = L.facts(d, 1000)._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan  # lines are parsed once
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert L.completions_per_rule(L.facts(d, 1000)).agg(F.sum("completed")).first()[0] == 3000


def test_rules_without_a_count(spark):
    text = ["Job stats:", "job    count", "-----  -----", "align      2", "odd     many", "x 1 2", "total   3", "", "late 4", "rule align:"]
    d = spark.createDataFrame([(1, "a", i, x) for i, x in enumerate(text)], "workflow_id long, run_id string, line_no long, line string")
    for size in (2, 100):
        assert {r["rule"] for r in L.expected_rules(d, size).collect()} == {"align", "odd", "x"}
        assert {(r["rule"], r["expected"]) for r in L.expected_counts(d, size).collect()} == {("align", 2), ("x", 2)}


@pytest.mark.parametrize("ending", ["", "\n", "\r\n"])
def test_files_of_many_splits(spark, tmp_path, ending):
    rnd = random.Random(1)
    text = {n: rnd.choice(["\n", "\r\n"]).join("é" * rnd.randint(0, 40) + str(i) for i in range(400)) + ending for n in ("a.log", "sub/b.log")}
    (tmp_path / "sub").mkdir()
    for n, t in text.items():
        (tmp_path / n).write_bytes(t.encode())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("700", "1"), strict=True):
            spark.conf.set(k, v)
        d = R.scan_logs(spark, str(tmp_path))
        got = sorted((r["log_path"].endswith("b.log"), r["line_no"], r["line"]) for r in d.collect())
        assert spark.read.text(str(tmp_path / "a.log"), lineSep="\n").rdd.getNumPartitions() > 5
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    assert got == [(b, i, x) for b, t in ((False, text["a.log"]), (True, text["sub/b.log"])) for i, x in enumerate(t.replace("\r\n", "\n").split("\n"))]


@pytest.mark.parametrize("width", [3.0, 1000.0])
def test_states_in_days(spark, width):
    rnd = random.Random(2)
    jobs = [(w, i, rnd.choice(["finished", "error", "running"]), rnd.choice([None, float(rnd.randint(0, 40))])) for w in range(3) for i in range(50)]
    d = spark.createDataFrame(jobs, "workflow_id long, job_id long, status string, end_time double")
    kept = set()
    for w in range(3):
        mine = [j for j in jobs if j[0] == w]
        ended = sorted((j for j in mine if j[2] != "running"), key=lambda j: (j[3] is None, j[3] or 0, j[1]))
        kept |= {j[:2] for j in mine if j[2] == "running"} | {j[:2] for j in ended[max(0, len(mine) - 20) :]}
    assert {(r["workflow_id"], r["job_id"]) for r in D.bounded(d, 20, width).collect()} == kept
    spans = [(1, "a", float(rnd.randint(0, 50)), rnd.choice([None, 1, 3])) for _ in range(60)]
    spans = [(w, r, s, s + rnd.randint(1, 30), t) for w, r, s, t in spans]
    most = max(sum(t or 1 for _, _, s, e, t in spans if s <= x < e) for x in range(90))
    p = spark.createDataFrame(spans, "workflow_id long, run_id string, start_time double, end_time double, threads int")
    assert X.peak_threads(p, width).first()["peak"] == most
    events = [(1, float(i // 3), i, "workflow_started" if i % 11 == 0 else "job_started") for i in range(60)]
    e = spark.createDataFrame(events, "workflow_id long, timestamp double, seq long, event_type string")
    assert [r["run_no"] for r in D.segment_runs(e, width).orderBy("seq").collect()] == [i // 11 + 1 for i in range(60)]


def test_tables_of_job_statistics(spark):
    """Two tables, one after blank lines and one without an end; no total, no line after a table, and words apart by tabs."""
    text = ["", "Job stats:", "job count", "----- ----", "a\t3", "total 3", "total\t4", "b b 4", "", "c 5", "Job stats:", "job count", "----- ----", "    d 1", "e 6", "f x"]
    d = spark.createDataFrame([("w", "r", i, t) for i, t in enumerate(text)], "workflow_id string, run_id string, line_no long, line string")
    for size in (1, 3, 1000):
        assert rows_of(L.expected_counts(d, size)) == rows_of(spark.createDataFrame([("w", "r", "a", 3), ("w", "r", "b", 4), ("w", "r", "e", 6)], "workflow_id string, run_id string, rule string, expected int"))
        assert {r["rule"] for r in L.expected_rules(d, size).collect()} == {"a", "b", "e", "f"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_split_only_in_tables(lines):
    """Splitting all lines of a log took more time than all else."""
    x = plan_of(L.expected_counts(lines))
    assert "split(" in x
    assert not [at for at in x.splitlines() if "Filter" in at and "split(" in at]


def test_only_fields_that_are_asked_for_are_read(lines):
    for f in (L.completions_per_rule, lambda x: L.pending_jobs(x, x.selectExpr("workflow_id", "run_id", "line_no AS job_id")), L.run_plan):
        assert S.WILDCARDS not in plan_of(f(lines))
    assert S.WILDCARDS in plan_of(L.running_jobs(lines))
    assert S.WILDCARDS not in plan_of(L.job_threads(lines))
    few, all_ = L.facts(lines, fields=("threads",)), L.facts(lines)
    assert rows_of(few) == rows_of(all_.drop("wildcards", "log"))


def test_ends_of_chunks_need_no_second_sort(lines):
    """Rows of a chunk are sorted once; what it ends with is an aggregate by hash of the same shuffle."""
    x = plan_of(L.with_context(L.parsed(lines)))
    assert len([at for at in x.splitlines() if "Sort [hash_" in at and "line_no" in at]) == 1


def test_facts_meet_their_block_without_another_shuffle(lines):
    """Lines are reduced in their chunk, and facts are shuffled by block: its owner's values need no shuffle of their own."""
    whole = [at for at in plan_of(L.failed_jobs(lines)).splitlines() if "Exchange hashpartitioning(workflow_id" in at and "block#" in at]
    assert len(whole) == 1


def test_odd_lines_in_chunks(spark):
    """A rule that starts on a line that finishes a job, stamps after it, values on finish lines, and blocks and errors over many chunks."""
    rnd = random.Random(7)
    kinds = ["[Mon Jan  1 10:00:{:02d} 2024]", "rule a{}:", "rule b: Finished job {}.", "Finished job {}.", "Finished jobid: {} (Rule: a)", "Error in rule a{}:", "    jobid: {}", "    threads: {}", "    log: l{}", "    log: Finished job {}", "text {}", "rule c: Error in rule d{}:"]
    text = [rnd.choice(kinds).format(rnd.randint(1, 9)) for _ in range(600)]
    d = spark.createDataFrame([(1, "a", i, x) for i, x in enumerate(text)], "workflow_id long, run_id string, line_no long, line string").cache()
    want = rows_of(L.facts(L.with_context(L.parsed(d), 1 << 40)))
    for size in (1, 5, 1000):
        assert rows_of(L.facts(d, size)) == want
    no_finish = rows_of(L.facts(L.with_context(L.parsed(d), 1 << 40)).where("kind <> 'finished'"))
    assert rows_of(L.facts(d, 5, finishes=False)) == no_finish


def odd_lines(spark, runs=2):
    """Runs of lines in which everything may come after everything."""
    rnd = random.Random(11)
    kinds = ["[Mon Jan  1 10:00:{:02d} 2024]", "[Mon Foo  1 10:00:{:02d} 2024]", "rule a{}:", "rule b: Finished job {}.", "Finished job {}.", "Error in rule a{}:", "    jobid: {}", "    jobid: {}", "    threads: {}", "    log: l{}", "    wildcards: k={}", "text {}"]
    rows = [(1, f"r{k}", i, rnd.choice(kinds).format(rnd.randint(1, 9))) for k in range(runs) for i in range(500)]
    return spark.createDataFrame(rows, "workflow_id long, run_id string, line_no long, line string").repartition(5)


def test_whole_runs_give_the_same_facts(spark):
    d = odd_lines(spark).cache()
    for options in ({}, {"fields": ("threads",)}, {"finishes": False}):
        assert rows_of(L.facts(d, L.WHOLE_RUNS, **options)) == rows_of(L.facts(d, 7, **options))
    assert rows_of(L.lifecycle(d, L.WHOLE_RUNS)) == rows_of(L.lifecycle(d))
    text = ["Job stats:", "job count", "----- ----", "a\t3", "total 3", "", "c 5", "Job stats:", "job count", "----- ----", "    d 1", "e 6"]
    t = spark.createDataFrame([("w", "r", i, x) for i, x in enumerate(text)], "workflow_id string, run_id string, line_no long, line string")
    assert rows_of(L.expected_counts(t, L.WHOLE_RUNS)) == rows_of(L.expected_counts(t))
    assert rows_of(L.run_plan(t, L.WHOLE_RUNS)) == rows_of(L.run_plan(t))


def test_jobs_are_counted_in_one_pass(spark):
    f = L.facts(odd_lines(spark, 20)).cache()
    count = lambda d: {r["run_id"]: r["count"] for r in d.groupBy("run_id").count().collect()}
    running, failed, done = count(L.running_jobs(f)), count(L.failed_jobs(f)), count(L.completed_jobs(f))
    got = L.job_counts(f).collect()
    assert len(got) == 20 and sum(failed.values()) > 20
    assert [(r["n_running"], r["n_failed"], r["n_completed"]) for r in got] == [tuple(c.get(r["run_id"], 0) for c in (running, failed, done)) for r in got]


@pytest.mark.parametrize("name", ["c02_completions_per_rule", "c06_running_jobs", "c07_failed_jobs", "c08_completed_jobs", "c10_scheduled_jobs", "c12_lifecycle"])
def test_rendered_lines_are_not_shuffled(spark, sf_dir, name):
    """A run's lines come from one task, which reads all from them that a query asks for."""
    plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate inline")]


@pytest.mark.parametrize("name", ["d27_run_plan", "i15_snapshot"])
def test_jobs_of_rendered_lines_are_not_shuffled(spark, sf_dir, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
    assert not [at for at in plan.splitlines() if "Exchange" in at and ("hash_" in at or "block#" in at or "job_id#" in at)]


def test_reports_by_whole_runs(spark):
    d = odd_lines(spark).cache()
    assert rows_of(P.snapshot(d, chunk_lines=L.WHOLE_RUNS)) == rows_of(P.snapshot(d))
    assert rows_of(L.run_plan(d, L.WHOLE_RUNS)) == rows_of(L.run_plan(d))


def test_lines_of_stored_jobs(spark, sf_dir):
    lines = A.log_lines_of(A.numbered(spark, sf_dir))
    assert rows_of(lines.where("workflow_id < 3")) == rows_of(A.log_lines(spark, sf_dir).where("workflow_id < 3"))


def test_outcomes_of_jobs(spark):
    f = L.facts(odd_lines(spark, 5)).cache()
    got = L.outcomes(f, L.FIELDS).cache()
    assert rows_of(got.where("done is not null").select("workflow_id", "run_id", "job_id", "done.*")) == rows_of(L.completed_jobs(f).drop("duration"))
    assert rows_of(got.where("running = 1").select("run_id", "job_id")) == rows_of(L.running_jobs(f).select("run_id", "job_id"))
    failed = L.failed_jobs(f)
    assert rows_of(got.where("failed > 0").selectExpr("run_id", "job_id", "failed")) == rows_of(failed.groupBy("run_id", "job_id").agg(F.count(F.lit(1)).alias("failed")))
    assert got.where("running = 1").join(failed, ["workflow_id", "run_id", "job_id"]).count() == 0
