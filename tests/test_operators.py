import math

import pytest
from pyspark.sql import functions as F

from runscope.operators import estimate as X
from runscope.operators import logs as L
from runscope.operators import state as D
from runscope.operators import stats as E
from runscope.operators import tools as G

DAY = 86400.0


def samples(spark, rows):
    full = [(r, float(d), float(t), s, th, w, i, 0, 0, 0) for i, (r, d, t, s, th, w) in enumerate(rows)]
    return spark.createDataFrame(full, "rule string, duration double, end_time double, input_size long, threads int, wildcards map<string,string>, k1 long, k2 long, k3 long, k4 long")


@pytest.fixture(scope="module")
def history(spark):
    return samples(spark, [("align", 100, i * DAY, None, 4, {"sample": "A"}) for i in range(5)] + [("sort", 50, i * DAY, None, None, {}) for i in range(3)]).cache()


def test_means(history):
    got = {r["rule"]: r for r in E.timing_stats(history, ["rule"]).collect()}
    assert (got["align"]["mean"], got["sort"]["mean"], got["sort"]["std"]) == (100, 50, 0)
    assert E.global_mean(history).first()[0] == 81.25
    assert E.global_mean(history.limit(0)).first()[0] == 60


def test_index_weighting_prefers_the_newest(spark):
    s = samples(spark, [("a", 10, 1, None, None, {}), ("a", 20, 2, None, None, {})])
    w = 0.5 ** (1 / 10)
    assert math.isclose(E.index_weighted_mean(s, ["rule"]).first()["weighted_mean"], (20 + 10 * w) / (1 + w))


def test_median_of_even_count_is_floored(spark):
    s = samples(spark, [("a", 1, i, z, None, {}) for i, z in enumerate([3, 4, None, 8, 1])])
    assert E.median_input_size(s, ["rule"]).first()["median_size"] == 3


def test_thread_best_match_falls_back_to_pooled(spark, history):
    got = {(r["rule"], r["threads"]): r["match"] for r in E.thread_best_match(history, spark.createDataFrame([("align", 4), ("align", 9), ("sort", 1)], "rule string, threads int")).collect()}
    assert got == {("align", 4): "exact", ("align", 9): "pooled", ("sort", 1): "none"}


LOG = """Provided cores: 16
Job stats:
job      count
-----  -------
align        2
all          1
total        3

[Mon Jan  6 10:00:00 2025]
rule align:
    jobid: 1
    wildcards: sample=A
    threads: 4
[Mon Jan  6 10:00:05 2025]
Finished job 1.
1 of 3 steps (33%) done
[Mon Jan  6 10:00:06 2025]
    rule align:
        jobid: 2
        log: logs/b.log
[Mon Jan  6 10:00:07 2025]
Error in rule align:
    jobid: 2
    log: logs/b.log (check log file(s) for error details)
rule all:
    jobid: 3
rule all:
    jobid: 3""".split("\n")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("w", "r", i, x) for i, x in enumerate(LOG)], "workflow_id string, run_id string, line_no long, line string").cache()


def test_log(lines):
    assert {(r["rule"], r["expected"]) for r in L.expected_counts(lines).collect()} == {("align", 2), ("all", 1)}
    assert L.provided_cores(lines).first()["cores"] == 16
    done = L.completed_jobs(lines).collect()
    assert [(r["job_id"], r["duration"], r["threads"]) for r in done] == [(1, 5.0, 4)]
    bad = L.failed_jobs(lines).collect()
    assert [(r["rule"], r["job_id"], r["log"]) for r in bad] == [("align", 2, "logs/b.log")]
    assert [(r["job_id"], r["rule"]) for r in L.running_jobs(lines).collect()] == [(3, "all")]
    assert L.latest_progress(lines).first()["completed"] == 1
    assert L.log_tail(lines, 3).count() == 3


def test_log_without_anything(spark, lines):
    none = lines.limit(0)
    for f in (L.completed_jobs, L.failed_jobs, L.running_jobs, L.expected_counts, L.latest_progress, L.run_start):
        assert f(none).count() == 0
    text = spark.createDataFrame([("w", "r", 0, "just text"), ("w", "r", 1, None)], lines.schema)
    assert L.latest_progress(text).first()["total"] == 0


def events(spark, rows):
    cols = "workflow_id long, job_id long, rule_name string, event_type string, timestamp double, seq long, duration double, threads int, completed_jobs int, total_jobs int"
    return spark.createDataFrame([(1, j, "a", k, float(t), i, d, th, None, None) for i, (j, k, t, d, th) in enumerate(rows)], cols)


def test_finish_before_start_keeps_the_job(spark):
    e = events(spark, [(1, "job_finished", 5, None, None), (1, "job_started", 3, None, 2), (2, "job_error", 4, None, 0), (3, "job_submitted", 1, None, None), (3, "job_submitted", 9, None, None)])
    got = {r["key"]: r for r in D.registry_fold(e).collect()}
    assert (got["1"]["status"], got["1"]["duration"], got["1"]["threads"]) == ("COMPLETED", 2.0, 2)
    assert (got["2"]["status"], got["2"]["start_time"], got["2"]["threads"]) == ("FAILED", None, None)
    acc = {r["job_id"]: r for r in D.accumulator_fold(e).collect()}
    assert (acc[3]["status"], acc[3]["submit_time"]) == ("submitted", 9.0)


def test_explicit_duration_wins_and_submission_replaces(spark):
    e = events(spark, [(1, "job_started", 1, None, None), (1, "job_finished", 4, 99.0, None), (2, "job_started", 1, None, None), (2, "job_submitted", 2, None, None)])
    acc = {r["job_id"]: r for r in D.accumulator_fold(e).collect()}
    assert acc[1]["duration"] == 99.0
    assert (acc[2]["status"], acc[2]["start_time"]) == ("submitted", None)


def test_time_frames(spark):
    runs = spark.createDataFrame([("w", "a", 10.0), ("w", "b", 20.0)], "workflow_id string, run_id string, run_start double")
    done = spark.createDataFrame([("w", 5.0), ("w", 10.0), ("w", 19.0), ("w", 20.0)], "workflow_id string, end_time double")
    assert sorted((r["frame_run"], r["end_time"]) for r in D.in_time_frame(done, runs).collect()) == [("a", 10.0), ("a", 19.0), ("b", 20.0)]


def test_is_running(spark):
    x = spark.createDataFrame([("a", False, True, 1.0), ("b", True, True, 1.0), ("c", True, False, None), ("d", True, False, 99_000.0), ("e", True, False, 98_200.0)], "workflow_id string, has_locks boolean, has_incomplete boolean, log_mtime double")
    assert {r[0]: r[1] for r in D.is_running(x, 100_000.0).collect()} == {"a": False, "b": True, "c": True, "d": True, "e": False}


def test_merge_jobs(spark):
    keys = ["workflow_id", "job_id"]
    old = spark.createDataFrame([(1, 1, "a", 1.0, None, None, "RUNNING"), (1, 2, "b", None, None, 3, "SUBMITTED")], "workflow_id long, job_id long, rule string, start_time double, end_time double, threads int, status string")
    new = spark.createDataFrame([(1, 1, None, None, 9.0, None), (1, 3, "c", 2.0, None, None)], "workflow_id long, job_id long, rule string, start_time double, end_time double, threads int")
    got = {r["job_id"]: (r["rule"], r["start_time"], r["end_time"], r["status"]) for r in D.merge_jobs(old, new, keys).collect()}
    assert got == {1: ("a", 1.0, 9.0, "COMPLETED"), 2: ("b", None, None, "SUBMITTED"), 3: ("c", 2.0, None, "RUNNING")}


def test_renamed_rule_gets_the_old_estimate(spark, history):
    s = history.unionByName(samples(spark, [("align_reads", 200, i, None, None, {}) for i in range(4)]))
    jobs = spark.createDataFrame([("align_readz", None, {}, None), ("nothing_like_it", None, {}, None)], "rule string, threads int, wildcards map<string,string>, input_size long")
    got = {r["rule"]: (r["method"], round(r["expected"], 3)) for r in X.job_estimates(jobs, s).collect()}
    assert got["align_readz"] == ("similar", 200.0)
    assert got["nothing_like_it"][0] == "global"


def estimate(spark, history, total, completed, **more):
    snap = spark.createDataFrame([("w", "r", total, completed, 100.0, 2)], "workflow_id string, run_id string, total long, completed long, elapsed double, cores int")
    todo = spark.createDataFrame([("w", "r", "sort", None, {}, None, "pending", None)] * max(0, total - completed), "workflow_id string, run_id string, rule string, threads int, wildcards map<string,string>, input_size long, state string, elapsed double")
    done = spark.createDataFrame([("w", "r", "align")], "workflow_id string, run_id string, rule string")
    return X.estimate_runs(snap, todo, history, done, 5 * DAY, **more).first()


def test_estimates(spark, history):
    assert estimate(spark, history, 0, 0)["method"] == "complete"
    assert estimate(spark, history, 3, 3)["confidence"] == 1.0
    boot = estimate(spark, history, 4, 0)
    assert (boot["method"], boot["confidence"]) == ("bootstrap", 0.05)
    w = estimate(spark, history, 6, 2)
    assert (w["method"], round(w["seconds_remaining"], 6)) == ("weighted", 100.0)
    simple = estimate(spark, history, 6, 2, has_history=False)
    assert simple["method"] == "simple"
    assert simple["confidence"] == 0.1


def test_rules_that_a_run_lacks_count_after_frequent_ones_that_it_has(spark):
    """One pending job: of the history's rules the third most frequent has all of it, since both before it are completed here."""
    s = samples(spark, [(rule, d, i, None, None, {}) for rule, d, n in (("a", 10, 9), ("b", 10, 8), ("c", 70, 6)) for i in range(n)])
    snap = spark.createDataFrame([("w", "r", 3, 2, 100.0, 1)], "workflow_id string, run_id string, total long, completed long, elapsed double, cores int")
    todo = spark.createDataFrame([], "workflow_id string, run_id string, rule string, threads int, wildcards map<string,string>, input_size long, state string, elapsed double")
    done = spark.createDataFrame([("w", "r", "a"), ("w", "r", "b")], "workflow_id string, run_id string, rule string")
    assert round(X.estimate_runs(snap, todo, s, done, 5 * DAY).first()["seconds_remaining"], 6) == 70.0


def test_pending_is_shared_with_even_rounding(spark):
    done = spark.createDataFrame([("w", "r", "a", 1), ("w", "r", "b", 1)], "workflow_id string, run_id string, rule string, n long")
    assert {r["rule"]: r["pending"] for r in X.pending_proportional(done, spark.createDataFrame([("w", "r", 5)], "workflow_id string, run_id string, pending long")).collect()} == {"a": 2, "b": 2}


def test_parts_half_way_are_exact(spark):
    """45 * 7 / 10 is 31.5, but 45 * (7 / 10) is a little less."""
    done = spark.createDataFrame([("w", "r", "a", 7), ("w", "r", "b", 3)], "workflow_id string, run_id string, rule string, n long")
    pending = spark.createDataFrame([("w", "r", 45)], "workflow_id string, run_id string, pending long")
    assert {r["rule"]: r["pending"] for r in X.pending_proportional(done, pending).collect()} == {"a": 32, "b": 14}


def test_tools(spark):
    rows = [("bwa", "[M::mem_process_seqs] Processed 10 reads\n[M::mem_process_seqs] Processed 5 reads"), ("samtools_sort", "[bam_sort_core] read 3 records\nread 2 records"), ("fastp", "total reads: 1000\nreads passed filter: 950\nProcessing 45.5%"), ("fgbio", "[INFO] Processed 2,000,000 records."), ("star", "Finished 5 reads"), ("other", "x"), ("bwa", None)]
    got = [(r["tool"], r["progress"] and r["progress"]["done"]) for r in G.tool_progress(spark.createDataFrame(rows, "rule string, content string").coalesce(1)).collect()]
    assert got == [("bwa", 15), ("samtools_sort", 3), ("fastp", 45), ("fgbio", 2_000_000), ("star", 5), (None, None), (None, None)]


def test_user_extractor(spark):
    mine = G.Extractor("mine", lambda r, c: F.contains(c, F.lit("done=")), lambda c: F.from_json(F.format_string('{"done": %s, "unit": "things"}', F.regexp_extract(c, r"done=(\d+)", 1)), G.PROGRESS))
    old = G.Extractor("old", lambda r, c: F.lit(True), lambda c: F.lit(None).cast(G.PROGRESS), api_version=0)
    d = spark.createDataFrame([("x", "done=7")], "rule string, content string")
    assert G.tool_progress(d, (old, mine)).first()["progress"]["done"] == 7

    def parse(rule, content):
        return int(content.split("=")[1]), None, rule

    e = spark.createDataFrame([("x", "done=7"), ("y", "broken")], "rule string, content string").coalesce(1)
    assert [r[0] and r[0]["done"] for r in e.select(G.python_extractor(parse)("rule", "content")).collect()] == [7, None]
