"""Operators that no query or other test calls."""

import json
import math

import pytest
from pyspark.sql import functions as F

from runscope.functions import scalars as S
from runscope.operators import estimate as X
from runscope.operators import logs as L
from runscope.operators import state as D
from runscope.operators import stats as E
from runscope.operators import tools as G
from runscope.plans import reports as P
from runscope.sources import readers as R
from runscope.streaming import lifecycle as H

RUN = "workflow_id string, run_id string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_reconcile(spark):
    running = spark.createDataFrame([("w", "r", 1), ("w", "r", 2), ("v", "r", 3)], f"{RUN}, job_id long")
    failed = spark.createDataFrame([("w", "r", 2), ("w", "r", None)], f"{RUN}, job_id long")
    live = spark.createDataFrame([("w", True), ("v", False)], "workflow_id string, running boolean")
    assert [r["job_id"] for r in D.reconcile(running, failed, live).collect()] == [1]


def test_merged_failures(spark):
    a = spark.createDataFrame([("w", 1), ("w", 2)], "workflow_id string, job_id long")
    b = spark.createDataFrame([("w", 2), ("w", 3)], "workflow_id string, job_id long")
    assert sorted(r["job_id"] for r in D.merged_failures(a, b, ["workflow_id", "job_id"]).collect()) == [1, 2, 3]


def test_current_event_files(spark):
    e = spark.createDataFrame([("a", "workflow_started", 100.0, 1), ("b", "workflow_started", 10.0, 1), ("c", "job_started", 100.0, 1), ("c", "workflow_started", 101.0, 2)], "workflow_id string, event_type string, timestamp double, seq long")
    runs = spark.createDataFrame([(w, "r", 150.0) for w in "abc"], f"{RUN}, run_start double")
    assert {r["workflow_id"]: r["current"] for r in D.current_event_files(e, runs).collect()} == {"a": True, "b": False, "c": False}


def test_pending_count_and_summary(spark):
    s = spark.createDataFrame([("w", "r", 10, 4, 1, 2, 1), ("v", "r", 0, 0, 0, 0, 0)], f"{RUN}, total long, completed long, n_failed long, n_running long, n_incomplete long")
    assert [(r["pending"], r["percent"]) for r in s.orderBy(F.desc("total")).select(*D.pending_count()).collect()] == [(2, 40.0), (0, 0.0)]
    assert {r["workflow_id"]: (r["succeeded"], r["pending"]) for r in P.summary(s).collect()} == {"w": (4, 2), "v": (0, 0)}


def test_completion_time(spark):
    assert one(spark, X.completion_time(F.lit(5.0), 100.0)) == 105.0


def test_running_table_and_rules(spark):
    j = spark.createDataFrame([("Align", 1, 5.0), ("sort", 2, None), ("realign", 3, 2.0)], "rule string, job_id long, remaining double")
    assert [r["job_id"] for r in P.running_table(j).collect()] == [3, 1, 2]
    assert [r["job_id"] for r in P.running_table(j, descending=True).collect()] == [1, 3, 2]
    assert {r["rule"] for r in P.rules_like(j, "ALIGN").collect()} == {"Align", "realign"}


def test_texts(spark):
    p = lambda done, total, percent=None: F.struct(F.lit(done).cast("long").alias("done"), F.lit(total).cast("long").alias("total"), F.lit("reads").alias("unit"), F.lit(percent).cast("double").alias("percent"))
    assert one(spark, G.progress_text(p(1500, 2000))) == "1,500/2,000 reads"
    assert one(spark, G.progress_text(p(1500, None))) == "1,500 reads"
    assert one(spark, G.percent_label(p(1, 4))) == "25.0%"
    assert one(spark, G.percent_label(p(1, None))) == "?"
    assert one(spark, S.rate_text(F.lit(10), F.lit(4.0), "jobs")) == "2.5 jobs/s"
    assert one(spark, S.rate_text(F.lit(10), F.lit(0.0))) == "0.0 items/s"


def test_incomplete_files(spark):
    m = spark.createDataFrame([("w", f"/data/w/out/{i}.txt") for i in range(9)] + [("w", None), ("v", "/data/vv/a"), ("u", "/x")], "workflow_id string, output_path string")
    roots = spark.createDataFrame([("w", "/data/w/"), ("v", "/data/v")], "workflow_id string, root string")
    got = P.incomplete_files(m, roots).collect()
    assert [(r["path"], r["more"]) for r in got if r["workflow_id"] == "w"] == [(f"out/{i}.txt", 2) for i in range(8)]
    assert {(r["path"], r["more"]) for r in got if r["workflow_id"] != "w"} == {("/data/vv/a", 0), ("/x", 0)}


def test_newest_first_and_finished(spark):
    m = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 1.0, "z")], "rule string, file_mtime double, file_path string")
    assert {r["file_path"]: r["age_rank"] for r in R.newest_first(m).collect()} == {"y": 1, "x": 2, "z": 1}
    text = ["[Mon Jan  1 10:00:00 2024]", "rule a:", "    jobid: 3", "Finished job 3.", "Finished jobid: 9 (Rule: a)"]
    lines = spark.createDataFrame([("w", "r", i, t) for i, t in enumerate(text)], f"{RUN}, line_no long, line string")
    assert {(r["job_id"], r["rule"]) for r in L.finished_jobs(lines).collect()} == {(3, "a"), (9, "a")}


def test_streams(spark, tmp_path):
    rows = [{"event_type": "job_error", "timestamp": 100.0 + i % 2, "job_id": i % 2, "rule_name": "a"} for i in range(6)] + [{"event_type": "job_error", "timestamp": 9e5, "job_id": 7, "rule_name": "a"}]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(json.dumps(r) for r in rows[k::2]))
    seen = []
    e = R.stream_events(spark, str(tmp_path / "in"))
    failures = e.select(F.lit("w").alias("workflow_id"), F.lit("r").alias("run_id"), F.col("rule_name").alias("rule"), "job_id", "timestamp")
    H.each_batch(H.new_failures(failures), lambda b, _: seen.extend(r["job_id"] for r in b.collect()), str(tmp_path / "a"), "append").awaitTermination(120)
    assert sorted(seen) == [0, 1, 7]
    counts = {}
    H.each_batch(H.throughput(e), lambda b, _: counts.update({r["window_start"]: r["n"] for r in b.collect()}), str(tmp_path / "b")).awaitTermination(120)
    assert counts == {0: 6, 900000: 1}


@pytest.fixture(scope="module")
def history(spark):
    rows = [(f"r{i % 2}", float(10 + i * 7 % 13), 86400.0 * (i * 11 % 90), i * 5 % 17 or None, [None, 1, 4][i % 3], [{"s": "ab"[i % 2], "t": "x"}, {}, None][i * 7 % 5 % 3], i, 0, 0, 0) for i in range(300)]
    return spark.createDataFrame(rows, "rule string, duration double, end_time double, input_size long, threads int, wildcards map<string,string>, k1 long, k2 long, k3 long, k4 long").cache()


def test_level_table_equals_single_statistics(history):
    """Put together from kinds, it is what each grouping of all samples gives."""
    as_of = 80 * 86400.0
    for strategy in ("index", "time"):
        t = E.level_table(history, as_of, strategy).cache()
        groups = {"rule": (history, ["rule"], []), "pooled": (history.where("threads is not null"), ["rule"], []), "threads": (history.where("threads is not null"), ["rule", "threads"], ["threads"])}
        groups["wildcard"] = (E.wildcard_samples(history).withColumnRenamed("key", "name"), ["rule", "name", "value"], ["name", "value"])
        groups["combination"] = (E.combination_samples(history), ["rule", "combo"], ["combo"])
        for level, (samples, by, key) in groups.items():
            plain = E.timing_stats(samples, by).join(E.weighted_mean(samples, by, strategy, as_of), by)
            want = {(r["rule"], *[str(r[k]) for k in key]): r for r in plain.collect()}
            got = {(r["rule"], *[x for x in (r["name"], r["key"]) if x]): r for r in t.where(F.col("level") == level).collect()}
            assert set(got) == set(want)
            for k, r in want.items():
                for c in ("n", "mean", "std", "min", "max", "weighted_mean"):
                    assert math.isclose(got[k][c], r[c], rel_tol=1e-9, abs_tol=1e-9), (level, k, c)
        rules = {r["rule"]: r for r in t.where("level = 'rule'").collect()}
        for f, c in ((E.median_input_size(history, ["rule"]), "median_size"), (E.typical_threads(history), "typical_threads"), (E.recent_consistency(history, ["rule"], as_of), "consistency")):
            assert all(math.isclose(rules[r["rule"]][c], r[c], rel_tol=1e-9) for r in f.collect())
        assert {r["rule"]: r["key"] for r in E.predictive_key(history, threshold=1e-9).collect()} == {r["rule"]: r["name"] for r in E.predictive_names(t, threshold=1e-9).collect()}


def test_only_the_newest_are_ranked(spark):
    """A group with more samples than weigh, over many months, and some without an end."""
    rows = [("a", float(i % 97), float(86400 * i), None, 1, {}, i, 0, 0, 0) for i in range(2500)] + [("b", 5.0, None, None, 1, {}, 1, 0, 0, 0)]
    h = spark.createDataFrame(rows, "rule string, duration double, end_time double, input_size long, threads int, wildcards map<string,string>, k1 long, k2 long, k3 long, k4 long")
    want = {r["rule"]: r["weighted_mean"] for r in E.index_weighted_mean(h, ["rule"]).collect()}
    got = {r["rule"]: r["weighted_mean"] for r in E.level_table(h).where("level = 'rule'").collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_states_merge(spark, history):
    a, b, c = (E.timing_state(history.where(F.col("k1") % 3 == i), ["rule"]) for i in range(3))
    got = {r["rule"]: r for r in E.state_stats(E.merge_states(E.merge_states(a, b, ["rule"]), c, ["rule"])).collect()}
    want = E.timing_stats(history, ["rule"]).join(E.index_weighted_mean(history, ["rule"]), "rule").collect()
    assert len(got) == len(want) == 2
    for r in want:
        assert all(math.isclose(got[r["rule"]][c], r[c], rel_tol=1e-9) for c in ("n", "mean", "std", "min", "max", "weighted_mean"))


def test_estimates_by_age(history):
    """The time strategy weighs by age; jobs without wildcards or threads are looked up, too."""
    jobs = history.select("rule", "threads", "wildcards", "input_size").limit(20)
    by_age = X.job_estimates(jobs, history, strategy="time", as_of=90 * 86400.0, conditioning=False).where("method = 'rule'")
    want = {r["rule"]: r["weighted_mean"] for r in E.time_weighted_mean(history, ["rule"], 90 * 86400.0).collect()}
    got = by_age.collect()
    assert got
    assert all(math.isclose(r["expected"], want[r["rule"]], rel_tol=1e-9) for r in got)
    with pytest.raises(ValueError, match="strategy"):
        E.level_table(history, strategy="other")


def test_old_samples_are_gone_before_they_are_sent(spark):
    """A level joined its month after each sample had been sent once a level; now a kind of sample knows it, and only samples young enough are sent."""
    h = spark.range(6000).selectExpr(
        "'a' AS rule", "cast(id % 7 AS double) AS duration", "cast(id * 86400 AS double) AS end_time", "id AS input_size", "cast(1 AS int) AS threads",
        "map('k', 'v') AS wildcards", "id AS k1", "0L AS k2", "0L AS k3", "0L AS k4",
    )
    t = E.level_table(h)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "explode(filter(starts" in plan and "since#" not in "".join(x for x in plan.splitlines() if "Join" in x)
    weights = [0.5 ** (i / 10) for i in range(1000)]
    expected = sum((5999 - i) % 7 * w for i, w in enumerate(weights)) / sum(weights)
    got = t.collect()
    assert len(got) == 5 and all(abs(r["weighted_mean"] - expected) < 1e-9 for r in got)
