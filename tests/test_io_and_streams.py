import base64
import json

import pytest
from pyspark.sql import functions as F

from runscope.operators import state as D
from runscope.operators import stats as E
from runscope.sources import readers as R
from runscope.streaming import lifecycle as H


def test_scan_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\r\ntwo\n")
    (tmp_path / "b.txt").write_text("no")
    assert [(r["line_no"], r["line"]) for r in R.scan_logs(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "one"), (1, "two"), (2, "")]


def test_scan_metadata(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"ok": json.dumps({"rule": "a", "starttime": 1.0, "endtime": 3.0, "wildcards": {"s": "1"}, "input": ["x"], "code": "f( x )"}), "sub/open": json.dumps({"rule": "b", "starttime": 1.0}), "bad": "{", "norule": "{}"}.items():
        (tmp_path / name).write_text(text)
    m = R.scan_metadata(spark, str(tmp_path))
    assert sorted(r["rule"] for r in m.collect()) == ["a", "b"]
    assert [r["duration"] for r in R.completed_metadata(m).collect()] == [2.0]
    assert R.full_metadata(m).where("code_hash is not null").count() == 1


def test_events_are_strict(spark, tmp_path):
    good = {"event_type": "job_finished", "timestamp": 3.0, "job_id": 1, "rule_name": "a", "duration": 2.0, "threads": 4, "wildcards": {"s": "A"}}
    rows = [json.dumps(good), "", "{", json.dumps(good | {"event_type": "other"}), json.dumps(good | {"what": 1}), json.dumps(good | {"threads": "x"}), json.dumps(good | {"error_message": "y" * (R.MAX_EVENT_BYTES + 1)})]
    (tmp_path / "e.jsonl").write_text("\n".join(rows))
    e = R.scan_events(spark, str(tmp_path / "e.jsonl"))
    assert sorted([r["threads"] for r in e.collect()], key=str) == [4, None]
    h = R.event_history(e)
    assert h.count() == 2
    assert R.has_wildcards(h).first()[0]
    R.write_events(e.drop("resources"), str(tmp_path / "out"), "overwrite")
    assert R.scan_events(spark, str(tmp_path / "out")).count() == 2


def test_markers_and_locks(spark):
    name = base64.b64encode(b"out/a.txt").decode()
    f = spark.createDataFrame([("w", "incomplete", f"i/{name}", 5.0), ("w", "incomplete", "i/migration_underway", 5.0), ("w", "incomplete", "i/%%%", 1.0), ("w", "locks", "l/0", 1.0), ("v", "log", "x.log", 2.0), ("v", "log", "y.log", 3.0)], "workflow_id string, area string, path string, mtime double")
    assert sorted((r["output_path"] for r in R.incomplete_markers(f).collect()), key=str) == [None, "out/a.txt"]
    assert R.incomplete_markers(f, 2.0).count() == 1
    assert {r["workflow_id"]: r["has_locks"] for r in R.lock_state(f).collect()} == {"w": True, "v": False}
    assert R.latest_logs(f).first()["log_path"] == "y.log"


def test_input_sizes(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("x.fq", 7)], "path string, size long")
    jobs = spark.createDataFrame([(1, ["a", "b"], "x.sorted.bam"), (2, ["a", "gone"], "y"), (3, [], "x.dedup")], "job_key long, input array<string>, output string")
    assert {r[0]: r[1] for r in R.input_sizes(jobs, files).collect()} == {1: 3, 2: None, 3: None}
    assert {r[0]: r[1] for r in R.input_size_from_output(jobs, files).collect()} == {1: 7, 2: None, 3: 7}


def test_resolve_job_logs(spark):
    files = spark.createDataFrame([("w", "joblog", "logs/align.1.log", 1.0), ("w", "joblog", "logs/align/x.log", 2.0), ("w", "joblog", "run/job7.log", 3.0)], "workflow_id string, area string, path string, mtime double")
    jobs = spark.createDataFrame([("w", "align", 1), ("w", "sort", 7), ("w", "none", 2)], "workflow_id string, rule string, job_id long")
    assert {r["job_id"]: r["log_path"] for r in R.resolve_job_logs(jobs, files).collect()} == {1: "logs/align/x.log", 7: "run/job7.log"}


def test_profile_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("a", 2.0, 5.0, 0, 0, 0, 0), ("a", 4.0, 3.0, 1, 0, 0, 0), ("b", 1.0, 1.0, 2, 0, 0, 0)], "rule string, duration double, end_time double, k1 long, k2 long, k3 long, k4 long")
    R.write_profile(E.profile(s), str(tmp_path / "p"), "2025-01-01")
    p = {r["rule"]: r for r in R.read_profile(spark, str(tmp_path / "p")).collect()}
    assert (p["a"]["durations"], p["a"]["sample_count"], p["b"]["mean_duration"]) == ([4.0, 2.0], 2, 1.0)
    (tmp_path / "v2.json").write_text(json.dumps({"version": 2, "rules": {}}))
    with pytest.raises(Exception, match="profile"):
        R.read_profile(spark, str(tmp_path / "v2.json")).collect()


def test_discrepancy_report(spark):
    d = spark.createDataFrame([("missing_running", "error", "not in log", 3, None)], "category string, severity string, message string, job_id long, rule string")
    assert R.discrepancy_lines(d).first()["value"] == "[missing_running] not in log | job_id=3"


SCHEMA = "workflow_id long, job_id long, rule_name string, event_type string, timestamp double, seq long, duration double, threads int, completed_jobs int, total_jobs int"


def test_stream_of_states_equals_the_batch_fold(spark, tmp_path):
    kinds = ["job_finished", "job_submitted", "job_started", "job_error"]
    rows = [(1, i % 5, "a", kinds[(i * 7) % 4], float((i * 13) % 29), i, 1.0, None, None, None) for i in range(40)]
    e = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        e.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def take(batch, _):
        for r in batch.collect():
            seen[r["job_id"]] = (r["status"], r["start_time"], r["end_time"])

    H.each_batch(H.job_lifecycle(stream), take, str(tmp_path / "ck")).awaitTermination(120)
    assert seen == {int(r["key"]): (r["status"], r["start_time"], r["end_time"]) for r in D.registry_fold(e).collect()}


def test_samples_are_recorded_once(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "a", "job_finished", 100.0, 1, 5.0, 2, None, None), (1, 1, "a", "job_finished", 100.0, 2, 5.0, 2, None, None)], SCHEMA)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    H.into_samples(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
