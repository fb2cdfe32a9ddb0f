"""Job logs against looking at every file for every job."""

import random

from pyspark.sql import functions as F

from runscope.operators import joblogs as J

FILES = "workflow_id string, area string, path string, mtime double"
JOBS = "workflow_id string, rule string, job_id long, wildcards map<string,string>"


def plainly(jobs, files, records):
    out = []
    for w, rule, job, wild in jobs:
        hits = []
        for fw, area, path, mtime in files:
            name, dirs = path.split("/")[-1], path.split("/")
            if fw != w:
                continue
            run = area == "runlog" and (rule in name or f"job{job}" in name)
            own = area == "joblog" and (name.startswith(rule) or (len(dirs) > 2 and dirs[-3] in ("log", "logs") and dirs[-2] == rule) or any(v and v in name for v in (wild or {}).values()))
            if run or own or any(rw == w and r == rule and path in log for rw, r, log in records):
                hits.append((mtime, path))
        if hits:
            out.append((w, rule, job, max(hits)[1]))
    return sorted(out)


def test_every_way_of_naming(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abé_.") for _ in range(rnd.randint(1, 6)))
    files = [(rnd.choice("wv"), rnd.choice(["runlog", "joblog", "data"]), "/".join([rnd.choice(["log", "logs", ".x/log"]), *([word()] if rnd.random() < 0.5 else []), word() + rnd.choice(["", "job1", "job12.log"])]), float(i)) for i in range(400)]
    jobs = [(rnd.choice("wv"), word(), i, rnd.choice([None, {}, {"s": word()}, {"s": "", "t": word()}])) for i in range(80)]
    records = [(w, r, [p]) for (w, r, _, _), (_, _, p, _) in zip(jobs[:20], files[:20], strict=True)]
    j, f = spark.createDataFrame(jobs, JOBS), spark.createDataFrame(files, FILES)
    got = J.job_logs(j, f, spark.createDataFrame(records, "workflow_id string, rule string, log array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == plainly(jobs, files, records)
    assert got.count() > 40


def test_frequent_short_texts_do_not_multiply(spark):
    """A value of one letter that all names hold."""
    f = spark.range(20_000).select(F.lit("w").alias("workflow_id"), F.lit("joblog").alias("area"), F.concat(F.lit("logs/a"), "id").alias("path"), F.col("id").cast("double").alias("mtime"))
    j = spark.range(2000).select(F.lit("w").alias("workflow_id"), F.lit("rule").alias("rule"), F.col("id").alias("job_id"), F.create_map(F.lit("s"), F.lit("a")).alias("wildcards"))
    got = J.job_logs(j, f)
    assert {r["log_path"] for r in got.collect()} == {"logs/a19999"}
    assert got.count() == 2000


def test_empty_tables(spark):
    assert J.job_logs(spark.createDataFrame([], JOBS), spark.createDataFrame([], FILES)).count() == 0
