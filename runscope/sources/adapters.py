"""Maps the driver tables to the engine's tables: samples, events, log lines, runs, files and tool logs.

Every adapter reads whole tables. The oracles repeat the mappings in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
RUN, TIE = ["workflow_id", "run_id"], ["k1", "k2", "k3", "k4", "end_time"]
PER_JOB, HEADER = 10, 1000
TASK_JOBS = 1 << 17  # jobs of whole runs that one task takes: their lines are sorted in its memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(col: str, unit: str = "SECOND"):
    """Time since 1970 of a zone-less time stamp, whatever the session's zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per completed job: workflow_id, run_id, rule, duration, times, threads, input_size, wildcards, tie key (k1..k4)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("rule"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("workflow_id"), F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), epoch("o_orderdate").cast("double").alias("run_date"))
    line = table(spark, sf_dir, "lineitem")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"]).join(orders, line["l_orderkey"] == orders["o_orderkey"])
    duration, end = F.col("l_quantity") * 10 + F.col("l_linenumber"), epoch("l_shipdate").cast("double")
    return joined.select(
        "workflow_id", "run_id", "run_date", "rule", duration.alias("duration"), (end - duration).alias("start_time"), end.alias("end_time"),
        F.when(F.col("l_tax") != 0, F.col("l_linenumber")).cast("int").alias("threads"),
        F.when(F.col("l_discount") != 0, (F.col("l_extendedprice") * 100).cast("long")).alias("input_size"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")).alias("wildcards"),
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(KEY, 1)], (F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("k4"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, job_id, rule_name, event_type, timestamp, seq, duration, threads, completed_jobs, total_jobs."""
    kinds = {"signup": "job_submitted", "click": "job_started", "purchase": "job_finished", "error": "job_error", "view": "progress"}
    kind = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in kinds.items()])
    e = table(spark, sf_dir, "events")
    is_progress = F.col("event_type") == "view"
    return e.select(
        (F.col("user_id") % 10).alias("workflow_id"), F.col("user_id").alias("job_id"), F.concat(F.lit("rule_"), (F.col("user_id") % 7).cast("string")).alias("rule_name"),
        kind.alias("event_type"), (epoch("ts", "MICROSECOND") / 1e6).alias("timestamp"), F.col("event_id").alias("seq"), F.col("value").alias("duration"),
        (F.col("event_id") % 5).cast("int").alias("threads"), F.when(is_progress, F.col("event_id") % 100).cast("int").alias("completed_jobs"), F.when(is_progress, F.lit(100)).alias("total_jobs"),
    ).where("event_type is not null")


def _by_run(jobs: DataFrame, n: int) -> DataFrame:
    """All jobs of a run in one task, in as many tasks as their number n asks for."""
    return jobs.repartition(max(jobs.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_JOBS)), *RUN)


def _samples_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_run(samples(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


def _numbered(s: DataFrame, *ties: str) -> DataFrame:
    s = s.withColumn("job_id", F.row_number().over(Window.partitionBy(*RUN).orderBy(*TIE, *ties)).cast("long"))
    return s.withColumn("ended", F.when(F.col("job_id") % 10 == 7, "failed").when(F.col("job_id") % 10 == 9, "running").otherwise("finished"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their job number in the run and how the job ended: every tenth fails, another tenth still runs."""
    return _numbered(_samples_by_run(spark, sf_dir))


def _with_rules(jobs: DataFrame, *order: str) -> DataFrame:
    """Jobs with their number (of_rule) in their run's rule, that rule's count, and its place (at) among the run's rules."""
    of_rule = Window.partitionBy(*RUN, "rule")
    jobs = jobs.withColumns({"of_rule": F.row_number().over(of_rule.orderBy(*order)), "count": F.count(F.lit(1)).over(of_rule)})
    return jobs.withColumn("at", F.sum((F.col("of_rule") == 1).cast("long")).over(Window.partitionBy(*RUN).orderBy("rule", *order).rowsBetween(Window.unboundedPreceding, 0)))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, run_id, line_no, line: a run log for every workflow and month, rendered from the samples. All lines of a run come from one task."""
    # with a tie of the windows before, jobs are numbered behind them and come in order of their lines
    return _rendered(_numbered(_with_rules(_samples_by_run(spark, sf_dir), *TIE), "of_rule"))


def log_lines_of(jobs: DataFrame) -> DataFrame:
    """The same lines from a table of the numbered jobs that is there already."""
    j = jobs.select(*RUN, "job_id", "rule", "start_time", "end_time", "threads", "ended", *[F.col("wildcards")[k].alias(k) for k in ("flag", "status")])
    j = _with_rules(_by_run(j, jobs.count()), "job_id")
    return _rendered(j.withColumn("wildcards", F.create_map(F.lit("flag"), F.col("flag"), F.lit("status"), F.col("status"))))


def _rendered(j: DataFrame) -> DataFrame:
    stamp = lambda c: F.concat(F.lit("["), F.date_format(F.timestamp_seconds(F.floor(c)), "EEE MMM d HH:mm:ss yyyy"), F.lit("]"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    n, rule = F.col("job_id"), F.col("rule")
    failed, done = F.col("ended") == "failed", F.col("ended") == "finished"
    lines = [
        stamp(F.col("start_time")), text("rule ", rule, ":"), text("    jobid: ", n), text("    wildcards: flag=", F.col("wildcards")["flag"], ", status=", F.col("wildcards")["status"]),
        F.when(F.col("threads").isNotNull(), text("    threads: ", F.col("threads"))), text("    log: logs/", rule, "/", n, ".log"),
        F.when(F.col("ended") != "running", stamp(F.col("end_time"))), F.when(done, text("Finished job ", n, ".")).when(failed, text("Error in rule ", rule, ":")),
        F.when(done, text(n, " of 1000 steps (1%) done")).when(failed, text("    jobid: ", n)), F.when(failed, text("    log: logs/", rule, "/", n, ".log (check log file(s) for error details)")),
    ]
    head = [(0, text("Provided cores: ", F.col("workflow_id") + 1)), (1, F.lit("Job stats:")), (2, F.lit("job      count")), (3, F.lit("-----  -------")), (500, F.lit("total    1000")), (501, F.lit(""))]
    one = lambda i, x: F.struct(i.cast("long").alias("line_no"), x.alias("line"))
    none = F.array().cast("array<struct<line_no:bigint,line:string>>")
    # a run's first job brings the lines above its jobs, a rule's first one its row among them, so that jobs are read once for all
    row = F.when(F.col("of_rule") == 1, F.array(one(F.col("at") + 4, F.concat_ws("    ", "rule", F.col("count").cast("string"))))).otherwise(none)
    above = F.when(n == 1, F.array(*[one(F.lit(i), x) for i, x in head])).otherwise(none)
    body = F.array(*[one(HEADER + n * PER_JOB + i, x) for i, x in enumerate(lines)])
    return j.select(*RUN, F.inline(F.concat(above, row, body))).where("line is not null")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, run_id, run_start: the first order date of each workflow and month."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 20).alias("workflow_id"), F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).agg(F.min(epoch("o_orderdate")).cast("double").alias("run_start"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, path, size: a file for each document."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("workflow_id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").cast("double").alias("mtime"))


def tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, rule, content: an order is a job, its lines are what its tool wrote."""
    tools = ["bwa_mem", "samtools_sort", "samtools_index", "fastp_trim", "fgbio_group", "star_align"]
    tool = F.element_at(F.array(*[F.lit(t) for t in tools]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    n = F.col("l_quantity").cast("long") * 100
    text = F.when(tool == "bwa_mem", F.concat(F.lit("[M::mem_process_seqs] Processed "), n, F.lit(" reads in 1.0 CPU sec"))).when(tool == "samtools_sort", F.concat(F.lit("[bam_sort_core] read "), n, F.lit(" records"))).when(tool == "fastp_trim", F.concat(F.lit("total reads: "), n)).when(tool == "fgbio_group", F.concat(F.lit("[INFO] Processed "), F.format_number(n, 0), F.lit(" records."))).when(tool == "star_align", F.concat(F.lit("Finished "), n, F.lit(" reads"))).otherwise(F.lit("indexing"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), tool.alias("rule"), F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")).alias("x"))
    return line.groupBy("job_id", "rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("content"))


def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, area, path, mtime: a log file for each document, named in one of the ways that runners and rules name logs."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n, text = F.col("doc_id"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    rule, value = text("rule_", n % 7), text("v", n * 7 % 50)
    way = n % 6
    path = (
        F.when(way == 0, text(".run/log/2024_", rule, "_", n, ".log")).when(way == 1, text(".run/log/a_job", n % 97, ".log")).when(way == 2, text("logs/", rule, ".", n, ".log"))
        .when(way == 3, text("log/", rule, "/", n, ".txt")).when(way == 4, text("logs/deep/er/x", value, "_", n)).otherwise(text("logs/other/", n))
    )
    return d.select((F.floor(n / 3) % 10).alias("workflow_id"), F.when(way < 2, "runlog").otherwise("joblog").alias("area"), path.alias("path"), n.cast("double").alias("mtime"))
