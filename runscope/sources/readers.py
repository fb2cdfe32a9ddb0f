"""Scans and sinks over what a workflow runner leaves on disk. All reading and writing is Spark's, so any store Spark knows works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.scans import carried

MAX_METADATA_BYTES, MAX_EVENT_BYTES = 10 << 20, 1 << 20
EVENT_TYPES = ["workflow_started", "job_submitted", "job_started", "job_finished", "job_error", "progress"]
METADATA = "rule string, starttime double, endtime double, input array<string>, output array<string>, log array<string>, wildcards map<string,string>, code string"
EVENT = "event_type string, timestamp double, job_id bigint, rule_name string, wildcards map<string,string>, threads string, resources map<string,string>, input_files array<string>, output_files array<string>, duration double, error_message string, completed_jobs int, total_jobs int, workflow_id string"
PROFILE = "version int, created string, updated string, machine string, rules map<string,struct<rule:string,sample_count:int,mean_duration:double,std_dev:double,min_duration:double,max_duration:double,durations:array<double>,timestamps:array<double>>>"


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """log_path, log_mtime, line_no, line. Files of any length: lines are numbered within each split of a file, and splits by what is before them.

    A file that ends with a line end has an empty last line; an empty file has no lines.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(path)
    raw = raw.select(
        meta["file_path"].alias("log_path"), F.unix_timestamp(meta["file_modification_time"]).cast("double").alias("log_mtime"),
        meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value",
    )
    count = {"lines": F.lit(1).cast("long"), "bytes": F.octet_length("value").cast("long") + 1}
    rows = carried(raw, ["log_path"], ["at"], F.col("block"), sums=count)
    line = F.regexp_replace("value", "\r$", "")
    ends = F.col("bytes") == F.col("size")  # of the last line only, and only if a line end follows it
    both = F.when(ends, F.array(line, F.lit(""))).otherwise(F.array(line))
    return rows.select("log_path", "log_mtime", "lines", F.posexplode(both).alias("i", "line")).select("log_path", "log_mtime", (F.col("lines") - 1 + F.col("i")).alias("line_no"), "line")


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable JSON file of at most 10 MB; the size filter prunes before content is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= MAX_METADATA_BYTES)
    m = F.from_json(F.col("content").cast("string"), METADATA)
    return f.select(F.col("path").alias("file_path"), F.unix_timestamp("modificationTime").cast("double").alias("file_mtime"), F.col("length").alias("file_size"), m.alias("m")).where("m.rule is not null").select("file_path", "file_mtime", "file_size", "m.*")


def completed_metadata(metadata: DataFrame) -> DataFrame:
    return metadata.where("rule is not null and starttime is not null and endtime is not null").select("rule", F.col("starttime").alias("start_time"), F.col("endtime").alias("end_time"), (F.col("endtime") - F.col("starttime")).alias("duration"), "wildcards", "input")


def full_metadata(metadata: DataFrame) -> DataFrame:
    return metadata.where("rule is not null").withColumn("code_hash", S.code_hash(F.col("code")))


def database_metadata(rows: DataFrame, namespace: str) -> DataFrame:
    """Finished rows of one namespace."""
    ok = (F.col("namespace") == namespace) & (F.coalesce("incomplete", F.lit(0)) == 0) & F.col("rule").isNotNull() & (F.col("record_format_version") > 0)
    key = ["workflow_id"] if "workflow_id" in rows.columns else []
    return rows.where(ok).select(*key, "rule", F.col("starttime").alias("start_time"), F.col("endtime").alias("end_time"), F.from_json("input", "array<string>").alias("input"), S.code_hash(F.col("code")).alias("code_hash"))


def incomplete_rows(rows: DataFrame, since: float | None = None) -> DataFrame:
    out = rows.where("incomplete = 1")
    return out if since is None else out.where(F.col("starttime") >= since)


def prefer_database(files: DataFrame, database: DataFrame) -> DataFrame:
    return files.join(database.select("workflow_id").distinct(), "workflow_id", "left_anti").unionByName(database, allowMissingColumns=True)


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of the column line; blank, long, malformed lines, unknown types and unknown keys are dropped."""
    keys = [x.split()[0] for x in EVENT.split(", ")]
    ok = (F.length(F.trim("line")) > 0) & (F.octet_length("line") <= MAX_EVENT_BYTES)
    known = F.size(F.array_except(F.json_object_keys("line"), F.array(*[F.lit(k) for k in keys]))) == 0
    e = lines.where(ok).where(known).select("*", F.from_json("line", EVENT).alias("e")).where(F.col("e.event_type").isin(EVENT_TYPES) & F.col("e.timestamp").isNotNull())
    return e.select(*[c for c in lines.columns if c not in ("line", "workflow_id")], "e.*").withColumn("threads", S.positive_int(F.col("threads")))


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path).withColumnRenamed("value", "line"))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Landed chunks of JSON lines; the checkpoint remembers the files."""
    return parse_events(spark.readStream.text(path).withColumnRenamed("value", "line"))


def event_history(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'job_finished' and duration is not null and timestamp is not null and rule_name is not null").select(F.col("rule_name").alias("rule"), "duration", F.col("timestamp").alias("end_time"), "threads", "wildcards")


def has_wildcards(history: DataFrame) -> DataFrame:
    return history.agg(F.coalesce(F.bool_or(F.size("wildcards") > 0), F.lit(False)).alias("has_wildcards"))


def incomplete_markers(files: DataFrame, since: float | None = None) -> DataFrame:
    """files(workflow_id, area, path, mtime): the marker's name is the base64 of the output path."""
    name = F.element_at(F.split("path", "/"), -1)
    out = files.where((F.col("area") == "incomplete") & (name != "migration_underway"))
    out = out if since is None else out.where(F.col("mtime") >= since)
    return out.select("workflow_id", F.col("mtime").alias("start_time"), F.expr("try_validate_utf8(cast(try_to_binary(element_at(split(path, '/'), -1), 'base64') as string))").alias("output_path"))


def lock_state(files: DataFrame) -> DataFrame:
    return files.groupBy("workflow_id").agg(F.bool_or(F.col("area") == "locks").alias("has_locks"), F.bool_or(F.col("area") == "incomplete").alias("has_incomplete"), F.max(F.when(F.col("area") == "log", F.col("mtime"))).alias("log_mtime"))


def latest_logs(files: DataFrame) -> DataFrame:
    return files.where("area = 'log'").groupBy("workflow_id").agg(F.max_by("path", F.struct("mtime", "path")).alias("log_path"))


def input_sizes(jobs: DataFrame, files: DataFrame, key: str = "job_key") -> DataFrame:
    """Sum of the sizes of all inputs; null if there are none or one is missing."""
    each = jobs.select(key, F.explode("input").alias("path"), F.size("input").alias("n")).join(files.select("path", "size"), "path", "left")
    sums = each.groupBy(key).agg(F.when(F.count("size") == F.max("n"), F.sum("size")).alias("input_size"))
    return jobs.select(key).join(sums, key, "left")


def input_size_from_output(jobs: DataFrame, files: DataFrame, key: str = "job_key") -> DataFrame:
    """The size of the first existing input that an output's name suggests."""
    # fixed values: suffixes that steps add, and endings of inputs
    suffixes, endings = [".sorted.bam", ".sorted", ".trimmed", ".filtered", ".dedup", ".aligned"], [".fastq.gz", ".fq.gz", ".fastq", ".fq", ".bam"]
    base = F.coalesce(*[F.when(F.endswith("output", F.lit(s)), F.expr(f"left(output, length(output) - {len(s)})")) for s in suffixes])
    names = F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(base, e))
    each = jobs.select(key, F.posexplode(names).alias("r", "path")).join(files.select("path", "size"), "path")
    return jobs.select(key).join(each.groupBy(key).agg(F.min_by("size", "r").alias("input_size")), key, "left")


def resolve_job_logs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """The newest log file of jobs(workflow_id, rule, job_id): named after the rule or the job, or in the rule's folder."""
    name = F.element_at(F.split("path", "/"), -1)
    logs = files.where("area = 'joblog'").select("workflow_id", "path", "mtime", F.regexp_extract(name, r"^([A-Za-z0-9_]+?)(?:[._-].*)?$", 1).alias("by_name"), F.regexp_extract("path", r"(?:^|/)logs?/(\w+)/", 1).alias("by_dir"), F.concat(F.lit("job"), F.regexp_extract(name, r"job(\d+)", 1)).alias("by_job"))
    keys = logs.select("workflow_id", "path", "mtime", F.explode(F.array_distinct(F.array("by_name", "by_dir", "by_job"))).alias("k")).where("k not in ('', 'job')")
    wanted = jobs.select("workflow_id", "rule", "job_id", F.explode(F.array(F.col("rule"), F.concat(F.lit("job"), F.col("job_id").cast("string")))).alias("k"))
    found = wanted.join(keys, ["workflow_id", "k"])
    return found.groupBy("workflow_id", "rule", "job_id").agg(F.max_by("path", F.struct("mtime", "path")).alias("log_path"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.schema(PROFILE).json(path, multiLine=True)
    ok = F.when((F.col("version") <= 1) & F.col("rules").isNotNull(), F.col("rules")).otherwise(F.raise_error(F.lit("unsupported or incomplete profile")).cast("map<string,struct<rule:string,sample_count:int,mean_duration:double,std_dev:double,min_duration:double,max_duration:double,durations:array<double>,timestamps:array<double>>>"))
    empty = F.array().cast("array<double>")
    return p.select("created", "machine", F.explode(ok).alias("name", "r")).select("created", "machine", "r.rule", "r.sample_count", "r.mean_duration", "r.std_dev", "r.min_duration", "r.max_duration", F.coalesce("r.durations", empty).alias("durations"), F.coalesce("r.timestamps", empty).alias("timestamps"))


def write_profile(profiles: DataFrame, path: str, updated: str, machine: str = "") -> None:
    """One JSON document; a profile has a row a rule, not a row a job."""
    row = F.struct("rule", F.col("sample_count").cast("int").alias("sample_count"), "mean_duration", "std_dev", "min_duration", "max_duration", "durations", "timestamps")
    doc = profiles.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", row)))).alias("rules"))
    doc.select(F.lit(1).alias("version"), F.lit(updated).alias("created"), F.lit(updated).alias("updated"), F.lit(machine).alias("machine"), "rules").coalesce(1).write.mode("overwrite").json(path)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines without null fields; overwrite begins a run."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def discrepancy_lines(d: DataFrame) -> DataFrame:
    """level and value: category, message (by default the category) and what is known of job, rule, wildcards and both values."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}="), c))
    names = (("job_id", "job_id"), ("rule", "rule"), ("wildcards", "wildcards"), ("events", "event_value"), ("parsed", "parsed_value"))
    pairs = lambda: F.array_join(F.transform(S.canonical(F.col("wildcards")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    text = lambda c: F.when(F.size("wildcards") > 0, F.concat(F.lit("{"), pairs(), F.lit("}"))) if c == "wildcards" else F.col(c).cast("string")
    have = [part(label, text(c)) for label, c in names if c in d.columns]
    message = F.coalesce("message", "category") if "message" in d.columns else F.col("category")
    return d.select(F.upper("severity").alias("level"), F.concat_ws(" | ", F.concat(F.lit("["), F.col("category"), F.lit("] "), message), *have).alias("value"))


def session_lines(spark: SparkSession) -> DataFrame:
    """What begins a session in the report."""
    rows = [("INFO", "=" * 60), ("INFO", "VALIDATION SESSION STARTED"), ("INFO", "=" * 60)]
    return spark.createDataFrame(rows, "level string, value string")


def summary_lines(events: DataFrame, log: DataFrame) -> DataFrame:
    """A line a workflow and view of total, completed, n_running and n_failed."""
    counts = lambda d, view: d.select(F.lit("DEBUG").alias("level"), F.format_string(f"{view} STATE: total=%d, completed=%d, running=%d, failed=%d", *[F.col(c).cast("long") for c in ("total", "completed", "n_running", "n_failed")]).alias("value"))
    return counts(events, "EVENT").unionByName(counts(log, "PARSED"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.select(F.concat_ws(" | ", "level", "value").alias("value")).write.mode("append").text(path)


def write_discrepancies(d: DataFrame, path: str, session: bool = False) -> None:
    """Appends a line a difference; session True begins with the marker of a session."""
    if session:
        write_report(session_lines(d.sparkSession).coalesce(1), path)
    write_report(discrepancy_lines(d), path)


def newest_first(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("age_rank", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("file_mtime"), "file_path")))
