"""Named queries over the driver tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import estimate as X
from ..operators import joblogs as J
from ..operators import logs as L
from ..operators import state as D
from ..operators import stats as E
from ..operators import tools as G
from ..operators.tables import stored
from ..sources import adapters as A
from . import reports as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = 1_000_000_000.0
RUN = ["workflow_id", "run_id"]

SAMPLES = """
part_ AS (SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS rule FROM part),
s AS (SELECT o_custkey % 20 AS workflow_id, strftime(o_orderdate, '%Y-%m') AS run_id, rule, l_quantity * 10 + l_linenumber AS duration,
  epoch(l_shipdate) - (l_quantity * 10 + l_linenumber) AS start_time, epoch(l_shipdate) AS end_time, epoch(o_orderdate) AS run_date,
  CASE WHEN l_tax <> 0 THEN l_linenumber END AS threads, CASE WHEN l_discount <> 0 THEN CAST(trunc(l_extendedprice * 100) AS BIGINT) END AS input_size,
  l_returnflag AS flag, l_linestatus AS status, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS k4
  FROM lineitem JOIN part_ ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
EVENTS = """
e AS (SELECT user_id % 10 AS workflow_id, user_id AS job_id, 'rule_' || (user_id % 7) AS rule_name,
  CASE event_type WHEN 'signup' THEN 'job_submitted' WHEN 'click' THEN 'job_started' WHEN 'purchase' THEN 'job_finished' WHEN 'error' THEN 'job_error' WHEN 'view' THEN 'progress' END AS event_type,
  epoch_us(ts) / 1e6 AS timestamp, event_id AS seq, value AS duration, nullif(event_id % 5, 0) AS threads,
  CASE WHEN event_type = 'view' THEN event_id % 100 END AS completed_jobs, CASE WHEN event_type = 'view' THEN 100 END AS total_jobs FROM events
  WHERE event_type IN ('signup', 'click', 'purchase', 'error', 'view'))"""
JOBS = (
    SAMPLES
    + """,
j AS (SELECT *, row_number() OVER (PARTITION BY workflow_id, run_id ORDER BY k1, k2, k3, k4, end_time) AS job_id FROM s),
jj AS (SELECT *, CASE job_id % 10 WHEN 7 THEN 'failed' WHEN 9 THEN 'running' ELSE 'finished' END AS ended FROM j)"""
)


def query(name: str, sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = (f"WITH {base}\n" if base else "") + sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Sums of doubles differ in the last places by their order."""
    return df.withColumns({c: F.round(c, places) for c in cols})


# ------------------------------------------------------------------ statistics

_STAT = "count(*) AS n, round(avg(duration), 6) AS mean, round(coalesce(stddev_samp(duration), 0), 6) AS std, min(duration) AS min, max(duration) AS max"
_W = "ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY end_time DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) - 1"


@query("e01_rule_stats", f"SELECT rule, n, mean, std, min, max, weighted_mean FROM (SELECT rule, {_STAT}, round(sum(duration * w) / sum(w), 6) AS weighted_mean FROM (SELECT *, pow(0.5, ({_W.format(by='rule')}) / 10.0) AS w FROM s) GROUP BY rule)", SAMPLES)
def rule_stats(spark, d):
    s = A.samples(spark, d)
    return rounded(E.timing_stats(s, ["rule"]).join(E.index_weighted_mean(s, ["rule"]), "rule"), "mean", "std", "weighted_mean")


@query("e02_variation", f"SELECT rule, n, mean, std, min, max, CASE WHEN mean > 0 THEN round(std / mean, 5) ELSE 0 END AS cv, std / mean > 0.5 AS high_variance FROM (SELECT rule, {_STAT} FROM s GROUP BY rule)", SAMPLES)
def variation(spark, d):
    return rounded(rounded(E.variation(E.timing_stats(A.samples(spark, d), ["rule"])), "mean", "std"), "cv", places=5)


@query("e03_index_weighted_mean", f"SELECT workflow_id, rule, round(sum(duration * w) / sum(w), 6) AS weighted_mean FROM (SELECT *, pow(0.5, ({_W.format(by='workflow_id, rule')}) / 10.0) AS w FROM s) GROUP BY ALL", SAMPLES)
def index_weighted(spark, d):
    return rounded(E.index_weighted_mean(A.samples(spark, d), ["workflow_id", "rule"]), "weighted_mean")


@query("e04_time_weighted_mean", f"SELECT workflow_id, rule, round(CASE WHEN sum(w) > 0 THEN sum(duration * w) / sum(w) ELSE avg(duration) END, 6) AS weighted_mean FROM (SELECT *, pow(0.5, greatest(0, {AS_OF} - end_time) / (365.0 * 86400)) AS w FROM s) GROUP BY ALL", SAMPLES)
def time_weighted(spark, d):
    return rounded(E.time_weighted_mean(A.samples(spark, d), ["workflow_id", "rule"], AS_OF, 365.0), "weighted_mean")


@query("e06_median_input_size", "SELECT rule, (min(x) + max(x)) // 2 AS median_size, max(c) AS sized FROM (SELECT rule, input_size AS x, row_number() OVER (PARTITION BY rule ORDER BY input_size, k1, k2, k3, k4) AS r, count(*) OVER (PARTITION BY rule) AS c FROM s WHERE input_size IS NOT NULL) WHERE r IN (c // 2 + 1, (c + 1) // 2) GROUP BY rule", SAMPLES)
def median_size(spark, d):
    return E.median_input_size(A.samples(spark, d), ["rule"])


_MED = "m AS (SELECT rule, (min(x) + max(x)) // 2 AS med, max(c) AS c FROM (SELECT rule, input_size AS x, row_number() OVER (PARTITION BY rule ORDER BY input_size, k1, k2, k3, k4) AS r, count(*) OVER (PARTITION BY rule) AS c FROM s WHERE input_size IS NOT NULL) WHERE r IN (c // 2 + 1, (c + 1) // 2) GROUP BY rule)"
_WM = f"wm AS (SELECT rule, sum(duration * w) / sum(w) AS w FROM (SELECT *, pow(0.5, ({_W.format(by='rule')}) / 10.0) AS w FROM s) GROUP BY rule)"


@query("e07_size_scaled", "SELECT rule, round(CASE WHEN c >= 3 AND med > 0 THEN w * least(2.0, greatest(0.5, pow(1e6 / med, 0.5))) ELSE w END, 6) AS expected, round(CASE WHEN c >= 3 AND med > 0 THEN least(0.8, c / 10.0) ELSE 0 END, 6) AS size_confidence FROM wm LEFT JOIN m USING (rule)", f"{SAMPLES}, {_MED}, {_WM}")
def size_scaled(spark, d):
    return rounded(E.size_scaled(A.samples(spark, d), ["rule"], F.lit(1e6)), "expected", "size_confidence")


@query("e08_recency", f"SELECT rule, round(least(1.0, avg(pow(0.5, greatest(0, {AS_OF} - end_time) / (7.0 * 86400)))), 6) AS recency FROM s GROUP BY rule", SAMPLES)
def recency(spark, d):
    return rounded(E.recency_factor(A.samples(spark, d), ["rule"], AS_OF), "recency")


@query("e09_consistency", "SELECT rule, round(CASE WHEN count(x) >= 2 AND avg(x) > 0 THEN greatest(0.3, 1 - stddev_pop(x) / avg(x)) ELSE 0.5 END, 6) AS consistency FROM (SELECT rule, CASE WHEN end_time >= 900000000.0 - 7 * 86400 THEN duration END AS x FROM s) GROUP BY rule", SAMPLES)
def consistency(spark, d):
    return rounded(E.recent_consistency(A.samples(spark, d), ["rule"], 900_000_000.0), "consistency")


_WC = "w AS (SELECT *, unnest(['flag', 'status']) AS key, unnest([flag, status]) AS value FROM s)"


@query("e10_wildcard_stats", f"SELECT rule, key, value, {_STAT} FROM w GROUP BY rule, key, value", f"{SAMPLES}, {_WC}")
def wildcard_stats(spark, d):
    return rounded(E.timing_stats(E.wildcard_samples(A.samples(spark, d)), ["rule", "key", "value"]), "mean", "std")


@query("e11_wildcard_value_lookup", f"SELECT rule, value, {_STAT} FROM w WHERE key = 'flag' GROUP BY rule, value HAVING count(*) >= 3", f"{SAMPLES}, {_WC}")
def wildcard_value(spark, d):
    return rounded(E.timing_stats(E.wildcard_samples(A.samples(spark, d)).where("key = 'flag'"), ["rule", "value"]).where("n >= 3"), "mean", "std")


@query("e12_predictive_key", "SELECT rule, arg_max(key, ratio) AS key, round(max(ratio), 6) AS ratio FROM (SELECT rule, key, var_pop(mean) / pow(avg(mean), 2) AS ratio FROM (SELECT rule, key, value, avg(duration) AS mean FROM w GROUP BY ALL HAVING count(*) >= 3) GROUP BY rule, key HAVING count(*) >= 2 AND var_pop(mean) / pow(avg(mean), 2) > 0.000001) GROUP BY rule", f"{SAMPLES}, {_WC}")
def predictive(spark, d):
    return rounded(E.predictive_key(A.samples(spark, d), threshold=1e-6), "ratio")


@query("e13_thread_stats", f"SELECT rule, threads, {_STAT} FROM s WHERE threads IS NOT NULL GROUP BY rule, threads", SAMPLES)
def thread_stats(spark, d):
    return rounded(E.timing_stats(A.samples(spark, d).where("threads is not null"), ["rule", "threads"]), "mean", "std")


@query("e14_thread_best_match", "SELECT x.rule, CAST(x.t AS INTEGER) AS threads, CASE WHEN a.n IS NOT NULL THEN 'exact' ELSE 'pooled' END AS match, coalesce(a.n, b.n) AS n, round(coalesce(a.m, b.m), 6) AS mean, round(coalesce(a.sd, b.sd), 6) AS std FROM (SELECT DISTINCT rule, 2 * l_linenumber AS t FROM lineitem JOIN part_ ON l_partkey = p_partkey) x LEFT JOIN (SELECT rule, threads, count(*) AS n, avg(duration) AS m, coalesce(stddev_samp(duration), 0) AS sd FROM s WHERE threads IS NOT NULL GROUP BY ALL) a ON a.rule = x.rule AND a.threads = x.t LEFT JOIN (SELECT rule, count(*) AS n, avg(duration) AS m, coalesce(stddev_samp(duration), 0) AS sd FROM s WHERE threads IS NOT NULL GROUP BY ALL) b ON b.rule = x.rule", SAMPLES)
def best_match(spark, d):
    s = A.samples(spark, d)
    return rounded(E.thread_best_match(s, s.select("rule", (F.col("k2") * 2).cast("int").alias("threads")).distinct()), "mean", "std")


_COMBO = "'flag=' || flag || ':status=' || status || coalesce(':threads=' || threads, '')"


@query("e15_combination_stats", f"SELECT rule, {_COMBO} AS combo, {_STAT} FROM s GROUP BY ALL HAVING count(*) >= 3", SAMPLES)
def combinations(spark, d):
    return rounded(E.timing_stats(E.combination_samples(A.samples(spark, d)), ["rule", "combo"]).where("n >= 3"), "mean", "std")


@query("e16_typical_threads", "SELECT rule, round(coalesce(avg(threads), 1.0), 6) AS typical_threads FROM s GROUP BY rule", SAMPLES)
def typical_threads(spark, d):
    return rounded(E.typical_threads(A.samples(spark, d)), "typical_threads")


@query("e17_global_mean", "SELECT round(coalesce(avg(duration), 60.0), 6) AS global_mean FROM s", SAMPLES)
def global_mean(spark, d):
    return rounded(E.global_mean(A.samples(spark, d)), "global_mean")


@query("e18_levels", f"SELECT rule, level, key, {_STAT} FROM (SELECT rule, duration, 'rule' AS level, '' AS key FROM s UNION ALL SELECT rule, duration, 'threads', CAST(threads AS VARCHAR) FROM s WHERE threads IS NOT NULL UNION ALL SELECT rule, duration, 'wildcard', key || '=' || value FROM w UNION ALL SELECT rule, duration, 'combination', {_COMBO} FROM s) GROUP BY ALL", f"{SAMPLES}, {_WC}")
def levels(spark, d):
    return rounded(E.levels(A.samples(spark, d)), "mean", "std")


@query("e19_code_hash_rules", "SELECT substr(sha256(p_type), 1, 16) AS code_hash, list_sort(list_distinct(list(rule))) AS rules FROM part JOIN part_ USING (p_partkey) GROUP BY 1", SAMPLES)
def code_hashes(spark, d):
    p = A.table(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("rule"), F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit(" \n ")), F.lit("\t")).alias("code"))
    return E.code_hash_rules(p)


@query("e20_totals", "SELECT count(*) AS n_samples, count(DISTINCT rule) AS n_rules FROM s", SAMPLES)
def totals(spark, d):
    return E.totals(A.samples(spark, d))


@query("e21_counts_by_rule", "SELECT workflow_id, run_id, rule, count(*) FILTER (ended = 'finished') AS completed, count(*) FILTER (ended = 'running') AS running FROM jj GROUP BY ALL", JOBS)
def counts_by_rule(spark, d):
    return A.numbered(spark, d).groupBy(*RUN, "rule").agg(F.count_if(F.col("ended") == "finished").alias("completed"), F.count_if(F.col("ended") == "running").alias("running"))


_PROFILE = "SELECT rule, count(*) AS sample_count, round(avg(duration), 6) AS mean_duration, round(coalesce(stddev_samp(duration), 0), 6) AS std_dev, min(duration) AS min_duration, max(duration) AS max_duration, list(duration ORDER BY end_time, k1, k2, k3, k4) AS durations, list(end_time ORDER BY end_time, k1, k2, k3, k4) AS timestamps"


@query("e22_profile", f"{_PROFILE} FROM s GROUP BY rule", SAMPLES)
def profile(spark, d):
    return rounded(E.profile(A.samples(spark, d)), "mean_duration", "std_dev")


@query("e23_profile_merge", "SELECT rule, count(*) AS sample_count, round(avg(duration), 6) AS mean_duration, round(coalesce(stddev_samp(duration), 0), 6) AS std_dev, min(duration) AS min_duration, max(duration) AS max_duration FROM s GROUP BY rule", SAMPLES)
def profile_merge(spark, d):
    s = A.samples(spark, d)
    a, b = E.profile(s.where("workflow_id < 10")), E.profile(s.where("workflow_id >= 10"))
    return rounded(E.merge_profiles(a, b), "mean_duration", "std_dev").drop("durations", "timestamps")


@query("e24_profile_listing", "SELECT rule, count(*) AS sample_count, sum(count(*)) OVER () AS all_samples, count(*) OVER () AS all_rules FROM s GROUP BY rule", SAMPLES)
def profile_listing(spark, d):
    p = E.timing_stats(A.samples(spark, d), ["rule"]).select("rule", F.col("n").alias("sample_count"))
    return p.crossJoin(F.broadcast(p.agg(F.sum("sample_count").alias("all_samples"), F.count(F.lit(1)).alias("all_rules")))).orderBy("rule")


@query("e25_stats_as_of_run", f"SELECT rule, {_STAT} FROM s WHERE end_time < 850000000 GROUP BY rule", SAMPLES)
def as_of(spark, d):
    s = A.samples(spark, d)
    return rounded(E.as_of_run(s, F.lit(850_000_000.0), s), "mean", "std")


@query("e25_before_runs", f"""SELECT f.workflow_id, f.run_id, f.rule, count(*) AS n, round(avg(duration), 6) AS mean, round(coalesce(stddev_samp(duration), 0), 6) AS std, min(duration) AS min, max(duration) AS max
  FROM (SELECT DISTINCT s.workflow_id, r.run_id, s.rule, r.run_start FROM s ASOF JOIN r ON s.workflow_id = r.workflow_id AND s.end_time >= r.run_start) f JOIN s ON s.workflow_id = f.workflow_id AND s.rule = f.rule AND s.end_time < f.run_start GROUP BY ALL""", f"""{SAMPLES},
r AS (SELECT o_custkey % 20 AS workflow_id, strftime(o_orderdate, '%Y-%m') AS run_id, CAST(min(epoch(o_orderdate)) AS DOUBLE) AS run_start FROM orders GROUP BY ALL)""")
def before_runs(spark, d):
    return rounded(E.before_runs(A.samples(spark, d), A.runs(spark, d)), "mean", "std")


@query("e23_state_merge", f"SELECT rule, n, mean, std, min, max, weighted_mean FROM (SELECT rule, {_STAT}, round(sum(duration * w) / sum(w), 6) AS weighted_mean FROM (SELECT *, pow(0.5, ({_W.format(by='rule')}) / 10.0) AS w FROM s) GROUP BY rule)", SAMPLES)
def state_merge(spark, d):
    """Profiles of two halves, kept as states of bounded size, merged without raw samples."""
    s = A.samples(spark, d)
    half = lambda ok: E.timing_state(s.where(ok), ["rule"])
    return rounded(E.state_stats(E.merge_states(half("workflow_id < 7"), half("workflow_id >= 7"), ["rule"])), "mean", "std", "weighted_mean")


@query("e26_current_rules_only", f"SELECT rule, {_STAT} FROM s WHERE rule IN (SELECT rule FROM s WHERE run_id = (SELECT max(run_id) FROM s)) GROUP BY rule", SAMPLES)
def current_rules(spark, d):
    s = A.samples(spark, d)
    last = s.agg(F.max("run_id").alias("run_id"))
    return rounded(E.only_rules(E.timing_stats(s, ["rule"]), s.join(F.broadcast(last), "run_id").select("rule").distinct()), "mean", "std")


# ------------------------------------------------------------------ logs: rendered from samples and parsed back


@query("c01_latest_progress", "SELECT workflow_id, run_id, CAST(coalesce(max(job_id) FILTER (ended = 'finished'), 0) AS INTEGER) AS completed, CAST(CASE WHEN count(*) FILTER (ended = 'finished') > 0 THEN 1000 ELSE 0 END AS INTEGER) AS total FROM jj GROUP BY ALL", JOBS)
def latest_progress(spark, d):
    return L.latest_progress(A.log_lines(spark, d))


@query("c02_completions_per_rule", "SELECT workflow_id, run_id, rule, count(*) AS completed FROM jj WHERE ended = 'finished' GROUP BY ALL", JOBS)
def completions(spark, d):
    return L.completions_per_rule(L.facts(A.log_lines(spark, d), L.WHOLE_RUNS, ()))


@query("c04_expected_counts", "SELECT workflow_id, run_id, rule, CAST(count(*) AS INTEGER) AS expected FROM jj GROUP BY ALL", JOBS)
def expected(spark, d):
    return L.expected_counts(A.log_lines(spark, d), L.WHOLE_RUNS)


@query("c05_cores", "SELECT DISTINCT workflow_id, run_id, CAST(workflow_id + 1 AS INTEGER) AS cores FROM jj", JOBS)
def cores(spark, d):
    return L.provided_cores(A.log_lines(spark, d))


@query("c06_running_jobs", "SELECT workflow_id, run_id, job_id, rule, threads, 'flag=' || flag || ', status=' || status AS wildcards, 'logs/' || rule || '/' || job_id || '.log' AS log, start_time FROM jj WHERE ended = 'running'", JOBS)
def running(spark, d):
    return L.running_jobs(L.facts(A.log_lines(spark, d), L.WHOLE_RUNS))


@query("c07_failed_jobs", "SELECT workflow_id, run_id, rule, job_id, 'logs/' || rule || '/' || job_id || '.log' AS log, threads, 'flag=' || flag || ', status=' || status AS wildcards FROM jj WHERE ended = 'failed'", JOBS)
def failed(spark, d):
    return L.failed_jobs(L.facts(A.log_lines(spark, d), L.WHOLE_RUNS, finishes=False))


@query("c08_completed_jobs", "SELECT workflow_id, run_id, job_id, rule, start_time, end_time, duration, threads, 'flag=' || flag || ', status=' || status AS wildcards, 'logs/' || rule || '/' || job_id || '.log' AS log FROM jj WHERE ended = 'finished'", JOBS)
def completed(spark, d):
    return L.completed_jobs(L.facts(A.log_lines(spark, d), L.WHOLE_RUNS))


@query("c09_job_threads", "SELECT workflow_id, run_id, job_id, threads FROM jj WHERE threads IS NOT NULL", JOBS)
def job_threads(spark, d):
    return L.job_threads(L.facts(A.log_lines(spark, d), L.WHOLE_RUNS, ("threads",), finishes=False))


@query("c10_scheduled_jobs", "SELECT workflow_id, run_id, job_id, rule, threads, start_time FROM jj", JOBS)
def scheduled(spark, d):
    return L.scheduled_jobs(L.facts(A.log_lines(spark, d), L.WHOLE_RUNS, ("threads",), finishes=False), ("threads",)).select(*RUN, "job_id", "rule", "threads", "start_time")


@query("c11_run_start", "SELECT workflow_id, run_id, arg_min(start_time, job_id) AS run_start FROM jj GROUP BY ALL", JOBS)
def run_start(spark, d):
    return L.run_start(A.log_lines(spark, d))


@query("b16_line_types", None)
def line_types(spark, d):
    """Every line of every document: arbitrary text must not break the classifier."""
    x = A.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return x.groupBy(S.line_type(F.col("line")).alias("line_type")).agg(F.count(F.lit(1)).alias("n"))


SQL["b16_line_types"] = r"""
SELECT CASE WHEN regexp_matches(l, '^\[(\w{3} \w{3} +\d+ \d+:\d+:\d+ \d+)\]') THEN 'timestamp' WHEN regexp_matches(l, '^\s') THEN 'none' WHEN regexp_matches(l, '^(?:local)?(?:rule|checkpoint) (\w+):') THEN 'rule_start'
  WHEN regexp_matches(l, '^Finished (?:job |jobid:\s*)(\d+)') THEN 'job_finished' WHEN regexp_matches(l, 'Error in rule (\w+):') THEN 'error' WHEN regexp_matches(l, '(\d+) of (\d+) steps \((\d+(?:\.\d+)?)%\) done') THEN 'progress' ELSE 'none' END AS line_type, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1"""


@query("b17_clamped_durations", "SELECT workflow_id, count(*) FILTER (end_time < run_date) AS skewed, round(sum(greatest(0, end_time - run_date)), 3) AS total FROM s GROUP BY 1", SAMPLES)
def clamped(spark, d):
    x = A.samples(spark, d).select("workflow_id", S.clamped_duration(F.col("run_date"), F.col("end_time")).alias("c"))
    return x.groupBy("workflow_id").agg(F.count_if("c.is_skewed").alias("skewed"), F.round(F.sum("c.duration"), 3).alias("total"))


@query("b15_combination_keys", f"SELECT {_COMBO} AS combo, count(*) AS n FROM s GROUP BY 1", SAMPLES)
def combo_keys(spark, d):
    return E.combination_samples(A.samples(spark, d)).groupBy("combo").agg(F.count(F.lit(1)).alias("n"))


@query("b11_input_sizes", "SELECT doc_id AS job_key, CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS BIGINT) AS input_size FROM documents")
def input_sizes(spark, d):
    from ..sources import readers

    docs, files = A.table(spark, d, "documents"), A.files(spark, d)
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    jobs = docs.select(F.col("doc_id").alias("job_key"), F.when(F.col("doc_id") % 3 == 0, F.array(path, F.lit("missing"))).otherwise(F.array(path)).alias("input"))
    return readers.input_sizes(jobs, files)


# ------------------------------------------------------------------ state

_REG = """SELECT workflow_id, CAST(job_id AS VARCHAR) AS key, arg_max(CASE event_type WHEN 'job_submitted' THEN 'SUBMITTED' WHEN 'job_started' THEN 'RUNNING' WHEN 'job_finished' THEN 'COMPLETED' ELSE 'FAILED' END, o) AS status,
  max(timestamp) FILTER (event_type = 'job_started') AS start_time, max(timestamp) FILTER (event_type IN ('job_finished', 'job_error')) AS end_time,
  CAST(coalesce(arg_max(threads, o) FILTER (event_type = 'job_started' AND threads IS NOT NULL), arg_min(threads, o) FILTER (threads IS NOT NULL)) AS INTEGER) AS threads, min(rule_name) AS rule,
  max(timestamp) FILTER (event_type IN ('job_finished', 'job_error')) - max(timestamp) FILTER (event_type = 'job_started') AS duration
  FROM (SELECT *, row_number() OVER (ORDER BY timestamp, seq) AS o FROM e WHERE event_type <> 'progress') GROUP BY workflow_id, job_id"""


@query("d13_registry_fold", f"SELECT workflow_id, key, status, start_time, end_time, threads, rule, round(duration, 6) AS duration FROM ({_REG})", EVENTS)
def registry(spark, d):
    return rounded(D.registry_fold(A.events(spark, d)), "duration")


_ACC = """a AS (SELECT *, row_number() OVER (ORDER BY timestamp, seq) AS o FROM e WHERE event_type <> 'progress'),
b AS (SELECT * FROM (SELECT *, max(o) FILTER (event_type = 'job_submitted') OVER (PARTITION BY job_id) AS so FROM a) WHERE so IS NULL OR o >= so),
acc AS (SELECT workflow_id, job_id, arg_max(CASE event_type WHEN 'job_submitted' THEN 'submitted' WHEN 'job_started' THEN 'running' WHEN 'job_finished' THEN 'finished' ELSE 'error' END, o) AS status,
  max(timestamp) FILTER (event_type = 'job_submitted') AS submit_time, max(timestamp) FILTER (event_type = 'job_started') AS start_time, max(timestamp) FILTER (event_type IN ('job_finished', 'job_error')) AS end_time,
  coalesce(arg_max(duration, o) FILTER (event_type = 'job_finished' AND duration IS NOT NULL), max(timestamp) FILTER (event_type IN ('job_finished', 'job_error')) - max(timestamp) FILTER (event_type = 'job_started')) AS duration FROM b GROUP BY ALL)"""


@query("d15_accumulator_fold", "SELECT workflow_id, job_id, status, submit_time, start_time, end_time, round(duration, 6) AS duration FROM acc", f"{EVENTS}, {_ACC}")
def accumulator(spark, d):
    return rounded(D.accumulator_fold(A.events(spark, d)), "duration")


@query("d16_bounded_jobs", "SELECT workflow_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY CASE WHEN status IN ('finished', 'error') THEN 0 ELSE 1 END, end_time NULLS LAST, job_id) AS r, count(*) OVER (PARTITION BY workflow_id) AS n FROM acc) WHERE status NOT IN ('finished', 'error') OR r > n - 5", f"{EVENTS}, {_ACC}")
def bounded(spark, d):
    return D.bounded(D.accumulator_fold(A.events(spark, d)), 5).select("workflow_id", "job_id", "status")


@query("d15_progress", "SELECT workflow_id, arg_max(completed_jobs, o)::INTEGER AS completed, arg_max(total_jobs, o)::INTEGER AS total FROM (SELECT *, row_number() OVER (ORDER BY timestamp, seq) AS o FROM e WHERE completed_jobs IS NOT NULL) GROUP BY 1", EVENTS)
def workflow_progress(spark, d):
    return D.workflow_progress(A.events(spark, d))


@query("d24_status_counts", f"SELECT workflow_id, count(*) FILTER (status = 'SUBMITTED') AS submitted, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM ({_REG}) GROUP BY 1", EVENTS)
def status_counts(spark, d):
    return D.status_counts(D.registry_fold(A.events(spark, d)))


@query("d17_compare_states", "SELECT workflow_id, job_id, 'missing_running' AS category, 'error' AS severity FROM acc WHERE status = 'running' AND job_id % 2 = 1 UNION ALL SELECT workflow_id, job_id, 'missing_failed', 'error' FROM acc WHERE status = 'error' AND job_id % 2 = 1 UNION ALL SELECT workflow_id, job_id, 'start_mismatch', 'info' FROM acc WHERE status = 'running' AND job_id % 4 = 0", f"{EVENTS}, {_ACC}")
def compare(spark, d):
    a = D.accumulator_fold(A.events(spark, d))
    return D.compare_states(a, a.where("job_id % 2 = 0").withColumn("start_time", F.when(F.col("job_id") % 4 == 0, F.col("start_time") + 60).otherwise(F.col("start_time"))))


@query("d17_compare_counts", "SELECT workflow_id, what, event_value, parsed_value FROM (SELECT workflow_id, unnest(['finished', 'running', 'error']) AS what, unnest([count(*) FILTER (status = 'finished'), count(*) FILTER (status = 'running'), count(*) FILTER (status = 'error')]) AS event_value, unnest([count(*) FILTER (status = 'finished' AND job_id % 2 = 0), count(*) FILTER (status = 'running' AND job_id % 2 = 0), count(*) FILTER (status = 'error' AND job_id % 2 = 0)]) AS parsed_value FROM acc GROUP BY 1) WHERE event_value <> parsed_value", f"{EVENTS}, {_ACC}")
def compare_counts(spark, d):
    a = D.accumulator_fold(A.events(spark, d))
    return D.compare_counts(a, a.where("job_id % 2 = 0"))


_RUNS = "r AS (SELECT o_custkey % 20 AS workflow_id, strftime(o_orderdate, '%Y-%m') AS run_id, min(epoch(o_orderdate)) AS run_start FROM orders GROUP BY ALL)"


@query("d09_run_cutoffs", "SELECT workflow_id, run_id, run_start, lead(run_start) OVER (PARTITION BY workflow_id ORDER BY run_start, run_id) AS next_start FROM r", _RUNS)
def run_cutoffs(spark, d):
    return D.next_runs(A.runs(spark, d))


@query("d02_time_frame", "SELECT s.workflow_id, n.run_id AS frame_run, count(*) AS n, round(sum(duration), 6) AS total FROM s JOIN (SELECT *, lead(run_start) OVER (PARTITION BY workflow_id ORDER BY run_start, run_id) AS nx FROM r) n ON s.workflow_id = n.workflow_id AND s.end_time >= n.run_start AND (n.nx IS NULL OR s.end_time < n.nx) GROUP BY ALL", f"{SAMPLES}, {_RUNS}")
def time_frame(spark, d):
    got = D.in_time_frame(A.samples(spark, d).select("workflow_id", "end_time", "duration"), A.runs(spark, d))
    return got.groupBy("workflow_id", "frame_run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 6).alias("total"))


@query("d04_augment_threads", "SELECT workflow_id, rule, count(t) AS known, sum(t)::BIGINT AS total FROM (SELECT s.workflow_id, s.rule, coalesce(s.threads, x.t) AS t FROM s LEFT JOIN (SELECT workflow_id, rule, end_time, max(threads) AS t FROM s GROUP BY ALL) x USING (workflow_id, rule, end_time)) GROUP BY ALL", SAMPLES)
def augment(spark, d):
    s = A.samples(spark, d)
    return D.augment_threads(s, s).groupBy("workflow_id", "rule").agg(F.count("threads").alias("known"), F.sum("threads").alias("total"))


@query("d03_fallback", "SELECT workflow_id, run_id, count(*) AS n FROM s WHERE run_id < '1995-01' GROUP BY ALL UNION ALL SELECT workflow_id, run_id, count(*) AS n FROM s WHERE NOT run_id < '1995-01' GROUP BY ALL", SAMPLES)
def fallback(spark, d):
    s = A.samples(spark, d)
    return D.with_fallback(s.where("run_id < '1995-01'"), s, RUN).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))


@query("d10_pending_jobs", "SELECT workflow_id, run_id, max(job_id) + 1 AS job_id FROM jj GROUP BY ALL", JOBS)
def pending(spark, d):
    j = A.numbered(spark, d).select(*RUN, "job_id")
    last = F.max("job_id").over(Window.partitionBy(*RUN))
    planned = j.withColumn("last", last).select(*RUN, F.explode(F.when(F.col("job_id") == F.col("last"), F.array("job_id", F.col("job_id") + 1)).otherwise(F.array("job_id"))).alias("job_id"))
    return L.pending_jobs(L.facts(A.log_lines(spark, d), L.WHOLE_RUNS, ()), planned)


@query("d19_segment_runs", "SELECT workflow_id, run_no, count(*) AS n FROM (SELECT workflow_id, sum((event_type = 'job_submitted')::INT) OVER (PARTITION BY workflow_id ORDER BY timestamp, seq) AS run_no FROM e) GROUP BY ALL", EVENTS)
def segments(spark, d):
    e = A.events(spark, d).withColumn("event_type", F.when(F.col("event_type") == "job_submitted", "workflow_started").otherwise(F.col("event_type")))
    return D.segment_runs(e).groupBy("workflow_id", "run_no").agg(F.count(F.lit(1)).alias("n"))


@query("d21_submitted_starts", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM e UNION ALL SELECT 'job_started' FROM e WHERE event_type = 'job_submitted') GROUP BY 1", EVENTS)
def submitted_starts(spark, d):
    return D.submitted_starts(A.events(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("d20_derive_events", "SELECT event_type, count(*) AS n, count(duration) AS with_duration, round(sum(duration), 3) AS total FROM (SELECT event_type, CASE WHEN event_type IN ('job_finished', 'job_error') THEN timestamp - last_value(CASE WHEN event_type = 'job_started' THEN timestamp END IGNORE NULLS) OVER (PARTITION BY workflow_id, job_id ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS duration FROM e WHERE event_type <> 'progress') GROUP BY 1", EVENTS)
def derived(spark, d):
    e = A.events(spark, d).where("event_type <> 'progress'").select("workflow_id", F.replace("event_type", F.lit("job_submitted"), F.lit("job_info")).alias("kind"), F.array("job_id").alias("job_ids"), F.col("rule_name").alias("rule"), "timestamp", "seq", F.lit(None).cast("int").alias("done"), F.lit(None).cast("int").alias("total"))
    return D.derive_events(e).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("duration").alias("with_duration"), F.round(F.sum("duration"), 3).alias("total"))


@query("d22_new_completions", "SELECT DISTINCT workflow_id, job_id FROM e WHERE event_type = 'job_finished' AND job_id % 2 = 1", EVENTS)
def new_completions(spark, d):
    e = A.events(spark, d).where("event_type = 'job_finished'").select("workflow_id", "job_id")
    return D.new_completions(e, e.where("job_id % 2 = 0"), ["workflow_id", "job_id"])


# ------------------------------------------------------------------ estimation


@query("f06_similar_rules", "SELECT rule, arg_min(match, d * 1000000 + r) AS match, min(d)::INTEGER AS distance FROM (SELECT a.rule, b.rule AS match, levenshtein(a.rule, b.rule) AS d, row_number() OVER (ORDER BY b.rule) AS r FROM (SELECT DISTINCT replace(rule, 'brand', 'brant') AS rule FROM part_) a, (SELECT DISTINCT rule FROM part_) b WHERE levenshtein(a.rule, b.rule) <= 3) GROUP BY rule", SAMPLES)
def similar(spark, d):
    k = A.samples(spark, d).select("rule").distinct()
    return X.similar_rules(k.select(F.replace("rule", F.lit("brand"), F.lit("brant")).alias("rule")), k)


@query("f05_renamed_rules", "SELECT rule, min(o) AS match FROM (SELECT a.rule, b.rule AS o FROM (SELECT DISTINCT rule, p_type FROM part JOIN part_ USING (p_partkey)) a JOIN (SELECT DISTINCT rule, p_type FROM part JOIN part_ USING (p_partkey)) b ON a.p_type = b.p_type AND a.rule <> b.rule) GROUP BY rule", SAMPLES)
def renamed(spark, d):
    return X.renamed_rules(A.table(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("rule"), F.col("p_type").alias("code")))


@query("f10_pending_exact", "SELECT workflow_id, run_id, rule, count(*) FILTER (ended = 'failed') AS pending FROM jj GROUP BY ALL HAVING count(*) FILTER (ended = 'failed') > 0", JOBS)
def pending_exact(spark, d):
    j = A.numbered(spark, d)
    n = lambda k: j.where(F.col("ended") == k).groupBy(*RUN, "rule").agg(F.count(F.lit(1)).alias("n"))
    return X.pending_exact(j.groupBy(*RUN, "rule").agg(F.count(F.lit(1)).alias("expected")), n("finished"), n("running"))


@query("f11_pending_proportional", "SELECT workflow_id, run_id, rule, pending FROM (SELECT workflow_id, run_id, rule, CAST(round_even(2 * o * n / t, 0) AS BIGINT) AS pending FROM (SELECT *, sum(n) OVER (PARTITION BY workflow_id, run_id) AS t, sum(m) OVER (PARTITION BY workflow_id, run_id) AS o FROM (SELECT workflow_id, run_id, rule, count(*) FILTER (ended = 'finished') AS n, count(*) FILTER (ended <> 'finished') AS m FROM jj GROUP BY ALL)) WHERE n > 0) WHERE pending > 0", JOBS)
def pending_proportional(spark, d):
    j = A.numbered(spark, d)
    done = j.where("ended = 'finished'").groupBy(*RUN, "rule").agg(F.count(F.lit(1)).alias("n"))
    return X.pending_proportional(done, j.groupBy(*RUN).agg((2 * F.count_if(F.col("ended") != "finished")).alias("pending")))


@query("f13_peak_threads", "SELECT workflow_id, run_id, CAST(max(x) AS BIGINT) AS peak FROM (SELECT workflow_id, run_id, sum(d) OVER (PARTITION BY workflow_id, run_id ORDER BY t) AS x FROM (SELECT workflow_id, run_id, t, sum(d) AS d FROM (SELECT workflow_id, run_id, start_time AS t, coalesce(threads, 1) AS d FROM s UNION ALL SELECT workflow_id, run_id, end_time, -coalesce(threads, 1) FROM s) GROUP BY ALL)) GROUP BY ALL", SAMPLES)
def peak(spark, d):
    return X.peak_threads(A.samples(spark, d))


def _history(j):
    """Samples in which one wildcard value takes three times as long, so that it predicts."""
    slow = F.when(F.col("wildcards")["flag"] == "R", 3).otherwise(1)
    return j.withColumn("duration", F.col("duration") * slow)


def _todo(j):
    """Jobs that run or failed, changed so that each way of estimating is needed for some."""
    j = j.where("ended <> 'finished'").withColumn("x", F.floor(F.col("job_id") / 10) % 8)
    x = F.col("x")
    rule = F.when(x == 5, F.concat("rule", F.lit("x"))).when(x == 6, F.lit("entirely_new")).otherwise(F.col("rule"))
    threads = F.when(x == 1, F.col("threads") + 10).when(x.isin(2, 3, 4), None).when(x == 7, 5).otherwise(F.col("threads")).cast("int")
    known = lambda key, other: F.when(x.isin(*other), F.lit("Z")).otherwise(F.col("wildcards")[key])
    wildcards = F.create_map(F.lit("flag"), known("flag", (3, 4, 7)), F.lit("status"), known("status", (2, 3, 4, 7)))
    size = F.when(x != 4, F.col("input_size"))
    state = F.when(F.col("ended") == "running", "running").otherwise("pending")
    return j.select(*RUN, "job_id", rule.alias("rule"), threads.alias("threads"), wildcards.alias("wildcards"), size.alias("input_size"), state.alias("state"), F.lit(20.0).alias("elapsed"))


_NEW = "end_time DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC"


def _weighted(by: str, source: str) -> str:
    return f"SELECT {by}, count(*) AS n, sum(duration * w) / sum(w) AS e, stddev_samp(duration) AS sd FROM (SELECT *, pow(0.5, (row_number() OVER (PARTITION BY {by} ORDER BY {_NEW}) - 1) / 10.0) AS w FROM {source}) GROUP BY {by}"


_EST = f"""
hs AS (SELECT * REPLACE (duration * CASE WHEN flag = 'R' THEN 3 ELSE 1 END AS duration), {_COMBO} AS combo FROM s),
tx AS (SELECT *, job_id // 10 % 8 AS x FROM jj WHERE ended <> 'finished'),
todo AS (SELECT workflow_id, run_id, job_id, ended, CASE x WHEN 5 THEN rule || 'x' WHEN 6 THEN 'entirely_new' ELSE rule END AS rule,
  CASE WHEN x = 1 THEN threads + 10 WHEN x IN (2, 3, 4) THEN NULL WHEN x = 7 THEN 5 ELSE threads END AS threads,
  CASE WHEN x IN (3, 4, 7) THEN 'Z' ELSE flag END AS flag, CASE WHEN x IN (2, 3, 4, 7) THEN 'Z' ELSE status END AS status, CASE WHEN x <> 4 THEN input_size END AS input_size FROM tx),
c AS ({_weighted('rule, combo', 'hs')}),
thr AS ({_weighted('rule, threads', '(SELECT * FROM hs WHERE threads IS NOT NULL)')}),
pool AS ({_weighted('rule', '(SELECT * FROM hs WHERE threads IS NOT NULL)')}),
allr AS ({_weighted('rule', 'hs')}),
wv AS (SELECT *, 'flag' AS key, flag AS value FROM hs UNION ALL SELECT *, 'status', status FROM hs),
pk AS (SELECT rule, arg_max(key, ratio) AS key FROM (SELECT rule, key, count(*) AS n, var_pop(mean) / pow(avg(mean), 2) AS ratio
  FROM (SELECT rule, key, value, avg(duration) AS mean FROM wv GROUP BY ALL HAVING count(*) >= 3) GROUP BY rule, key) WHERE n >= 2 AND ratio > 0.05 GROUP BY rule),
wx AS (SELECT * FROM ({_weighted('rule, key, value', 'wv')}) WHERE n >= 3),
{_MED},
near AS (SELECT rule, arg_min(match, d * 1000000 + r) AS match FROM (SELECT a.rule, b.rule AS match, levenshtein(a.rule, b.rule) AS d, row_number() OVER (ORDER BY b.rule) AS r
  FROM (SELECT DISTINCT rule FROM todo WHERE rule NOT IN (SELECT rule FROM allr)) a, allr b WHERE levenshtein(a.rule, b.rule) <= 3) GROUP BY rule),
g AS (SELECT avg(duration) AS e FROM hs),
found AS (SELECT t.*, CASE WHEN c.n IS NOT NULL THEN 'combination' WHEN t.threads IS NOT NULL AND pool.n IS NOT NULL THEN 'threads' WHEN wx.n IS NOT NULL THEN 'wildcard'
    WHEN allr.n IS NOT NULL AND t.input_size > 0 AND m.c >= 4 THEN 'size' WHEN allr.n IS NOT NULL THEN 'rule' WHEN near.match IS NOT NULL THEN 'similar' ELSE 'global' END AS method,
  c.e AS ce, c.n AS cn, c.sd AS csd, coalesce(thr.e, pool.e) AS pe, CASE WHEN thr.n IS NULL THEN CASE WHEN pool.n > 1 THEN pool.sd * pool.sd ELSE pow(0.3 * pool.e, 2) END WHEN thr.n > 1 THEN thr.sd * thr.sd ELSE pow(0.2 * thr.e, 2) END AS pv,
  wx.e AS we, wx.sd AS wsd, allr.e AS re, allr.n AS rn, allr.sd AS rsd, m.med, m.c AS mc, x.e AS xe, x.n AS xn, x.sd AS xsd, g.e AS ge
  FROM todo t LEFT JOIN c ON c.rule = t.rule AND c.combo = 'flag=' || t.flag || ':status=' || t.status || coalesce(':threads=' || t.threads, '')
  LEFT JOIN thr ON thr.rule = t.rule AND thr.threads = t.threads LEFT JOIN pool ON pool.rule = t.rule LEFT JOIN allr ON allr.rule = t.rule LEFT JOIN m ON m.rule = t.rule
  LEFT JOIN pk ON pk.rule = t.rule LEFT JOIN wx ON wx.rule = t.rule AND wx.key = pk.key AND wx.value = CASE pk.key WHEN 'flag' THEN t.flag ELSE t.status END
  LEFT JOIN near ON near.rule = t.rule LEFT JOIN allr x ON x.rule = near.match, g),
res AS (SELECT *, CASE method WHEN 'combination' THEN ce WHEN 'threads' THEN pe WHEN 'wildcard' THEN we WHEN 'size' THEN re * least(2.0, greatest(0.5, pow(input_size / med, 0.5))) WHEN 'rule' THEN re WHEN 'similar' THEN xe ELSE ge END AS expected,
  CASE method WHEN 'combination' THEN CASE WHEN cn >= 3 THEN csd * csd ELSE pow(0.5 * ce, 2) END WHEN 'threads' THEN pv WHEN 'wildcard' THEN wsd * wsd WHEN 'size' THEN rsd * rsd * (1 - 0.5 * least(0.8, mc / 10.0))
    WHEN 'rule' THEN rsd * rsd WHEN 'similar' THEN xsd * xsd ELSE pow(0.5 * ge, 2) END AS variance FROM found)"""


@query("f09_job_estimates", "SELECT workflow_id, run_id, job_id, method, round(expected, 5) AS expected, round(variance, 4) AS variance FROM res", f"{JOBS}, {_EST}")
def job_estimates(spark, d):
    j = stored(A.numbered(spark, d), "jobs")  # both sides read it several times
    got = X.job_estimates(_todo(j), _history(j))
    return got.select(*RUN, "job_id", "method", F.round("expected", 5).alias("expected"), F.round("variance", 4).alias("variance"))


@query("f09_methods", "SELECT method, count(*) AS n FROM res GROUP BY 1", f"{JOBS}, {_EST}")
def job_methods(spark, d):
    j = stored(A.numbered(spark, d), "jobs")
    return X.job_estimates(_todo(j), _history(j)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


_RUN_EST = """
ty AS (SELECT rule, coalesce(avg(threads), 1.0) AS tt FROM hs GROUP BY rule),
jobs AS (SELECT r.*, coalesce(r.threads, ty.tt, 1.0) AS t, ended = 'running' AS runs FROM res r LEFT JOIN ty ON ty.rule = r.rule WHERE ended = 'running' OR workflow_id % 2 = 0),
work AS (SELECT workflow_id, run_id, sum(greatest(0, expected - 20) * t) FILTER (runs) AS rw, sum(expected * t) FILTER (NOT runs) AS pw, sum(variance * t * t) FILTER (runs) AS rv, sum(variance * t * t) FILTER (NOT runs) AS pv,
  sum(coalesce(threads, 1)) FILTER (runs) AS peak, sum(t) AS threads, count(*) FILTER (NOT runs) AS listed FROM jobs GROUP BY ALL),
snap AS (SELECT workflow_id, run_id, count(*) AS total, count(*) FILTER (ended = 'finished') AS completed, count(*) FILTER (ended = 'failed') AS pending, CASE WHEN workflow_id % 5 <> 0 THEN workflow_id + 1 END AS cores FROM jj GROUP BY ALL),
done AS (SELECT workflow_id, run_id, rule, count(*) AS n FROM jj WHERE ended = 'finished' GROUP BY ALL),
expd AS (SELECT workflow_id, run_id, rule, count(*) AS x FROM jj WHERE workflow_id % 4 = 1 GROUP BY ALL),
runr AS (SELECT workflow_id, run_id, rule, count(*) AS n FROM jobs WHERE runs GROUP BY ALL),
cnt AS (SELECT s.workflow_id, s.run_id, pending FROM snap s LEFT JOIN work w USING (workflow_id, run_id) WHERE NOT (coalesce(listed, 0) > 0 AND coalesce(listed, 0) >= pending) AND pending > 0),
exact AS (SELECT e.workflow_id, e.run_id, e.rule, x - coalesce(d.n, 0) - coalesce(r.n, 0) AS k FROM expd e JOIN cnt USING (workflow_id, run_id) LEFT JOIN done d USING (workflow_id, run_id, rule) LEFT JOIN runr r USING (workflow_id, run_id, rule)),
shared AS (SELECT c.workflow_id, c.run_id, a.rule, c.pending, coalesce(d.n, a.n) AS n FROM cnt c CROSS JOIN allr a LEFT JOIN done d ON d.workflow_id = c.workflow_id AND d.run_id = c.run_id AND d.rule = a.rule WHERE c.workflow_id % 4 <> 1),
prop AS (SELECT workflow_id, run_id, rule, CAST(round_even(pending * (n / sum(n) OVER (PARTITION BY workflow_id, run_id)), 0) AS BIGINT) AS k FROM shared),
counted AS (SELECT p.workflow_id, p.run_id, sum(k * a.e * ty.tt) AS cw, sum(k * CASE WHEN a.n > 1 THEN a.sd * a.sd ELSE pow(0.3 * a.e, 2) END * ty.tt * ty.tt) AS cv
  FROM (SELECT * FROM exact WHERE k > 0 UNION ALL SELECT * FROM prop WHERE k > 0) p JOIN allr a USING (rule) JOIN ty USING (rule) GROUP BY ALL),
cov AS (SELECT workflow_id, run_id, count(*) AS done FROM done GROUP BY ALL),
z AS (SELECT s.workflow_id, s.run_id, total, completed, greatest(1.0, coalesce(cores, peak, 1)) AS cores, coalesce(threads, total) AS threads,
  coalesce(rw, 0) + coalesce(CASE WHEN coalesce(listed, 0) > 0 AND listed >= pending THEN pw ELSE cw END, 0) AS work, coalesce(rv, 0) + coalesce(CASE WHEN coalesce(listed, 0) > 0 AND listed >= pending THEN pv ELSE cv END, 0) AS var,
  least(0.9, 0.4 * 1.0 + 0.3 * 0.9 + 0.2 * 0.5 + 0.1 * CASE WHEN s.workflow_id % 4 = 1 THEN coalesce(done, 0) / (SELECT count(*) FROM allr) ELSE 1.0 END) AS conf, g.e AS ge
  FROM snap s LEFT JOIN work USING (workflow_id, run_id) LEFT JOIN counted USING (workflow_id, run_id) LEFT JOIN cov USING (workflow_id, run_id), g),
eta AS (SELECT workflow_id, run_id, CASE WHEN completed >= total THEN 'complete' WHEN completed = 0 THEN 'bootstrap' ELSE 'weighted' END AS method,
  CASE WHEN completed >= total THEN 0 WHEN completed = 0 THEN ge * threads / cores ELSE work / cores END AS seconds_remaining,
  CASE WHEN completed >= total THEN 0 WHEN completed = 0 THEN ge * threads / cores * 0.2 ELSE greatest(0, work / cores - 2 * CASE WHEN var > 0 THEN sqrt(var) / cores ELSE work / cores * 0.3 END) END AS lower,
  CASE WHEN completed >= total THEN 0 WHEN completed = 0 THEN ge * threads / cores * 3 ELSE work / cores + 2 * CASE WHEN var > 0 THEN sqrt(var) / cores ELSE work / cores * 0.3 END END AS upper,
  CASE WHEN completed >= total THEN 1.0 WHEN completed = 0 THEN 0.05 ELSE conf END AS confidence FROM z)"""


def _estimates(spark, d, begun=None, jobs=None, **more):
    """Odd workflows have no list of pending jobs, some of them expected counts; every fifth doesn't tell its cores. Runs that aren't begun have nothing completed."""
    j = stored(A.numbered(spark, d), "jobs") if jobs is None else jobs
    ended = lambda k: F.count_if(F.col("ended") == k)
    snap = j.groupBy(*RUN).agg(F.count(F.lit(1)).alias("total"), ended("finished").alias("completed"), ended("failed").alias("pending"), (F.max("end_time") - F.min("start_time")).alias("elapsed"))
    snap = snap.withColumn("cores", F.when(F.col("workflow_id") % 5 != 0, F.col("workflow_id") + 1))
    if begun is not None:
        snap = snap.withColumn("completed", F.when(begun, F.col("completed")).otherwise(0))
    todo = _todo(j).where("state = 'running' or workflow_id % 2 = 0")
    expected = j.where("workflow_id % 4 = 1").groupBy(*RUN, "rule").agg(F.count(F.lit(1)).alias("expected"))
    return X.estimate_runs(snap, todo, _history(j), j.where("ended = 'finished'").select(*RUN, "rule"), AS_OF * 2, expected=expected, **more)


_SIMPLE = """
sp AS (SELECT workflow_id, run_id, sum(20 * t) FILTER (runs) AS spent, sum(t) AS th FROM jobs GROUP BY ALL),
el AS (SELECT workflow_id, run_id, max(end_time) - min(start_time) AS elapsed FROM jj GROUP BY ALL),
y AS (SELECT z.workflow_id, z.run_id, total, CASE WHEN z.workflow_id % 10 = 3 THEN 0 ELSE completed END AS completed, cores, th, coalesce(spent, 0) AS spent, elapsed, ge * threads / cores AS boot
  FROM z LEFT JOIN sp USING (workflow_id, run_id) JOIN el USING (workflow_id, run_id)),
se AS (SELECT *, CASE WHEN completed >= total THEN 'complete' WHEN completed = 0 OR elapsed <= 0 THEN 'bootstrap' ELSE 'simple' END AS method, greatest(0.3, 1 - completed / total) AS u,
  CASE WHEN completed > 0 THEN CASE WHEN th IS NOT NULL THEN greatest(0, elapsed / completed * cores * th - spent) / cores ELSE elapsed / completed * (total - completed) END END AS e FROM y),
simple AS (SELECT workflow_id, run_id, method, CASE method WHEN 'complete' THEN 0 WHEN 'bootstrap' THEN boot ELSE e END AS seconds_remaining, CASE method WHEN 'complete' THEN 0 WHEN 'bootstrap' THEN boot * 0.2 ELSE e * (1 - u) END AS lower,
  CASE method WHEN 'complete' THEN 0 WHEN 'bootstrap' THEN boot * 3 ELSE e * (1 + 2 * u) END AS upper, CASE method WHEN 'complete' THEN 1.0 WHEN 'bootstrap' THEN 0.05 ELSE least(0.7, completed / 20) END AS confidence FROM se)"""


@query("f18_simple_estimates", "SELECT workflow_id, run_id, method, round(seconds_remaining, 4) AS seconds_remaining, round(lower, 4) AS lower, round(upper, 4) AS upper, round(confidence, 6) AS confidence FROM simple", f"{JOBS}, {_EST}, {_RUN_EST}, {_SIMPLE}")
def simple_estimates(spark, d):
    """Without timings of earlier runs, and with runs that have not completed a job."""
    return rounded(rounded(_estimates(spark, d, F.col("workflow_id") % 10 != 3, has_history=False), "seconds_remaining", "lower", "upper", places=4), "confidence")


@query("f20_run_estimates", "SELECT workflow_id, run_id, method, round(seconds_remaining, 4) AS seconds_remaining, round(lower, 4) AS lower, round(upper, 4) AS upper, round(confidence, 6) AS confidence FROM eta", f"{JOBS}, {_EST}, {_RUN_EST}")
def run_estimates(spark, d, jobs=None):
    return rounded(rounded(_estimates(spark, d, jobs=jobs), "seconds_remaining", "lower", "upper", places=4), "confidence")


@query("f21_confidence_parts", "SELECT workflow_id, run_id, least(1.0, (SELECT count(*) FROM s) / 10.0) AS sample, CAST(0.9 AS DOUBLE) AS recency, CAST(0.5 AS DOUBLE) AS consistency, CASE WHEN workflow_id % 2 = 0 THEN round(count(DISTINCT rule) / (SELECT count(DISTINCT rule) FROM s), 6) ELSE round(1.0 + 1.0 / (SELECT count(DISTINCT rule) FROM s), 6) END AS coverage FROM s GROUP BY workflow_id, run_id", SAMPLES)
def confidence_parts(spark, d):
    """Even workflows have expected counts; odd ones also completed a rule without history."""
    s = A.samples(spark, d)
    done = s.select(*RUN, "rule")
    new = done.where("workflow_id % 2 = 1").select(*RUN, F.lit("unseen").alias("rule"))
    parts = X.confidence_parts(s, done.unionByName(new), AS_OF * 2, done.where("workflow_id % 2 = 0"))
    return rounded(parts, "coverage", "recency", "consistency")


# ------------------------------------------------------------------ tools


@query("g10_tool_progress", None)
def tool_progress(spark, d):
    return G.tool_progress(A.tool_logs(spark, d)).select("job_id", "rule", "tool", F.col("progress.done").alias("done"), F.col("progress.unit").alias("unit"))


SQL["g10_tool_progress"] = """
SELECT job_id, rule, CASE k WHEN 0 THEN 'bwa' WHEN 1 THEN 'samtools_sort' WHEN 2 THEN 'samtools_index' WHEN 3 THEN 'fastp' WHEN 4 THEN 'fgbio' ELSE 'star' END AS tool,
  CASE k WHEN 0 THEN total WHEN 1 THEN biggest WHEN 2 THEN NULL ELSE latest END AS done, CASE k WHEN 0 THEN 'reads' WHEN 1 THEN 'records' WHEN 2 THEN NULL WHEN 4 THEN 'records' ELSE 'reads' END AS unit
FROM (SELECT l_orderkey AS job_id, l_orderkey % 6 AS k, ['bwa_mem', 'samtools_sort', 'samtools_index', 'fastp_trim', 'fgbio_group', 'star_align'][l_orderkey % 6 + 1] AS rule,
  CAST(sum(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) AS total, max(CAST(l_quantity AS BIGINT) * 100) AS biggest, last(CAST(l_quantity AS BIGINT) * 100 ORDER BY l_linenumber, l_partkey, l_suppkey) AS latest FROM lineitem GROUP BY l_orderkey)"""


# ------------------------------------------------------------------ reports


@query("i01_duration_texts", """SELECT duration, end_time_text AS text, n FROM (SELECT duration, CASE WHEN x < 60 THEN x || 's' WHEN x < 3600 THEN CASE WHEN x % 60 = 0 THEN (x // 60) || 'm' ELSE (x // 60) || 'm ' || (x % 60) || 's' END ELSE CASE WHEN x % 3600 // 60 = 0 THEN (x // 3600) || 'h' ELSE (x // 3600) || 'h ' || (x % 3600 // 60) || 'm' END END AS end_time_text, count(*) AS n FROM (SELECT duration * 17 AS duration, CAST(floor(duration * 17) AS BIGINT) AS x FROM s) GROUP BY ALL)""", SAMPLES)
def duration_texts(spark, d):
    x = A.samples(spark, d).select((F.col("duration") * 17).alias("duration"))
    return x.groupBy("duration").agg(F.count(F.lit(1)).alias("n")).select("duration", S.duration_text(F.col("duration")).alias("text"), "n")


@query("i05_count_texts", "SELECT workflow_id, run_id, done || ' of ' || total || ' (' || format('{:.1f}', done * 100.0 / total) || '%)' AS text FROM (SELECT workflow_id, run_id, count(*) AS total, count(*) FILTER (ended = 'finished') AS done FROM jj GROUP BY ALL)", JOBS)
def count_texts(spark, d):
    x = A.numbered(spark, d).groupBy(*RUN).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ended") == "finished").alias("done"))
    return x.select(*RUN, S.count_text(F.col("done"), F.col("total")).alias("text"))


@query("i10_recent_completions", "SELECT workflow_id, run_id, job_id, rule, end_time, CASE ended WHEN 'failed' THEN 'failed' ELSE 'completed' END AS state FROM jj WHERE ended <> 'running' ORDER BY end_time DESC, rule, job_id, workflow_id, run_id LIMIT 20", JOBS)
def recent(spark, d):
    j = A.numbered(spark, d).select(*RUN, "job_id", "rule", "end_time", "ended")
    done, bad = (j.where(F.col("ended") == k).drop("ended") for k in ("finished", "failed"))
    return R.recent_completions(done, bad)


@query("i11_pending_table", "SELECT rule, count(*) AS pending, greatest(0, (SELECT count(DISTINCT rule) FROM jj WHERE ended = 'failed') - 10) AS more FROM jj WHERE ended = 'failed' GROUP BY rule ORDER BY 2 DESC, 1 LIMIT 10", JOBS)
def pending_table(spark, d):
    return R.pending_table(A.numbered(spark, d).where("ended = 'failed'").withColumn("pending", F.lit(1)))


@query("i12_stats_table", f"SELECT rule, CAST(threads AS VARCHAR) AS threads, {_STAT} FROM s WHERE threads IS NOT NULL GROUP BY ALL", SAMPLES)
def stats_table(spark, d):
    return rounded(R.stats_table(A.samples(spark, d)), "mean", "std")


@query("i13_top_failures", "SELECT workflow_id, run_id, rule, job_id, more FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id, run_id ORDER BY rule, job_id) AS r, greatest(0, count(*) OVER (PARTITION BY workflow_id, run_id) - 8) AS more FROM jj WHERE ended = 'failed') WHERE r <= 8", JOBS)
def top_failures(spark, d):
    return R.top_with_overflow(A.numbered(spark, d).where("ended = 'failed'")).select(*RUN, "rule", "job_id", "more")


@query("i14_page", "SELECT rule, job_id, workflow_id, run_id FROM jj ORDER BY rule, job_id, workflow_id, run_id LIMIT 10 OFFSET 20", JOBS)
def page(spark, d):
    return R.page(A.numbered(spark, d).select("rule", "job_id", *RUN), ["rule", "job_id", *RUN], 20)


@query("i15_snapshot", "SELECT workflow_id, run_id, count(*) FILTER (ended = 'finished') AS n_completed, count(*) FILTER (ended = 'failed') AS n_failed, arg_min(start_time, job_id) AS run_start FROM jj GROUP BY ALL", JOBS)
def snapshot(spark, d):
    return R.snapshot(A.log_lines(spark, d), chunk_lines=L.WHOLE_RUNS).select(*RUN, "n_completed", "n_failed", "run_start")


@query("i16_shares", "SELECT workflow_id, run_id, round(c * 100.0 / t, 6) AS succeeded, round(f * 100.0 / t, 6) AS failed, CAST(0 AS DOUBLE) AS incomplete, round((t - c - f) * 100.0 / t, 6) AS remaining, round((c + f) * 100.0 / t, 6) AS percent_done FROM (SELECT workflow_id, run_id, count(*) AS t, count(*) FILTER (ended = 'finished') AS c, count(*) FILTER (ended = 'failed') AS f FROM jj GROUP BY ALL)", JOBS)
def shares(spark, d):
    x = A.numbered(spark, d).groupBy(*RUN).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ended") == "finished").alias("completed"), F.count_if(F.col("ended") == "failed").alias("n_failed")).withColumn("n_incomplete", F.lit(0))
    return rounded(R.shares(x), "succeeded", "failed", "incomplete", "remaining", "percent_done")


def _duration_sql(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    minutes = f"CASE WHEN {s} % 60 = 0 THEN ({s} // 60) || 'm' ELSE ({s} // 60) || 'm ' || ({s} % 60) || 's' END"
    hours = f"CASE WHEN {s} % 3600 // 60 = 0 THEN ({s} // 3600) || 'h' ELSE ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm' END"
    return f"(CASE WHEN {x} < 0 THEN '0s' WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN {minutes} ELSE {hours} END)"


_ETA_TEXT = f"""CASE WHEN confidence > 0.7 AND (lower IS NULL OR (seconds_remaining > 0 AND (upper - lower) / seconds_remaining < 0.3)) THEN '~' || {_duration_sql('seconds_remaining')}
  WHEN confidence > 0.4 AND lower IS NOT NULL THEN {_duration_sql('lower')} || ' - ' || {_duration_sql('upper')}
  ELSE '~' || {_duration_sql('seconds_remaining')} || CASE WHEN confidence > 0.1 THEN ' (rough)' ELSE ' (very rough)' END END"""


@query("i06_eta_texts", f"SELECT duration, c AS confidence, bounded, {_ETA_TEXT} AS text FROM (SELECT duration, c, b AS bounded, duration AS seconds_remaining, CASE WHEN b THEN duration * 0.9 END AS lower, CASE WHEN b THEN duration * (1.1 + c) END AS upper, c AS confidence FROM (SELECT DISTINCT duration FROM s), (SELECT unnest([0.05, 0.3, 0.5, 0.75, 0.95]::DOUBLE[]) AS c), (SELECT unnest([true, false]) AS b))", SAMPLES)
def eta_texts(spark, d):
    x = A.samples(spark, d).select("duration").distinct()
    x = x.withColumn("confidence", F.explode(F.array(*[F.lit(v) for v in (0.05, 0.3, 0.5, 0.75, 0.95)]))).withColumn("bounded", F.explode(F.array(F.lit(True), F.lit(False))))
    low, high = (F.when(F.col("bounded"), F.col("duration") * v) for v in (F.lit(0.9), 1.1 + F.col("confidence")))
    return x.withColumn("text", S.eta_text(F.col("duration"), low, high, F.col("confidence")))


@query("i03_size_texts", "SELECT size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN CASE WHEN size % 1024 = 0 THEN (size // 1024) || ' KB' ELSE format('{:.1f}', size / 1024) || ' KB' END WHEN size < 1073741824 THEN CASE WHEN size % 1048576 = 0 THEN (size // 1048576) || ' MB' ELSE format('{:.1f}', size / 1048576) || ' MB' END ELSE format('{:.1f}', size / 1073741824) || ' GB' END AS text FROM (SELECT DISTINCT CAST(n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1000 END AS BIGINT) AS size FROM documents)")
def size_texts(spark, d):
    factor = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1024).otherwise(1000)
    x = A.table(spark, d, "documents").select((F.col("n_chars") * factor).cast("long").alias("size")).distinct()
    return x.select("size", S.size_text(F.col("size")).alias("text"))


@query("i17_status_report", f"""SELECT q.workflow_id, q.run_id, CASE WHEN n_failed > 0 THEN 'failed' WHEN completed < total THEN 'incomplete' ELSE 'completed' END AS status,
  completed || ' of ' || total || CASE WHEN total > 0 THEN ' (' || format('{{:.1f}}', completed * 100.0 / total) || '%)' ELSE '' END AS progress, {_duration_sql(f'({AS_OF} - run_start)')} AS elapsed, 0 AS n_running, n_failed, CAST(0 AS BIGINT) AS n_incomplete, eta.text AS eta
  FROM (SELECT workflow_id, run_id, coalesce(max(job_id) FILTER (ended = 'finished'), 0) AS completed, CASE WHEN count(*) FILTER (ended = 'finished') > 0 THEN 1000 ELSE 0 END AS total, count(*) FILTER (ended = 'failed') AS n_failed, arg_min(start_time, job_id) AS run_start FROM jj GROUP BY ALL) q
  JOIN (SELECT workflow_id, run_id, {_ETA_TEXT} AS text FROM (SELECT * REPLACE (round(seconds_remaining, 4) AS seconds_remaining, round(lower, 4) AS lower, round(upper, 4) AS upper) FROM eta)) eta USING (workflow_id, run_id)""", f"{JOBS}, {_EST}, {_RUN_EST}")
def status_report(spark, d):
    j = stored(A.numbered(spark, d).drop("run_date"), "jobs")
    return R.status_report(R.snapshot(A.log_lines_of(j), chunk_lines=L.WHOLE_RUNS), run_estimates(spark, d, j), AS_OF)


# ------------------------------------------------------------------ views put together


@query("c12_lifecycle", "SELECT workflow_id, run_id, job_id, rule, threads, 'flag=' || flag || ', status=' || status AS wildcards, 'logs/' || rule || '/' || job_id || '.log' AS log, start_time, CASE WHEN ended = 'finished' THEN end_time END AS end_time, CASE ended WHEN 'finished' THEN 'completed' ELSE ended END AS status, CASE WHEN ended = 'finished' THEN CAST(row_number() OVER (PARTITION BY workflow_id, run_id ORDER BY CASE WHEN ended = 'finished' THEN end_time END NULLS LAST, job_id) AS INTEGER) END AS end_order FROM jj", JOBS)
def lifecycle(spark, d):
    return L.lifecycle(A.log_lines(spark, d), L.WHOLE_RUNS)


@query("d27_run_plan", "SELECT workflow_id, run_id, CAST(workflow_id + 1 AS INTEGER) AS cores, arg_min(start_time, job_id) AS run_start, CAST(count(DISTINCT rule) AS INTEGER) AS n_rules, count(*) AS n_expected, count(*) AS n_scheduled FROM jj GROUP BY workflow_id, run_id", JOBS)
def run_plan(spark, d):
    return L.run_plan(A.log_lines(spark, d), L.WHOLE_RUNS).select(*RUN, "cores", "run_start", F.size("expected").alias("n_rules"), "n_expected", "n_scheduled")


_SNAP = f"""reg AS ({_REG}),
snap AS (SELECT workflow_id, count(*) FILTER (status = 'SUBMITTED') AS pending, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM reg GROUP BY 1),
prog AS (SELECT workflow_id, max(timestamp) AS t0, arg_max(total_jobs, o)::INTEGER AS total FROM (SELECT *, row_number() OVER (ORDER BY timestamp, seq) AS o FROM e WHERE total_jobs IS NOT NULL) WHERE workflow_id % 3 <> 0 GROUP BY 1)"""


@query("d26_registry_snapshot", "SELECT workflow_id, pending, running, completed, failed, start_time, status, coalesce(total, 0) AS total FROM (SELECT *, CASE WHEN total IS NULL THEN CASE WHEN failed > 0 THEN 'failed' WHEN running > 0 THEN 'running' ELSE 'unknown' END WHEN running > 0 THEN 'running' WHEN failed > 0 AND completed < total THEN 'failed' WHEN completed >= total THEN 'completed' WHEN completed = 0 THEN 'not_started' WHEN start_time IS NULL THEN 'incomplete' WHEN 1000000000 - start_time > 1800 THEN 'stale' ELSE 'running' END AS status FROM (SELECT snap.workflow_id, CASE WHEN snap.workflow_id % 4 = 0 THEN 0 ELSE pending END AS pending, running, completed, failed, CASE WHEN snap.workflow_id % 2 = 0 THEN CAST(1e9 - 100 * snap.workflow_id AS DOUBLE) END AS start_time, total FROM snap LEFT JOIN prog USING (workflow_id)))", f"{EVENTS}, {_SNAP}")
def registry_snapshot(spark, d):
    e = A.events(spark, d)
    jobs = D.registry_fold(e).where("not (workflow_id % 4 = 0 and status = 'SUBMITTED')")
    starts = e.where("workflow_id % 2 = 0").select("workflow_id", (F.lit(1e9) - 100 * F.col("workflow_id")).cast("double").alias("start_time")).distinct()
    return D.registry_snapshot(jobs, D.workflow_progress(e).where("workflow_id % 3 <> 0"), starts, AS_OF)


_VIEWS = f"""reg AS (SELECT workflow_id, CAST(key AS BIGINT) AS job_id, status, rule, threads FROM ({_REG})),
lg AS (SELECT workflow_id, job_id, CASE WHEN job_id % 5 = 0 THEN 'failed' ELSE 'running' END AS state, rule FROM reg WHERE job_id % 2 = 0),
ev AS (SELECT workflow_id, job_id, CASE status WHEN 'SUBMITTED' THEN 'pending' WHEN 'RUNNING' THEN 'running' WHEN 'COMPLETED' THEN 'completed' ELSE 'failed' END AS es, rule AS er, threads FROM reg WHERE job_id % 3 <> 0)"""


@query("d12_event_overlay", "SELECT workflow_id, job_id, CASE WHEN es = 'failed' OR state = 'failed' THEN 'failed' WHEN es = 'pending' AND state IS NOT NULL THEN state ELSE coalesce(es, state) END AS state, coalesce(er, rule) AS rule, threads FROM lg FULL JOIN ev USING (workflow_id, job_id)", f"{EVENTS}, {_VIEWS}")
def event_overlay(spark, d):
    r = D.registry_fold(A.events(spark, d)).select("workflow_id", F.col("key").cast("long").alias("job_id"), "status", "rule", "threads", F.create_map().cast("map<string,string>").alias("wildcards"), "start_time", "end_time")
    log = r.where("job_id % 2 = 0").withColumn("state", F.when(F.col("job_id") % 5 == 0, "failed").otherwise("running")).withColumn("threads", F.lit(None).cast("int")).drop("status")
    return D.overlay(log, r.where("job_id % 3 <> 0")).select("workflow_id", "job_id", "state", "rule", "threads")


@query("d25_all_samples", "SELECT source, count(*) AS n, count(threads) AS with_threads, round(sum(duration), 3) AS total FROM (SELECT 'profile' AS source, duration, NULL AS threads FROM s WHERE flag = 'A' UNION ALL SELECT 'metadata', duration, NULL FROM s WHERE flag = 'N' UNION ALL SELECT 'events', duration, threads FROM e WHERE event_type = 'job_finished' AND duration IS NOT NULL UNION ALL SELECT 'log', duration, threads FROM s WHERE flag = 'R' AND threads IS NOT NULL) GROUP BY 1", f"{SAMPLES}, {EVENTS}")
def all_samples(spark, d):
    from ..sources import readers

    s, e = A.samples(spark, d), A.events(spark, d)
    flag = lambda v: s.where(F.col("wildcards")["flag"] == v)
    events = readers.event_history(e.withColumn("wildcards", F.lit(None).cast("map<string,string>"))).withColumn("threads", F.nullif("threads", F.lit(0)))
    got = D.all_samples(E.profile_samples(E.profile(flag("A"))), flag("N").drop("threads"), events, flag("R"))
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("threads").alias("with_threads"), F.round(F.sum("duration"), 3).alias("total"))


_JOB_FILES = f"""{EVENTS},
jobs AS (SELECT DISTINCT workflow_id, job_id, rule_name AS rule, 'v' || (job_id % 50) AS value FROM e WHERE job_id % 4 <> 3),
f AS (SELECT (doc_id // 3) % 10 AS workflow_id, doc_id AS mtime, doc_id % 6 < 2 AS run, CASE doc_id % 6 WHEN 0 THEN '.run/log/2024_rule_' || (doc_id % 7) || '_' || doc_id || '.log' WHEN 1 THEN '.run/log/a_job' || (doc_id % 97) || '.log'
  WHEN 2 THEN 'logs/rule_' || (doc_id % 7) || '.' || doc_id || '.log' WHEN 3 THEN 'log/rule_' || (doc_id % 7) || '/' || doc_id || '.txt' WHEN 4 THEN 'logs/deep/er/xv' || (doc_id * 7 % 50) || '_' || doc_id ELSE 'logs/other/' || doc_id END AS path FROM documents),
g AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '(?:^|/)logs?/([^/]+)/[^/]+$', 1) AS folder FROM f)"""


@query("a18_job_logs", """SELECT j.workflow_id, j.rule, j.job_id, arg_max(path, mtime) AS log_path FROM jobs j JOIN g ON g.workflow_id = j.workflow_id AND CASE WHEN run THEN contains(name, j.rule) OR contains(name, 'job' || j.job_id)
  ELSE starts_with(name, j.rule) OR folder = j.rule OR contains(name, value) OR (mtime % 30 = 5 AND j.rule = 'rule_' || (mtime % 7)) END GROUP BY ALL""", _JOB_FILES)
def job_logs(spark, d):
    jobs = A.events(spark, d).where("event_type is not null and job_id % 4 <> 3").select("workflow_id", "job_id", F.col("rule_name").alias("rule")).distinct()
    jobs = jobs.withColumn("wildcards", F.create_map(F.lit("s"), F.concat(F.lit("v"), (F.col("job_id") % 50).cast("string"))))
    files = A.job_files(spark, d)
    records = files.where("mtime % 30 = 5").select("workflow_id", F.concat(F.lit("rule_"), (F.col("mtime") % 7).cast("int").cast("string")).alias("rule"), F.array("path").alias("log"))
    return J.job_logs(jobs, files, records)


_WHOLE = f"""{JOBS},
q AS (SELECT workflow_id, run_id, arg_min(start_time, job_id) AS run_start, count(*) FILTER (ended = 'failed' AND workflow_id % 3 <> 1) AS n_failed, count(*) FILTER (ended = 'running' OR (ended = 'failed' AND workflow_id % 3 = 1)) AS open,
  coalesce(max(job_id) FILTER (ended = 'finished'), 0) AS completed, CASE WHEN count(*) FILTER (ended = 'finished') = 0 THEN 0 WHEN workflow_id % 6 = 4 THEN 1 ELSE 1000 END AS total FROM jj GROUP BY workflow_id, run_id),
r AS (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY run_start DESC, run_id DESC) = 1 AS latest, row_number() OVER (PARTITION BY workflow_id ORDER BY run_start DESC, run_id DESC) = 1 AND workflow_id % 7 <> 0 AND (workflow_id % 4 = 1 OR 200 * workflow_id < 1800) AS live FROM q),
fin AS (SELECT * FROM jj WHERE ended = 'finished'),
known AS (SELECT workflow_id, rule, end_time, max(threads) AS t FROM fin WHERE threads IS NOT NULL GROUP BY ALL),
one AS (SELECT workflow_id, run_start, max(run_id) AS run_id FROM r GROUP BY ALL),
meta AS (SELECT o.workflow_id, o.run_id, 'metadata' AS source, f.rule, f.end_time, NULL AS threads FROM fin f ASOF JOIN one o ON f.workflow_id = o.workflow_id AND f.end_time >= o.run_start WHERE f.workflow_id % 5 <> 0 AND f.flag <> 'N'),
done AS (SELECT * FROM meta UNION ALL SELECT workflow_id, run_id, 'log', rule, end_time, threads FROM fin WHERE NOT EXISTS (SELECT 1 FROM meta m WHERE m.workflow_id = fin.workflow_id AND m.run_id = fin.run_id)),
dn AS (SELECT d.workflow_id, d.run_id, any_value(source) AS source, count(*) AS n, count(coalesce(d.threads, k.t)) AS t FROM done d LEFT JOIN known k ON k.workflow_id = d.workflow_id AND k.rule = d.rule AND k.end_time = d.end_time GROUP BY ALL),
mk AS (SELECT r.workflow_id, r.run_id, count(*) AS n FROM r JOIN jj j ON j.workflow_id = r.workflow_id AND j.ended = 'running' AND j.workflow_id % 2 = 0 AND j.start_time >= r.run_start WHERE latest AND NOT live GROUP BY ALL),
w AS (SELECT r.*, CASE WHEN live THEN open ELSE 0 END AS n_running, coalesce(mk.n, 0) AS n_incomplete, coalesce(dn.n, 0) AS n_completions, coalesce(dn.t, 0) AS n_with_threads, source FROM r LEFT JOIN mk USING (workflow_id, run_id) LEFT JOIN dn USING (workflow_id, run_id))"""


@query("d08_whole_snapshot", "SELECT workflow_id, run_id, CAST(completed AS INTEGER) AS completed, CAST(total AS INTEGER) AS total, run_start, latest, live, n_running, n_failed, n_incomplete, n_completions, n_with_threads, source, CASE WHEN n_running > 0 THEN 'running' WHEN n_failed > 0 THEN 'failed' WHEN n_incomplete > 0 THEN 'incomplete' WHEN completed < total AND NOT live THEN 'incomplete' WHEN live THEN 'running' ELSE 'completed' END AS status FROM w", _WHOLE)
def whole_snapshot(spark, d):
    """Some workflows' logs have no errors, some are done, some have locks, fresh logs or markers, and some metadata."""
    j = stored(A.numbered(spark, d).select(*RUN, "job_id", "rule", "start_time", "end_time", "threads", "wildcards", "ended"), "jobs")
    w = F.col("workflow_id")
    lines = A.log_lines_of(j).where(~((w % 3 == 1) & F.startswith("line", F.lit("Error in rule"))))
    lines = lines.withColumn("line", F.when(w % 6 == 4, F.replace("line", F.lit("of 1000 steps"), F.lit("of 1 steps"))).otherwise(F.col("line")))
    locks = j.select("workflow_id").distinct().select("workflow_id", (w % 7 != 0).alias("has_locks"), (w % 4 == 1).alias("has_incomplete"), (F.lit(AS_OF) - 200 * w).alias("log_mtime"))
    markers = j.where("ended = 'running' and workflow_id % 2 = 0").select("workflow_id", "start_time")
    metadata = j.where("ended = 'finished' and workflow_id % 5 <> 0").where(F.col("wildcards")["flag"] != "N").select("workflow_id", "rule", "start_time", "end_time")
    return R.whole_snapshot(lines, locks, markers, metadata, AS_OF, L.WHOLE_RUNS).drop("cores")
