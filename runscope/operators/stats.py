"""Timing statistics over samples(rule, duration, end_time, input_size, threads, wildcards, k1..k4).

`by` names the grouping columns, so one implementation serves rules, thread counts,
wildcard values and combinations. Orders are always (end_time, tie key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scalars as S
from .state import frames
from .tables import stored

TIE = ["k1", "k2", "k3", "k4"]
DAY = 86400.0


def _newest(by: list[str]):
    return Window.partitionBy(*by).orderBy(F.desc("end_time"), *[F.desc(c) for c in TIE])


def summary() -> list[Column]:
    d = F.col("duration")
    return [F.count(d).alias("n"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"), F.min(d).alias("min"), F.max(d).alias("max")]


def timing_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation (0 below two), least and largest duration."""
    return samples.groupBy(*by).agg(*summary())


def variation(stats: DataFrame, high: float = 0.5) -> DataFrame:
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0))
    return stats.withColumn("cv", cv).withColumn("high_variance", cv > high)


def index_weighted_mean(samples: DataFrame, by: list[str], half_life: float = DEFAULT.half_life_logs) -> DataFrame:
    """Mean with weight 0.5^(runs ago / half life); the newest is 0 runs ago.

    Samples more than 100 half lives ago weigh less than 1e-28 in all, below the precision of the
    sums, and are not ranked (`newest`). So each task sends its newest ones of a group only, and a group with
    very many samples is no long sort in one task.
    """
    w = F.pow(F.lit(0.5), (F.col("r") - 1) / F.lit(half_life))
    return newest(samples, by, int(100 * half_life)).groupBy(*by).agg((F.sum(F.col("duration") * w) / F.sum(w)).alias("weighted_mean"))


def newest(samples: DataFrame, by: list[str], most: int) -> DataFrame:
    """The newest samples of each group, numbered by r from 1."""
    return samples.select(*by, "duration", "end_time", *TIE).withColumn("r", F.row_number().over(_newest(by))).where(F.col("r") <= most)


def _age_weight(as_of: float, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.lit(as_of) - F.col("end_time")) / F.lit(half_life_days * DAY))


def time_weighted_mean(samples: DataFrame, by: list[str], as_of: float, half_life_days: float = DEFAULT.half_life_days) -> DataFrame:
    """Mean with weight 0.5^(age / half life); the plain mean where all weights vanish."""
    w = _age_weight(as_of, half_life_days)
    total = F.sum(w)
    return samples.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("duration") * w) / total).otherwise(F.avg("duration")).alias("weighted_mean"))


def weighted_mean(samples: DataFrame, by: list[str], strategy: str = "index", as_of: float | None = None) -> DataFrame:
    if strategy == "time" and as_of is not None:
        return time_weighted_mean(samples, by, as_of)
    if strategy not in ("index", "time"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return index_weighted_mean(samples, by)


def _bin(size: Column) -> Column:
    """A number that grows with the size: its ten leading bits and its length in bits."""
    bits = F.greatest(F.length(F.bin(F.greatest(size, F.lit(0)))) - 10, F.lit(0))
    return bits * 512 + F.call_function("shiftright", F.greatest(size, F.lit(0)), bits)


def median_input_size(samples: DataFrame, by: list[str]) -> DataFrame:
    """Of the known sizes; the integer mean, rounded down, of the middle two.

    A histogram of each group tells the bins that the middle sizes are in; only the distinct sizes
    in those are put in order.
    """
    known = samples.where("input_size is not null").select(*by, F.col("input_size").cast("long").alias("x"))
    known = known.withColumn("bin", _bin(F.col("x")))
    w = Window.partitionBy(*by)
    bins = known.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("c", F.sum("n").over(w))
    has = lambda r: f"(upto - n < {r} and {r} <= upto)"
    middle = f"{has('c div 2 + 1')} or {has('(c + 1) div 2')}"
    bins = bins.where(middle).select(*by, "bin", (F.col("upto") - F.col("n")).alias("before"), "c")
    sizes = known.join(bins, [*by, "bin"]).groupBy(*by, "bin", "before", "c", "x").agg(F.count(F.lit(1)).alias("n"))
    # the middle ranks are in one bin or in two that follow each other
    inside, first = F.sum("n").over(w.orderBy("bin", "x")), F.min("before").over(w)
    mid = sizes.withColumn("upto", first + inside).where(middle)
    return mid.groupBy(*by).agg(F.expr("(min(x) + max(x)) div 2").alias("median_size"), F.first("c").alias("sized"))


def size_scaled(samples: DataFrame, by: list[str], size: Column) -> DataFrame:
    """Expected duration at an input size, and how far the scaling is trusted."""
    c = DEFAULT
    base = index_weighted_mean(samples, by).join(median_input_size(samples, by), by, "left")
    ok = (F.coalesce("sized", F.lit(0)) >= c.min_pairs_for_size) & (F.coalesce("median_size", F.lit(0)) > 0)
    ratio = F.least(F.lit(c.size_clamp_high), F.greatest(F.lit(c.size_clamp_low), F.pow(size / F.col("median_size"), F.lit(0.5))))
    return base.select(*by, F.when(ok, F.col("weighted_mean") * ratio).otherwise(F.col("weighted_mean")).alias("expected"), F.when(ok, F.least(F.lit(0.8), F.col("sized") / 10.0)).otherwise(F.lit(0.0)).alias("size_confidence"))


def recency_factor(samples: DataFrame, by: list[str], as_of: float | None = None) -> DataFrame:
    value = F.when(F.count("duration") > 0, 0.9).otherwise(0.5) if as_of is None else F.coalesce(F.least(F.lit(1.0), F.avg(_age_weight(as_of, DEFAULT.half_life_days))), F.lit(0.5))
    return samples.groupBy(*by).agg(value.alias("recency"))


def recent_consistency(samples: DataFrame, by: list[str], as_of: float, days: float = DEFAULT.recent_days) -> DataFrame:
    """max(0.3, 1 - variation) of the last days; 0.5 with fewer than two samples."""
    return samples.groupBy(*by).agg(_consistency(as_of, days).alias("consistency"))


def _consistency(as_of: float, days: float = DEFAULT.recent_days) -> Column:
    d = F.when(F.col("end_time") >= as_of - days * DAY, F.col("duration"))
    mean = F.avg(d)
    return F.when((F.count(d) >= 2) & (mean > 0), F.greatest(F.lit(DEFAULT.consistency_floor), 1 - F.stddev_pop(d) / mean)).otherwise(F.lit(0.5))


def wildcard_samples(samples: DataFrame) -> DataFrame:
    return samples.select("*", F.explode("wildcards").alias("key", "value"))


def predictive_key(samples: DataFrame, least: int = DEFAULT.min_samples, threshold: float = DEFAULT.predictive_threshold) -> DataFrame:
    """The wildcard key of each rule whose values' means differ most, if by enough."""
    per = wildcard_samples(samples).groupBy("rule", "key", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean")).where(F.col("n") >= least)
    score = per.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("values"), (F.var_pop("mean") / F.pow(F.avg("mean"), 2)).alias("ratio")).where((F.col("values") >= 2) & (F.col("ratio") > threshold))
    return score.groupBy("rule").agg(F.max_by("key", F.struct("ratio", "key")).alias("key"), F.max("ratio").alias("ratio"))


def combination_samples(samples: DataFrame) -> DataFrame:
    return samples.withColumn("combo", S.combination_key(F.col("wildcards"), F.col("threads"))).where("combo is not null")


def thread_best_match(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted(rule, threads): the statistics of that thread count, else of all thread counts of the rule."""
    known = samples.where("threads is not null")
    exact = timing_stats(known, ["rule", "threads"]).select("rule", "threads", F.struct("n", "mean", "std").alias("exact"))
    pooled = timing_stats(known, ["rule"]).select("rule", F.struct("n", "mean", "std").alias("pooled"))
    out = wanted.join(exact, ["rule", "threads"], "left").join(pooled, "rule", "left")
    return out.select("rule", "threads", F.coalesce("exact", "pooled").alias("s"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("pooled").isNotNull(), "pooled").otherwise("none").alias("match")).select("rule", "threads", "match", "s.n", "s.mean", "s.std")


def typical_threads(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rule").agg(F.coalesce(F.avg("threads"), F.lit(1.0)).alias("typical_threads"))


def global_mean(samples: DataFrame) -> DataFrame:
    return samples.agg(F.coalesce(F.avg("duration"), F.lit(DEFAULT.default_mean)).alias("global_mean"))


LEVEL = ["rule", "level", "name", "key"]
STATE = ["n", "total", "m2", "min", "max"]


def state() -> list[Column]:
    """Aggregates that `merged` can put together: count, sum, sum of squared deviations, least and largest duration."""
    d = F.col("duration")
    return [F.count(d).alias("n"), F.sum(d).alias("total"), (F.var_pop(d) * F.count(d)).alias("m2"), F.min(d).alias("min"), F.max(d).alias("max")]


def merged(states: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """States of groups as one state of what is equal in `by`, with mean and std as in `summary`; more are further aggregates."""
    w = Window.partitionBy(*by)
    mean = F.sum("total").over(w) / F.sum("n").over(w)
    own = F.col("total") / F.col("n")
    off = F.col("m2") + F.col("n") * (own - mean) * (own - mean)
    n = F.sum("n")
    return states.withColumn("m2", F.when(F.col("n") > 0, off)).groupBy(*by).agg(
        n.alias("n"), F.sum("total").alias("total"), F.sum("m2").alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.coalesce(F.sum("total") / n, F.lit(0.0)).alias("mean"), F.coalesce(F.sqrt(F.sum("m2") / F.nullif(n - 1, F.lit(0))), F.lit(0.0)).alias("std"), *more,
    )


def timing_state(samples: DataFrame, by: list[str], half_life: float = DEFAULT.half_life_logs) -> DataFrame:
    """What a profile keeps of each group: its state and its newest samples, as many as weigh in an index-weighted mean."""
    last = newest(samples, by, int(100 * half_life)).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("end_time", *TIE, "duration")), False).alias("newest"))
    return samples.groupBy(*by).agg(*state()).join(last, by, "left")


def merge_states(a: DataFrame, b: DataFrame, by: list[str], half_life: float = DEFAULT.half_life_logs) -> DataFrame:
    """The state of both together, from a row a group of each; no raw sample but the newest is read."""
    both = a.select(*by, *STATE, "newest").unionByName(b.select(*by, *STATE, "newest"))
    last = newest(both.select(*by, F.inline("newest")), by, int(100 * half_life))
    last = last.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("end_time", *TIE, "duration")), False).alias("newest"))
    return merged(both, by).select(*by, *STATE).join(last, by, "left")


def state_stats(states: DataFrame, half_life: float = DEFAULT.half_life_logs) -> DataFrame:
    """n, mean, std, min, max and weighted_mean of each state."""
    zero, n = F.lit(0.0), F.col("n")
    weight = lambda i: F.pow(F.lit(0.5), i / F.lit(half_life))
    total = lambda f: F.aggregate(F.transform("newest", f), zero, lambda s, x: s + x)
    mean = total(lambda x, i: x["duration"] * weight(i)) / total(lambda x, i: weight(i))
    keys = [c for c in states.columns if c not in (*STATE, "newest")]
    std = F.coalesce(F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0))), zero)
    return states.select(*keys, "n", F.coalesce(F.col("total") / n, zero).alias("mean"), std.alias("std"), "min", "max", mean.alias("weighted_mean"))


def _level_keys() -> Column:
    """(level, name, key) of every group that a kind of sample, what(rule, threads, entries), counts in: its rule, its threads and all known threads, each wildcard value, its combination."""
    kind = "array<struct<level:string,name:string,key:string>>"
    one = lambda level, key, name="": F.array(F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"), key.alias("key")))
    none, threads = F.array().cast(kind), F.col("what.threads")
    combo = S.combination_key(F.map_from_entries("what.entries"), threads)
    values = F.transform("what.entries", lambda e: F.struct(F.lit("wildcard").alias("level"), e["key"].alias("name"), e["value"].alias("key")))
    return F.concat(
        one("rule", F.lit("")),
        F.when(threads.isNotNull(), F.concat(one("pooled", F.lit("")), one("threads", threads.cast("string")))).otherwise(none),
        F.coalesce(values, none),
        one("combination", combo),
    )


def what() -> Column:
    """The kind of a sample or job: all that estimates know of it but its input size."""
    return F.struct("rule", "threads", S.canonical(F.col("wildcards")).alias("entries")).alias("what")


def _by_level(kinds: DataFrame) -> DataFrame:
    """Rows of kinds for each of their levels: rule, level, name, key besides."""
    return kinds.select("*", F.inline(_level_keys())).where("key is not null").withColumn("rule", F.col("what.rule"))


def levels(samples: DataFrame) -> DataFrame:
    """All four levels of statistics: rule, threads, each wildcard value, combination. Samples are grouped by their kind once; levels are put together from kinds."""
    rows = _by_level(samples.select(what(), "duration").groupBy("what").agg(*state())).where("level <> 'pooled'")
    key = F.when(F.col("level") == "wildcard", F.concat("name", F.lit("="), "key")).otherwise(F.col("key"))
    return merged(rows.withColumn("key", key), ["rule", "level", "key"]).select("rule", "level", "key", "n", "mean", "std", "min", "max")


def level_table(samples: DataFrame, as_of: float | None = None, strategy: str = "index") -> DataFrame:
    """What estimates look up, a row a (rule, level, name, key): n, total, mean, std, min, max, weighted_mean; of rules also typical
    threads, recency, consistency before as_of, median_size and sized.

    Samples are grouped by kind and month, and levels are put together from kinds. Counts by month tell from when on a level
    has the newest samples that weigh in its mean, and only those are ranked. Four tables are written, each of the size of kinds or levels.
    """
    if strategy not in ("index", "time"):
        raise ValueError(f"unknown strategy {strategy!r}")
    of_time = strategy == "time" and as_of is not None
    recent = F.when(F.col("end_time") >= (as_of or 0.0) - DEFAULT.recent_days * DAY, F.col("duration"))
    weight = _age_weight(as_of or 0.0, DEFAULT.half_life_days)
    more = [F.count(recent).alias("r_n"), F.sum(recent).alias("r_total"), (F.var_pop(recent) * F.count(recent)).alias("r_m2"), F.sum(weight).alias("weight"), F.sum(F.col("duration") * weight).alias("weighed")]
    month = F.floor(F.col("end_time") / (32 * DAY))
    kinds = stored(samples.select(what(), "duration", "end_time", month.alias("month")).groupBy("what", "month").agg(*state(), *more), "kinds")
    sums = ["r_n", "r_total", "weight", "weighed"]
    r_mean = F.sum("r_total").over(Window.partitionBy("what")) / F.sum("r_n").over(Window.partitionBy("what"))
    off = F.col("r_m2") + F.col("r_n") * F.pow(F.col("r_total") / F.col("r_n") - r_mean, 2)
    rows = _by_level(merged(kinds.withColumn("r_m2", F.when(F.col("r_n") > 0, off)), ["what"], *[F.sum(x).alias(x) for x in [*sums, "r_m2"]]).drop("mean", "std"))

    threads = F.when(F.col("what.threads").isNotNull(), F.col("n"))
    typical = F.coalesce(F.sum(F.col("what.threads") * threads) / F.sum(threads), F.lit(1.0)).alias("typical_threads")
    recency = F.when(F.sum("n") > 0, 0.9).otherwise(0.5).alias("recency")
    by_age = F.coalesce(F.sum("weighed") / F.nullif(F.sum("weight"), F.lit(0.0)), F.sum("total") / F.sum("n")).alias("weighted_mean")
    out = merged(rows, LEVEL, typical, recency, *([by_age] if of_time else [])).withColumn("id", F.monotonically_increasing_id())
    late = rows.where("level = 'rule' and r_n > 0").select("rule", "level", *[F.col(f"r_{x}").alias(x) for x in ("n", "total", "m2")], F.lit(None).alias("min"), F.lit(None).alias("max"))
    late = merged(late, ["rule", "level"]).where("n >= 2 and mean > 0").select("rule", "level", F.greatest(F.lit(DEFAULT.consistency_floor), 1 - F.sqrt(F.col("m2") / F.col("n")) / F.col("mean")).alias("consistency"))
    sizes = median_input_size(samples, ["rule"]).withColumn("level", F.lit("rule"))
    out = out.join(late, ["rule", "level"], "left").join(sizes, ["rule", "level"], "left")
    out = stored(out.withColumn("consistency", F.coalesce("consistency", F.lit(0.5))), "levels")
    if of_time:
        return out.drop("id", "m2")
    # by number of level, so that nothing but numbers is sorted
    half_life = DEFAULT.half_life_logs
    of_level = stored(rows.join(out.select(*LEVEL, "id"), LEVEL).select("what", "id"), "level-ids")  # a few levels a kind
    months = kinds.join(of_level, "what").groupBy("id", "month").agg(F.sum("n").alias("n"))
    after = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc_nulls_last("month"))) - F.col("n")
    since = months.withColumn("after", after).where(F.col("after") < int(100 * half_life)).groupBy("id").agg(F.min(F.coalesce("month", F.lit(-(2**62)))).alias("since"))
    # since when a level ranks is told with the levels of a kind: samples too old are gone before a row a level is made or sent
    starts = stored(of_level.join(since, "id").groupBy("what").agg(F.collect_list(F.struct("id", "since")).alias("starts")), "level-starts")
    each = samples.select(what(), "duration", "end_time", *TIE, F.coalesce(month, F.lit(-(2**62))).alias("month")).join(starts, "what")
    each = each.select(F.explode(F.filter("starts", lambda s: s["since"] <= F.col("month"))).alias("s"), "duration", "end_time", *TIE).select("s.id", "duration", "end_time", *TIE)
    return out.join(index_weighted_mean(each, ["id"], half_life), "id", "left").drop("id", "m2")


def predictive_names(levels: DataFrame, least: int = DEFAULT.min_samples, threshold: float = DEFAULT.predictive_threshold) -> DataFrame:
    """`predictive_key` from a table of levels."""
    per = levels.where((F.col("level") == "wildcard") & (F.col("n") >= least)).groupBy("rule", "name")
    score = per.agg(F.count(F.lit(1)).alias("values"), (F.var_pop("mean") / F.pow(F.avg("mean"), 2)).alias("ratio"))
    score = score.where((F.col("values") >= 2) & (F.col("ratio") > threshold))
    return score.groupBy("rule").agg(F.max_by("name", F.struct("ratio", "name")).alias("name"))


def code_hash_rules(records: DataFrame) -> DataFrame:
    """code_hash -> rules, of records(rule, code)."""
    return records.select("rule", S.code_hash(F.col("code")).alias("code_hash")).where("code_hash is not null").groupBy("code_hash").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def totals(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("rule").alias("n_rules"))


def profile(samples: DataFrame) -> DataFrame:
    """Summary of each rule with its raw samples in time order. The arrays are an export format: one row a rule."""
    raw = F.array_sort(F.collect_list(F.struct("end_time", *TIE, "duration")))
    return samples.groupBy("rule").agg(F.count(F.lit(1)).alias("sample_count"), F.avg("duration").alias("mean_duration"), F.coalesce(F.stddev_samp("duration"), F.lit(0.0)).alias("std_dev"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), raw.alias("raw")).select("rule", "sample_count", "mean_duration", "std_dev", "min_duration", "max_duration", F.transform("raw", lambda x: x["duration"]).alias("durations"), F.transform("raw", lambda x: x["end_time"]).alias("timestamps"))


def profile_samples(profiles: DataFrame) -> DataFrame:
    """A profile's arrays as samples again."""
    return profiles.select("rule", F.posexplode(F.arrays_zip("durations", "timestamps")).alias("k1", "x")).select("rule", F.col("x.durations").alias("duration"), F.col("x.timestamps").alias("end_time"), F.col("k1").cast("long").alias("k1"), *[F.lit(0).cast("long").alias(k) for k in TIE[1:]])


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of the rules; samples of shared rules are put together, sorted and summed up anew."""
    return profile(profile_samples(a).unionByName(profile_samples(b)))


def as_of_run(samples: DataFrame, cutoff: Column, fallback: DataFrame | None = None) -> DataFrame:
    """Statistics from what ended before a cutoff; from `fallback` if nothing did."""
    old = samples.where(F.col("end_time") < cutoff)
    if fallback is not None:
        none = old.limit(1).select(F.lit(1).alias("one"))
        old = old.unionByName(fallback.join(none, F.lit(True), "left_anti"))
    return timing_stats(old, ["rule"])


def before_runs(samples: DataFrame, runs: DataFrame, by: tuple[str, ...] = ("rule",)) -> DataFrame:
    """For every run of runs(workflow_id, run_id, run_start) and group with samples in its time frame: n, mean, std, min, max of
    the workflow's samples from before the run.

    Samples are matched with runs once and added up by run; these states are put together in run order, so nothing
    reads a sample again for each run. Groups without an earlier sample give no row.
    """
    keys = ["workflow_id", *by]
    first = runs.select("workflow_id").distinct().select("workflow_id", F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"), F.lit(-1e12).alias("run_start"))
    starts = runs.select("workflow_id", "run_id", "run_start").unionByName(first)
    framed = frames(samples.select(*keys, "duration", "end_time"), starts)
    framed = framed.groupBy(*keys, F.col("frame_run").alias("run_id"), F.col("frame_start").alias("run_start")).agg(*state())
    w = Window.partitionBy(*keys)
    before = w.orderBy("run_start", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    # squares around the mean of the whole group, so that their differences lose no digits
    mid = F.sum("total").over(w) / F.sum("n").over(w)
    off = F.col("total") / F.col("n") - F.col("mid")
    x = framed.where("n > 0").withColumn("mid", mid).withColumn("s2", F.col("m2") + F.col("n") * off * off)
    sums = {f"b_{c}": F.sum(c).over(before) for c in ("n", "total", "s2")} | {"b_min": F.min("min").over(before), "b_max": F.max("max").over(before)}
    x = x.withColumns(sums).where("b_n > 0")
    mean = F.col("b_total") / F.col("b_n")
    m2 = F.greatest(F.lit(0.0), F.col("b_s2") - F.col("b_n") * (mean - F.col("mid")) * (mean - F.col("mid")))
    std = F.coalesce(F.sqrt(m2 / F.nullif(F.col("b_n") - 1, F.lit(0))), F.lit(0.0))
    return x.select("workflow_id", "run_id", *by, F.col("b_n").alias("n"), mean.alias("mean"), std.alias("std"), F.col("b_min").alias("min"), F.col("b_max").alias("max"))


def only_rules(stats: DataFrame, rules: DataFrame) -> DataFrame:
    return stats.join(rules, "rule", "left_semi")
