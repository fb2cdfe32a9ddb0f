"""Remaining-time estimation: a prioritised lookup of jobs in one table of statistics, then one aggregate per run.

`stats.level_table` has a row for every group of samples that may tell how long a job takes. A kind of job (rule, threads,
wildcards) has a few candidate keys in it, of which the first that is there counts. The table is written once, since
several steps read it; its size doesn't grow with jobs or samples but with rules and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scalars as S
from . import stats as E
from .scans import carried
from .tables import stored

RUN = ["workflow_id", "run_id"]
M = DEFAULT.multipliers


def scenario_variance(mean: Column, std: Column, n: Column, scenario: str) -> Column:
    """Observed variance above one sample, else (mean x multiplier)^2; a mean of 0 or less counts as 60."""
    m = F.when(mean <= 0, F.lit(DEFAULT.default_mean)).otherwise(mean)
    return F.when(n > 1, std * std).otherwise(F.pow(m * M.get(scenario, M["global"]), 2))


def adjusted_variance(variance: Column, confidence: Column) -> Column:
    return variance * (1 - 0.5 * confidence)


def bounds(estimate: Column, std: Column, sigmas: float = DEFAULT.sigmas) -> list[Column]:
    return [F.greatest(F.lit(0.0), estimate - sigmas * std).alias("lower"), (estimate + sigmas * std).alias("upper")]


def simple_confidence(completed: Column) -> Column:
    return F.least(F.lit(DEFAULT.simple_max_confidence), completed / DEFAULT.simple_confidence_jobs)


def confidence(sample: Column, recency: Column, consistency: Column, coverage: Column) -> Column:
    c = DEFAULT
    return F.least(F.lit(c.max_confidence), c.weight_sample * sample + c.weight_recency * recency + c.weight_consistency * consistency + c.weight_coverage * coverage)


def similar_rules(unknown: DataFrame, known: DataFrame, most: int = DEFAULT.max_rule_distance) -> DataFrame:
    """The nearest known rule of each unknown one: least edit distance, then name.

    Only distinct names meet, never jobs, and only names whose lengths are within
    the distance: the length is the key of an equi-join.
    """
    u, k = unknown.select("rule").distinct(), known.select(F.col("rule").alias("match")).distinct()
    lengths = u.select("rule", F.explode(F.sequence(F.length("rule") - most, F.length("rule") + most)).alias("len"))
    near = lengths.join(k.withColumn("len", F.length("match")), "len").withColumn("distance", F.levenshtein("rule", "match", most)).where("distance >= 0 and rule <> match")
    return near.groupBy("rule").agg(F.min(F.struct("distance", "match")).alias("m")).select("rule", "m.match", "m.distance")


def renamed_rules(records: DataFrame) -> DataFrame:
    """The smallest other rule with the same code hash, of records(rule, code)."""
    h = records.select("rule", S.code_hash(F.col("code")).alias("h")).where("h is not null").distinct()
    two = h.groupBy("h").agg(F.min("rule").alias("first"))
    second = h.join(two, "h").where(F.col("rule") > F.col("first")).groupBy("h").agg(F.min("rule").alias("second"))
    other = h.join(two, "h").join(second, "h", "left").select("rule", F.when(F.col("rule") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("match"))
    return other.where("match is not null").groupBy("rule").agg(F.min("match").alias("match"))


def best_matches(unknown: DataFrame, known: DataFrame, records: DataFrame | None = None) -> DataFrame:
    by_name = similar_rules(unknown, known).select("rule", F.col("match").alias("by_name"))
    out = unknown.select("rule").distinct().join(by_name, "rule", "left")
    if records is None:
        return out.select("rule", F.col("by_name").alias("match"))
    by_code = renamed_rules(records).join(known.select(F.col("rule").alias("match")).distinct(), "match", "left_semi").select("rule", F.col("match").alias("by_code"))
    return out.join(by_code, "rule", "left").select("rule", F.coalesce("by_code", "by_name").alias("match"))


#: The order in which levels are tried, and what a job's estimate is then called.
PRIORITY = ["combination", "threads", "pooled", "wildcard", "rule", "similar"]


def _candidates(conditioning: bool) -> Column:
    """(priority, rule, level, name, key) that a kind of job may be looked up by, from what(rule, threads, entries) and match."""
    rule, threads, entries = F.col("what.rule"), F.col("what.threads"), F.col("what.entries")
    kind = "array<struct<priority:int,of:string,level:string,name:string,key:string>>"

    def one(method: str, level: str, key: Column, of: Column = rule, name: Column | None = None) -> Column:
        name = F.lit("") if name is None else name
        return F.struct(F.lit(PRIORITY.index(method)).alias("priority"), of.alias("of"), F.lit(level).alias("level"), name.alias("name"), key.alias("key"))

    some = lambda ok, *x: F.when(ok, F.array(*x)).otherwise(F.array().cast(kind))
    parts = [some(threads.isNotNull(), one("threads", "threads", threads.cast("string")), one("pooled", "pooled", F.lit(""))), F.array(one("rule", "rule", F.lit("")))]
    parts.append(some(F.col("match").isNotNull(), one("similar", "rule", F.lit(""), F.col("match"))))
    if conditioning:
        combo = S.combination_key(F.map_from_entries("what.entries"), threads)
        parts.append(some(combo.isNotNull(), one("combination", "combination", combo)))
        parts.append(F.coalesce(F.transform(entries, lambda e: one("wildcard", "wildcard", e["value"], name=e["key"])), F.array().cast(kind)))
    return F.concat(*parts)


def lookup(kinds: DataFrame, levels: DataFrame, *, conditioning: bool = True, records: DataFrame | None = None) -> DataFrame:
    """found: the first candidate's statistics and its priority, for kinds(what); no row where nothing is known.

    Of wildcard values only those of the rule's most predictive name are there, with enough samples.
    """
    rules = levels.where("level = 'rule'").select("rule")
    unknown = kinds.select("what.rule").distinct().join(rules, "rule", "left_anti")
    match = best_matches(unknown, rules, records).where("match is not null")
    enough = levels.where((F.col("level") == "wildcard") & (F.col("n") >= DEFAULT.min_samples))
    table = levels.where("level <> 'wildcard'").unionByName(enough.join(E.predictive_names(levels), ["rule", "name"], "left_semi"))
    table = table.withColumnRenamed("rule", "of").withColumn("s", F.struct("n", "std", "weighted_mean", "median_size", "sized")).select("of", "level", "name", "key", "s")
    keys = kinds.join(match, F.col("what.rule") == F.col("rule"), "left").select("what", F.inline(_candidates(conditioning)))
    got = keys.join(table, ["of", "level", "name", "key"]).groupBy("what").agg(F.min_by(F.struct("priority", "s"), "priority").alias("found"))
    return got.select("what", "found.priority", "found.s.*")


def _picked() -> Column:
    """expected, variance and method from priority, n, std, weighted_mean, median_size, sized, input_size and global_mean."""
    w, std, n = F.col("weighted_mean"), F.col("std"), F.col("n")
    est = lambda e, v, m: F.struct(e.alias("expected"), v.alias("variance"), F.lit(m).alias("method"))
    is_ = lambda method: F.col("priority") == PRIORITY.index(method)
    few = (F.coalesce("sized", F.lit(0)) < DEFAULT.min_pairs_for_size) | (F.coalesce("median_size", F.lit(0)) <= 0)
    trust = F.when(few, F.lit(0.0)).otherwise(F.least(F.lit(0.8), F.col("sized") / 10.0))
    ratio = F.pow(F.col("input_size") / F.col("median_size"), F.lit(0.5))
    scaled = w * F.least(F.lit(DEFAULT.size_clamp_high), F.greatest(F.lit(DEFAULT.size_clamp_low), ratio))
    by_size = F.coalesce((F.col("input_size") > 0) & (trust > DEFAULT.size_confidence), F.lit(False))
    relaxed = scenario_variance(w, std, F.lit(1), "relaxed_combination")
    g = F.col("global_mean")
    return (
        F.when(is_("combination"), est(w, F.when(n >= DEFAULT.min_samples, scenario_variance(w, std, n, "combination")).otherwise(relaxed), "combination"))
        .when(is_("threads"), est(w, scenario_variance(w, std, n, "exact_thread"), "threads"))
        .when(is_("pooled"), est(w, scenario_variance(w, std, n, "pooled_thread"), "threads"))
        .when(is_("wildcard"), est(w, std * std, "wildcard"))
        .when(is_("rule") & by_size, est(scaled, adjusted_variance(scenario_variance(scaled, std, n, "size_scaled"), trust), "size"))
        .when(is_("rule"), est(w, scenario_variance(w, std, n, "single_sample"), "rule"))
        .when(is_("similar"), est(w, scenario_variance(w, std, n, "fuzzy"), "similar"))
        .otherwise(est(g, scenario_variance(g, g, F.lit(0), "global"), "global"))
    )


def overall_mean(levels: DataFrame) -> DataFrame:
    """The mean of all samples, from the rows of rules."""
    return levels.where("level = 'rule'").agg(F.coalesce(F.sum("total") / F.sum("n"), F.lit(DEFAULT.default_mean)).alias("global_mean"))


def job_estimates(jobs: DataFrame, samples: DataFrame | None = None, *, levels: DataFrame | None = None, conditioning: bool = True, records: DataFrame | None = None, strategy: str = "index", as_of: float | None = None) -> DataFrame:
    """expected, variance and method for jobs(rule, threads, wildcards, input_size, ...): combination, threads, wildcard, rule, similar rule, global mean.

    levels is a `stats.level_table`; without it, one of the samples is written (strategy "time" weighs them by age as of as_of).
    Jobs of one kind are looked up once; conditioning False leaves out combinations and wildcards.
    """
    if levels is None:
        levels = stored(E.level_table(samples, as_of, strategy), "levels")
    j = jobs.select("*", E.what())
    found = lookup(jobs.select(E.what()).distinct(), levels, conditioning=conditioning, records=records)
    j = j.join(found, "what", "left").crossJoin(F.broadcast(overall_mean(levels)))  # one row
    return j.select(*jobs.columns, _picked().alias("x")).select(*jobs.columns, "x.*")


def pending_exact(expected: DataFrame, completed: DataFrame, running: DataFrame) -> DataFrame:
    """Per run and rule: expected - completed - running where positive."""
    keys = [*RUN, "rule"]
    j = expected.join(completed.select(*keys, F.col("n").alias("c")), keys, "left").join(running.select(*keys, F.col("n").alias("r")), keys, "left")
    return j.select(*keys, (F.col("expected") - F.coalesce("c", F.lit(0)) - F.coalesce("r", F.lit(0))).alias("pending")).where("pending > 0")


def pending_proportional(completed: DataFrame, pending: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Shares a run's pending number among rules like its completions (n), rounding half to even.

    current(run, rule), if given, are the rules that a run still has; others get no share.
    """
    if current is not None:
        completed = completed.join(current.select(*RUN, "rule").distinct(), [*RUN, "rule"], "left_semi")
    # multiplied first: n / total is inexact, and would move parts that lie half way between two numbers
    rows = completed.withColumn("total_n", F.sum("n").over(Window.partitionBy(*RUN)))
    part = F.bround(F.col("pending") * F.col("n") / F.col("total_n"))
    return rows.join(pending, RUN).select(*RUN, "rule", part.cast("long").alias("pending")).where("pending > 0")


def pending_per_rule(expected: DataFrame, completed: DataFrame, running: DataFrame, pending: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Exact for runs with expected counts, proportional for others; nothing where nothing is pending."""
    some = pending.where("pending > 0").select(*RUN, "pending")
    exact = pending_exact(expected, completed, running).join(some.select(*RUN), RUN, "left_semi")
    rest = some.join(expected.select(*RUN).distinct(), RUN, "left_anti")
    return exact.unionByName(pending_proportional(completed, rest, current))


def peak_threads(jobs: DataFrame, width: float = 86400.0) -> DataFrame:
    """Largest sum of threads that ran at once, of jobs(start_time, end_time, threads); ends come before starts of the same time.

    Each day (width) of a run is summed up for itself first.
    """
    t = F.coalesce("threads", F.lit(1)).cast("long")
    steps = jobs.select(*RUN, F.inline(F.array(F.struct(F.col("start_time").alias("at"), t.alias("d")), F.struct(F.col("end_time").alias("at"), (-t).alias("d"))))).where("at is not null").groupBy(*RUN, "at").agg(F.sum("d").alias("d"))
    return carried(steps, RUN, ["at"], F.floor(F.col("at") / width), sums={"now": F.col("d")}).groupBy(*RUN).agg(F.max("now").alias("peak"))


def estimated_cores(provided: Column, peak: Column) -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(F.when(provided >= 1, provided.cast("double")), peak.cast("double"), F.lit(1.0)))


def confidence_parts(samples: DataFrame, rules_done: DataFrame, as_of: float, expected: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Per run: sample, recency, consistency and coverage. rules_done: run, rule.

    In runs with expected counts (run, rule, ...) only rules done there count; in others, every
    known rule counts as done, too. runs: all runs to give, by default those of rules_done.
    """
    per = E.timing_stats(samples, ["rule"]).select("rule", "n").join(E.recency_factor(samples, ["rule"]), "rule").join(E.recent_consistency(samples, ["rule"], as_of), "rule")
    rows = rules_done.select(*RUN, "rule").distinct().select("*", F.lit(1).alias("done"))
    if expected is not None:
        rows = rows.unionByName(expected.select(*RUN, "rule", F.lit(1).alias("expected")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("expected", F.lit(None).cast("int"))
    got = rows.join(per, "rule", "left").groupBy(*RUN).agg(*_confidence_counts())
    if runs is None:
        got = got.where("done_rules > 0")
    else:
        got = runs.select(*RUN).distinct().join(got, RUN, "left")
    return got.crossJoin(F.broadcast(_all_rules(per))).select(*RUN, *_confidence_columns())  # one row


def _confidence_counts() -> list[Column]:
    """What a run's confidence needs, from rows (done, expected, n, recency, consistency) by rule."""
    done = F.col("done") > 0
    return [
        F.avg(F.when(done, F.col("recency"))).alias("recency"), F.avg(F.when(done, F.col("consistency"))).alias("consistency"),
        F.count_if(done).alias("done_rules"), F.count_if(done & F.col("n").isNull()).alias("unknown"), F.bool_or(F.col("expected").isNotNull()).alias("planned"),
    ]


def _all_rules(per: DataFrame, *more: Column) -> DataFrame:
    return per.agg(F.least(F.lit(1.0), F.sum("n") / 10.0).alias("sample"), F.count(F.lit(1)).alias("rules"), F.avg("recency").alias("all_recency"), F.avg("consistency").alias("all_consistency"), *more)


def _confidence_columns() -> list[Column]:
    planned, none = F.coalesce("planned", F.lit(False)), F.lit(0)
    pick = lambda c: F.coalesce(F.when(planned, F.col(c)).otherwise(F.col(f"all_{c}")), F.lit(0.5)).alias(c)
    covered = F.when(planned, F.coalesce("done_rules", none)).otherwise(F.col("rules") + F.coalesce("unknown", none))
    return ["sample", pick("recency"), pick("consistency"), (covered / F.greatest(F.lit(1), F.col("rules"))).alias("coverage")]


def _shared_pending(counted: DataFrame, by_rule: DataFrame, rules: DataFrame, current: bool) -> DataFrame:
    """(run, rule, pending) of counted(run, pending, total_n): pending jobs shared like completions and, for other rules, like the history.

    A rule whose part rounds to nothing gets no row. Of the history's rules that a run has not completed only as many, the most
    frequent first, can have a part as there are twice the pending jobs. Those that it has completed may rank before all of them, so
    own_rules more ranks are joined; no run meets all rules.
    """
    part = F.bround(F.col("pending") * (F.col("share") / F.col("total_n"))).cast("long").alias("pending")
    own = by_rule.where("current" if current else "done > 0").join(rules.select("rule", F.col("n").alias("history")), "rule", "left")
    own = own.select(*RUN, "rule", F.coalesce(F.nullif("done", F.lit(0)), "history").alias("share"))
    out = counted.join(own, RUN).select(*RUN, "rule", part)
    if not current:
        order = Window.orderBy(F.desc("n"), "rule")
        ranked = rules.select("rule", F.col("n").alias("share"), F.row_number().over(order).alias("rank"))  # a row a rule
        most = F.least(2 * F.col("pending") + F.col("own_rules"), F.col("rules")).cast("int")
        ranks = counted.where("rules > 0").select("*", F.explode(F.sequence(F.lit(1), most)).alias("rank")).join(ranked, "rank")
        out = out.unionByName(ranks.join(by_rule.where("done > 0").select(*RUN, "rule"), [*RUN, "rule"], "left_anti").select(*RUN, "rule", part))
    return out.where("pending > 0")


def estimate_runs(
    snapshot: DataFrame,
    todo: DataFrame,
    samples: DataFrame | None,
    rules_done: DataFrame,
    as_of: float,
    *,
    levels: DataFrame | None = None,
    records: DataFrame | None = None,
    expected: DataFrame | None = None,
    current: DataFrame | None = None,
    has_history: bool = True,
    strategy: str = "index",
) -> DataFrame:
    """One estimate per run: seconds_remaining, lower, upper, confidence, method.

    snapshot: run, total, completed, elapsed, cores (null: what its running jobs use) and maybe
    pending (by default what is neither completed nor running).
    todo: pending and running jobs of the runs (state, rule, threads, wildcards, input_size,
    elapsed). rules_done: run and rule of every completion. Where a run's pending jobs are not
    all in todo, their number is shared among rules: by expected(run, rule, expected) counts
    if a run has any, else like its completions and, for other rules, like the history;
    current(run, rule), if given, are the rules that a run still has, and others get no share.

    Two tables are written, levels (unless given) and what each run and rule has: jobs, completions and expected counts.
    """
    c, zero = DEFAULT, F.lit(0.0)
    if levels is None:
        levels = stored(E.level_table(samples, as_of, strategy), "levels")
    rules = levels.where("level = 'rule'").select("rule", "n", "std", "weighted_mean", "typical_threads", "recency", "consistency")
    mean = overall_mean(levels)

    j = job_estimates(todo, levels=levels, records=records).join(rules.select("rule", "typical_threads"), "rule", "left")
    t = F.coalesce(F.col("threads").cast("double"), "typical_threads", F.lit(1.0))
    runs, old = F.col("state") == "running", F.coalesce("elapsed", zero)
    left = F.when(runs, F.greatest(zero, F.col("expected") - old)).otherwise(F.col("expected"))
    var = F.col("variance") * t * t
    of = lambda ok, value, name: F.when(ok, value).alias(name)
    work = j.select(
        *RUN, "rule", of(runs, left * t, "r_work"), of(~runs, left * t, "p_work"), of(runs, var, "r_var"), of(~runs, var, "p_var"), of(runs, old * t, "spent"),
        of(runs, F.coalesce(F.col("threads"), F.lit(1)).cast("double"), "peak"), t.alias("t"), (~runs).cast("long").alias("listed"), runs.cast("long").alias("running"),
    )
    sums = ["r_work", "p_work", "r_var", "p_var", "spent", "peak", "t", "listed", "running", "done", "expected"]
    rows = work.unionByName(rules_done.select(*RUN, "rule", F.lit(1).cast("long").alias("done")), allowMissingColumns=True)
    none = F.lit(None).cast("long")
    rows = rows.withColumn("expected", none) if expected is None else rows.unionByName(expected.select(*RUN, "rule", F.col("expected").cast("long").alias("expected")), allowMissingColumns=True)
    rows = rows.withColumn("current", F.lit(False)) if current is None else rows.unionByName(current.select(*RUN, "rule", F.lit(True).alias("current")), allowMissingColumns=True)
    by_rule = stored(rows.groupBy(*RUN, "rule").agg(*[F.sum(x).alias(x) for x in sums], F.coalesce(F.bool_or("current"), F.lit(False)).alias("current")), "by-rule")

    each = by_rule.join(rules, "rule", "left")
    shares = F.col("current") if current is not None else F.col("done") > 0
    own = F.coalesce(F.nullif("done", F.lit(0)), "n")
    per_run = each.groupBy(*RUN).agg(
        *[F.sum(x).alias(x) for x in sums[:-2]], F.count("rule").alias("rows"),
        *_confidence_counts(), F.sum(F.when(shares, own)).alias("own_n"), F.sum(F.when(shares, F.col("n"))).alias("own_history"),
    )
    s = snapshot.join(per_run, RUN, "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("listed", "running")}).withColumnRenamed("t", "threads")
    s = s.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(_all_rules(rules, F.sum("n").alias("history"))))  # one row each
    if "pending" not in snapshot.columns:
        s = s.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("running")))

    # pending jobs by rule where there is no whole list of them
    counted = s.where("not (listed > 0 and listed >= pending) and pending > 0")
    others = F.lit(0) if current is not None else F.coalesce("history", F.lit(0)) - F.coalesce("own_history", F.lit(0))
    exact = counted.where("planned").select(*RUN).join(by_rule.where("expected is not null"), RUN)
    exact = exact.select(*RUN, "rule", (F.col("expected") - F.coalesce("done", F.lit(0)) - F.coalesce("running", F.lit(0))).alias("pending")).where("pending > 0")
    rest = counted.where("planned is null or not planned").select(*RUN, "pending", "rules", F.coalesce("done_rules", F.lit(0)).alias("own_rules"), (F.coalesce("own_n", F.lit(0)) + others).alias("total_n"))
    per_rule = exact.unionByName(_shared_pending(rest, by_rule, rules, current is not None))
    p = per_rule.join(rules, "rule", "left").crossJoin(F.broadcast(mean))
    typical = F.coalesce("typical_threads", F.lit(1.0))
    known = F.coalesce("weighted_mean", "global_mean")
    spread = F.when(F.col("n").isNull(), scenario_variance(known, known, F.lit(0), "global")).otherwise(scenario_variance(known, F.col("std"), F.col("n"), "single_sample"))
    work = p.groupBy(*RUN).agg(F.sum(F.col("pending") * known * typical).alias("c_work"), F.sum(F.col("pending") * spread * typical * typical).alias("c_var"))
    s = s.join(work, RUN, "left")

    s = s.select(*RUN, "total", "completed", "pending", "elapsed", "cores", "peak", "threads", "listed", "spent", "global_mean", *[f"{k}_{x}" for x in ("work", "var") for k in "rpc"], *_confidence_columns())
    cores = estimated_cores(F.col("cores"), F.col("peak"))
    est = lambda m, e, lo, hi, conf: F.struct(F.lit(m).alias("method"), e.alias("seconds_remaining"), lo, hi, conf.alias("confidence"))
    low, high = (lambda x: x.alias("lower")), (lambda x: x.alias("upper"))
    boot = F.col("global_mean") * F.coalesce(F.col("threads"), F.col("total").cast("double")) / cores
    bootstrap = est("bootstrap", boot, low(boot * c.bootstrap_low), high(boot * c.bootstrap_high), F.lit(c.bootstrap_confidence))
    rate = F.col("elapsed") / F.col("completed")
    simple_e = F.when(F.col("threads").isNotNull(), F.greatest(zero, rate * cores * F.col("threads") - F.coalesce("spent", zero)) / cores).otherwise(rate * (F.col("total") - F.col("completed")))
    unsure = F.greatest(F.lit(c.simple_min_uncertainty), 1 - F.col("completed") / F.col("total"))
    simple = est("simple", simple_e, low(simple_e * (1 - unsure)), high(simple_e * (1 + unsure * 2)), simple_confidence(F.col("completed")))
    simple = F.when(F.coalesce("elapsed", zero) <= 0, bootstrap).otherwise(simple)
    whole = (F.col("listed") > 0) & (F.col("listed") >= F.col("pending"))
    both = lambda x: F.coalesce(f"r_{x}", zero) + F.coalesce(F.when(whole, F.col(f"p_{x}")).otherwise(F.col(f"c_{x}")), zero)
    e = both("work") / cores
    sd = F.when(both("var") > 0, F.sqrt(both("var")) / cores).otherwise(e * M["single_sample"])
    conf = confidence(F.coalesce("sample", zero), F.col("recency"), F.col("consistency"), F.coalesce("coverage", zero))
    weighted = est("weighted", e, *bounds(e, sd), conf)
    done_ = (F.col("total") == 0) | (F.col("completed") >= F.col("total"))
    complete = est("complete", zero, low(zero), high(zero), F.lit(1.0))
    pick = F.when(done_, complete).when(F.col("completed") == 0, bootstrap).otherwise(weighted if has_history else simple)
    return s.select(*RUN, pick.alias("x")).select(*RUN, "x.*")


def running_remaining(jobs: DataFrame) -> DataFrame:
    """remaining of running jobs(expected, variance, elapsed, tool_percent): the tool's share wins; overdue within two deviations is 0, beyond two thirds of the elapsed time."""
    p = F.col("tool_percent") / 100
    left = F.col("expected") - F.col("elapsed")
    by_rule = F.when(left >= 0, left).when(-left <= 2 * F.sqrt("variance"), F.lit(0.0)).otherwise(0.67 * F.col("elapsed"))
    return jobs.withColumn("remaining", F.when((p > 0) & (p <= 1), F.col("elapsed") * (1 - p) / p).otherwise(by_rule))


def completion_time(remaining: Column, as_of: float) -> Column:
    return F.lit(as_of) + remaining
