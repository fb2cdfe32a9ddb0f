"""Run-log reconstruction over log_lines(workflow_id, run_id, line_no, line).

Lines without a pattern of the runner are dropped before anything is shuffled, and of the
others only extracted values travel. A scan of a run's lines, chunk by chunk, carries the context
forward (`scans.carried`), so a long log is many tasks, and one grouping reduces the run to `facts`: a row for
each rule block, each finish and each error block. The other operators work on facts; they take lines or,
where several of them are needed, the facts that `facts` made once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .scans import GROUP, KEY, carried, in_chunks

RUN = ["workflow_id", "run_id"]
CHUNK_LINES = 1 << 18  # lines of a run that one task takes at a time
WHOLE_RUNS = None  # instead: a run is scanned in one task. Lines whose table is partitioned by run, such as rendered ones, are then not shuffled at all


FIELDS = ("threads", "wildcards", "log")


def parsed(lines: DataFrame, every: bool = False, fields: Sequence[str] = FIELDS, finishes: bool = True) -> DataFrame:
    """What the lines with a pattern hold; with every, other lines stay with nulls. Patterns are tried only on lines with their fixed text.

    Lines of other fields than those asked for are like lines without a pattern, and, if finishes is False, lines that can only be a finish.
    """
    x = F.col("line")
    has = lambda *texts: reduce(or_, [F.contains(x, F.lit(t)) for t in texts])
    values = {
        "rule_start": (has("rule ", "checkpoint "), S.rule_start(x)),
        "job_id": (has("jobid:"), S.job_id(x)),
        "finished": (has("Finished "), S.finished(x)),
        "error_rule": (has("Error in rule "), S.error_rule(x)),
        "ts": (F.startswith(x, F.lit("[")), S.timestamp(x)),
        "wildcards": (has("wildcards:"), S.found(x, S.WILDCARDS)),
        "threads": (has("threads:"), S.threads(x)),
        "log": (has("log:"), S.log_path(x)),
    }
    values = {k: v for k, v in values.items() if k not in FIELDS or k in fields}
    some = lines if every else lines.where(reduce(or_, [ok for k, (ok, _) in values.items() if finishes or k != "finished"]))  # by fixed text: no pattern is tried twice
    return some.select(*RUN, "line_no", *[F.when(ok, v).alias(k) for k, (ok, v) in values.items()])


def _chunk(lines: int) -> Column:
    return F.floor(F.col("line_no") / lines)


def _carry() -> tuple[dict[str, Column], dict[str, Column]]:
    """Running counts and last values of a run's lines."""
    opens = F.col("error_rule").isNotNull()
    closes = F.col("rule_start").isNotNull() | F.col("ts").isNotNull()
    state = F.when(opens, True).when(closes, False)
    number = lambda c: c.isNotNull().cast("long")
    return {"block": number(F.col("rule_start")), "error_block": number(state)}, {"last_ts": F.col("ts"), "rule": F.col("rule_start"), "in_error": state}


def _running(rows: DataFrame, chunk_lines: int | None, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Rows with running counts and last values of their run, in order of lines."""
    if chunk_lines is not None:
        return carried(rows, RUN, ["line_no"], _chunk(chunk_lines), sums, lasts)
    w = Window.partitionBy(*RUN).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in sums.items()} | {k: F.last(v, True).over(w) for k, v in lasts.items()})


def _in_order(lines: DataFrame, chunk_lines: int | None) -> DataFrame:
    """Whole runs are sorted before their lines are parsed: short rows, and once."""
    return lines.sortWithinPartitions(*RUN, "line_no") if chunk_lines is None else lines


def with_context(p: DataFrame, chunk_lines: int | None = CHUNK_LINES) -> DataFrame:
    """Block numbers, the last time stamp and rule so far, and if a line is in an error block."""
    return _running(p, chunk_lines, *_carry()).withColumn("in_error", F.coalesce("in_error", F.lit(False)))


def _plain() -> Column:
    """If the line that began a block is one of its lines."""
    return F.when(F.col("rule_start").isNotNull(), F.col("finished").isNull() & F.col("error_rule").isNull())


def _only_stamp(fields: Sequence[str]) -> Column:
    """A time stamp is in last_ts already; its line says nothing else of a block that a line of the same kind has begun."""
    silent = reduce(and_, [F.col(c).isNull() for c in ("rule_start", "job_id", *fields)])
    return F.coalesce(F.col("plain") & (F.col("kind") == "block") & silent, F.lit(False))


def _first_known(fields: Sequence[str]) -> list[Column]:
    """Aggregates of the lines or pieces of a block, a finish or an error block: of each value the first."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return [F.min("finished").alias("finished"), F.min_by("first", "line_no").alias("first"), *[known(c) for c in ("id", *fields)], F.min("line_no").alias("line_no")]


def _pieces(lines: DataFrame, chunk_lines: int, fields: Sequence[str], finishes: bool) -> DataFrame:
    """kind, block, number and values of each block, finish and error block, a row for each chunk that it has lines in.

    Lines are reduced inside their chunk; what came before the chunk is added to the few rows that are left.
    """
    p = parsed(lines, fields=fields, finishes=finishes)  # a finish tells nothing of other lines
    sums, lasts = _carry()
    lasts["plain"] = _plain()
    p, before = in_chunks(p, RUN, ["line_no"], _chunk(chunk_lines), sums, lasts)
    # in_error is null before the first line of a chunk that tells: such lines go on with what the chunk before was in
    kind = F.when(F.col("finished").isNotNull(), "finished").when(F.col("in_error"), "error").when(F.col("in_error").isNull(), "head").otherwise("block")
    number = F.when(kind == "finished", F.col("line_no")).when(kind == "error", F.col("error_block")).otherwise(0)
    p = p.withColumns({"kind": kind, "number": number}).where(~_only_stamp(fields))
    p = p.withColumns({"first": F.struct("error_rule", "rule", "last_ts"), "id": F.when(F.col("job_id").isNotNull(), F.struct("job_id", "last_ts"))})
    p = p.groupBy(*GROUP, "block", "kind", "number").agg(*_first_known(fields)).join(before, GROUP)
    error = (F.col("kind") == "error") | ((F.col("kind") == "head") & F.coalesce("in_error_before", F.lit(False)))
    block = F.col("block") + F.coalesce("block_before", F.lit(0))
    kind = F.when(F.col("kind") == "finished", "finished").when(error, "error").when(block > 0, "block")
    ts = lambda c: F.coalesce(f"{c}.last_ts", "last_ts_before").alias("last_ts")
    return p.select(
        *[F.col(f"{KEY}.{c}").alias(c) for c in RUN], block.alias("block"), kind.alias("kind"),
        F.when(kind == "finished", F.col("number")).when(error, F.col("number") + F.coalesce("error_block_before", F.lit(0))).otherwise(0).alias("number"),
        F.struct("first.error_rule", F.coalesce("first.rule", "rule_before").alias("rule"), F.when(kind == "finished", ts("first")).alias("last_ts")).alias("first"),  # no other kind asks for that time
        F.when(F.col("id").isNotNull(), F.struct("id.job_id", ts("id"))).alias("id"), "finished", *fields, "line_no",
    )


def _labelled(p: DataFrame) -> DataFrame:
    """Lines with their context: which block, finish or error block they belong to."""
    kind = F.when(F.col("finished").isNotNull(), "finished").when(F.col("in_error"), "error").when(F.col("block") > 0, "block")
    number = F.when(kind == "finished", F.col("line_no")).when(kind == "error", F.col("error_block")).otherwise(F.col("block"))
    return p.withColumns({"kind": kind, "number": number, "first": F.struct("error_rule", "rule", "last_ts"), "id": F.when(F.col("job_id").isNotNull(), F.struct("job_id", "last_ts"))})


def _reduced(p: DataFrame, fields: Sequence[str]) -> DataFrame:
    got = p.groupBy(*RUN, "block", "kind", "number").agg(*_first_known(fields))
    end = F.col("kind") == "finished"
    return got.select(
        *RUN, "kind", "block", F.coalesce("first.error_rule", "first.rule").alias("rule"),
        F.coalesce("finished", "id.job_id").alias("job_id"), *fields,
        F.when(end, F.col("first.last_ts")).otherwise(F.col("id.last_ts")).alias("time"), "line_no",
    )


def facts(lines: DataFrame, chunk_lines: int | None = CHUNK_LINES, fields: Sequence[str] = FIELDS, finishes: bool = True) -> DataFrame:
    """kind (block, finished, error), block (the rule block around it), rule, job_id, threads, wildcards, log, time, line_no.

    Of a block's values the first of each counts; time is the last time stamp before the job id
    of a block and before a finish. Blocks come without a job id, too. Takes lines, or lines with
    their context as a stream has left them. Of threads, wildcards and log only the fields that are asked for are read;
    finishes False leaves out finishes.
    """
    if "kind" in lines.columns:
        return lines if finishes else lines.where("kind <> 'finished'")
    asked = "kind is not null" if finishes else "kind <> 'finished'"
    if "in_error" in lines.columns:
        p = _labelled(lines).where(asked)
    elif chunk_lines is None:
        sums, lasts = _carry()
        p = parsed(_in_order(lines, None), fields=fields, finishes=finishes)
        p = _running(p, None, sums, lasts | {"plain": _plain()}).withColumn("in_error", F.coalesce("in_error", F.lit(False)))
        p = _labelled(p).where(asked)
        return _reduced(p.where(~_only_stamp(fields)), fields)
    else:
        p = _pieces(lines, chunk_lines, fields, finishes).where(asked)
    # by block, so that readers of a block's facts need no other shuffle
    return _reduced(p.repartition(*RUN, "block"), fields)


def _first_of(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*RUN, *by).orderBy(order))
    return rows.withColumn("r", r).where("r = 1").drop("r")


def _latest(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _earliest(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _if_has(text: str, value: Column) -> Column:
    return F.when(F.contains(F.col("line"), F.lit(text)), value)


def _progress() -> Column:
    return _latest(_if_has(" steps (", S.progress(F.col("line"))))


def _started() -> Column:
    return _earliest(F.when(F.startswith(F.col("line"), F.lit("[")), S.timestamp(F.col("line"))))


def _cores() -> Column:
    return _earliest(_if_has("Provided cores:", S.cores(F.col("line"))))


def latest_progress(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*RUN).agg(_progress().alias("p")).select(*RUN, *_counts())


def _counts() -> list[Column]:
    return [F.coalesce("p.completed", F.lit(0)).alias("completed"), F.coalesce("p.total", F.lit(0)).alias("total")]


def overview(lines: DataFrame) -> DataFrame:
    """Progress, start and cores of each run in one grouping."""
    got = lines.groupBy(*RUN).agg(_progress().alias("p"), _started().alias("run_start"), _cores().alias("cores"))
    return got.select(*RUN, *_counts(), "run_start", "cores")


def _given(f: DataFrame) -> list[str]:
    return [c for c in FIELDS if c in f.columns]


def blocks(lines: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per rule block with a job id: rule, job_id, the fields (threads, wildcards, log), start and first line."""
    f = facts(lines, fields=fields, finishes=False).where("kind = 'block' and job_id is not null")
    return f.select(*RUN, "block", "rule", "job_id", *fields, F.col("time").alias("start_time"), "line_no")


def scheduled_jobs(lines: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The first block of every job id."""
    b = blocks(lines, fields)
    b = b if "kind" in lines.columns else b.repartition(*RUN, "job_id")  # sorted once, behind the shuffle
    return _first_of(b, ["job_id"], "block").drop("block")


def job_threads(lines: DataFrame) -> DataFrame:
    return blocks(lines, ("threads",)).where("threads is not null").groupBy(*RUN, "job_id").agg(F.min_by("threads", "block").alias("threads"))


def finished_jobs(lines: DataFrame) -> DataFrame:
    return facts(lines, fields=()).where("kind = 'finished'").select(*RUN, "job_id", F.col("time").alias("end_time"), "rule", "line_no")


def completions_per_rule(lines: DataFrame) -> DataFrame:
    """Finished jobs by the rule of their id's last block, or else the current rule."""
    f = facts(lines, fields=()).where("job_id is not null and kind in ('block', 'finished')")
    last = F.max_by("rule", F.when(F.col("kind") == "block", F.col("block"))).over(Window.partitionBy(*RUN, "job_id"))
    done = f.withColumn("rule", F.coalesce(last, "rule")).where("kind = 'finished'")
    return done.groupBy(*RUN, "rule").agg(F.count(F.lit(1)).alias("completed"))


_FIELDS = ["rule", "threads", "wildcards", "log"]


def completed_jobs(lines: DataFrame) -> DataFrame:
    """As-of match: a finish belongs to the latest start of its job id before it; both times are needed."""
    f = facts(lines).where("job_id is not null and kind in ('block', 'finished')")
    w = Window.partitionBy(*RUN, "job_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("kind") == "block", F.struct("rule", F.col("time").alias("start_time"), *_given(f)))
    got = f.withColumn("s", F.last(start, True).over(w)).where("kind = 'finished' and time is not null and s.start_time is not null")
    got = got.select(*RUN, "job_id", "s", F.col("time").alias("end_time"), "line_no")
    got = _first_of(got.withColumn("line_no", -F.col("line_no")), ["job_id"], "line_no").select(*RUN, "job_id", "s.*", "end_time")
    return got.select(*RUN, "job_id", "rule", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), *_given(f))


def _with_owners(f: DataFrame) -> DataFrame:
    """Error blocks take what they don't say from the rule block around them, if it is of the same rule (own)."""
    own = F.max(F.when(F.col("kind") == "block", F.struct("rule", "job_id", *_given(f)))).over(Window.partitionBy(*RUN, "block"))
    f = f.withColumn("own", F.when(F.col("kind") == "error", own))
    f = f.withColumn("own", F.when(F.col("own.rule") == F.col("rule"), F.col("own")))
    return f.withColumn("job_id", F.coalesce("job_id", "own.job_id"))


def failed_jobs(lines: DataFrame) -> DataFrame:
    """Error blocks; fields inside win over those of the rule block if its rule is the same; the first of equal (rule, job id) stays."""
    err = _with_owners(facts(lines, finishes=False)).where("kind = 'error'")
    given = {"log": F.coalesce("log", "own.log"), "threads": F.col("own.threads"), "wildcards": F.col("own.wildcards")}
    got = err.select(*RUN, "rule", "job_id", *[given[c].alias(c) for c in ("log", "threads", "wildcards") if c in _given(err)], "line_no")
    return _first_of(got, ["rule", "job_id"], "line_no").drop("line_no")


def running_jobs(lines: DataFrame) -> DataFrame:
    """Started, neither finished nor failed; the first start of an id counts.

    The start is the last time stamp before the job id; a log without time stamps has none.
    """
    f = _with_owners(facts(lines)).where("job_id is not null")
    ended = F.max((F.col("kind") != "block").cast("int")).over(Window.partitionBy(*RUN, "job_id"))
    open_ = f.withColumn("ended", ended).where("ended = 0")
    return _first_of(open_, ["job_id"], "block").select(*RUN, "job_id", "rule", *_given(f), F.col("time").alias("start_time"))


def outcomes(lines: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """What became of every job id, in one pass: running and failed count its rows of `running_jobs` and `failed_jobs`, done is its row of
    `completed_jobs` (rule, start_time, the fields, end_time) or null. Jobs without an id are one row."""
    f = _with_owners(facts(lines, fields=fields))
    w = Window.partitionBy(*RUN, "job_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    given = ["rule", "start_time", *_given(f)]
    begun = F.last(F.when(F.col("kind") == "block", F.struct("rule", F.col("time").alias("start_time"), *_given(f))), True).over(w)
    known, error = F.col("job_id").isNotNull(), F.col("kind") == "error"
    done = known & (F.col("kind") == "finished") & F.col("time").isNotNull() & F.col("s.start_time").isNotNull()
    f = f.withColumn("s", begun).withColumn("done", F.when(done, F.struct(*[F.col(f"s.{c}").alias(c) for c in given], F.col("time").alias("end_time"))))
    got = f.groupBy(*RUN, "job_id").agg(
        F.max((F.col("kind") != "block").cast("int")).alias("ended"), F.size(F.collect_set(F.when(error, F.struct("rule")))).cast("long").alias("failed"),
        F.max_by("done", F.when(F.col("done").isNotNull(), F.col("line_no"))).alias("done"),
    )
    return got.select(*RUN, "job_id", (known & (F.col("ended") == 0)).cast("long").alias("running"), "failed", "done")


def outcome_counts(jobs: DataFrame) -> DataFrame:
    """n_running, n_failed and n_completed of each run with `outcomes`."""
    return jobs.groupBy(*RUN).agg(F.sum("running").alias("n_running"), F.sum("failed").alias("n_failed"), F.count("done").alias("n_completed"))


def job_counts(lines: DataFrame) -> DataFrame:
    """n_running, n_failed and n_completed of each run with facts: the rows of `running_jobs`, `failed_jobs` and `completed_jobs`, counted in one pass."""
    return outcome_counts(outcomes(lines))


def lifecycle(lines: DataFrame, chunk_lines: int | None = CHUNK_LINES) -> DataFrame:
    """Every job id of a log: its last start with the fields that its blocks gave first or later, its end and what it is.

    status is failed, completed or running by what the log says last; end_order numbers the
    completed jobs of a run by their end.
    """
    f = facts(lines, chunk_lines).where("job_id is not null")
    last = lambda c, kind: F.max_by(c, F.when((F.col("kind") == kind) & F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    ended = F.col("kind").isin("finished", "error")
    got = f.groupBy(*RUN, "job_id").agg(
        *[last(c, "block") for c in _FIELDS],
        F.max_by("time", F.when(F.col("kind") == "block", F.col("line_no"))).alias("start_time"),
        F.max_by("time", F.when(ended, F.col("line_no"))).alias("end_time"),
        F.max_by("kind", "line_no").alias("last"),
    )
    status = F.when(F.col("last") == "finished", "completed").when(F.col("last") == "error", "failed").otherwise("running")
    got = got.withColumn("status", status).withColumn("end_time", F.when(F.col("last") == "finished", F.col("end_time"))).drop("last")
    done = F.col("status") == "completed"
    if chunk_lines is None:
        got = got.withColumn("end_order", F.sum(done.cast("long")).over(Window.partitionBy(*RUN).orderBy("end_time", "job_id").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        got = carried(got, RUN, ["end_time", "job_id"], F.floor(F.col("end_time") / 3600), sums={"end_order": done.cast("long")})
    return got.withColumn("end_order", F.when(done, F.col("end_order")).cast("int"))


def _stats_rows(lines: DataFrame, chunk_lines: int | None) -> DataFrame:
    """run, rule and last word of the rows of each run's job statistics tables, without their totals.

    A table goes from its title to the first blank line after its two head lines. Rows have two words or more.
    """
    text = F.trim("line")
    head = text.startswith("-") | (text.startswith("job") & F.contains(text, F.lit("count")))
    kind = F.when(text == "Job stats:", "title").when(text == "", "blank").when(~F.startswith("line", F.lit(" ")) & ~head & text.rlike(r"\s"), "row")
    x = _in_order(lines, chunk_lines).select(*RUN, "line_no", kind.alias("kind"), F.when(kind == "row", text).alias("text")).where("kind is not null")
    at = lambda k: F.when(F.col("kind") == k, F.col("line_no"))
    x = _running(x, chunk_lines, {}, {"head": at("title"), "blank": at("blank")})
    # the last blank line so far is the one that tells: if it is before the end of the head lines, all are
    x = x.where("kind = 'row' and head is not null and (blank is null or blank <= head + 2)")
    words = F.split("text", r"\s+")
    # as a generator, so that no filter on words makes all lines of the log be split before it is known which are rows
    x = x.select(*RUN, F.inline(F.array(F.struct(words[0].alias("rule"), F.element_at(words, -1).alias("last")))))
    return x.where("rule <> 'total'")


def expected_rules(lines: DataFrame, chunk_lines: int | None = CHUNK_LINES) -> DataFrame:
    """The rules of the job statistics table, whatever stands as their count."""
    return _stats_rows(lines, chunk_lines).select(*RUN, "rule").distinct()


def expected_counts(lines: DataFrame, chunk_lines: int | None = CHUNK_LINES) -> DataFrame:
    """The rules and counts of the job statistics table; rows whose last word is no integer are left out."""
    x = _stats_rows(lines, chunk_lines)
    return x.select(*RUN, "rule", F.col("last").try_cast("int").alias("expected")).where("expected is not null")


def provided_cores(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*RUN).agg(_cores().alias("cores"))


def run_start(lines: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    out = lines.groupBy(*RUN).agg(_started().alias("run_start"))
    if fallback is None:
        return out
    return out.join(fallback.select(*RUN, F.col("ctime")), RUN, "left").select(*RUN, F.coalesce("run_start", "ctime").alias("run_start"))


def side_by_side(*tables: DataFrame) -> DataFrame:
    """One row a run of tables that have one at most, nulls where a table has none. Unlike a join it puts no filter on one reader of a log only, so that all share their input."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.groupBy(*RUN).agg(*[F.any_value(c, True).alias(c) for c in out.columns if c not in RUN])


def run_plan(lines: DataFrame, chunk_lines: int | None = CHUNK_LINES) -> DataFrame:
    """What a log announces, a row a run: cores, start, expected jobs by rule, and the number of scheduled jobs."""
    counts = expected_counts(lines, chunk_lines).groupBy(*RUN).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "expected")))).alias("expected"),
        F.sum("expected").alias("n_expected"),
    )
    scheduled = scheduled_jobs(lines if chunk_lines else facts(lines, None, (), False), ()).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_scheduled"))
    head = overview(lines).select(*RUN, "cores", "run_start")
    out = side_by_side(head, counts, scheduled)
    return out.withColumn("n_scheduled", F.coalesce("n_scheduled", F.lit(0)))


def pending_jobs(lines: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned jobs (workflow_id, run_id, job_id) that neither run nor ended."""
    return planned.join(_with_owners(facts(lines, fields=())).select(*RUN, "job_id"), [*RUN, "job_id"], "left_anti")


def log_tail(lines: DataFrame, n: int = 500) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("line_no")))
    return lines.withColumn("r", r).where(F.col("r") <= n).drop("r")
