"""Column expressions over log lines, metadata and report values. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what the runner writes to its log
PROGRESS = r"(\d+) of (\d+) steps \((\d+(?:\.\d+)?)%\) done"
RULE = r"^(?:local)?(?:rule|checkpoint) (\w+):"
JOBID = r"^\s+jobid:\s*(\d+)"
FINISHED = r"Finished (?:job |jobid:\s*)(\d+)"
ERROR = r"Error in rule (\w+):"
TIMESTAMP = r"^\[(\w{3} \w{3} +\d+ \d+:\d+:\d+ \d+)\]"
WILDCARDS = r"^\s+wildcards:\s*(.+)"
THREADS = r"^\s+threads:\s*(\d+)"
LOG = r"^\s+log:\s*(.+)"
CORES = r"Provided cores:\s+(\d+)"


def found(line: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null without one; the pattern is tried once."""
    return F.try_element_at(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), F.lit(1))


def progress(line: Column) -> Column:
    return F.when(line.rlike(PROGRESS), F.struct(F.regexp_extract(line, PROGRESS, 1).try_cast("int").alias("completed"), F.regexp_extract(line, PROGRESS, 2).try_cast("int").alias("total")))


def rule_start(line: Column) -> Column:
    return found(F.ltrim(line), RULE)


def job_id(line: Column) -> Column:
    return found(line, JOBID).try_cast("long")


def finished(line: Column) -> Column:
    return found(line, FINISHED).try_cast("long")


def error_rule(line: Column) -> Column:
    return found(line, ERROR)


def timestamp(line: Column) -> Column:
    """Epoch seconds of a time stamp line in the session zone; invalid dates are null."""
    day = TIMESTAMP.replace(r"(\w{3} ", r"\w{3} (", 1)  # the same without the weekday
    text = F.regexp_replace(found(line, day), " +", " ")
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("MMM d HH:mm:ss yyyy"))).cast("double")


def wildcards(text: Column) -> Column:
    """map of "k=v, k=v": parts without = are left out, the last of equal keys wins."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 0)
    empty = F.create_map().cast("map<string,string>")

    def put(m: Column, p: Column) -> Column:
        key = F.trim(F.substring_index(p, "=", 1))
        return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, F.trim(p.substr(F.instr(p, "=") + 1, F.length(p)))))

    return F.aggregate(parts, empty, put)


def threads(line: Column) -> Column:
    n = found(line, THREADS).try_cast("int")
    return F.when(n > 0, n)


def log_path(line: Column) -> Column:
    return F.trim(F.substring_index(found(line, LOG), " (check log file", 1))


def cores(line: Column) -> Column:
    return found(line, CORES).try_cast("int")


def positive_int(text: Column) -> Column:
    n = F.trim(text).try_cast("int")
    return F.when(n > 0, n)


def non_negative_int(text: Column) -> Column:
    n = F.trim(text).try_cast("int")
    return F.when(n >= 0, n)


def code_hash(code: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the code with white space runs as one space."""
    words = F.filter(F.split(code, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.substring(F.sha2(F.array_join(words, " "), 256), 1, 16))


def canonical(m: Column) -> Column:
    """Entries of a map in order of its keys."""
    return F.sort_array(F.map_entries(m))


def combination_key(m: Column, n: Column) -> Column:
    """Sorted k=v joined by colons, then threads=n; null if empty."""
    pairs = F.coalesce(F.transform(canonical(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), F.array().cast("array<string>"))
    t = F.when(n.isNotNull(), F.array(F.concat(F.lit("threads="), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.nullif(F.array_join(F.concat(pairs, t), ":"), F.lit(""))


def line_type(line: Column) -> Column:
    """One type a line, in fixed precedence."""
    body = F.ltrim(line)
    indented = F.when(line.rlike(RULE.replace("^", r"^\s*")), "rule_start").when(body.startswith("wildcards:"), "wildcards").when(body.startswith("threads:"), "threads").when(body.startswith("log:"), "log_path").when(body.startswith("jobid:"), "jobid").otherwise("none")
    return (
        F.when(line.rlike(TIMESTAMP), "timestamp").when(line.rlike(r"^\s"), indented).when(line.rlike(RULE), "rule_start").when(line.rlike("^" + FINISHED), "job_finished").when(line.rlike(ERROR), "error").when(line.rlike(PROGRESS), "progress").otherwise("none")
    )


def clamped_duration(start: Column, end: Column) -> Column:
    """struct(duration, is_skewed): never negative."""
    return F.struct(F.greatest(F.lit(0.0), end - start).alias("duration"), (end - start < 0).alias("is_skewed"))


def normalised(m: Column) -> Column:
    """Without private keys and opaque objects; empty maps are null."""
    kept = F.map_filter(m, lambda k, v: ~k.startswith("_") & v.isNotNull() & ~v.rlike("^<.* object at"))
    return F.when(F.size(kept) > 0, kept)


# ------------------------------------------------------------------ report texts


def _fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def duration_text(seconds: Column, precision: str = "auto") -> Column:
    """5s, 2m 5s, 3h 4m; negative is 0s, infinite or null is unknown."""
    s = F.floor(seconds).cast("long")
    h, m, sec = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    whole_m = F.floor(s / 60)
    text = {
        "auto": F.when(s < 60, _fmt("%ds", s)).when(s < 3600, F.when(sec == 0, _fmt("%dm", whole_m)).otherwise(_fmt("%dm %ds", whole_m, sec))).otherwise(F.when(m == 0, _fmt("%dh", h)).otherwise(_fmt("%dh %dm", h, m))),
        "seconds": _fmt("%ds", s),
        "minutes": _fmt("%dm", whole_m),
        "hours": _fmt("%dh", h),
    }[precision]
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds == float("inf")), "unknown").when(seconds < 0, "0s").otherwise(text)


def duration_range(low: Column, high: Column) -> Column:
    return F.concat(duration_text(low), F.lit(" - "), duration_text(high))


def _decimals(x: Column, places: int) -> Column:
    """Rounded half to even, as exact decimals."""
    return _fmt(f"%.{places}f", F.bround(x, places))


def size_text(size: Column, binary: bool = True, precision: int = 1) -> Column:
    """B to PB in steps of 1024 or 1000; whole numbers of a unit without decimals, except of PB."""
    step = 1024.0 if binary else 1000.0
    size = size.cast("double")
    out = F.concat(_decimals(size / step**5, precision), F.lit(" PB"))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        x = size / step**power
        text = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(_decimals(x, precision))
        out = F.when(x < step, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return F.when(size.isNull() | (size < 0), "0 B").otherwise(out)


def size_rate_text(bytes_per_second: Column, precision: int = 1) -> Column:
    return F.concat(size_text(bytes_per_second, precision=precision), F.lit("/s"))


def rate_text(items: Column, seconds: Column, unit: str = "items") -> Column:
    return F.when(seconds > 0, F.format_string(f"%.1f {unit}/s", items / seconds)).otherwise(f"0.0 {unit}/s")


def percent_text(x: Column) -> Column:
    """At most 1.0 is a fraction; kept within 0 and 100."""
    p = F.when(x <= 1.0, x * 100).otherwise(x)
    return _fmt("%.1f%%", F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), p)), 1))


def count_text(done: Column, total: Column, compact: bool = False) -> Column:
    if compact:
        return _fmt("%d/%d", done.cast("long"), total.cast("long"))
    text = _fmt("%d of %d", done.cast("long"), total.cast("long"))
    return F.when(total > 0, F.concat(text, F.lit(" ("), _decimals(done / total * 100, 1), F.lit("%)"))).otherwise(text)


def eta_text(seconds: Column, low: Column, high: Column, confidence: Column) -> Column:
    """An estimate at high confidence if its bounds are near or unknown, a range at medium confidence if bounds are known, else a rough estimate."""
    near = F.concat(F.lit("~"), duration_text(seconds))
    bounded = low.isNotNull() & high.isNotNull()
    plain = (confidence > 0.7) & (~bounded | ((seconds > 0) & ((high - low) / seconds < 0.3)))
    rough = F.when(confidence > 0.1, F.concat(near, F.lit(" (rough)"))).otherwise(F.concat(near, F.lit(" (very rough)")))
    text = F.when(plain, near).when((confidence > 0.4) & bounded, duration_range(low, high)).otherwise(rough)
    return F.when(seconds == float("inf"), "unknown").otherwise(text)


def wildcard_text(m: Column, most: int = 50) -> Column:
    text = F.array_join(F.transform(canonical(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def tool_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), done / total * 100))
