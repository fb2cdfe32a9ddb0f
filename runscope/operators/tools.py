"""Progress of tools from their logs: tool_logs(job_id, rule, content), evaluated once a row.

An extractor is a name, a test on (rule, content) and a column of progress. Built-in
ones come first, in fixed order; users add Column expressions, or a pandas function
for what those cannot express.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

API_VERSION = 1
PROGRESS = "struct<done:bigint,total:bigint,unit:string,percent:double>"


@dataclass(frozen=True)
class Extractor:
    name: str
    accepts: Callable[[Column, Column], Column]
    extract: Callable[[Column], Column]
    api_version: int = API_VERSION


def _numbers(content: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(pattern), group), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long"))


def _out(done: Column, unit: str, total: Column | None = None, percent: Column | None = None) -> Column:
    null = F.lit(None)
    return F.when(done.isNotNull() if percent is None else done.isNotNull() | percent.isNotNull(), F.struct(done.cast("long").alias("done"), (null if total is None else total).cast("long").alias("total"), F.lit(unit).alias("unit"), (null if percent is None else percent).cast("double").alias("percent")))


def _last(x: Column) -> Column:
    return F.try_element_at(x, F.lit(-1))


def _sum(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))


def _named(*names: str) -> Callable[[Column], Column]:
    def test(rule: Column) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.contains(F.lower(rule), F.lit(n))
        return out

    return test


def _bwa(c: Column) -> Column:
    return _out(F.coalesce(_sum(_numbers(c, r"Processed (\d+) reads")), _sum(_numbers(c, r"read (\d+) sequences"))), "reads")


def _samtools_sort(c: Column) -> Column:
    return _out(F.array_max(_numbers(c, r"read (\d+) records")), "records")


def _fastp(c: Column) -> Column:
    percent = _last(F.transform(F.regexp_extract_all(c, F.lit(r"Processing (\d+(?:\.\d+)?)%"), 1), lambda x: x.cast("double")))
    total, passed = _last(_numbers(c, r"total reads: (\d+)")), _last(_numbers(c, r"reads passed filter: (\d+)"))
    return F.when(percent.isNotNull(), _out(percent.cast("long"), "percent", F.lit(100), percent)).when(passed.isNotNull() & total.isNotNull(), _out(passed, "reads", total)).otherwise(_out(total, "reads"))


def _fgbio(c: Column) -> Column:
    # fixed values: what the tool writes
    patterns = [(r"[Pp]rocessed ([\d,]+) records", "records"), (r"[Pp]rocessed ([\d,]+) reads", "reads"), (r"[Rr]ead ([\d,]+) records", "records"), (r"[Ww]rote ([\d,]+) records", "records"), (r"([\d,]+) templates", "templates")]
    rows = F.array_compact(F.array(*[F.when(F.size(_numbers(c, p)) > 0, F.struct(_last(_numbers(c, p)).alias("n"), F.lit(-i).alias("i"), F.lit(u).alias("u"))) for i, (p, u) in enumerate(patterns)]))
    best = F.array_max(rows)
    return F.when(best.isNotNull(), F.struct(best["n"].alias("done"), F.lit(None).cast("long").alias("total"), best["u"].alias("unit"), F.lit(None).cast("double").alias("percent")))


def _star(c: Column) -> Column:
    return _out(F.coalesce(_last(_numbers(c, r"Finished (\d+) reads")), _last(_numbers(c, r"(\d+) reads processed"))), "reads")


def _either(names: tuple[str, ...], *marks: str) -> Callable[[Column, Column], Column]:
    def test(rule: Column, content: Column) -> Column:
        out = _named(*names)(rule)
        for m in marks:
            out = out | F.contains(content, F.lit(m))
        return out

    return test


BUILT_IN = (
    Extractor("bwa", _either(("bwa",), "[M::bwa_idx", "[M::mem_"), _bwa),
    Extractor("samtools_sort", lambda r, c: (F.contains(F.lower(r), F.lit("samtools")) & F.contains(F.lower(r), F.lit("sort"))) | F.contains(c, F.lit("[bam_sort_core]")), _samtools_sort),
    Extractor("samtools_index", lambda r, c: F.contains(F.lower(r), F.lit("samtools")) & F.contains(F.lower(r), F.lit("index")), lambda c: F.lit(None).cast(PROGRESS)),
    Extractor("fastp", _either(("fastp",), "fastp v"), _fastp),
    Extractor("fgbio", _either(("fgbio",), "fgbio"), _fgbio),
    Extractor("star", _either(("star",), "STAR version"), _star),
)


def detect(rule: Column, content: Column, extractors: tuple[Extractor, ...] = BUILT_IN) -> Column:
    return F.coalesce(*[F.when(x.accepts(rule, content), F.lit(x.name)) for x in extractors])


def percent_of(p: Column) -> Column:
    return F.coalesce(p["percent"], F.when(p["total"] > 0, F.least(F.lit(100.0), p["done"] / p["total"] * 100)))


def progress_text(p: Column) -> Column:
    done = F.format_number(p["done"], 0)
    return F.when(p["total"].isNotNull(), F.concat(done, F.lit("/"), F.format_number(p["total"], 0), F.lit(" "), p["unit"])).otherwise(F.concat(done, F.lit(" "), p["unit"]))


def percent_label(p: Column) -> Column:
    x = percent_of(p)
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x)).otherwise("?")


def tool_progress(logs: DataFrame, own: tuple[Extractor, ...] = ()) -> DataFrame:
    """The first extractor that accepts (rule, content) decides; missing logs and no match are null."""
    usable = (*BUILT_IN, *[x for x in own if x.api_version == API_VERSION])
    r, c = F.coalesce("rule", F.lit("")), F.col("content")
    out = logs.withColumn("tool", F.when(c.isNotNull(), detect(r, c, usable)))
    got = F.coalesce(*[F.when(F.col("tool") == x.name, x.extract(c)) for x in usable])
    return out.withColumn("progress", got)


def python_extractor(parse: Callable[[str, str], tuple[int, int | None, str] | None]) -> Callable:
    """A pandas function for arbitrary Python; a failing parse is no progress."""

    @F.pandas_udf(PROGRESS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(rule: str, content: str) -> tuple:
            try:
                got = parse(rule, content)
            except Exception:
                got = None
            return (None, None, None, None) if got is None else (*got, None)

        for rule, content in parts:
            yield pd.DataFrame([one(a, b) for a, b in zip(rule, content, strict=True)], columns=["done", "total", "unit", "percent"])

    return run
