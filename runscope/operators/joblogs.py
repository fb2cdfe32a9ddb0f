"""Which log file belongs to a job: names that hold a rule, a job number or a wildcard value, by an inverted index of name parts.

A name is looked up by what it contains, which no equality join finds. So all runs of three letters of the names
(and of one and two, for shorter texts) are an index, every wanted text picks its rarest run of three, joins
on that, and the few names that have it are compared. Texts of up to three letters are themselves keys of the index, where only the
newest file of each key is kept, so a frequent one doesn't multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AT = ["workflow_id", "area"]


def _parts(text: Column, n: int) -> Column:
    """All different runs of n letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def _newest() -> list[Column]:
    return [F.max(F.struct("mtime", "path")).alias("file")]


def containing(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(workflow_id, area, text, file): the newest of names(workflow_id, area, name, path, mtime) that contains each text(workflow_id, area, text).

    file is a struct of mtime and path. Texts and names are compared as they are; empty texts and nulls match nothing.
    """
    texts = texts.where("text <> ''").distinct()
    short = F.length("text") <= 3
    # texts that are keys of the index
    sizes = F.concat(*[_parts(F.col("name"), n) for n in (1, 2, 3)])
    keys = names.select(*_AT, "mtime", "path", F.explode(F.array_distinct(sizes)).alias("text")).groupBy(*_AT, "text").agg(*_newest())
    by_key = texts.where(short).join(keys, [*_AT, "text"])
    # longer ones, by their rarest part
    index = names.select(*_AT, "name", "mtime", "path", F.explode(_parts(F.col("name"), 3)).alias("part"))
    often = index.groupBy(*_AT, "part").agg(F.count(F.lit(1)).alias("often"))
    parts = texts.where(~short).select(*_AT, "text", F.explode(_parts(F.col("text"), 3)).alias("part"))
    rarest = parts.join(often, [*_AT, "part"], "left").groupBy(*_AT, "text").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "part")).alias("r"))
    wanted = rarest.where("r.often > 0").select(*_AT, "text", F.col("r.part").alias("part"))
    found = wanted.join(index, [*_AT, "part"]).where(F.contains("name", F.col("text"))).groupBy(*_AT, "text").agg(*_newest())
    return by_key.unionByName(found)


def job_logs(jobs: DataFrame, files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """log_path of jobs(workflow_id, rule, job_id, wildcards): the newest file that one of these finds; jobs without any have no row.

    * metadata(workflow_id, rule, log array): a file that a record of the rule names;
    * files of area runlog whose name contains the rule or ``job`` and the number;
    * files of area joblog (below ``logs/`` or ``log/``) whose name begins with the rule or contains a wildcard value, or that are directly in the rule's folder.
    """
    name = F.element_at(F.split("path", "/"), -1)
    f = files.where(F.col("area").isin("runlog", "joblog")).select(*_AT, "path", "mtime", name.alias("name"))
    key = ["workflow_id", "kind", "text"]
    number = F.concat(F.lit("job"), F.col("job_id").cast("string"))
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    values = F.transform(F.map_values("wildcards"), lambda v: one("value", v))
    asked = F.concat(F.array(*[one(k, F.col("rule")) for k in ("rule", "prefix", "folder", "record")], one("job", number)), F.coalesce(values, F.array().cast("array<struct<kind:string,text:string>>")))
    asks = jobs.select("workflow_id", "rule", "job_id", F.inline(asked)).where("text <> ''")
    texts = asks.select(*key).distinct()

    areas = F.when(F.col("kind").isin("rule", "job"), "runlog").when(F.col("kind") == "value", "joblog")
    inside = containing(texts.select("workflow_id", areas.alias("area"), "text").where("area is not null"), f)
    held = texts.withColumn("area", areas).join(inside, [*_AT, "text"]).select(*key, "file")
    rules = texts.where("kind = 'prefix'")
    # names by their first letters, as many as the shortest rule has at least
    lengths = rules.select("workflow_id", F.length("text").alias("n")).distinct()
    begins = f.where("area = 'joblog'").join(lengths, "workflow_id").where(F.length("name") >= F.col("n")).select("workflow_id", F.expr("left(name, n)").alias("text"), "mtime", "path")
    prefix = rules.join(begins, ["workflow_id", "text"]).groupBy(*key).agg(*_newest())
    folder = f.where("area = 'joblog'").select("workflow_id", F.regexp_extract("path", r"(?:^|/)logs?/([^/]+)/[^/]+$", 1).alias("text"), "mtime", "path")
    folder = texts.where("kind = 'folder'").join(folder, ["workflow_id", "text"]).groupBy(*key).agg(*_newest())
    found = held.unionByName(prefix).unionByName(folder)
    if metadata is not None:
        named = metadata.select("workflow_id", F.col("rule").alias("text"), F.explode("log").alias("path")).distinct()
        record = named.join(files.select("workflow_id", "path", "mtime"), ["workflow_id", "path"]).groupBy("workflow_id", "text").agg(*_newest())
        found = found.unionByName(texts.where("kind = 'record'").join(record, ["workflow_id", "text"]).select(*key, "file"))
    best = asks.join(found, key).groupBy("workflow_id", "rule", "job_id").agg(F.max("file").alias("file"))
    return best.select("workflow_id", "rule", "job_id", F.col("file.path").alias("log_path"))
