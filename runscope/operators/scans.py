"""Running counts and last known values over ordered rows, in two levels, so that a long group is many tasks.

A group (a run, a workflow, a file) is cut into chunks of neighbouring rows. Each chunk is scanned for itself; what
it ends with is one row, its running values at its last row; these few rows are scanned in chunk order and tell each chunk what
came before it. Nothing sorts a whole group in one task but the table of its chunks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, CHUNK, HASH = "key_", "chunk_", "hash_"
GROUP = [HASH, KEY, CHUNK]  # the hash is the first column to sort by: one number tells nearly all chunks apart


def in_chunks(rows: DataFrame, by: list[str], order: list[str], chunk: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with GROUP (`by` is in the struct KEY only) and the running values of their own chunk, and what came before each chunk: GROUP and the values with the suffix _before.

    For readers that reduce the rows of a chunk before they add what came before it.
    """
    sums, lasts, maxima = sums or {}, lasts or {}, maxima or {}
    # a struct is never null, so the join below adds no filter to one reader only, and null keys meet
    rows = rows.withColumns({KEY: F.struct(*by), CHUNK: F.coalesce(chunk.cast("long"), F.lit(-(2**62)))})
    rows = rows.withColumn(HASH, F.xxhash64(KEY, CHUNK)).drop(*by).repartition(*GROUP)
    # what a chunk ends with is one aggregate of the shuffled rows; its list asks for all columns, so that it shares their shuffle, but is of
    # no row that there is. A list makes it an aggregate by hash, without a sort, of the few chunks of a task
    at = F.struct(*order)
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct"))]
    every = F.collect_list(F.when(reduce(and_, [F.col(c).cast("string").eqNullSafe("\0") for c in sorted(plain, key=lambda c: c in (*order, HASH, CHUNK))]), F.lit(1))).alias("every_")
    nested = [c for c, kind in rows.dtypes if kind.startswith(("array", "struct")) and c != KEY]
    every = [every] if not nested else [every, F.max(F.hash(*nested) % 1).alias("nested_")]
    ends = {k: F.coalesce(F.sum(v), F.lit(0)) for k, v in sums.items()}
    ends |= {k: F.max_by(v, F.when(v.isNotNull(), at)) for k, v in lasts.items()} | {k: F.max(v) for k, v in maxima.items()}
    ends = rows.groupBy(*GROUP).agg(*every, *[c.alias(k) for k, c in ends.items()]).where("size(every_) >= 0" + (" and nested_ >= 0" if nested else ""))
    inside = Window.partitionBy(*GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = {k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}
    local |= {k: F.last(v, True).over(inside) for k, v in lasts.items()} | {k: F.max(v).over(inside) for k, v in maxima.items()}
    before = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    prefix = {k: F.coalesce(F.sum(k).over(before), F.lit(0)) for k in sums}
    prefix |= {k: F.last(k, True).over(before) for k in lasts} | {k: F.max(k).over(before) for k in maxima}
    return rows.withColumns(local), ends.select(*GROUP, *[c.alias(f"{k}_before") for k, c in prefix.items()])


def carried(rows: DataFrame, by: list[str], order: list[str], chunk: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Rows with running sums, last known values and running maxima up to each row, in order within `by`.

    chunk is a long that never falls in that order; null is the first chunk. Nulls add nothing to a sum and are no
    last value; a sum without values is 0. Rows that are equal in order come in any order; null is a value like others in `by`.
    """
    sums, lasts, maxima = sums or {}, lasts or {}, maxima or {}
    rows, ends = in_chunks(rows, by, order, chunk, sums, lasts, maxima)
    whole = {k: F.col(k) + F.coalesce(f"{k}_before", F.lit(0)) for k in sums}
    whole |= {k: F.coalesce(k, f"{k}_before") for k in lasts} | {k: F.greatest(k, f"{k}_before") for k in maxima}
    return rows.join(ends, GROUP).withColumns(whole).select(*[F.col(f"{KEY}.{c}").alias(c) for c in by], *[c for c in rows.columns if c not in GROUP])
