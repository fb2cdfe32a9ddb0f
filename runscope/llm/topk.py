"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(256 * x), and the score is their inner product.
Every query is scored against all rows. For each query a histogram of all scores
is refined level by level (bins of 2^16, 2^8 and 1): the tasks count their scores
in the bin that holds the k-th best value, the counts are summed over all tasks,
and the bin that the k-th value falls in is cut finer, until it is one value. Then
scores above it are kept, and ties at it go to the smaller vec_id.

A task reports at most k counts a query: the k-th value of all is no smaller than
the k-th of the task, so counts below that are of no use. Queries are a stated
share of the rows; they go to the tasks in blocks of at most `block_bytes`, each
broadcast for a pass over all rows, and a task scores `TILE` pairs at a time, so no task
and no message depends on how many queries there are, and no pairs are shuffled.

Vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id. Only vectors of equal length score with one another. Rows
that repeat a vec_id are candidates each, and none of them for its own id; a
repeated query counts once, by the smallest of its vectors. With fewer than k
candidates, all are returned; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

K, SCALE, LEVELS, BLOCK_BYTES, EVERY, TILE = 5, 256, (16, 8, 0), 8 << 20, 50, 2 << 20
_NONE = np.iinfo(np.int64).min


def _scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """queries x rows; in floating point where that is exact."""
    if v.size and q.size and float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 2**52:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _tiles(batches, dim: int, queries: int):
    """Ids and vectors of a few rows at a time."""
    rows = max(1, TILE // max(1, queries))
    for b in batches:
        b = b.filter(pc.equal(pc.list_value_length(b.column("v")), dim))
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            flat = pc.list_flatten(part.column("v")).to_numpy(zero_copy_only=False)
            yield part.column("vec_id").to_numpy(), flat.reshape(part.num_rows, dim)


def _counting(shared, k: int, dim: int, shift: int):
    def run(batches):
        ids, q, shift_before, bin_before = shared.value
        best = np.full((len(ids), k), _NONE)
        for vec, v in _tiles(batches, dim, len(ids)):
            s = _scores(v, q)
            out = vec[None, :] == ids[:, None]
            if shift_before is not None:
                out |= (s >> shift_before) != bin_before[:, None]
            s = np.where(out, _NONE, s >> shift)
            best = np.partition(np.concatenate([best, s], axis=1), -k, axis=1)[:, -k:]
        for r in range(len(ids)):
            some = best[r][best[r] != _NONE]
            if len(some):
                bins, n = np.unique(some, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), ids[r])), pa.array(bins), pa.array(n)], ["query_id", "bin", "n"])

    return run


def _keeping(shared, k: int, dim: int):
    def run(batches):
        ids, q, least = shared.value
        kept = [np.zeros(0, np.int64)] * 3
        for vec, v in _tiles(batches, dim, len(ids)):
            s = _scores(v, q)
            r, c = np.nonzero((s >= least[:, None]) & (vec[None, :] != ids[:, None]))
            kept = [np.concatenate(x) for x in zip(kept, (ids[r], vec[c], s[r, c]), strict=True)]
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            kept = [x[order] for x in kept]
            first = np.searchsorted(kept[0], kept[0])
            kept = [x[np.arange(len(x)) - first < k] for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["query_id", "vec_id", "score"])

    return run


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer vector, of the rows that take part."""
    x = F.col(vector_col)
    good = x.isNotNull() & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, every: int = EVERY, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = integers(vectors, id_col, vector_col, scale)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = queries.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    parts = []
    for dim, n in ((r["dim"], r["n"]) for r in sizes):
        blocks = max(1, math.ceil(n * max(dim, 1) * 8 / block_bytes))
        for j in range(blocks):
            own = queries.where((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == j)).collect()
            if own:
                parts.append(_search(rows, own, dim, k))
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, own: list, dim: int, k: int) -> DataFrame:
    """One block of queries, of bounded size, against all rows."""
    share = rows.sparkSession.sparkContext.broadcast
    ids = np.array([r["vec_id"] for r in own], np.int64)
    q = np.array([r["v"] for r in own], np.int64).reshape(len(own), dim)
    order = np.argsort(ids)
    ids, q = ids[order], q[order]
    need, bins, before = np.full(len(ids), k), np.zeros(len(ids), np.int64), None
    all_of = np.zeros(len(ids), bool)  # fewer candidates than k: all are kept
    for shift in LEVELS:
        counts = rows.mapInArrow(_counting(share((ids, q, before, bins)), k, dim, shift), "query_id long, bin long, n long")
        w = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        wanted = rows.sparkSession.createDataFrame(list(zip(ids.tolist(), need.tolist(), strict=True)), "query_id long, need long")
        upto = counts.join(F.broadcast(wanted), "query_id").where("upto - n < need")  # a row a query of this block
        found: dict[int, tuple[int, int, int]] = {}
        for r in upto.groupBy("query_id").agg(F.min_by(F.struct("bin", "n", "upto"), "bin").alias("x")).collect():  # likewise
            found[r["query_id"]] = (r["x"]["bin"], r["x"]["n"], r["x"]["upto"])
        for i, one in enumerate(ids.tolist()):
            b, n, upto_ = found.get(one, (0, 0, 0))
            if upto_ < need[i]:
                all_of[i] = True
            else:
                bins[i], need[i] = b, need[i] - (upto_ - n)
        before = shift
    least = np.where(all_of, _NONE + 1, bins)
    return rows.mapInArrow(_keeping(share((ids, q, least)), k, dim), "query_id long, vec_id long, score long")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
