"""Quality selection by importance resampling.

Target text (labelled quality 1) and raw text (all documents) are each modelled as
a bag of hashed word unigrams and bigrams. The weight of a document is its log
likelihood ratio, target over raw, as a mean over its n-grams with `shrink` neutral
ones added, so that a few words alone decide little. Documents are drawn without
replacement in proportion to exp(scale * weight) by Gumbel top-k: key =
scale * weight + Gumbel noise hashed from the id and a seed; the k largest stay. With
the default scale the noise is small beside the weights, so that clean documents stay:
nearly a threshold of the weight. A smaller scale and a given k make it a draw.

The raw counts cover every document. Target counts come from a sample of labelled
rows, the `sample` smallest by hash of the id; half of them (another hash) fit the
target, the other half calibrates: without a given k, k is the number of documents
whose weight reaches the weight that a share `recall` of held-out target documents
reach. Selection finds the k-th key by refining a histogram of all keys; nothing but
histograms of at most 4096 bins, and the last bin if it is small, comes to the driver.

Documents of null or empty text have weight 0. Rows with a null id take part (same
noise for all). Repeated rows have equal keys; all ties at the k-th key stay. Without
any target document all weights are 0 and everything stays. Labels of unknown ids
have no effect; null labels count as no label. An empty table gives no rows. Columns
that documents has besides are passed through by `select_documents`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, texts, written

BUCKETS, SAMPLE, RECALL, SCALE, SHRINK, SEED = 1 << 16, 50_000, 0.9995, 100.0, 20.0, 17
_CELL = 2048


def _features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    w = K.Words(column)
    two, at = w.grams(2)
    own = w.owner()
    return np.concatenate([own, own[at]]), (np.concatenate([w.hash, two]) % np.uint64(buckets)).astype(np.int64)


def _counting(shared, buckets: int):
    def run(batches):
        target = shared.value
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in K.slices(batches, "text"):
            own, f = _features(b.column("text"), buckets)
            raw += np.bincount(f, minlength=buckets)
            is_target = np.isin(b.column("doc_id").fill_null(-(2**63)).to_numpy(), target)
            good += np.bincount(f[is_target[own]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets // _CELL)), *(pa.array([x.tobytes() for x in c.reshape(-1, _CELL)], pa.binary()) for c in (raw, good))], ["cell", "raw", "good"])

    return run


def _summing(table: pa.Table) -> pa.Table:
    add = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64).reshape(-1, _CELL).sum(axis=0).tobytes()
    return pa.table({"cell": [table.column("cell")[0].as_py()], "raw": pa.array([add("raw")], pa.binary()), "good": pa.array([add("good")], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, sample: int = SAMPLE) -> tuple[np.ndarray, list[int]]:
    """Log ratio of each bucket, and the held-out target ids. docs: doc_id, text."""
    share = docs.sparkSession.sparkContext.broadcast
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [(r["doc_id"], r["fold"]) for r in seen.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("fold")).collect()]
    target = share(np.array([i for i, fold in rows if fold == 0], np.int64))
    cells = docs.mapInArrow(_counting(target, buckets), "cell long, raw binary, good binary").groupBy("cell").applyInArrow(_summing, "cell long, raw binary, good binary").orderBy("cell").collect()
    raw, good = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[c], np.int64) for r in cells)]) for c in ("raw", "good"))
    if not good.sum():
        return np.zeros(buckets), []
    ratio = np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    return ratio, [i for i, fold in rows if fold == 1]


def _weighing(shared, shrink: float, also: tuple[str, ...]):
    def run(batches):
        ratio = shared.value
        for b in K.slices(batches, "text"):
            own, f = _features(b.column("text"), len(ratio))
            n = np.bincount(own, minlength=b.num_rows)
            weight = np.bincount(own, weights=ratio[f], minlength=b.num_rows) / (n + shrink)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in also), pa.array(weight)], [*also, "weight"])

    return run


def kth_largest(values: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of the column x (k from 1 to the number of rows), by refining a histogram."""
    lo, hi, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    inside, width = n, 0.0
    while inside > few and hi > lo:
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))
        counts = values.where(F.col("x").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in counts:
            if r["n"] >= k:
                lo, hi, inside = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
    if hi == lo:
        return lo
    return sorted((r["x"] for r in values.where(F.col("x").between(lo, hi)).collect()), reverse=True)[k - 1]


def _key(weight, scale: float, seed: int):
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    return weight * scale - F.log(-F.log(u))


def _selection(docs: DataFrame, labels: DataFrame, k: int | None, buckets: int, sample: int, recall: float, scale: float, shrink: float, seed: int):
    """The broadcast model, the weights and keys of all documents, and the smallest key that stays."""
    ratio, held_out = fit(docs, labels, buckets=buckets, sample=sample)
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    weights = docs.mapInArrow(_weighing(model, shrink, ("doc_id",)), "doc_id long, weight double")
    weights = written(weights.select("doc_id", "weight", _key(F.col("weight"), scale, seed).alias("x")), "weights")
    if k is None:
        if not held_out:
            return model, weights, float("-inf")
        ids = docs.sparkSession.createDataFrame([(i,) for i in held_out], "doc_id long")  # bounded by `sample`
        cut = weights.join(F.broadcast(ids), "doc_id", "left_semi").agg(F.expr(f"percentile(weight, {1 - recall})")).first()[0]
        k = weights.where(F.col("weight") >= cut).count() if cut is not None else weights.count()
    if k <= 0:
        return model, weights, float("inf")
    return model, weights, kth_largest(weights, k) if k < weights.count() else float("-inf")


def importance_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int | None = None, buckets: int = BUCKETS, sample: int = SAMPLE, recall: float = RECALL, scale: float = SCALE, shrink: float = SHRINK, seed: int = SEED) -> DataFrame:
    """doc_id and log_weight of the selected documents."""
    small_batches(docs.sparkSession)
    _, weights, least = _selection(texts(docs, id_col, text_col), labels, k, buckets, sample, recall, scale, shrink, seed)
    return weights.where(F.col("x") >= least).select("doc_id", F.col("weight").alias("log_weight"))


def select_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int | None = None, buckets: int = BUCKETS, sample: int = SAMPLE, recall: float = RECALL, scale: float = SCALE, shrink: float = SHRINK, seed: int = SEED) -> DataFrame:
    """The selected rows with all columns that docs has; no row is shuffled."""
    small_batches(docs.sparkSession)
    plain = texts(docs, id_col, text_col)
    model, _, least = _selection(plain, labels, k, buckets, sample, recall, scale, shrink, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema.simpleString()
    weighed = rows.mapInArrow(_weighing(model, shrink, ("row", "doc_id")), f"row {kind}, doc_id long, weight double")
    return weighed.where(_key(F.col("weight"), scale, seed) >= least).select("row.*")
