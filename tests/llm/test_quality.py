"""Quality selection against a plain rewriting with dictionaries of n-grams; toxicity scores without labels of held-out rows."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.llm import quality
from runscope.llm.queries import QUERIES

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def grams(text):
    """Words and pairs of words; so few that none share a bucket."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return Counter([*w, *zip(w, w[1:], strict=False)])


def brute(spark, rows, labels, k=None, scale=quality.SCALE):
    """(doc_id, weight) of the rows that stay."""
    buckets, shrink = quality.BUCKETS, quality.SHRINK
    ids = spark.createDataFrame([(d,) for d, _ in rows], "doc_id long")
    drawn = ids.select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)), F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(2**52))).collect()
    fold, noise = [r[0] for r in drawn], [-math.log(-math.log((r[1] + 0.5) / 2**52)) for r in drawn]
    wanted = {d for d, q, _ in labels if q == 1 and d is not None}
    raw, good = Counter(), Counter()
    for (d, t), side in zip(rows, fold, strict=True):
        raw.update(grams(t))
        if d in wanted and side == 0:
            good.update(grams(t))
    n_raw, n_good = sum(raw.values()) + buckets, sum(good.values()) + buckets
    weights = []
    for _, t in rows:
        g = grams(t)
        total = sum(c * (math.log((good[x] + 1) / n_good) - math.log((raw[x] + 1) / n_raw)) for x, c in g.items())
        weights.append(total / (sum(g.values()) + shrink))
    if k is None:
        cut = np.percentile([w for w, (d, _), side in zip(weights, rows, fold, strict=True) if d in wanted and side == 1], 100 * (1 - quality.RECALL))
        k = sum(w >= cut for w in weights)
    keys = [scale * w + e for w, e in zip(weights, noise, strict=True)]
    least = sorted(keys, reverse=True)[k - 1]
    return sorted((-1 if d is None else d, round(w, 9)) for (d, _), w, x in zip(rows, weights, keys, strict=True) if x >= least)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(12)
    good, junk = ["one", "two", "Tree", "für"], ["buy", "NOW", "$$", "one"]
    text = lambda v: " ".join(rng.choice(v, int(rng.integers(1, 60))))
    rows = [(i, text(good if i % 4 else junk)) for i in range(400)]
    rows += [(None, "buy NOW"), (None, "one two"), (500, None), (501, ""), (502, " \t"), rows[1], rows[1], rows[4], (503, "one two " * 20_000)]
    labels = [(i, None if i % 30 == 0 else int(i % 4 > 0), 0) for i in range(0, 400, 3)] + [(9999, 1, 0), (None, 1, 0)]
    return rows, labels


def test_the_query_equals_brute_force(spark, made, tmp_path):
    rows, labels = made
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op8_quality"](spark, str(tmp_path)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["log_weight"], 9)) for r in got) == brute(spark, rows, labels)
    assert 250 < len(got) < len(rows)


@pytest.mark.parametrize("k", [1, 40, 200])
def test_noise_decides_where_the_scale_is_small(spark, made, k):
    rows, labels = made
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = quality.importance_sample(docs, marks, k=k, scale=2.0).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["log_weight"], 9)) for r in got) == brute(spark, rows, labels, k, 2.0)
    assert {r["doc_id"] for r in got} != {r["doc_id"] for r in quality.importance_sample(docs, marks, k=k).collect()}


def test_toxicity_learns_nothing_from_held_out_labels(spark, sf_dir, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    a, b = ({r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, d).collect()} for d in (sf_dir, str(tmp_path)))
    assert set(a) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for d, r in a.items())
    assert {d: (r["score"], r["predicted"]) for d, r in a.items()} == {d: (r["score"], r["predicted"]) for d, r in b.items()}


def test_toxicity_of_held_out_documents(spark, sf_dir):
    """A floor, not an aim: of 1000 documents 94 of 95 clean and 14 of 18 toxic ones were right, so 0.95 of each kind is missed; README has more."""
    larger = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if not os.path.isdir(larger):
        pytest.skip("no larger table here")
    truth = spark.read.parquet(f"{larger}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = QUERIES["op2_toxicity"](spark, larger).where("held_out").join(truth, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr("int(predicted = toxic)")).alias("right")).collect()
    assert {r["toxic"] for r in got} == {0, 1}
    assert all(r["n"] > 10 and r["right"] >= 0.75 for r in got), got
    assert sum(r["n"] * r["right"] for r in got) >= 0.95 * sum(r["n"] for r in got)
