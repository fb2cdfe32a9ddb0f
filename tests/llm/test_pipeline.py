"""Every stage of the corpus pipeline against brute force, and on odd tables."""

import itertools
import re
import tempfile
import zlib

import numpy as np
import pytest

import corpus_pipeline
from runscope.llm import quality

from .test_lines import WORDS, made
from .test_lines import brute as similar_lines

STAGES = dict(corpus_pipeline.STAGES)
#: Names that operators use themselves.
SCHEMA = "doc_id long, text string, row string, items int, `__key` string, spans string, weight double, x int, gone string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, f"r{k}", 1, "k", "s", 0.5, 2, "g", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    w = " ".join(f"leak{i}" for i in range(12))
    out = made(21, 60)
    return [*out, (out[3][0], out[3][1]), (None, "words without an id " * 5), (None, None), (500, ""), (501, "two words"), (502, "Two words"), (503, f"so {w} then"), (504, "long " * 30_000)]


@pytest.fixture(scope="module")
def sf_dir(spark):
    where = tempfile.mkdtemp()
    items = [(1, " ".join(f"leak{i}" for i in range(12))), (None, "five words of null id"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 180, 2)] + [(None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    return where


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_lines(spark, rows, sf_dir):
    d = table(spark, rows)
    got = STAGES["lines"](spark, d, sf_dir)
    assert got.schema.simpleString() == d.schema.simpleString()
    gone = similar_lines(rows)
    cut = lambda i, t: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
    assert pairs(got) == sorted(((i, cut(i, t)) for i, t in rows), key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_near_duplicates(spark, rows, sf_dir):
    whole = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    sets = []
    for _, t in rows:
        w = whole(t)
        sets.append({w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    best = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0)
        if sets[k] and (group[k] not in best or key < best[group[k]][0]):
            best[group[k]] = (key, i, t)
    want = [(i, t) for _, i, t in best.values()] + [r for k, r in enumerate(rows) if not sets[k]]
    assert [r[0] for r in pairs(STAGES["near_duplicates"](spark, table(spark, rows), sf_dir))] == [r[0] for r in sorted(want, key=repr)]


def test_decontaminate(spark, rows, sf_dir):
    d = table(spark, rows)
    leak = [f"leak{i}" for i in range(12)]
    windows = [tuple(leak[k : k + 10]) for k in range(3)] + [("five", "words", "of", "null", "id")]
    hit = lambda t: any(tuple(w[k : k + len(x)]) == x for w in [WORDS.findall((t or "").lower())] for x in windows for k in range(len(w)))
    got = STAGES["decontaminate"](spark, d, sf_dir)
    assert got.schema.simpleString() == d.schema.simpleString()
    assert pairs(got) == sorted((r for r in rows if not hit(r[1])), key=repr)


def test_quality(spark, rows, sf_dir):
    """Keys computed anew from the model that fitting gives; the stage keeps those down to the smallest one that it needs."""
    d, labels = table(spark, rows), spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = STAGES["quality"](spark, d, sf_dir)
    assert kept.schema.simpleString() == d.schema.simpleString()
    ratio, _ = quality.fit(d.select("doc_id", "text"), labels)
    import pyarrow as pa

    own, f = quality._features(pa.array([t for _, t in rows], pa.string()), len(ratio))
    n = np.bincount(own, minlength=len(rows))
    weight = np.bincount(own, weights=ratio[f], minlength=len(rows)) / (n + quality.SHRINK)
    spark.createDataFrame([(i, float(w)) for (i, _), w in zip(rows, weight, strict=True)], "doc_id long, w double").createOrReplaceTempView("weights")
    noise = f"-ln(-ln((pmod(xxhash64(doc_id, {quality.SEED}), {2**52}L) + 0.5D) / {2**52}D))"
    keys = [r[0] for r in spark.sql(f"SELECT w * {quality.SCALE}D + {noise} FROM weights").collect()]
    for k in (1, 7, len(rows)):
        least = sorted(keys, reverse=True)[k - 1]
        want = [r for r, x in zip(rows, keys, strict=True) if x >= least - 1e-9]
        assert pairs(quality.select_documents(d, labels, k=k)) == sorted(want, key=repr)
    assert len(pairs(kept)) <= len(rows)
    assert pairs(quality.select_documents(d, labels.limit(0))) == sorted(rows, key=repr)


def test_pack(spark, rows, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = STAGES["pack"](spark, table(spark, rows), sf_dir).collect()
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)


def test_whole_and_empty(spark, rows, sf_dir):
    for content in (rows, []):
        where = tempfile.mkdtemp()
        table(spark, content).write.parquet(f"{where}/documents.parquet")
        for name in ("benchmark", "labels"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
        got = corpus_pipeline.run(spark, where)
        assert (got.count() > 0) == bool(content)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = table(spark, [])
        assert stage(spark, d, sf_dir).schema.simpleString() == d.schema.simpleString(), name
