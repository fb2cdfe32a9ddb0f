"""Edge cases and brute-force comparisons on small tables."""

import itertools
import re
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runscope.llm import chat, decontaminate, lines, minhash, packing, quality, sentences, suffixes, textkit, topk, toxicity

DOCS = "doc_id long, text string, key string, n long, row string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))


def made(n=60, seed=3):
    """Documents with copies, near copies, repeats, nulls and empty texts."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 4 and texts:
            texts.append(texts[int(rng.integers(len(texts)))])
        elif kind == 5 and texts:
            w = (texts[int(rng.integers(len(texts)))] or "x").split(" ")
            w[int(rng.integers(len(w)))] = "changed"
            texts.append(" ".join(w))
        else:
            texts.append(". ".join(" ".join(rng.choice(vocab, int(rng.integers(3, 15)))) for _ in range(int(rng.integers(1, 12)))) + ".")
    return [*texts, None, "", "one two", "one two", "  ", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, "r") for i, t in enumerate(made())], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_of_batches():
    texts = ["a B  c\n", "", None, "é à b", "x" * 100, "\x0b1 2"]
    w = textkit.Words(pa.array(texts))
    for i, t in enumerate(texts):
        assert [bytes(w.data[s:e]).decode().translate(FOLD) for s, e in zip(w.start[w.at[i] : w.at[i + 1]], w.end[w.at[i] : w.at[i + 1]], strict=True)] == words(t)


def test_near_duplicates_equal_brute_force(docs):
    sets = {}
    for i, t in enumerate(made()):
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_packing_is_gapless_and_whole(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = packing.pack(docs, capacity=64, max_documents=5).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    size = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in enumerate(made())}
    per, seq = {}, {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    assert {k: sum(r["length"] for r in v) for k, v in per.items()} == size
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
        assert len(v) <= 5


def test_vector_best_fit_respects_every_capacity():
    for score in ("norm", "dot"):
        bins = packing.vector_best_fit({9: 4, 5: 7, 2: 20, 1: 3}, 16, 4, 120, (1, 0.5, 0.5), score)
        total = {}
        for c, n in bins:
            assert sum(k * v for k, v in c.items()) <= 16
            assert sum(c.values()) <= 4
            assert sum(k * k * v for k, v in c.items()) <= 120
            for k, v in c.items():
                total[k] = total.get(k, 0) + v * n
        assert total == {9: 4, 5: 7, 2: 20, 1: 3}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(120, 4)), 1).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    q = np.floor(256 * v.astype(float)).astype(int)
    want = set()
    for i in range(0, 120, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(120) if j != i))[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(few).count() == 1


def test_quality_keeps_good_and_rejects_junk(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab, 80)) if i % 5 else " ".join(["junk%d" % (i % 7)] * 80)) for i in range(400)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit(1))
    labels = spark.createDataFrame([(i, int(bool(i % 5))) for i in range(0, 400, 2)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.importance_sample(d, labels).collect()}
    assert not [i for i in kept if i < 400 and i % 5 == 0]
    assert len([i for i in kept if i < 400]) >= 315
    chosen = quality.select_documents(d, labels, k=10)
    assert chosen.columns == d.columns
    assert chosen.count() == 10
    assert quality.importance_sample(d, labels.limit(0)).count() == 402


def test_toxic_words_are_found(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(rng.choice(vocab, 40))
        if i % 4 == 0:
            w[int(rng.integers(40))] = "foulword"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(300))
    r = got[4]
    assert [rows[4][1][s["start"] : s["end"]] for s in r["spans"]] == ["foulword"]
    assert got[900]["predicted"] == got[901]["predicted"] == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    at, e, trans = np.array([0, 3, 3, 8]), rng.uniform(0.2, 3, 8), np.array([[0.9, 0.1], [0.4, 0.6]])
    got = toxicity.marginals(e, at, trans, 0.0)
    for lo, hi in ((0, 3), (3, 8)):
        total = np.zeros(hi - lo)
        z = 0.0
        for y in itertools.product((0, 1), repeat=hi - lo):
            p, prev = 1.0, 0
            for k, s in enumerate(y):
                p *= trans[prev, s] * (e[lo + k] if s else 1)
                prev = s
            z += p
            total += p * np.array(y)
        assert np.allclose(got[lo:hi], total / z)


def test_passages(spark):
    rng = np.random.default_rng(6)
    w = [f"u{i}" for i in range(1000)]
    p = " ".join(rng.choice(w, 60))
    own = lambda k: " ".join(rng.choice(w, k))
    d = spark.createDataFrame([(1, own(30) + " " + p + " " + own(30)), (2, own(10) + " " + p + " " + own(80)), (3, own(200)), (4, None), (5, "short text")], "doc_id long, text string")
    got = {r["doc_id"]: (r["start_word"], r["n_words"], r["other_doc_id"]) for r in suffixes.repeated_passages(d).collect()}
    assert got == {1: (30, 60, 2), 2: (10, 60, 1)}


def test_contamination_in_blocks_is_the_same(spark, docs):
    items = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join((made()[k] or "").split()[:14]) for k in (0, 1, 2, 7)] + ["one two", None, ""])], "item_id long, text string")
    key = lambda d: sorted(map(str, d.collect()))
    whole, parts = decontaminate.contamination(docs, items), decontaminate.contamination(docs, items, block_words=20)
    assert key(whole) == key(parts)
    assert {r["doc_id"] for r in whole.where("contaminated").collect()} >= {0, 1, 2, 7, 62, 63}


def test_replies(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line"), (1, 1, "a", "> Hello  THERE\n> second line\nhi"), (1, 2, "user", ">> Hello there\n> hi\nok"), (1, 3, "a", "no quote"), (2, 0, "u", None), (None, 1, "u", "> hi")]
    got = {(r["conv_id"], r["turn"]): (r["text"], r["n_quotes"], r["parent_turn"], r["root_turn"]) for r in chat.reply_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): ("Hello there\nsecond line", 0, None, 0), (1, 1): ("hi", 1, 0, 0), (1, 2): ("ok", 2, 1, 0), (1, 3): ("no quote", 0, None, 3), (2, 0): ("", 0, None, 0), (None, 1): ("", 1, None, 1)}


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (minhash.near_duplicates(empty), packing.pack(empty), sentences.repeats(empty), suffixes.repeated_passages(empty), lines.line_duplicates(empty), lines.without_lines(empty), decontaminate.contamination(empty, items), quality.importance_sample(empty, labels), toxicity.toxicity(empty, labels), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")), chat.reply_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))):
        assert df.count() == 0


def test_near_duplicate_stage_works_on_rows(spark):
    from corpus_pipeline import STAGES

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "pqrs")
    rows = [(2, a), (2, a), (1, a + " end"), (None, a), (None, b), (None, b), (3, c), (3, d), (3, d), (5, c + " end"), (7, ""), (7, ""), (None, None), (8, "two words"), (9, "two words")]
    got = dict(STAGES)["near_duplicates"](spark, spark.createDataFrame([(*x, "r") for x in rows], "doc_id long, text string, source string"), "")
    assert got.columns == ["doc_id", "text", "source"]
    want = [(1, a + " end"), (None, b), (3, c), (3, d), (7, ""), (7, ""), (None, None), (8, "two words")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, want))


def test_contamination_with_null_ids(spark):
    from corpus_pipeline import STAGES

    leak, other, clean = (" ".join(f"{x}{i}" for i in range(15)) for x in "xyz")
    items = spark.createDataFrame([(None, leak), (None, other), (4, leak)], "item_id long, text string")
    d = spark.createDataFrame([(1, "so " + other, "a"), (1, clean, "b"), (None, leak, "c"), (None, clean, "d"), (2, leak + " " + other, "e"), (3, None, "f")], "doc_id long, text string, source string")
    for size in (20, decontaminate.BLOCK_WORDS):
        got = decontaminate.contamination(d, items, block_words=size).collect()
        assert [(r["n_hit"], r["n_items"], r["items"]) for r in got] == [(15, 1, []), (0, 0, []), (15, 2, ["4"]), (0, 0, []), (30, 2, ["4"]), (0, 0, [])]
        kept = decontaminate.clean_documents(d, items, block_words=size)
        assert kept.schema.simpleString() == d.schema.simpleString()
        assert sorted(r["source"] for r in kept.collect()) == ["b", "d", "f"]
    items.write.parquet(f"{(where := tempfile.mkdtemp())}/benchmark.parquet")
    assert sorted(r["source"] for r in dict(STAGES)["decontaminate"](spark, d, where).collect()) == ["b", "d", "f"]


def test_passages_of_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, [w if rng.random() > 0.05 else f"v{rng.integers(10**9)}" for w in base]) for i in range(150)]
    where = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    want = {(i, k + j) for x in where.values() if len(x) > 1 for i, k in x for j in range(50)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in [*rows, rows[0]]], "doc_id long, text string")
    got = suffixes.repeated_passages(d).collect()
    assert {(r["doc_id"], k) for r in got for k in range(r["start_word"], r["end_word"])} == want
    assert all(r["other_doc_id"] != r["doc_id"] for r in got)
