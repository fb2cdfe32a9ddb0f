"""Repeated rows, ties, very long texts, clashing names and nulls, for the operators whose own tests don't have them."""

import math
import re
import time
import zlib

import numpy as np

from runscope.llm import chat, decontaminate, minhash, quality, suffixes, topk, toxicity

NAMES = ", h long, spans string, score double, w int, items string, key int, n int, other long, lo int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 0.5, 2, "i", 3, 4, 5, 6) for r in rows], "doc_id long, text string" + NAMES)


def test_minhash_repeats_and_long_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(300)) for x in "ab")
    rows = [(5, a), (5, a), (3, a + " more"), (7, a), (7, b), (9, b + " end"), (None, a), (8, None), (8, ""), (10, "x " * 200_000), (11, "x " * 100_000)]
    got = sorted({tuple(r)[:1] + (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()})
    by = {d: (c, k) for d, c, k in got}
    assert len(got) == len(by) == 7
    assert by[3] == (3, True)
    assert by[5] == (3, False)
    assert by[10] == (10, True)
    assert by[11] == (10, False)
    assert by[8] == (8, True)
    assert by[7][0] in (3, 7)  # which of its texts decides is fixed by their hashes
    assert by[9] == ((9, True) if by[7][0] == 3 else (7, False))
    counts = sorted(r["n_shingles"] for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert counts == sorted([296, 296, 297, 296, 296, 297, 0, 0, 1, 1])


def test_passages_with_repeats_ties_and_long_texts(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    p, q = text(70), text(55)
    rows = [(1, f"{text(20)} {p} {text(9)}"), (2, f"{p} {q}"), (2, f"{p} {q}"), (3, f"{q} {text(40)} {q}"), (4, "same " * 30_000), (5, "same " * 100), (None, p), (6, None), (7, ""), (8, text(49))]
    where = {}
    for d, t in dict(r for r in rows if r[0] is not None).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), []).append((d, k))
    want = {(d, k + j) for x in where.values() if len(x) > 1 for d, k in x for j in range(50)}
    got = suffixes.repeated_passages(docs(spark, rows)).collect()
    assert {(r["doc_id"], k) for r in got for k in range(r["start_word"], r["end_word"])} == want


def test_contamination_repeats_and_exact_hits(spark):
    leak = [f"b{i}" for i in range(12)]
    items = spark.createDataFrame([(1, " ".join(leak)), (2, "tiny item"), (2, "tiny item"), (3, None)], "item_id long, text string").selectExpr("*", "'x' AS words", "1 AS item")
    t = "so " + " ".join(leak[:11]) + " then TINY item"
    rows = [(1, t), (1, t), (None, t), (2, "tiny " * 50_000 + "item"), (3, "b0 b1"), (4, None)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs(spark, rows), items).collect())
    assert got == [(0, 15, 13, 2, True), (1, 15, 13, 2, True), (1, 15, 13, 2, True), (2, 50_001, 2, 1, True), (3, 2, 0, 0, False), (4, 0, 0, 0, False)]


def test_top_k_repeats_infinities_and_other_columns(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [float("inf"), 1.0]), (4, [1.0]), (None, [9.0, 9.0]), (50, [0.5, -1.0]), (100, [])]
    d = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], "vec_id long, embedding array<float>, score int, query_id int, rank string")
    got = [tuple(r) for r in topk.top_k(d, k=3).orderBy("query_id", "rank").collect()]
    one = 256 * 256
    assert got[:3] == [(0, 1, 1, 2 * one), (0, 2, 2, 2 * one), (0, 3, 2, 2 * one)]
    assert [(q, r, v) for q, r, v, _ in got[3:]] == [(50, 1, 0), (50, 2, 1), (50, 3, 2)]
    many = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(600)], "vec_id long, embedding array<float>")
    blocks = topk.top_k(many, every=3, block_bytes=640)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, topk.top_k(many, every=3).collect()))


def test_replies_with_repeats_long_messages_and_other_columns(spark):
    rows = [(1, 0, "u", "hello there"), (1, 0, "u", "hello there"), (1, 1, "u", "hello there"), (1, 2, "a", "> hello there\nyes"), (1, 3, "a", "> " + "long " * 30_000), (1, 4, "u", ">> yes\n> no such\nso")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, h int, source int")
    got = sorted((r["turn"], r["parent_turn"], r["root_turn"], r["n_quotes"]) for r in chat.reply_conversations(d).collect())
    assert got == [(0, None, 0, 0), (0, None, 0, 0), (1, None, 1, 0), (2, 1, 1, 1), (3, None, 3, 1), (4, 2, 1, 2)]


def test_quality_ties_and_repeats(spark):
    rows = [(i % 50, f"word{i % 50} common text") for i in range(100)] + [(60, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 50, 2)], "doc_id long, quality int")
    d = docs(spark, rows)
    got = quality.select_documents(d, labels, k=11)
    assert got.columns == d.columns
    kept = [r["doc_id"] for r in got.collect()]
    assert len(kept) in (11, 12)
    assert all(kept.count(i) == (1 if i == 60 else 2) for i in kept)  # keys of equal rows tie


def test_toxicity_held_out_repeats_and_long_texts(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(240):
        w = list(rng.choice(vocabulary, 30))
        if i % 4 == 0:
            w[3] = "foulword"
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    long = " ".join(rng.choice(vocabulary, 50_000))
    more = [(0, rows[0][1]), (None, rows[4][1]), (500, long), (501, long + " foulword"), (502, None)]
    got = toxicity.toxicity(docs(spark, rows + more), labels).collect()
    assert len(got) == 245
    for r in got:
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == out
        assert 0 <= r["score"] <= 1
        assert not math.isnan(r["score"])
        assert r["predicted"] == int(r["score"] >= 0.7)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["score"], r["predicted"], [(s["start"], s["end"]) for s in r["spans"]]))
    assert len(by[0]) == 2
    assert by[0][0] == by[0][1]
    assert by[None][0] == by[4][0]
    assert all(by[i][0][1] == int(i % 4 == 0) for i in range(240))
    assert by[500][0][1] == by[502][0][1] == 0
    assert by[501][0][2] == [(len(long) + 1, len(long) + 9)]


def test_chat_with_very_many_lines(spark):
    """20 000 quoted lines, in one passage and in as many; levels that change in every line."""
    n = 20_000
    said = "\n".join(f"line {i}" for i in range(n))
    rows = [(1, 0, "u", said), (1, 1, "a", "\n".join(f"> line {i}" for i in range(n))), (1, 2, "u", "\n".join((">" * (i % 3)) + f"line {i}" for i in range(n))), (1, 3, "a", ">> line 9\n> nothing\n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r["turn"]: r for r in chat.reply_conversations(d).collect()}
    assert time.time() - began < 60
    assert [(got[t]["n_quotes"], got[t]["parent_turn"], got[t]["root_turn"]) for t in range(4)] == [(0, None, 0), (1, 0, 0), (2 * n // 3, 0, 0), (2, 2, 0)]
    assert got[0]["text"] == said
    assert got[1]["text"] == ""
    assert got[2]["text"].split("\n") == [f"line {i}" for i in range(0, n, 3)]
