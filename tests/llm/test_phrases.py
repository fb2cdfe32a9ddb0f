"""Collocations and their word index against counting every phrase."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runscope.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, word string, n long"


def plainly(rows, least, top=2000, cover=80):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for m in (1, 2, 3, 4):
                f.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), b in kept.items():
        for m in range(2, len(w)):
            covered.update((lang, w[i : i + m]) for i in range(len(w) - m + 1) if 100 * b >= cover * f[lang, w[i : i + m]])
    by_lang = defaultdict(list)
    for (lang, w), a in kept.items():
        if (lang, w) not in covered:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by_lang[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(repr((lang, i + 1, p.decode(), -a, l, r, total[lang], -s)) for lang, x in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def made():
    rng = np.random.default_rng(8)
    words = ["the", "The", "on", "é", "日本", "b-c", "\x00", "x" * 300, *[f"w{i}" for i in range(12)]]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", ":", "\x0b", " \x0c"]
    rows = []
    for _ in range(150):
        n = int(rng.integers(0, 60))
        text = "".join(str(rng.choice(words, p=[0.2, 0.1] + [0.7 / 18] * 18)) + str(rng.choice(marks, p=[0.7] + [0.3 / 9] * 9)) for _ in range(n))
        rows.append((text, [None, "en", "de", "und"][int(rng.integers(4))]))
    return [*rows, (None, "en"), ("", "en"), (" . , ", "fr"), ("a b c d " * 20_000, "long"), *rows[:10], ("the the the the the", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "w", 1) for i, (t, lang) in enumerate(made())], SCHEMA).repartition(5)


@pytest.mark.parametrize(("least", "top", "cover"), [(5, 2000, 80), (2, 7, 50), (30, 3, 101)])
def test_equals_counting_every_phrase(docs, least, top, cover):
    got = phrases.collocations(docs, least=least, top=top, cover=cover).collect()
    assert sorted(repr(tuple(r)) for r in got) == plainly(made(), least, top, cover)
    assert len(got) > 5


def test_index_finds_all_intervals():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 60, 400):
        sequence = np.append(rng.integers(0, 5, size), 0)
        at, depth = phrases.WordIndex(sequence, 4), 4
        grams = lambda m: Counter(tuple(map(int, sequence[i : i + m])) for i in range(len(sequence) - m + 1) if sequence[i : i + m].all())  # noqa: B023, E731
        for m, (found, count) in zip(range(2, depth + 1), at.phrases(), strict=True):
            assert dict(zip(map(tuple, found.tolist()), count.tolist(), strict=True)) == grams(m)
        for phrase, count in grams(3).items():
            low, high = at.interval(list(phrase))
            assert high - low == count
            assert at.right(at.interval(list(phrase[:2])), 2, phrase[2]) == (low, high)


def test_words_with_one_number_get_another_seed(spark):
    words = spark.createDataFrame([("en", "a", 1), ("en", "b", 2), ("de", "a", 3)], "lang string, word string, n long")
    same_at_first = lambda w, seed: np.array([len(x) if seed < 2 else ord(x) for x in w.to_pylist()], np.uint64)
    got, seed = phrases.numbered(words, same_at_first)
    assert seed == 2
    assert {(r["lang"], r["word"]): r["id"] for r in got.collect()} == {("en", "a"): 97, ("en", "b"): 98, ("de", "a"): 97}


def test_rows_make_shards():
    b = pa.record_batch({"text": ["ab cd"] * 100, "lang": ["en"] * 100})
    assert [x.num_rows for x in phrases.shards(iter([b, b]), 300)][0] < 100
    assert sum(x.num_rows for x in phrases.shards(iter([b, b]), 300)) == 200


def test_empty_tables(spark, docs):
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
