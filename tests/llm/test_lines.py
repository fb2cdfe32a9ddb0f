"""Line de-duplication against brute force."""

import itertools
import re

import numpy as np
import pytest

from runscope.llm import lines

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, percent=75, width=1):
    """(doc_id, line) of every line with an earlier similar one."""
    sets = []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n") if i is not None else []):
            w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x))
            s = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
            if s:
                sets.append((i, k, s))
    sets.sort(key=lambda x: x[:2])
    out = set()
    for a, b in itertools.combinations(sets, 2):
        both = len(a[2] & b[2])
        if a[:2] != b[:2] and 100 * both >= percent * (len(a[2]) + len(b[2]) - both):
            out.add(b[:2])
    return out


def made(seed, n=120, vocabulary=300, longest=40):
    """Lines of frequent and rare words, half of them changed copies; some ids repeat."""
    rng = np.random.default_rng(seed)
    v = [f"w{i}" for i in range(vocabulary)]
    p = 1 / np.arange(1, vocabulary + 1)
    rows, pool = [], []
    for _ in range(n):
        text = []
        for _ in range(rng.integers(1, 6)):
            if pool and rng.random() < 0.5:
                w = list(pool[rng.integers(len(pool))])
                for _ in range(rng.integers(0, len(w) // 4 + 2)):
                    w[rng.integers(len(w))] = v[rng.integers(vocabulary)]
            else:
                w = list(rng.choice(v, rng.integers(1, longest), p=p / p.sum()))
            pool.append(w)
            text.append(" ".join(w))
        rows.append((int(rng.integers(0, 3 * n)), "\n".join(text)))
    return rows


L = lines.Limits


@pytest.mark.parametrize(
    ("limits", "percent", "width"),
    [(L(), 75, 1), (L(hot=3), 75, 1), (L(hot=3, kept=1, many=2, split=4, long=20), 75, 1), (L(hot=0, kept=2, many=4, split=2, long=10), 90, 1), (L(hot=3, kept=1, many=2, split=4, long=20), 60, 1), (L(), 75, 5)],
)
def test_equal_brute_force(spark, limits, percent, width):
    rows = made(percent + width + limits.hot)
    got = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, width=width, limits=limits)
    assert {tuple(r) for r in got.collect()} == brute(rows, percent, width)


def test_short_lines_nulls_repeats_and_other_columns(spark):
    x = " ".join(f"word{i}" for i in range(20))
    rows = [
        (1, x + "\nsee below\na b c\n\nalone"), (2, x.replace("word10", "changed") + "\nsee below\na b c d\n...\na b e\nother"),
        (3, "see\nSee below!\nalone\nsee"), (None, "alone"), (4, None), (5, ""), (1, x + "\nsee below\na b c\n\nalone"), (6, "y " * 3000 + x + "\n" + " ".join(f"z{i}" for i in range(3000))),
        (7, " ".join(f"z{i}" for i in range(100, 3000))),
    ]
    d = spark.createDataFrame([(*r, "r", 1) for r in rows], "doc_id long, text string, row string, gone int")
    assert {tuple(r) for r in lines.removed_lines(d).collect()} == brute(rows) == {(2, 0), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (6, 0), (7, 0)}
    got = lines.without_lines(d)
    assert got.columns == d.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {1: rows[0][1], 2: "...\na b e\nother", 3: "see", None: "alone", 4: None, 5: "", 6: rows[7][1].split("\n")[1], 7: ""}
    assert [(r["doc_id"], r["removed"], r["n_removed"]) for r in lines.line_duplicates(d).orderBy("doc_id").collect()][1] == (3, [1, 2, 3], 3)
