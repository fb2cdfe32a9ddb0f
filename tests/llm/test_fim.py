"""Fill-in-middle against a plain rewriting, and exact restoring."""

import hashlib
import re

import numpy as np
import pytest

from runscope.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string"
MARKS = (b"<P>", b"<S>", b"<M>")


def plainly(i, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(m in t for m in fim.SENTINELS) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return i, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def made():
    rng = np.random.default_rng(5)
    parts = ["word", "Ab", " ", "\n", "é", "日本", "😀", ".", "<", "<S", "P>", ">", "<P>", "\x00", "\r\n", "9"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)), p=[0.15] * 4 + [0.4 / 12] * 12)) for _ in range(300)]
    texts += [None, "", "a", "é", "<M>", "<<S>", "<P", "x" * 700_000, "é " * 400_000, "a b"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (None, None), (3, "other text of the same id"), (309, "a b")]


def test_equals_a_plain_rewriting(spark):
    rows = made()
    d = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], SCHEMA)
    got = fim.restored(fim.fill_in_middle(d)).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr(plainly(*x)) for x in rows)
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    sums = fim.digests(d).where("output_sha256 is null or length(restored_sha256) <> 64")
    assert sums.count() == 0


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_rotations_are_undone(form):
    for size in range(9):
        text = bytes(range(97, 97 + size))
        for a in range(size + 1):
            for b in range(a, size + 1):
                assert fim.undone(fim.arranged(text, a, b, form, MARKS), form, MARKS) == text
