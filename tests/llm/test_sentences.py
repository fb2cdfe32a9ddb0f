"""Sentence spans against a plain rewriting of their definition."""

import re

import numpy as np

from runscope.llm import sentences

SCHEMA = "doc_id long, text string, i string, h int, removed string"


def units(text):
    """The sentences of a text: lists of words."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    parts, end = [], 0
    for m in word.finditer(text):
        gap = text[end : m.start()]
        if not parts or "\n" in gap or (re.search("[.!?]", gap) and re.search(r"[\t-\r ]", gap)):
            parts.append([])
        parts[-1].append(m[0])
        end = m.end()
    out = []
    for p in parts:
        pieces = [[]]
        for w in p:
            pieces[-1].append(w)
            b = w.encode()
            if len(p) > sentences.LONG and (b[0] + 3 * b[-1]) % 5 == 0:
                pieces.append([])
        most = sentences.MOST if len(p) > sentences.LONG else len(p)
        out += [q[k : k + most] for q in pieces for k in range(0, len(q), most)]
    return out


def brute(rows, least, across=False):
    """doc_id -> (removed, first documents)."""
    runs, places = {}, {}
    for doc, text in rows:
        if doc is None or text is None:
            continue
        u = units(text)
        n = [len(x) for x in u]
        if 0 < sum(n) < least:
            runs.setdefault(tuple(w for x in u for w in x), set()).add((doc, 0, len(u) - 1))
        for i in range(len(u)):
            for j in range(i, len(u)):
                size = sum(n[i : j + 1])
                if size >= least and (size - n[j] < least or size - n[i] < least):
                    runs.setdefault(tuple(w for x in u[i : j + 1] for w in x), set()).add((doc, i, j))
    for found in runs.values():
        if len({d for d, *_ in found} if across else found) > 1:
            first = min(found)
            for d, i, j in found:
                gone, docs = places.setdefault(d, (set(), set()))
                if (d, i) != first[:2]:
                    gone.update(range(i, j + 1))
                    docs.add(first[0])
    return {d: (sorted(g), sorted(f)) for d, (g, f) in places.items()}


def check(spark, rows, least, **options):
    d = spark.createDataFrame([(*r, "i", 1, "x") for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["removed"], r["first_doc_ids"]) for r in sentences.repeats(d, min_words=least, **options).collect()}
    assert got == brute(rows, least, **options)
    return got


def test_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [f"{x}{i}" for i, x in enumerate(["un", "Zwei", "é", "q"] * 60)]
    text = lambda n: " ".join(w + str(rng.choice(["", "", "", "", ".", ",", ".%%%", "!\n", " --"])) for w in rng.choice(v, n))
    shared = [text(int(rng.integers(3, 90))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(6))], text(int(rng.integers(0, 30)))]
        rows.append((int(rng.integers(0, 90)), str(rng.choice([" ", "\n"])).join(parts)))
    for least in (6, 20, sentences.MIN_WORDS):
        assert check(spark, rows, least)


def test_passages_of_few_sentences_noise_and_edge_cases(spark):
    v = [f"w{i}" for i in range(400)]
    p = " ".join(v[:60]) + "."  # one sentence without marks inside
    noisy = re.sub(r"(w[0-9]*3)( |$)", r"\1.%% ", p.upper())
    rows = [(1, p), (2, "Before. " + p + " After."), (3, " ".join(v[100:160])), (None, p), (4, None), (5, ""), (6, "... !"), (1, p), (7, p + "\n" + p), (8, "same " * 200), (9, "x " + noisy)]
    got = check(spark, rows, 30)
    assert got[1] == ([], [])
    assert {2, 7} <= set(got)
    assert got[8] == (list(range(1, 25)), [8])  # of one piece over and over the first stays
    assert 8 not in check(spark, rows, 30, across=True)
    assert check(spark, [], 30) == {}


def test_own_repeats_and_short_copies(spark):
    v = [f"w{i}" for i in range(300)]
    say = lambda a, n: ". ".join(" ".join(v[k : k + 10]) for k in range(a, a + n, 10)) + ". "
    rows = [(1, say(0, 40)[:-2]), (2, say(0, 40).upper()), (3, say(100, 80) + "Then this. " + say(100, 80)), (4, say(200, 30)), (5, "Only one"), (6, "only ONE!"), (6, "only ONE!"), (7, "only two")]
    got = check(spark, rows, sentences.MIN_WORDS)
    assert got[1] == ([], []) and got[2] == ([0, 1, 2, 3], [1])
    assert got[3] == (list(range(9, 17)), [3])
    assert got[5] == ([], []) and got[6] == ([0], [5])
    assert 4 not in got and 7 not in got
    assert set(check(spark, rows, sentences.MIN_WORDS, across=True)) == {1, 2, 5, 6}


def test_removal(spark):
    v = [f"w{i}" for i in range(60)]
    p = ". ".join(" ".join(v[k : k + 6]) for k in range(0, 60, 6)) + "."
    d = spark.createDataFrame([(1, p), (2, "New start here. " + p + " The end."), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in sentences.without_repeats(d).collect()}
    assert got[1] == p
    assert got[2].split() == "New start here. The end.".split()
    assert got[3] is None
