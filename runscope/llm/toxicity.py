"""Toxic spans by a linear-chain conditional random field.

Tokens are words; each has the features word, first four bytes and first five bytes,
hashed into `BUCKETS` weights of the label "toxic" against "clean". Neighbouring
labels are tied by a 2 x 2 transition table. Forward-backward gives the marginal
of every token of a whole text; the spans are the tokens of 0.5 or more with their
byte offsets, and the score of a document is a logistic function of its largest
marginal and its number of toxic tokens.

*Labelled tokens.* Labels mark whole documents. In the training documents a word,
or a beginning of four or five bytes, that occurs in `MIN_DOCS` toxic ones (and a
share `MIN_SHARE` of them) and nearly only there marks its tokens toxic in toxic documents; all others are clean.
Weights and transitions then maximise the conditional likelihood of those tokens.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1, a sample of at
most `PER_CLASS` documents of each label, smallest hash first, of texts of at most
`MAX_CHARS` characters; it fits on the driver. Scoring covers every document and
whole texts, inside tasks, without a shuffle; language, source, ids and labels are
no inputs of it.

Null and empty texts have no tokens and get the score of a text without toxic
tokens. Rows with a null id are scored (held_out false). Repeated rows are scored
each. Without any labels of either kind, scores are the prior 0. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, texts

BUCKETS, PER_CLASS, MAX_CHARS, MIN_DOCS, MIN_SHARE, PURE, EPOCHS, THRESHOLD, CHUNK = 1 << 18, 1000, 20_000, 3, 0.01, 0.95, 40, 0.7, 256
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


def token_features(words: K.Words) -> np.ndarray:
    """n x 3 hashed features: the word, its first four and its first five bytes."""
    up, down = K._powers(len(words.data) + 1)
    c = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(K._BYTE[words.data] * up[: len(words.data)], out=c[1:])
    cols = [words.hash]
    for m in (4, 5):
        end = np.minimum(words.start + m, words.end)
        cols.append(K.mix((c[end] - c[words.start]) * down[words.start], 40 + m))
    return (np.stack(cols, axis=1) % np.uint64(BUCKETS)).astype(np.int64)


def marginals(e: np.ndarray, at: np.ndarray, trans: np.ndarray, start: float, pairs: bool = False):
    """P(toxic) of every token of all texts. e: odds of each token alone; at: where texts begin; trans: 2 x 2 potentials; start: odds before a text.

    Texts are cut into chunks that advance together, one token a step; a chunk's
    effect is a 2 x 2 matrix, and a text's chunks are then chained exactly.
    """
    n = np.diff(at)
    per = -(-n // CHUNK)
    text = np.repeat(np.arange(len(n)), per)
    order = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = at[:-1][text] + order * CHUNK
    size = np.minimum(CHUNK, at[1:][text] - begin)
    place = begin[:, None] + np.arange(CHUNK)
    live = np.arange(CHUNK) < size[:, None]
    x = np.where(live, e[np.where(live, place, 0)] if len(e) else 1.0, 1.0)
    (t00, t01), (t10, t11) = trans.tolist()
    first, last = order == 0, order == per[text] - 1

    def matrix(steps, one):
        m = [np.ones(len(x)), np.zeros(len(x)), np.zeros(len(x)), np.ones(len(x))]
        for k in steps:
            new = one(k, m)
            s = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
            m = [np.where(live[:, k], a / s, b) for a, b in zip(new, m, strict=True)]
        return m

    # rows of m: state 0 and 1 from the starting states 0 and 1
    fwd = matrix(range(CHUNK), lambda k, m: (t00 * m[0] + t10 * m[2], t00 * m[1] + t10 * m[3], x[:, k] * (t01 * m[0] + t11 * m[2]), x[:, k] * (t01 * m[1] + t11 * m[3])))
    bwd = matrix(range(CHUNK - 1, -1, -1), lambda k, m: (t00 * m[0] + t01 * x[:, k] * m[2], t00 * m[1] + t01 * x[:, k] * m[3], t10 * m[0] + t11 * x[:, k] * m[2], t10 * m[1] + t11 * x[:, k] * m[3]))
    into, after = np.full(len(x), start), np.ones(len(x))
    f, b = np.stack(fwd, axis=1).tolist(), np.stack(bwd, axis=1).tolist()
    for i in range(1, len(x)):
        if not first[i]:
            m, r = f[i - 1], into[i - 1]
            into[i] = (m[2] + m[3] * r) / (m[0] + m[1] * r)
    for i in range(len(x) - 2, -1, -1):
        if not last[i]:
            m, r = b[i + 1], after[i + 1]
            after[i] = (m[2] + m[3] * r) / (m[0] + m[1] * r)
    left, right = np.empty_like(x), np.empty_like(x)
    r = into
    for k in range(CHUNK):
        new = x[:, k] * (t01 + t11 * r) / (t00 + t10 * r)
        r = np.where(live[:, k], new, r)
        left[:, k] = r
    r = after
    for k in range(CHUNK - 1, -1, -1):
        right[:, k] = r
        z = x[:, k] * r
        r = np.where(live[:, k], (t10 + t11 * z) / (t00 + t01 * z), r)
    odds = (left * right)[live]
    p = odds / (1 + odds)
    if not pairs:
        return p
    before = np.concatenate([into[:, None], left[:, :-1]], axis=1)[live]
    z = x[live] * right[live]
    joint = np.stack([t00 + 0 * z, t01 * z, t10 * before, t11 * before * z])
    return p, (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


def _document_inputs(p: np.ndarray, words: K.Words) -> np.ndarray:
    n = len(words.at) - 1
    top, many = np.zeros(n), np.zeros(n)
    own = words.owner()
    np.maximum.at(top, own, p)
    np.add.at(many, own, p >= 0.5)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)) / 5, np.log1p(many)], axis=1)


def _distinct(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies, whose words would count once a copy: a text goes if an earlier one has two of its eight smallest shingles."""
    owner, sh = K.shingles(K.Words(pa.array([t for t, _ in rows], pa.string())))
    at = np.searchsorted(owner, np.arange(len(rows) + 1))
    seen, out = set(), []
    for i, row in enumerate(rows):
        few = set(sh[at[i] : min(at[i] + 8, at[i + 1])].tolist())
        if len(few & seen) < min(2, len(few)):
            seen |= few
            out.append(row)
    return out


def train(rows: list[tuple[str, int]]) -> dict | None:
    """rows: text and label of at most twice PER_CLASS documents."""
    rows = _distinct(rows)
    y = np.array([t for _, t in rows])
    if not len(y) or y.min() == y.max():
        return None
    words = K.Words(pa.array([t for t, _ in rows], pa.string()), K.ALNUM)
    f, own = token_features(words), words.owner()
    seen = np.zeros((2, BUCKETS))
    for j in range(3):
        u = np.unique(own * BUCKETS + f[:, j])
        np.add.at(seen, (y[u // BUCKETS], u % BUCKETS), 1)
    share = seen[1] / max(1, (y == 1).sum()) / (seen[1] / max(1, (y == 1).sum()) + (seen[0] + 0.5) / max(1, (y == 0).sum()))
    mark = (seen[1] >= max(MIN_DOCS, MIN_SHARE * (y == 1).sum())) & (share >= PURE)
    rate = seen[1] / (seen[1] + seen[0] + 1e-9)
    label = (mark & (rate > 0.9))[f].any(axis=1) & (y[own] == 1)
    w, trans, g_w, g_t = np.zeros(BUCKETS), np.log(np.array([[0.9, 0.1], [0.6, 0.4]])), np.full(BUCKETS, 1e-3), np.full((2, 2), 1e-3)
    bias, g_b = -3.0, 1e-3
    new = np.zeros(len(own), bool)
    new[words.at[:-1][words.counts > 0]] = True
    past = np.where(new, 0, np.concatenate([[0], label[:-1]]))
    have = np.array([[((past == i) & (label == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    for _ in range(EPOCHS):
        e = np.exp(np.clip(w[f].sum(axis=1) + bias, -30, 30))
        p, joint = marginals(e, words.at, np.exp(trans), 0.0, pairs=True)
        d = label - p
        grad = np.bincount(f.ravel(), weights=np.repeat(d, 3), minlength=BUCKETS) - 1e-2 * w
        for value, g, acc, rate_ in ((w, grad, g_w, 0.5), (trans, (have - joint), g_t, 0.1)):
            acc += g * g
            value += rate_ * g / np.sqrt(acc)
        g_b += d.sum() ** 2
        bias += 0.3 * d.sum() / np.sqrt(g_b)
    p = marginals(np.exp(np.clip(w[f].sum(axis=1) + bias, -30, 30)), words.at, np.exp(trans), 0.0)
    x, a = _document_inputs(p, words), np.zeros(3)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (y - q) - 1e-2 * a)
    return {"w": w.astype(np.float32), "bias": bias, "trans": np.exp(trans), "a": a}


def _scoring(shared):
    def run(batches):
        m = shared.value
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
        for b in K.slices(batches, "text"):
            words = K.Words(b.column("text"), K.ALNUM)
            if m is None:
                p, score = np.zeros(len(words.hash)), np.zeros(b.num_rows)
            else:
                f = token_features(words)
                e = np.exp(np.clip(m["w"][f].sum(axis=1) + m["bias"], -30, 30).astype(np.float64))
                p = marginals(e, words.at, m["trans"], 0.0)
                score = 1 / (1 + np.exp(-np.clip(_document_inputs(p, words) @ m["a"], -30, 30)))
            hit = np.flatnonzero(p >= 0.5)
            own = words.owner()[hit]
            offs = np.searchsorted(own, np.arange(b.num_rows + 1)).astype(np.int32)
            base = words.text_at[own]
            flat = pa.StructArray.from_arrays([pa.array(words.start[hit] - base), pa.array(words.end[hit] - base), pa.array(p[hit])], fields=list(span))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(pa.array(offs), flat)], ["doc_id", "score", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (byte offsets and marginals of toxic tokens)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(f"doc_id is not null and toxic in (0, 1) and not ({HELD_OUT})").dropDuplicates(["doc_id"])
    pick = lambda t: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for t in (0, 1) for r in pick(t).collect()], "doc_id long, toxic int")
    rows = docs.where(F.length("text") <= MAX_CHARS).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    model = spark.sparkContext.broadcast(train([(r["text"], r["toxic"]) for r in rows]))
    out = docs.mapInArrow(_scoring(model), "doc_id long, score double, spans array<struct<start:bigint,end:bigint,p:double>>")
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
