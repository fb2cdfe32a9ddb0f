"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. A
window is `width` consecutive words of an item, or the whole item if it has
fewer, but some. A document word inside any occurrence of a window is hit.

The words of a window are ordered by rarity (exact counts over all documents).
An occurrence must hold every word of its window, so the rarest word is the
necessary prefix: only document words equal to some window's rarest word are
looked at. The word's place in the window gives the one possible place of the
window (positional bound), which must lie within the document (length bound);
then all words are compared.

The items travel to the tasks as word hashes (8 bytes a word) in blocks of at
most `block_words` words, which is checked by counting them first. A benchmark
beyond one block is matched block by block; each pass adds to the spans and items
that a row carries, so there is no shuffle of documents either way.

Null and empty texts have no words and no hits; null item texts have no windows.
Items with null ids hit like others; n_items counts all of them as one, and neither
items nor items_sha256 names it.
Repeated rows give repeated results. An empty table of documents gives no rows;
an empty benchmark gives rows without hits. Other columns are not looked at. An
item longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, texts

WIDTH, BLOCK_WORDS = 10, 2_000_000
_CHUNK = 1 << 20


class Windows:
    """The distinct windows of some items, and for each word that is the rarest of a window: those windows and its place there."""

    def __init__(self, items: list[tuple[str, bytes]], counts: dict[int, int] | None, width: int):
        self.items = [i for i, _ in items]
        seqs = [np.frombuffer(b, np.uint64) for _, b in items]
        self.words = np.concatenate([*seqs, np.zeros(0, np.uint64)])
        at, start, length, item = 0, [], [], []
        for k, s in enumerate(seqs):
            m = min(width, len(s))
            if m:
                n = len(s) - m + 1
                start.append(np.arange(at, at + n))
                length.append(np.full(n, m))
                item.append(np.full(n, k))
            at += len(s)
        cat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
        self.start, self.length, self.item = cat(start), cat(length), cat(item)
        self.vocab, code = np.unique(self.words, return_inverse=True)
        if counts is None:
            return
        seen = np.array([counts.get(int(w), 0) for w in self.vocab.view(np.int64)], np.int64)
        rank = np.empty(len(self.vocab), np.int64)
        rank[np.lexsort((self.vocab, seen))] = np.arange(len(self.vocab))
        place = np.zeros(len(self.start), np.int64)
        for m in np.unique(self.length):
            of = np.flatnonzero(self.length == m)
            place[of] = rank[code[self.start[of][:, None] + np.arange(m)]].argmin(axis=1)
        token = self.words[self.start + place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.place, self.window = place[order], order
        self.token, self.first, self.many = np.unique(token[order], return_index=True, return_counts=True)

    def found(self, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.token) or not len(words.hash):
            return none, none
        t = np.minimum(np.searchsorted(self.token, words.hash), len(self.token) - 1)
        p = np.flatnonzero(self.token[t] == words.hash)
        t = t[p]
        lo, hi = np.repeat(words.at[:-1], words.counts)[p], np.repeat(words.at[1:], words.counts)[p]
        out, cut = [(none, none)], np.cumsum(self.many[t])
        i = 0
        while i < len(p):  # candidates in stretches of bounded size
            j = max(i + 1, int(np.searchsorted(cut, (cut[i - 1] if i else 0) + _CHUNK, "right")))
            n = self.many[t[i:j]]
            entry = np.repeat(self.first[t[i:j]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            win = self.window[entry]
            s = np.repeat(p[i:j], n) - self.place[entry]
            ok = (s >= np.repeat(lo[i:j], n)) & (s + self.length[win] <= np.repeat(hi[i:j], n))
            s, win = s[ok], win[ok]
            for d in range(int(self.length[win].max(initial=0))):
                inside = self.length[win] > d
                same = words.hash[np.where(inside, s + d, 0)] == self.words[np.where(inside, self.start[win] + d, 0)]
                ok = same | ~inside
                s, win = s[ok], win[ok]
            out.append((s, win))
            i = j
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _item_words(batches):
    for b in K.slices(batches, "text"):
        w = K.Words(b.column("text"), K.ALNUM)
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(w.counts), K.packed(w.hash, w.counts)], ["item", "n", "words"])


def _counting(shared, width):
    def run(batches):
        vocab = Windows(shared.value, None, width).vocab
        seen = np.zeros(len(vocab), np.int64)
        for b in K.slices(batches, "text"):
            h = K.Words(b.column("text"), K.ALNUM).hash
            if len(vocab) and len(h):
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                seen += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([K.signed(vocab[some]), pa.array(seen[some])], ["word", "n"])

    return run


def _matching(shared, counts, width, last):
    def run(batches):
        index = Windows(shared.value, counts.value, width)
        nothing = hashlib.sha256(b"").hexdigest()
        for b in K.slices(batches, "text"):
            w = K.Words(b.column("text"), K.ALNUM)
            s, win = index.found(w)
            doc = np.searchsorted(w.at, s, "right") - 1
            cover = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(cover, s, 1)
            np.add.at(cover, s + index.length[win], -1)
            items = [set(x) for x in b.column("items").to_pylist()]  # None stands for the items with null ids
            for d, i in np.unique(np.stack([doc, index.item[win]]), axis=1).T.tolist():
                items[d].add(index.items[i])
            for d, x in enumerate(b.column("spans").to_pylist()):  # what earlier blocks have found
                for lo, hi in np.frombuffer(x, np.int64).reshape(-1, 2) + w.at[d]:
                    cover[lo] += 1
                    cover[hi] -= 1
            hit = np.cumsum(cover[:-1]) > 0
            n_hit = np.bincount(w.owner()[hit], minlength=b.num_rows)
            ordered = [sorted(x - {None}) for x in items]
            carried = [c for c in b.schema.names if c not in ("doc_id", "text", "spans", "items")]
            if last:
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in ordered]
                cols = [b.column("doc_id"), pa.array(w.counts), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array(n_hit > 0), pa.array(ordered, pa.list_(pa.string()))]
                if carried:
                    cols += [b.column(c) for c in ("text", *carried)]
                    carried = ["text", *carried]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *carried])
                continue
            spans = []
            for d in range(b.num_rows):
                x = np.diff(np.concatenate([[0], hit[w.at[d] : w.at[d + 1]].astype(np.int8), [0]]))
                spans.append(np.stack([np.flatnonzero(x > 0), np.flatnonzero(x < 0)], axis=1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(spans, pa.binary()), pa.array([list(x) for x in items], pa.list_(pa.string())), *(b.column(c) for c in carried)], ["doc_id", "text", "spans", "items", *carried])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings) for every row of docs."""
    return _judged(texts(docs, id_col, text_col), benchmark, item_col, item_text_col, width, block_words)


def _judged(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As contamination, for doc_id and text; columns besides these two are carried along, and the text with them."""
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).mapInArrow(_item_words, "item string, n long, words binary").where("n > 0")
    total = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_words))
    out = docs.withColumns({"spans": F.lit(b"").cast("binary"), "items": F.array().cast("array<string>")})
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = sc.broadcast([(r["item"], bytes(r["words"])) for r in block.select("item", "words").collect()])
        seen = docs.select("text").mapInArrow(_counting(shared, width), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = sc.broadcast({r["word"]: r["n"] for r in seen.collect()})
        last = k == blocks - 1
        schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>" + (", text string" if carried else "") if last else "doc_id long, text string, spans binary, items array<string>"
        out = out.mapInArrow(_matching(shared, counts, width, last), schema + more)
    return out


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), {WIDTH}) AS m, array_to_string(ws[k:k + least(len(ws), {WIDTH}) - 1], ' ') AS w
        FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), {WIDTH}) + 2)) AS k FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS w
       FROM (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)),
hit AS (SELECT dw.doc_id, win.item, dw.k, dw.m FROM dw JOIN win ON dw.w = win.w AND dw.m = win.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all columns, in which no benchmark window occurs; each row is judged by its own text, whatever its id."""
    row = F.struct(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(c) for c in docs.columns]).alias("row")
    judged = _judged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row), benchmark, **options)
    return judged.where("not contaminated").select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
