"""Substring de-duplication by sliding sentence spans.

Words are digits, letters and non-ASCII; A-Z count as a-z. A sentence ends where a
mark (. ! ?) and white space, or a line end, stand between two words, whatever
symbols stand there too. Texts without such marks have sentences as well: one of more
than `long` words, and no other, is cut after words that a rule on their first and last
byte chooses (so copies are cut alike), and its pieces are cut every `most` words.

Every shortest run of consecutive sentences with at least `min_words` words, from each
sentence on and up to each sentence, is hashed and joined over all documents; two runs
are equal if their words are. A text of fewer words is one run. So a passage that repeats
is covered by its runs as far as its whole sentences go, if these have `min_words` words.
A run counts if it stands at two places, in two documents or in one (`across`: in two
only). Its first place, by doc_id and then place, stays; the sentences under any other
place go, where places overlap too: of a sentence said over and over one stays.

The hashes (one row a run, no text) are written once. The first document of a run is a
minimum of longs, combined before the shuffle, so a run that very many documents hold
is one row a task, and the join with the places can be split. Null texts and rows with
null ids give nothing; texts without words have no runs. Texts may be of any length.
Repeated rows with one doc_id are that document again: equal places are no repeats. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, texts, written

MIN_WORDS, LONG, MOST = 40, 16, 8
_MARKS = np.zeros(256, bool)
_MARKS[[ord(x) for x in ".!?"]] = True


def _since(flags: np.ndarray) -> np.ndarray:
    """For each place, how far the last flag lies behind it; the first place has one."""
    at = np.flatnonzero(flags)
    return np.arange(len(flags)) - np.repeat(at, np.diff(np.append(at, len(flags))))


class Sentences:
    """The sentences of some texts: number of words, byte span; ``at`` says where each text's begin."""

    def __init__(self, column: pa.Array, long: int = LONG, most: int = MOST):
        w = self.of = K.Words(column, K.ALNUM)
        own, d = w.owner(), w.data
        n = len(own)
        new = np.ones(n, bool)
        if n:
            between = lambda is_it: (c := np.concatenate([[0], np.cumsum(is_it)]))[w.start[1:]] > c[w.end[:-1]]
            ends = between(_MARKS[d]) & between(~K.SPACED[d]) | between(d == 10)
            new[1:] = ends | (own[1:] != own[:-1])
            size = np.diff(np.append(np.flatnonzero(new), n))
            first, last = d[w.start].astype(np.int64), d[w.end - 1].astype(np.int64)
            for b in (first, last):
                b += 32 * ((b >= 65) & (b <= 90))
            cut = np.repeat(size > long, size)
            new[1:] |= (cut & ((first + 3 * last) % 5 == 0))[:-1]
            new |= cut & (_since(new) % most == 0)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], n) if n else self.first
        self.words = self.last - self.first
        self.at = np.searchsorted(own[self.first], np.arange(len(column) + 1))
        self.start, self.end = (w.start[self.first], w.end[self.last - 1]) if n else (self.first, self.first)
        self.text_at = w.text_at

    def runs(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, last sentence (numbers over all texts) and hash of every shortest run of so many words, and of whole shorter texts."""
        text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        c = np.concatenate([[0], np.cumsum(self.words)])
        here = np.arange(len(text))
        to = np.searchsorted(c, c[:-1] + min_words) - 1
        back = np.searchsorted(c, c[1:] - min_words, "right") - 1
        i, j = np.concatenate([here, back]), np.concatenate([to, here])
        ok = (i >= 0) & (j < len(text))
        i, j = i[ok], j[ok]
        same = text[i] == text[j]
        size = c[self.at[1:]] - c[self.at[:-1]]
        whole = (size > 0) & (size < min_words)
        i, j = np.concatenate([i[same], self.at[:-1][whole]]), np.concatenate([j[same], self.at[1:][whole] - 1])
        i, j = np.divmod(np.unique(i * len(text) + j), max(1, len(text)))
        h = self.of.hash
        up, down = K._powers(len(h) + 1)
        s = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=s[1:])
        a, b = self.first[i], self.last[j]
        return i, j, K.mix((s[b] - s[a]) * down[a] + (b - a).astype(np.uint64), 61)


def _spans(min_words: int, long: int, most: int):
    def make(b: pa.RecordBatch) -> list:
        s = Sentences(b.column("text"), long, most)
        i, j, h = s.runs(min_words)
        text = np.searchsorted(s.at, i, "right") - 1
        base = s.at[text]
        return [K.signed(h), b.column("doc_id").to_numpy()[text], (i - base).astype(np.int32), (j - base).astype(np.int32)]

    return K.per_slice("text", ["h", "doc_id", "i", "j"], make)


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_words: int = MIN_WORDS,
    long: int = LONG,
    most: int = MOST,
    across: bool = False,
) -> DataFrame:
    """doc_id, i, j, first_doc_id, is_first: every place (sentences i to j) of a run with two places; with across, in two documents."""
    small_batches(docs.sparkSession)
    docs = texts(docs, id_col, text_col).where("doc_id is not null")
    spans = docs.mapInArrow(_spans(min_words, long, most), "h long, doc_id long, i int, j int")
    spans = written(spans, "spans")
    held = spans.groupBy("h").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    held = held.where(f"first_doc_id < last_doc_id or lo < hi and not {str(across).lower()}").select("h", "first_doc_id")
    held = written(held, "held")  # so that the join can split a hot run
    places = written(spans.join(held, "h"), "places")
    # only the first document's own places can be first
    first = places.where("doc_id = first_doc_id").groupBy("h").agg(F.min("i").alias("first_i"))
    own = places.where("doc_id = first_doc_id").join(first, "h").select("doc_id", "i", "j", "first_doc_id", F.expr("i = first_i").alias("is_first"))
    other = places.where("doc_id <> first_doc_id").select("doc_id", "i", "j", "first_doc_id", F.lit(False).alias("is_first"))
    return own.unionByName(other)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, removed (sentence numbers, in order), n_removed, first_doc_ids: a row for each document with a repeated run.

    A document that holds only first places loses nothing (removed is empty); first_doc_ids
    are the documents with the first places of what goes.
    """
    found = repeated_spans(docs, id_col, text_col, **options)
    per = found.groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("is_first"), F.struct("i", "j"))).alias("runs"),
        F.array_sort(F.collect_set(F.when(~F.col("is_first"), F.col("first_doc_id")))).alias("first_doc_ids"),
    )
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["i"], x["j"])))))
    return per.select("doc_id", gone.alias("removed"), "first_doc_ids").withColumn("n_removed", F.size("removed").cast("long"))


def _cut(long: int, most: int):
    def make(b: pa.RecordBatch) -> list:
        s, out = Sentences(b.column("text"), long, most), []
        rows = zip(b.column("text").to_pylist(), b.column("removed").to_pylist(), strict=True)
        for k, (text, removed) in enumerate(rows):
            if not removed or text is None:
                out.append(text)
                continue
            raw, keep, at = text.encode(), [], 0
            edge = np.append(s.start[s.at[k] : s.at[k + 1]] - s.text_at[k], len(raw))
            for i in removed:
                keep.append(raw[at : edge[i]])
                at = edge[i + 1]
            out.append(b"".join([*keep, raw[at:]]).decode(errors="ignore"))
        return [b.column("doc_id"), pa.array(out, pa.string())]

    return K.per_slice("text", ["doc_id", "text"], make)


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_words: int = MIN_WORDS,
    long: int = LONG,
    most: int = MOST,
    across: bool = False,
) -> DataFrame:
    """doc_id, text: all documents, texts without the removed sentences."""
    gone = repeats(docs, id_col, text_col, min_words=min_words, long=long, most=most, across=across)
    gone = gone.where("n_removed > 0").select("doc_id", "removed")
    return texts(docs, id_col, text_col).join(gone, "doc_id", "left").mapInArrow(_cut(long, most), "doc_id long, text string")


_N = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
SQL = rf"""
WITH p AS (SELECT doc_id, k, regexp_extract_all(part, '[^{_N}]+') AS w
  FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k
        FROM (SELECT doc_id, string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[{_N}]*(\n|[.!?][{_N}]*[\t-\r ]|[\t-\r ][{_N}]*[.!?])[{_N}]*', chr(10), 'g'), chr(10)) AS parts
              FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))),
x AS (SELECT doc_id, k, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS r FROM p WHERE len(w) > 0),
c AS (SELECT *, n > {LONG} AND (CAST('0x' || left(hex(w), 2) AS INTEGER) + 3 * CAST('0x' || right(hex(w), 2) AS INTEGER)) % 5 = 0 AS chosen FROM x),
y AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY r) AS piece
      FROM (SELECT *, coalesce(lag(chosen) OVER (PARTITION BY doc_id, k ORDER BY r), false) AS b FROM c)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, piece ORDER BY r) - 1 AS q FROM y),
v AS (SELECT doc_id, w, k, r, CAST(sum(CASE WHEN q = 0 OR n > {LONG} AND q % {MOST} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k, r) - 1 AS INTEGER) AS i FROM z),
s AS (SELECT doc_id, i, string_agg(w, ' ' ORDER BY k, r) AS t, count(*) AS n FROM v GROUP BY doc_id, i),
u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM s),
e AS (SELECT a.doc_id, a.i, b.i AS j, b.c - a.c + a.n AS n, min(b.i) OVER (PARTITION BY a.doc_id, a.i) AS lo, max(a.i) OVER (PARTITION BY a.doc_id, b.i) AS hi
      FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {MIN_WORDS} AND b.c - a.c + a.n >= {MIN_WORDS}),
l AS (SELECT doc_id, list(t ORDER BY i) AS t FROM s GROUP BY doc_id),
b AS (SELECT doc_id, i, j FROM e WHERE j = lo OR i = hi UNION ALL SELECT doc_id, 0, max(i) FROM u GROUP BY doc_id HAVING max(c) < {MIN_WORDS}),
g AS (SELECT b.doc_id, i, j, array_to_string(l.t[i + 1:j + 1], ' ') AS run FROM b JOIN l ON b.doc_id = l.doc_id),
o AS (SELECT *, first_value(doc_id) OVER f AS fd, first_value(i) OVER f AS fi, max(doc_id) OVER (PARTITION BY run) AS ld,
             min(i) OVER (PARTITION BY run) < max(i) OVER (PARTITION BY run) AS apart
      FROM g WINDOW f AS (PARTITION BY run ORDER BY doc_id, i)),
h AS (SELECT doc_id, (doc_id, i) <> (fd, fi) AS goes, i, j, fd FROM o WHERE fd < ld OR apart),
m AS (SELECT doc_id, unnest(range(i, j + 1)) AS gone, fd FROM h WHERE goes),
n AS (SELECT doc_id, list_sort(list_distinct(list(CAST(gone AS INTEGER)))) AS removed, list_sort(list_distinct(list(fd))) AS first_doc_ids, count(DISTINCT gone) AS n_removed
      FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(removed, CAST([] AS INTEGER[])) AS removed, coalesce(first_doc_ids, CAST([] AS BIGINT[])) AS first_doc_ids, coalesce(n_removed, 0) AS n_removed
FROM (SELECT DISTINCT doc_id FROM h) d LEFT JOIN n ON d.doc_id = n.doc_id
"""
