"""Fill-in-middle: whole texts are cut in three, marked by sentinels and put in another order, and restored exactly.

A text is cut into units, runs of ASCII letters and single other code points. Two cuts
drawn by hash split it into prefix, middle and suffix. Its bytes go into one bytearray,
sentinels are inserted before each part, and neighbouring blocks change places in place by three reversals
(of one block, of the other, of both together), so nothing but that array is needed
for a text. `restored` finds the sentinels, rotates back and takes them out.

Forms: psm is ``<P>prefix<S>suffix<M>middle``, spm is ``<S>suffix<P>prefix<M>middle``, and
plain is the text itself. Empty texts, null ones (which count as empty) and those that hold a
sentinel are plain, so in the other forms each sentinel occurs once: it begins with a
character that it has only once, hence text around it cannot make another one.

The draw is the SHA-256 of the seed, a colon and the decimal doc_id (nothing for a null one),
so repeated rows give repeated results, and rows of one id are cut by the same draws.
An empty table gives no rows. Only doc_id and text are looked at; other columns can't clash.
Texts go through tasks in slices of half a megabyte; a longer one is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, texts

SENTINELS = ("<P>", "<S>", "<M>")
_LETTER = ((np.arange(256) >= 65) & (np.arange(256) <= 90)) | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_INSIDE = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)  # a code point's second and later bytes
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(view: np.ndarray, low: int, high: int) -> None:
    """Turns view[low:high] around in place."""
    half = (high - low) // 2
    left = view[low : low + half].copy()
    view[low : low + half] = view[high - half : high][::-1]
    view[high - half : high] = left[::-1]


def rotate(view: np.ndarray, low: int, middle: int, high: int) -> None:
    """Exchanges the blocks [low, middle) and [middle, high) in place, by three reversals."""
    reverse(view, low, middle)
    reverse(view, middle, high)
    reverse(view, low, high)


def arranged(text: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text cut at two byte places, in the order of the form."""
    p, s, m = marks
    buffer = bytearray(text)
    for at, mark in ((second, s), (first, m), (0, p)):
        buffer[at:at] = mark
    a, b, end = len(p) + first, len(p) + len(m) + second, len(buffer)
    view = np.frombuffer(buffer, np.uint8)  # prefix [0, a), middle [a, b), suffix [b, end)
    rotate(view, a, b, end)
    if form == "spm":
        rotate(view, 0, a, a + end - b)
    return bytes(view)


def undone(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that `arranged` was given, from its output and form alone."""
    p, s, m = marks
    buffer = bytearray(output)
    view = np.frombuffer(buffer, np.uint8)
    end = len(buffer)
    if form == "spm":
        prefix, middle = buffer.find(p), buffer.find(m)
        rotate(view, 0, prefix, middle)
        a = middle - prefix
    else:
        a, middle = buffer.find(s), buffer.find(m)
    rotate(view, a, middle, end)
    b = a + end - middle
    del view
    for at, mark in ((b, s), (a, m), (0, p)):
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def units(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, where each text begins and the last ends, the first byte of every unit, and the number of units before each text."""
    data, at = K.raw(texts_)
    letter = _LETTER[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[at[:-1][at[:-1] < len(data)]] = False
    start = np.flatnonzero(~inner & ~_INSIDE[data])
    return data, at, start, np.searchsorted(start, at)


def _text_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _transforming(marks: tuple[bytes, bytes, bytes], plain: int, spm: int):
    def make(b: pa.RecordBatch) -> list:
        data, at, start, of = units(b.column("text"))
        points = np.concatenate([[0], np.cumsum(~_INSIDE[data])])
        n = np.diff(of)
        h = [b.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
        cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
        start = np.append(start, len(data))
        whole = data.tobytes()
        forms, prefix, middle, out = [], [], [], []
        for i in range(b.num_rows):
            text = whole[at[i] : at[i + 1]]
            if not text or h[2][i] % 100 >= 100 - plain or any(m in text for m in marks):
                forms.append("plain"), prefix.append(None), middle.append(None), out.append(text)
                continue
            form = "spm" if h[3][i] % 100 < spm else "psm"
            first, second = (int(at[i + 1] if c[i] == n[i] else start[of[i] + c[i]]) for c in cuts)
            forms.append(form)
            prefix.append(int(points[first] - points[at[i]]))
            middle.append(int(points[second] - points[first]))
            out.append(arranged(text, first - int(at[i]), second - int(at[i]), form, marks))
        return [b.column("doc_id"), n, forms, pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _text_column(out)]

    return make


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """A row a document: n units, form, lengths of prefix and middle in code points (null if plain), output."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    marks = tuple(s.encode() for s in sentinels)
    rows = texts(docs).select("doc_id", "text", *draws)
    return rows.mapInArrow(K.per_slice("text", [c.split()[0] for c in OUT.split(", ")], _transforming(marks, plain_percent, spm_percent)), OUT)


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of `fill_in_middle` with a column restored: the text again, from output and form."""
    marks = tuple(s.encode() for s in sentinels)

    def make(b: pa.RecordBatch) -> list:
        data, at = K.raw(b.column("output"))
        whole, forms = data.tobytes(), b.column("form").to_pylist()
        each = [whole[at[i] : at[i + 1]] for i in range(b.num_rows)]
        return [*b.columns, _text_column([t if f == "plain" else undone(t, f, marks) for t, f in zip(each, forms, strict=True)])]

    return rows.mapInArrow(K.per_slice("output", [*rows.columns, "restored"], make), rows.withColumn("restored", F.lit("")).schema)


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: SHA-256 of output and of what is restored from it."""
    sums = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return restored(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sums)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS d FROM t),
c AS (SELECT *, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
