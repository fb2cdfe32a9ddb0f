"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

A document is its token ids and a final 0. One longer than the capacity is cut
into capacity-sized pieces, of which the first may be shorter. Each piece is an
item with three sizes: tokens, one document, and attention cost (tokens squared).

*Vector best-fit.* Items are taken from long to short. Of the bins that have room
for an item under all three capacities, the one with the smallest value gets it:
the weighted dot product of the item's sizes and the bin's residual capacities,
each as a share of its capacity (score="dot": the least room), or the weighted norm
of what would be left (score="norm": the least waste). If no bin
has room, the item opens one. By default only tokens count (no document or attention
capacity, their weights 0), since then the fewest sequences come out.

*Scale.* An item is determined by its length, so there are at most `capacity`
kinds of items, and best fit only needs their counts: a table of at most
`capacity` rows, whatever the corpus. Bins with equal contents are one kind of
bin with a count. The result is a plan: for each length, which ranks (first,
second, ... piece of that length) go to which bins. Every piece gets its rank in
Spark and looks up its bin in the plan, which is broadcast (its size depends on the
capacity alone). Ranks are counted in cells of a length and a hash of the document,
as many for a length as its share of the rows asks for, so one very frequent length
is spread over all tasks.

Texts go through the tokenizer once; the pieces (no texts, no ids) are written.
Null texts are empty documents (one token, the final 0); rows with a null id
take part; repeated rows are packed each. An empty table gives no rows. Other
columns are not looked at. Very long texts give many pieces. Ids are those of the
tokenizers library (no special tokens added, but a special token's name in a text is
that token), also for texts that are mostly white space.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, texts, written

CAPACITY, VOCABULARY = 2048, "byte_bpe_50k"
_BLANK = re.compile(r"\s{300}")


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """The ids of the tokenizers library's file, from the same vocabulary's ranks by a library that is several times as fast.

    That one's pattern matching takes time quadratic in a run of white space, and stack in very long ones; texts with
    runs of 300 go to the first one.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = {t.content: i for i, t in plain.get_added_tokens_decoder().items()}
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) >= 300 and _BLANK.search(text):
            return plain.encode(text, add_special_tokens=False).ids
        if any(x in text for x in special):
            return fast.encode(text, allowed_special="all", disallowed_special=())
        return fast.encode_ordinary(text)

    return encode


def _cutting(capacity: int, vocabulary: str, end: int):
    def run(batches):
        encode, known = _encoder(vocabulary), {}
        for b in K.slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = text or ""
                got = known.get(text)
                if got is None:
                    ids = np.array([*encode(text), end], "<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    got = [(s, e - s, zlib.crc32(ids[s:e].tobytes())) for s, e in zip(cuts, cuts[1:], strict=False)]
                    if len(text) < 20_000:
                        if len(known) > 500:
                            known.clear()
                        known[text] = got
                for k, (s, n, crc) in enumerate(got):
                    for col, v in zip(out, (doc, k, s, n, crc), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def vector_best_fit(counts: dict[int, int], capacity: int = CAPACITY, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> list[tuple[dict[int, int], int]]:
    """(contents, number of bins): contents are length -> pieces of that length in each bin.

    counts: pieces of each length, 1 to capacity. Without a document or attention
    capacity, those never bind (every piece has a token; squares of parts add up to
    less than the square of the whole).
    """
    full = np.array([capacity, max_documents or capacity, max_attention or capacity * capacity], float)
    w = np.asarray(weights, float)
    if score not in ("dot", "norm"):
        raise ValueError(f"unknown score {score!r}")
    if counts and (min(counts) < 1 or max(counts) > capacity or (max(counts) ** 2 > full[2])):
        raise ValueError("a piece exceeds a capacity by itself")
    kinds: list[dict[int, int]] = []
    room, have = np.zeros((64, 3)), np.zeros(64, np.int64)

    def add(contents: dict[int, int], left: np.ndarray, n: int) -> None:
        nonlocal room, have
        same = np.flatnonzero((room[: len(kinds)] == left).all(axis=1) & (have[: len(kinds)] > 0))
        for i in same:
            if kinds[i] == contents:
                have[i] += n
                return
        if len(kinds) == len(have):
            room, have = np.concatenate([room, np.zeros_like(room)]), np.concatenate([have, np.zeros_like(have)])
        room[len(kinds)], have[len(kinds)] = left, n
        kinds.append(contents)

    for length in sorted(counts, reverse=True):
        size, todo = np.array([length, 1, length * length], float), counts[length]
        while todo:
            k = len(kinds)
            fits = (have[:k] > 0) & (room[:k] >= size).all(axis=1)
            if not fits.any():
                many = int(min(full // size))  # as many into each new bin as best fit itself would add, one after another
                if todo >= many:
                    add({length: many}, full - many * size, todo // many)
                    todo %= many
                else:
                    add({length: todo}, full - todo * size, 1)
                    todo = 0
                continue
            at = np.flatnonzero(fits)
            left = (room[at] - size) / full
            value = (left * left * w).sum(axis=1) if score == "norm" else (room[at] / full * (size / full) * w).sum(axis=1)
            i = int(at[value.argmin()])
            per = max(1, int(min(room[i] // size))) if todo > 1 else 1
            bins = int(min(have[i], max(1, todo // per)))
            per = min(per, todo)
            have[i] -= bins
            add({**kinds[i], length: kinds[i].get(length, 0) + per}, room[i] - per * size, bins)
            todo -= bins * per
    return [(c, int(n)) for c, n in zip(kinds, have[: len(kinds)], strict=True) if n]


def _plan(bins: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, rows in order of rank: first rank, pieces in each bin, first sequence, place of the first such piece."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for contents, n in bins:
        offset = 0
        for length, per in contents.items():
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, per, sequence, offset))
            ranks[length] = rank + n * per
            offset += length * per
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def _placing(shared):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, per, sequence, offset = shared.value[int(n)]
                i = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[i]
                seq[at], off[at] = sequence[i] + k // per[i], offset[i] + k % per[i] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm", vocabulary: str = VOCABULARY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    small_batches(spark)
    ints = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = written(texts(docs, id_col, text_col).mapInArrow(_cutting(capacity, vocabulary, end), ints), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(_plan(vector_best_fit(counts, capacity, max_documents, max_attention, weights, score)))

    cell_rows = max(1, sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cells = spark.createDataFrame([(k, max(1, -(-n // cell_rows))) for k, n in counts.items()], "length long, cells long")
    salted = pieces.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells")))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", within.cast("long") - 1).join(base, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placing(plan), f"{ints}, sequence_id long, offset long")
