"""Repeated passages by sparse suffix arrays.

Words (digits, letters, non-ASCII; A-Z in lower case) stand for a text. Of every
`window` consecutive runs of `seed` words, the one with the smallest hash is chosen;
the suffixes that begin there are the sparse suffix array. Since seed + window - 1 is
at most `min_words`, every passage of `min_words` words holds a chosen run wherever it
occurs, and the choice depends on its words alone.

Suffixes whose first run is unique have no neighbour that matches, so first only
(hash, document, place) travel, and just repeated ones go on. These carry the words
around them (`reach` to the left of the run and to its right, 4 bytes each). They are
sorted by run, then by the words that follow, in ranges over the whole cluster (a
frequent passage is spread over ranges), neighbours are compared, and the match is
extended word by word to the left and to the right. Across ranges, the last suffix
of one and the first of the next are compared as well. A match of `min_words` or more
counts in both places; overlapping matches of a document are merged.

A second sort, by run and then by the words before it, finds partners that agree on
the left. In a run with three suffixes or more, a place's only long partner may be nearest
in neither order. But no match reaches farther to one side than one with a neighbour in
the order of that side. Windows of `min_words` words that these limits allow and that no
match holds are hashed (64 bits) and joined with all equal windows of their run.

Null and empty texts and rows with null ids have no suffixes. Repeated rows with one
doc_id are the same document: a place is no repeat of itself. Texts under `min_words`
words have no matches. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .shared import small_batches, texts, written

MIN_WORDS, SEED = 50, 26


def chosen(words: K.Words, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the runs that are smallest in some window of their text; in a text of fewer runs, the smallest of all."""
    g, at = words.grams(seed)
    if not len(g):
        return g, at
    own = words.owner()[at]
    lo = np.searchsorted(own, own)
    hi = np.searchsorted(own, own, "right")
    rank = K.mix(g, 99)
    low, size = rank.copy(), 1
    while size < window:  # sliding minimum by doubling; may run over a text's end, which the choice below excludes
        step = min(size, window - size)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        size += step
    i = np.arange(len(g))
    pick = np.zeros(len(g), bool)
    whole = np.flatnonzero(i + window <= hi)
    for d in range(window):
        here = whole[rank[whole + d] == low[whole]]
        pick[here + d] = True
    short = (hi - lo) < window
    if short.any():
        s = np.flatnonzero(short)
        order = s[np.lexsort((rank[s], own[s]))]
        new = np.ones(len(order), bool)
        new[1:] = own[order][1:] != own[order][:-1]
        pick[order[new]] = True
    return g[pick], at[pick]


def _anchors(seed: int, window: int):
    def make(b: pa.RecordBatch) -> list:
        w = K.Words(b.column("text"), K.ALNUM)
        g, at = chosen(w, seed, window)
        own = w.owner()[at] if len(at) else at
        return [K.signed(g), pa.array(b.column("doc_id").to_numpy()[own]), pa.array((at - w.at[:-1][own]).astype(np.int32))]

    return K.per_slice("text", ["h", "doc_id", "pos"], make)


def _suffixes(seed: int, reach: int):
    """For each wanted place: the run's hash, and the words before it (nearest first) and after it, as 4-byte hashes; 0 is beyond the text."""

    def make(b: pa.RecordBatch) -> list:
        w = K.Words(b.column("text"), K.ALNUM)
        want = b.column("places")
        n = pc.list_value_length(want).to_numpy()
        own = np.repeat(np.arange(b.num_rows), n)
        pos = want.flatten().to_numpy().astype(np.int64)
        at = w.at[:-1][own] + pos
        tiny = np.append((w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
        d = np.arange(reach)
        left, right = at[:, None] - 1 - d, at[:, None] + seed + d
        left = tiny[np.where(left >= w.at[:-1][own][:, None], left, len(tiny) - 1)]
        right = tiny[np.where(right < w.at[1:][own][:, None], right, len(tiny) - 1)]
        g = K.runs(w.hash, seed)[at] if len(at) else np.zeros(0, np.uint64)
        size = np.full(len(at), reach)
        return [K.signed(g), K.packed(left.astype(">u4").ravel(), size), K.packed(right.astype(">u4").ravel(), size), pa.array(b.column("doc_id").to_numpy()[own]), pa.array(pos.astype(np.int32))]

    return K.per_slice("text", ["h", "before", "after", "doc_id", "pos"], make)


_OUT = "doc_id long, lo int, hi int, other long, kind int, part int, h long, before binary, after binary, pos int"
_NAMES = ["doc_id", "lo", "hi", "other", "kind", "part", "h", "before", "after", "pos"]


def _matches(t: pa.Table, a: np.ndarray, b: np.ndarray, seed: int, reach: int, min_words: int) -> pa.RecordBatch:
    """Matches of rows a with rows b, extended both ways; a row for either side."""
    doc, pos, h = (t.column(c).to_numpy() for c in ("doc_id", "pos", "h"))
    ok = (h[a] == h[b]) & ((doc[a] != doc[b]) | (pos[a] != pos[b]))
    a, b = a[ok], b[ok]
    ext = []
    for c in ("before", "after"):
        x = np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(-1, reach)
        same = (x[a] == x[b]) & (x[a] != 0)
        ext.append(np.logical_and.accumulate(same, axis=1).sum(axis=1))
    ok = ext[0] + ext[1] + seed >= min_words
    a, b, l, r = a[ok], b[ok], ext[0][ok], ext[1][ok]
    x, y, l, r = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([l, l]), np.concatenate([r, r])
    null = lambda kind: pa.nulls(len(x), kind)
    return pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array((pos[x] - l).astype(np.int32)), pa.array((pos[x] + seed + r).astype(np.int32)), pa.array(doc[y]), pa.array(np.zeros(len(x), np.int32)), null(pa.int32()), null(pa.int64()), null(pa.binary()), null(pa.binary()), pa.array(pos[x].astype(np.int32))], names=_NAMES)


def _limits(t: pa.Table, side: int, reach: int, ends: tuple) -> tuple[pa.RecordBatch, tuple]:
    """How far any match can go to one side (lo; kind 3 before, 4 after) of all rows but the last, unless a neighbour shows all of that; ends: the last row's extents, as they are known."""
    doc, pos, h = (t.column(c).to_numpy() for c in ("doc_id", "pos", "h"))
    x = [np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(-1, reach) for c in ("before", "after")]
    ok = (h[1:] == h[:-1]) & ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))
    near, far = (np.logical_and.accumulate((y[1:] == y[:-1]) & (y[1:] != 0) & ok[:, None], axis=1).sum(axis=1) for y in (x[side], x[1 - side]))
    near, far = np.append(ends[0], near), np.append(ends[1], far)  # with the row before; with the next row one later
    room = (x[1 - side] != 0).sum(axis=1)[:-1]
    limit = np.maximum(near[:-1], near[1:])
    shown = ((near[:-1] == limit) & (far[:-1] == room)) | ((near[1:] == limit) & (far[1:] == room))
    i = np.flatnonzero(~shown & (limit + room >= reach))
    null = lambda kind: pa.nulls(len(i), kind)
    row = [pa.array(doc[i]), pa.array(limit[i].astype(np.int32)), null(pa.int32()), null(pa.int64()), pa.array(np.full(len(i), 3 + side, np.int32)), null(pa.int32()), pa.array(h[i]), null(pa.binary()), null(pa.binary()), pa.array(pos[i])]
    return pa.RecordBatch.from_arrays(row, names=_NAMES), (near[-1], far[-1])


def _neighbours(seed: int, reach: int, min_words: int, side: int):
    cols = ["h", "before", "after", "doc_id", "pos"]

    def edge(t: pa.Table, kind: int) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        v = {c: t.column(c)[0].as_py() for c in cols}
        row = {"doc_id": v["doc_id"], "kind": kind, "part": part, "h": v["h"], "before": v["before"], "after": v["after"], "pos": v["pos"], "lo": reach, "hi": None, "other": None}
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(_NAMES, types, strict=True)], names=_NAMES)

    def run(batches):
        last, ends = None, (reach, -1)
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(cols)
            if last is None:
                yield edge(t, 1)
            else:
                t = pa.concat_tables([last, t])
            i = np.arange(t.num_rows - 1)
            yield _matches(t, i, i + 1, seed, reach, min_words)
            limits, ends = _limits(t, side, reach, ends)
            yield limits
            last = t.slice(t.num_rows - 1)
        if last is not None:
            yield edge(last, 2)

    return run


def _pairwise(seed: int, reach: int, min_words: int):
    def run(batches):
        for b in batches:
            left = pa.table({c: b.column(f"x{c}") for c in ("h", "before", "after", "doc_id", "pos")})
            right = pa.table({c: b.column(c) for c in ("h", "before", "after", "doc_id", "pos")})
            n = b.num_rows
            yield _matches(pa.concat_tables([left, right]), np.arange(n), np.arange(n) + n, seed, reach, min_words)

    return run


def _windows(seed: int, reach: int, only_open: bool):
    """Hash, document and first word of each window around a run that a match (lo, hi in `cover`) holds or that the limits allow; open: no match holds it."""

    def make(b: pa.RecordBatch) -> list:
        before, after = (np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(-1, reach).astype(np.uint64) for c in ("before", "after"))
        pos = b.column("pos").to_numpy().astype(np.int64)
        cover = pc.fill_null(b.column("cover"), pa.scalar([], b.column("cover").type))
        own = np.repeat(np.arange(len(pos)), pc.list_value_length(cover).to_numpy())
        lo, hi = (cover.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
        first, last = np.maximum(reach - (hi - pos[own] - seed), 0), np.minimum(pos[own] - lo, reach)  # words to the left of the run in the windows that a match holds
        held = np.zeros((len(pos), reach + 2), np.int64)
        np.add.at(held, (own, first), 1)
        np.add.at(held, (own, last + 1), -1)
        held = np.cumsum(held, axis=1)[:, : reach + 1] > 0
        most = [pc.fill_null(b.column(c), -1).to_numpy().astype(np.int64)[:, None] for c in ("most_before", "most_after")]
        wanted = ~held & (np.arange(reach + 1) <= most[0]) & (reach - np.arange(reach + 1) <= most[1])
        left, right = [K.mix(b.column("h").to_numpy().view(np.uint64), 51)], [np.zeros(len(pos), np.uint64)]
        for d in range(reach):
            left.append(K.mix(left[-1] + before[:, d], 52))
            right.append(K.mix(right[-1] + after[:, d], 53))
        w = np.stack([K.mix(left[d] ^ right[reach - d], 54) for d in range(reach + 1)], axis=1)
        d = np.arange(reach + 1)
        n_left, n_right = (before != 0).sum(axis=1), (after != 0).sum(axis=1)
        ok = (d <= n_left[:, None]) & (reach - d <= n_right[:, None])
        x, d = np.nonzero(ok & wanted if only_open else ok & (wanted | held))
        return [K.signed(w[x, d]), pa.array(b.column("doc_id").to_numpy()[x]), pa.array((pos[x] - d).astype(np.int32)), pa.array(wanted[x, d])]

    return K.per_slice("before", ["w", "doc_id", "lo", "open"], make)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, other_doc_id: every stretch of a document that is covered by passages of at least min_words words which occur elsewhere too; the smallest doc_id that it was matched with."""
    small_batches(docs.sparkSession)
    window = min_words - seed + 1
    reach = window - 1
    docs = texts(docs, id_col, text_col).where("doc_id is not null")
    anchors = written(docs.mapInArrow(_anchors(seed, window), "h long, doc_id long, pos int"), "anchors")
    often = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")  # a table of its own, so that the join below can split a hot run
    places = anchors.join(often, "h", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    suffix = written(docs.join(places, "doc_id").mapInArrow(_suffixes(seed, reach), "h long, before binary, after binary, doc_id long, pos int"), "suffixes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, covers, limits = [], [], []
    for side, keys in ((1, ["h", "after", "before", "doc_id", "pos"]), (0, ["h", "before", "after", "doc_id", "pos"])):
        near = written(suffix.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_neighbours(seed, reach, min_words, side), _OUT), "matches")
        found.append(near.where("kind = 0").select("doc_id", "lo", "hi", "other"))
        covers.append(near.where("kind = 0").select("doc_id", "pos", "lo", "hi"))
        limits.append(near.where("kind > 0").groupBy("doc_id", "pos").agg(F.first("h").alias("h"), F.max("lo").alias(("most_before", "most_after")[side])))  # edges of a range: no limit is known
        edges = near.where("kind in (1, 2)").select("part", "kind", "h", "before", "after", "doc_id", "pos")  # two rows a range
        w = Window.orderBy("part", "kind")  # in one task: two rows for each of `parts` ranges, whatever the data
        across = edges.select("*", *[F.lag(c).over(w).alias(f"x{c}") for c in ("kind", "h", "before", "after", "doc_id", "pos")]).where("kind = 1 and xkind = 2")
        found.append(across.mapInArrow(_pairwise(seed, reach, min_words), _OUT).select("doc_id", "lo", "hi", "other"))
    all_found = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])

    # windows that neighbours did not show, where a run has more suffixes than two; matches across ranges needn't count as cover
    cover = covers[0].unionByName(covers[1]).groupBy("doc_id", "pos").agg(F.collect_set(F.struct("lo", "hi")).alias("cover"))
    rest = limits[0].join(limits[1].drop("h"), ["doc_id", "pos"]).where(f"most_before + most_after >= {reach}").join(often.where("n > 2"), "h", "left_semi").join(cover, ["doc_id", "pos"], "left")
    rest = written(rest.where(f"cover is null or not exists(cover, x -> pos - x.lo >= most_before and x.hi - pos - {seed} >= most_after)").select("h", "doc_id", "pos", "most_before", "most_after"), "rest")
    runs = written(rest.select("h").distinct(), "runs")  # so that the join can split a hot run
    crowd = suffix.join(runs, "h", "left_semi").join(cover, ["doc_id", "pos"], "left").join(rest.drop("h"), ["doc_id", "pos"], "left")
    crowd = written(crowd.select("h", "before", "after", "doc_id", "pos", "cover", "most_before", "most_after"), "crowd")
    windows = lambda only_open: crowd.mapInArrow(_windows(seed, reach, only_open), "w long, doc_id long, lo int, open boolean")
    place = F.struct("doc_id", "lo")
    equal = windows(False).groupBy("w").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.bool_or("open").alias("open"))
    equal = written(equal.where("open and a <> b").select("w", "a", "b"), "windows")  # so that the join can split a hot window
    other = F.when(place == F.col("a"), F.col("b.doc_id")).otherwise(F.col("a.doc_id"))
    shown = windows(True).join(equal, "w").select("doc_id", "lo", (F.col("lo") + min_words).alias("hi"), other.alias("other"))
    all_found = all_found.unionByName(shown)
    spans = all_found.groupBy("doc_id", "lo", "hi").agg(F.min("other").alias("other"))
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    part = spans.withColumn("far", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("g", F.sum(F.when(F.col("far") >= F.col("lo"), 0).otherwise(1)).over(w))
    merged = part.groupBy("doc_id", "g").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"), F.min("other").alias("other_doc_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id")
