"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Words are what white space separates, A-Z in lower case. A document is the set
of its distinct 5-word shingles (fewer words: the whole sequence is its one
shingle; no words: the empty set). Two documents are linked when
100 * |A & B| >= 75 * |A | B|; the groups are the connected components.

1. *Classes.* Documents with the same set are one class; its smallest doc_id
   stands for it, so copies cost one row each and no pair.
2. *Sketch.* `coordinates` bins. In round r every shingle is thrown into a
   hashed bin with a hashed value, and a bin keeps its smallest value of the
   first round that reached it; from round `coordinates` on, round r throws
   everything into bin r - coordinates, so all bins fill. Large sets fill up in
   one round, so a sketch costs about one hash a shingle.
3. *Banding.* `bands` keys of `rows` coordinates each. At the threshold 0.75 two
   sets share a band with probability 0.42, and less than `least` of 40 bands
   with probability below 2e-7 (the bands are the only step that is not exact).
4. *Links.* A candidate pair shares `least` bands. First every class is compared
   with the one other member that it shares most bands with among the first of
   its buckets; the components of the confirmed links are formed; then, in each
   bucket, what is left to compare are members of different components: a member
   outside the bucket's largest component against all members of others. Pairs
   within a component are never made, so a group of thousands of near copies
   gives about as many pairs as members. All pairs are confirmed on full sets.

Null ids are dropped (they can't be linked or returned as a row of a document);
null and empty texts have the empty set and are alone; rows that repeat a doc_id are
that document again, each with its own n_shingles, and if their sets differ, the one
with the smallest hash decides on the links of all of them. An empty table
gives no rows. Columns other than the two named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import components, contains, let_go, marked, small_batches, texts, written

BANDS, ROWS, LEAST, PERCENT, WIDTH = 40, 3, 3, 75, 5
COORDINATES, BLOCK = 1024, 2048
_U = np.uint64


def sketch(owner: np.ndarray, shingle: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t coordinates (uint32) of the sets given by (owner, shingle); empty sets stay at the top value."""
    top = np.uint64(2**64 - 1)
    out = np.full(n * t, top)
    counts = np.bincount(owner, minlength=n)
    full = counts == 0
    for r in range(2 * t):
        if r and full.all():
            break
        if r:
            live = ~full[owner]
            owner, shingle = owner[live], shingle[live]
        h = K.mix(shingle, 5000 + r)
        bin_ = (h % _U(t)).astype(np.int64) if r < t else np.full(len(h), r - t)
        # the round counts before the value, so that a bin keeps its earliest round
        np.minimum.at(out, owner * t + bin_, (_U(r) << _U(48)) | (h >> _U(16)))
        full |= (out.reshape(n, t) < top).all(axis=1)
    return (K.mix(out, 3) >> _U(32)).astype(np.uint32).reshape(n, t)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, the 128-bit identity of the set (s1, s2) and its band keys (keys, 8 bytes each)."""

    def make(b: pa.RecordBatch) -> list:
        words = K.Words(b.column("text"))
        n, t = b.num_rows, bands * rows
        owner, sh = K.shingles(words, width)
        s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(s1, owner, K.mix(sh, 21))
        np.add.at(s2, owner, K.mix(sh, 22))
        k = sketch(owner, sh, n, t).astype(np.uint64).reshape(n, bands, rows)
        key = np.broadcast_to(K.mix(np.arange(bands, dtype=np.uint64), 77), (n, bands)).copy()
        for j in range(rows):
            key = K.mix(key ^ k[:, :, j], 300 + j)
        return [b.column("doc_id"), np.bincount(owner, minlength=n).astype(np.int64), K.signed(s1), K.signed(s2), K.packed(key.ravel(), np.full(n, bands))]

    names = ["doc_id", "n_shingles", "s1", "s2", "keys"]
    return docs.mapInArrow(K.per_slice("text", names, make), "doc_id long, n_shingles long, s1 long, s2 long, keys binary")


def shingle_sets(docs: DataFrame, width: int = WIDTH, wanted=None) -> DataFrame:
    """doc_id, a hash of its set (s1, as in signatures) and its sorted distinct shingle hashes as 8-byte items (grams).

    wanted: a broadcast bitmap of the ids to take (and maybe a few others).
    """

    def make(b: pa.RecordBatch) -> list:
        if wanted is not None:
            b = b.filter(pa.array(contains(wanted.value, b.column("doc_id").to_numpy())))
        owner, sh = K.shingles(K.Words(b.column("text")), width)
        s1 = np.zeros(b.num_rows, np.uint64)
        np.add.at(s1, owner, K.mix(sh, 21))
        return [b.column("doc_id"), K.signed(s1), K.packed(sh, np.bincount(owner, minlength=b.num_rows))]

    names = ["doc_id", "s1", "grams"]
    return docs.mapInArrow(K.per_slice("text", names, make), "doc_id long, s1 long, grams binary")


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            n, m, both = K.overlaps(b.column("ga"), b.column("gb"))
            yield b.select(["a", "b"]).filter(pa.array((100 * both >= percent * (n + m - both)) & (both > 0)))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Only sets of pairs are shuffled, to the pair that needs them."""
    pairs = written(pairs.select("a", "b"), "pairs")
    side = lambda i: pairs.join(sets.select(F.col("doc_id").alias(i), F.col("grams").alias(f"g{i}")), i)
    return side("a").join(side("b"), ["a", "b"]).select("a", "b", "ga", "gb").mapInArrow(_confirm(percent), "a long, b long")


def _detail(batches):
    for b in K.slices(batches, "grams"):
        size = pc.binary_length(b.column("grams")).to_numpy() // 8
        flat = np.frombuffer(b"".join(b.column("grams").to_pylist()), np.uint64)
        sk = sketch(np.repeat(np.arange(b.num_rows), size), flat, b.num_rows, COORDINATES).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), K.packed(sk.ravel(), np.full(b.num_rows, COORDINATES))], ["doc_id", "sk"])


def _across(percent: int, least: int):
    """Pairs of different components in one chunk of a bucket that may be similar enough.

    Probes, which are members outside the bucket's largest component, are compared with the
    chunk's own members; theirs are in every chunk. A pair is looked at in the first bucket that it shares. Coordinates
    (a byte each) agree with a probability of at least the similarity; five standard
    deviations below the threshold, less than one pair in a million is missed.
    """
    low = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        doc, n, comp = (table.column(c).to_numpy() for c in ("doc_id", "n", "comp"))
        main, mine = (table.column(c).to_numpy() for c in ("of_main", "own"))
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(len(doc), -1)
        sk = np.frombuffer(b"".join(table.column("sk").to_pylist()), np.uint8).reshape(len(doc), -1)
        band = int((keys[0] == table.column("key")[0].as_py()).argmax())
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        own = np.flatnonzero(mine)
        for x in np.flatnonzero(~main):
            fit = (comp[own] != comp[x]) & (main[own] | (doc[own] > doc[x]))
            y = own[fit & (100 * np.minimum(n[own], n[x]) >= percent * np.maximum(n[own], n[x]))]
            same = keys[y] == keys[x]
            y = y[(same.argmax(axis=1) == band) & (same.sum(axis=1) >= least)]
            y = y[(sk[y] == sk[x]).mean(axis=1) >= low]
            out.append(np.stack([np.minimum(doc[y], doc[x]), np.maximum(doc[y], doc[x])], axis=1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, kept."""
    small_batches(docs.sparkSession)
    docs = texts(docs, id_col, text_col).where("doc_id is not null")
    sig = written(signatures(docs, bands, rows, width), "sig")
    # an id with several sets takes part with one of them
    several = sig.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"))
    several = written(several.where("lo <> hi").select("doc_id", "lo"), "several")
    some = not several.isEmpty()
    one_set = lambda d: d.join(several, "doc_id", "left").where("lo is null or s1 = lo").drop("lo") if some else d
    rows_of, sig = sig.select("doc_id", "n_shingles"), one_set(sig)
    ids = sig.select("doc_id", "n_shingles", "s1", "s2")
    classes = written(ids.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id")), "classes")  # so that the join can split a hot class
    member = ids.join(classes, ["s1", "s2"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    if some:
        member = rows_of.join(member.drop("n_shingles").distinct(), "doc_id")

    # one row a band of every class; buckets of one class are of no use
    first = sig.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("x")).select("x.*")

    def spread(batches):
        for b in batches:
            n = b.num_rows
            flat = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(b.column("doc_id").to_numpy(), bands if n else 0)), pa.array(np.repeat(b.column("n_shingles").to_numpy(), bands if n else 0))], ["key", "doc_id", "n"])

    spreads = first.mapInArrow(spread, "key long, doc_id long, n long")
    shared = spreads.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("doc_id", "n")).alias("lead")).where("members > 1")
    shared = written(shared, "shared")
    bucket = written(spreads.join(shared, "key").select("key", "doc_id", "n", "lead"), "buckets")
    wanted = docs.sparkSession.sparkContext.broadcast(marked(bucket.select("doc_id").distinct()))
    sets = written(one_set(shingle_sets(docs, width, wanted)).drop("s1").dropDuplicates(["doc_id"]), "sets")
    wanted.destroy()
    let_go(docs.sparkSession)
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"

    # the one leader that a class shares most bands with
    edge = bucket.where("doc_id <> lead.doc_id").groupBy(F.col("doc_id").alias("a"), F.col("lead.doc_id").alias("b"), "n", F.col("lead.n").alias("m")).agg(F.count(F.lit(1)).alias("s")).where(f"s >= {least} and {fits}")
    best = edge.groupBy("a").agg(F.max_by("b", F.struct("s", -F.col("b"))).alias("b"))
    links = written(confirmed(best, sets, percent), "links")
    comp = components(links)

    # members of different components: compared by sketches where their first shared bucket is
    in_comp = written(bucket.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("comp")), "comps")
    size = in_comp.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = size.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("members")).where("comps > 1")
    rest = written(in_comp.join(mixed, "key").select("key", "doc_id", "n", "comp", (F.col("comp") == F.col("main")).alias("of_main"), F.ceil(F.col("members") / BLOCK).alias("chunks")), "mixed")
    detail = written(sets.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_detail, "doc_id long, sk binary").join(first.select("doc_id", "keys"), "doc_id"), "detail")
    # a member is in one chunk, and if it is outside the largest component, is compared with those in every other one
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    own = rest.select("key", "doc_id", "n", "comp", "of_main", F.lit(True).alias("own"), "chunk")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    probes = rest.where("not of_main and chunks > 1").select("*", every).where("other <> chunk")
    probes = probes.select("key", "doc_id", "n", "comp", "of_main", F.lit(False).alias("own"), F.col("other").alias("chunk"))
    chunks = own.unionByName(probes).join(detail, "doc_id")
    pairs = chunks.groupBy("key", "chunk").applyInArrow(_across(percent, least), "a long, b long").distinct()
    pairs = written(pairs, "pairs")
    let_go(docs.sparkSession)
    more = confirmed(pairs, sets, percent)
    all_links = written(links.unionByName(more), "links")
    comp = components(all_links)
    return member.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row, with all columns, of each group of near duplicates: that of the smallest doc_id, null ids last.

    Rows are keyed by a 64-bit hash of id and text, so rows with null ids take part and
    rows with one doc_id but different texts are documents of their own. Of rows that are
    equal in id and text one stays, whatever their other columns hold. Texts without words
    have no group; all their rows stay.
    """
    row, both = F.struct("*").alias("row"), (F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    keyed = docs.select(row, F.xxhash64(*both).alias("key"), both[0].alias("id"), both[1].alias("text"))
    rows = keyed.select("key", "id").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), **options)
    group = found.select(F.col("doc_id").alias("key"), "component_id", "n_shingles").distinct().join(rows, "key")
    first = group.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "n", "n_shingles")).alias("f"))
    first = written(first.select("f.key", F.expr("f.n > 1 and f.n_shingles > 0").alias("many")), "kept")
    keyed = keyed.select("row", "key")
    once = keyed.join(first.where("not many"), "key", "left_semi")
    many = keyed.join(first.where("many"), "key", "left_semi").dropDuplicates(["key"])
    return once.unionByName(many).select("row.*")
