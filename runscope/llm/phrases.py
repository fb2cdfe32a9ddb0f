"""Phrase collocations: an FM-index over word numbers in every shard, counts summed across shards.

Texts are cut into pieces at punctuation and line breaks and those into words; phrases of two to
four words are counted within pieces, for each language.

Three steps, each over all texts or all counts:

1. Words. Every shard (8 MB of texts of a task) counts its words and its pairs of neighbouring
   words; pairs as 32-bit keys with counts, packed in cells. Cells are summed in counters of
   bounded size. A key below the least count can't be a phrase, nor be in one. This only
   prunes: keys that meet by chance stay in.
2. Phrases. Every shard keeps the runs of words whose neighbouring pairs may be frequent and builds
   an index of them (`WordIndex`): suffixes sorted by their first words, the word before each
   suffix, and the order of these words, which leads an interval of a phrase to the interval of the
   phrase with one more word on its left; the same interval, divided by what follows,
   gives those with one more word on its right. All intervals of a depth are extended at once.
   Counts of phrases go out under the words' 64-bit numbers and are summed across shards.
3. Scores. Parts of a phrase are frequent phrases or words, too, so one join finds the counts of both
   sides of every cut. A phrase is inside a longer candidate with enough of its count only if that is so
   of a candidate with one more word on its left or right, which is one grouping.

Numbers of words are seeded hashes; that no two words of a language share one is checked on the table of
all words, and another seed is taken if they do. So counts are exact.

Null texts are empty, null languages are `und`. Empty tables give no rows; equal scores
are ordered by count, then by the bytes of the phrase; repeated rows count each. Long texts are
a shard of their own. Only text and lang are looked at; other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .shared import contains, marked, small_batches, written

LEAST, WORDS, TOP, COVER = 30, 4, 2000, 80
SHARD_BYTES = 8 << 20
_CELLS = 8  # bits of a pair's key that name its cell
_BLANK = np.isin(np.arange(256), [0x20, 0x09])
_BREAK = np.isin(np.arange(256), [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PARTS = "lang string, word string, n long, cell int, keys binary, counts binary"


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at least so many bytes of text together, the last ones with fewer."""
    held, size = [], 0
    for b in K.slices(batches, "text", most):
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Tokens:
    """The words of some texts as numbers: `number` of each word, `joined` where the next word is of the same piece.

    Numbers are dense over (language, word); `word` and `lang` tell what they stand for.
    """

    def __init__(self, b: pa.RecordBatch):
        data, at = K.raw(b.column("text"))
        is_word = ~(_BLANK | _BREAK)[data]
        w = np.zeros(len(data) + 2, bool)
        w[1:-1] = is_word
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        start = np.flatnonzero(w[1:] & (~w[:-1] | edge))
        end = np.flatnonzero(w[:-1] & (~w[1:] | edge))
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[data], out=breaks[1:])
        owner = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))
        self.joined = (owner[1:] == owner[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[is_word]])).dictionary_encode()
        langs = b.column("lang").dictionary_encode()
        size = max(1, len(words.dictionary))
        both = langs.indices.to_numpy().astype(np.int64)[owner] * size + words.indices.to_numpy()
        kinds, self.number = np.unique(both, return_inverse=True)
        self.lang = langs.dictionary.take(pa.array(kinds // size))
        self.word = words.dictionary.take(pa.array(kinds % size))

    def hashes(self, seed: int, of: np.ndarray | None = None) -> np.ndarray:
        """The seeded 64-bit number of each word (of those in `of`); without its language."""
        words = self.word if of is None else self.word.take(pa.array(of))
        return word_hashes(words, seed)

    def pair_keys(self) -> np.ndarray:
        """A 32-bit key of each two joined words, languages apart."""
        lang = word_hashes(self.lang.dictionary_encode().dictionary, 1) if len(self.lang) else np.zeros(0, np.uint64)
        h = K.mix(self.hashes(0) + lang[self.lang.dictionary_encode().indices.to_numpy()], 3)
        i = np.flatnonzero(self.joined)
        return (K.mix(h[self.number[i]] * np.uint64(0xD6E8FEB86659FD93) + h[self.number[i + 1]], 5) >> np.uint64(32)).astype(np.uint32)


def word_hashes(words: pa.Array, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARTS.split(", ")]
    for b in shards(batches):
        t = Tokens(b)
        m = len(t.word)
        none = lambda n, kind: pa.nulls(n, kind)
        n = np.bincount(t.number, minlength=m)
        yield pa.RecordBatch.from_arrays([t.lang.cast(pa.string()), t.word.cast(pa.string()), pa.array(n), none(m, pa.int32()), none(m, pa.binary()), none(m, pa.binary())], names)
        keys, counts = np.unique(t.pair_keys(), return_counts=True)
        bounds = np.searchsorted(keys, np.arange(1 << _CELLS, dtype=np.uint64) << np.uint64(32 - _CELLS))
        size = np.diff(np.append(bounds, len(keys)))
        some = np.flatnonzero(size)
        packed = [K.packed(x, size[some]) for x in (keys, counts.astype(np.uint32))]
        m = len(some)
        yield pa.RecordBatch.from_arrays([none(m, pa.string()), none(m, pa.string()), none(m, pa.int64()), pa.array(some.astype(np.int32)), *packed], names)


def _summing(bits: int, least: int):
    """Sums the packed counts of a cell in 2^(bits - 8) counters, and gives the keys, cut to so many bits, that reach the least count."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << (bits - _CELLS), np.int64)
        for b in batches:
            for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
                k = np.frombuffer(keys.as_buffer(), np.uint32) >> np.uint32(32 - bits)
                np.add.at(counters, k & np.uint32(len(counters) - 1), np.frombuffer(counts.as_buffer(), np.uint32))
        found = np.flatnonzero(counters >= least) + (key[0].as_py() << (bits - _CELLS))
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    # the form that takes a key and iterators is chosen by its annotations, which must be types here
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


class WordIndex:
    """An FM-index, as deep as the longest phrase, of a sequence of word numbers above 0; 0 ends each run of words, the last one too.

    `rows` are suffixes in order of their first `depth` words. A phrase of at most that many words is an interval of
    rows. `before` is the word before each row's suffix; `order` sorts rows by it, so that the rows of a phrase with a
    word w before them, in `order`, are the interval of the phrase with w on its left.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        self.sequence, self.depth = sequence, depth
        rank, size = sequence.astype(np.int64), 1
        while size < depth:
            after = np.zeros_like(rank)
            after[:-size] = rank[size:]
            rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)[1]
            size *= 2
        self.rows = np.argsort(rank, kind="stable")
        self.before = sequence[self.rows - 1]
        self.order = np.argsort(self.before, kind="stable")
        self.start = np.searchsorted(self.before[self.order], np.arange(sequence.max(initial=0) + 2))

    def left(self, interval: tuple[int, int], word: int) -> tuple[int, int]:
        """The interval of the phrase with a word on its left."""
        rows = self.order[self.start[word] : self.start[word + 1]]
        low, high = np.searchsorted(rows, interval)
        return int(self.start[word] + low), int(self.start[word] + high)

    def right(self, interval: tuple[int, int], length: int, word: int) -> tuple[int, int]:
        """The interval of a phrase of this length with a word on its right."""
        next_ = self.sequence[self.rows[interval[0] : interval[1]] + length]
        low, high = np.searchsorted(next_, (word, word + 1))
        return interval[0] + int(low), interval[0] + int(high)

    def interval(self, phrase: list[int]) -> tuple[int, int]:
        at = (0, len(self.rows))
        for word in reversed(phrase):
            at = self.left(at, word)
        return at

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, counts) of all phrases of 2, 3, ... words: every interval is extended to the left by every word before it, all at once."""
        first = self.sequence[self.rows]
        alive, group = first > 0, first
        word = self.before[self.order]
        for length in range(2, self.depth + 1):
            group = group[self.order]
            new = np.ones(len(group), bool)
            new[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
            alive, group = alive[self.order] & (word > 0), np.cumsum(new)
            low = np.flatnonzero(new)
            count = np.diff(np.append(low, len(new)))
            low, count = low[alive[low]], count[alive[low]]
            yield self.sequence[self.rows[low][:, None] + np.arange(length)], count


def runs_of_pairs(number: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Numbers plus 1 of all words with a link to a neighbour, and 0 after each run of linked ones."""
    after = np.append(linked, False)
    kept = np.flatnonzero(after | np.append(False, linked))
    ends = ~after[kept]
    out = np.zeros(len(kept) + int(ends.sum()), np.int64)
    out[np.arange(len(kept)) + np.cumsum(ends) - ends] = number[kept] + 1
    return out


def _finding(bitmap: np.ndarray, bits: int, words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches):
            t = Tokens(b)
            linked = t.joined.copy()
            linked[linked] = contains(bitmap, (t.pair_keys() >> np.uint32(32 - bits)).astype(np.int64))
            sequence = runs_of_pairs(t.number, linked)
            if not len(sequence):
                continue
            used = np.unique(sequence)[1:] - 1
            of_word = np.zeros(len(t.word), np.uint64)
            of_word[used] = t.hashes(seed, used)
            for found, count in WordIndex(sequence, words).phrases():
                at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                ids = pa.ListArray.from_arrays(at, K.signed(of_word[found.ravel() - 1]))
                yield pa.RecordBatch.from_arrays([t.lang.take(pa.array(found[:, 0] - 1)).cast(pa.string()), ids, pa.array(count)], ["lang", "ids", "n"])

    return run


def numbered(words: DataFrame, hashes=word_hashes) -> tuple[DataFrame, int]:
    """Words with their number, and the seed with which no two words of a language share one."""
    seed = 0
    while True:

        def number(batches, seed=seed):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, K.signed(hashes(b.column("word"), seed))], ["lang", "word", "n", "id"])

        got = written(words.mapInArrow(number, "lang string, word string, n long, id long"), "phrases-words")
        if not got.groupBy("lang", "id").count().where("count > 1").take(1):
            return got, seed
        seed += 1


def frequent(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (lang, ids, n) of two words or more, words (lang, word, n, id), both of at least that count, and lang, n: all words of each language."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = written(rows.mapInArrow(_counting, PARTS), "phrases-parts")
    counted = parts.where("cell is null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    all_words, seed = numbered(counted)
    sizes = written(all_words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = min(32, max(16, total.bit_length() + 3))
    keys = parts.where("cell is not null").select("cell", "keys", "counts").groupBy("cell").applyInArrow(_summing(bits, least), "key long")
    bitmap = marked(written(keys, "phrases-keys"))
    counts = rows.mapInArrow(_finding(bitmap, bits, words, seed), "lang string, ids array<long>, n long")
    found = counts.groupBy("lang", "ids").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return written(found, "phrases-found"), all_words.where(F.col("n") >= least), sizes


def scored(found: DataFrame, words: DataFrame, cover: int = COVER) -> DataFrame:
    """lang, ids, a, l, r, score of phrases that no longer one covers, by their lowest-scoring cut."""
    known = found.select("lang", "ids", "n").unionByName(words.select("lang", F.array("id").alias("ids"), "n"))
    length = F.size("ids")
    cut = found.select("lang", "ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    side = lambda part, name: known.select("lang", F.col("ids").alias(part), F.col("n").alias(name))
    cut = cut.withColumns({"head": F.slice("ids", 1, F.col("k")), "rest": F.slice("ids", F.col("k") + 1, length - F.col("k"))})
    cut = cut.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("(2000000BD * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cut.groupBy("lang", "ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inner = F.explode(F.array_distinct(F.array(F.slice("ids", 1, length - 1), F.slice("ids", 2, length - 1))))
    longer = found.where(length > 2).select("lang", inner.alias("ids"), F.col("n").alias("f")).groupBy("lang", "ids").agg(F.max("f").alias("f"))
    covered = F.coalesce(F.col("f") * F.lit(100).cast("decimal(20, 0)") >= F.col("a") * F.lit(cover).cast("decimal(20, 0)"), F.lit(False))
    return best.join(longer, ["lang", "ids"], "left").where(~covered).select("lang", "ids", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, cover: int = COVER) -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, known, sizes = frequent(docs, least, words)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # all ties at the last place stay until phrases have their text
    first = written(scored(found, known, cover).withColumn("rank", F.rank().over(w)).where(F.col("rank") <= top).drop("rank"), "phrases-top")
    each = first.select("lang", "ids", F.posexplode("ids").alias("i", "id")).join(known.select("lang", "id", "word"), ["lang", "id"])
    text = each.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = first.join(text, ["lang", "ids"]).join(sizes, "lang")
    named = named.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE m >= 2 AND f >= 30),
k AS MATERIALIZED (SELECT lang, m, phrase, f AS a, k, array_to_string(s[1:k], ' ') AS head, array_to_string(s[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
cuts AS (SELECT k.lang, k.m, k.phrase, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.f >= 80 * b.a)),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000"""
