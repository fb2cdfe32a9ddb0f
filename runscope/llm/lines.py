"""Line de-duplication by an exact set-similarity join.

A line's tokens are its distinct words (digits, letters, non-ASCII; A-Z in lower case),
or with width > 1 its distinct runs of so many words, a line of fewer words being one
token. A line goes if an earlier line (by doc_id, then place) has Jaccard similarity of
at least `percent` / 100 with it, whether or not that line goes itself.

1. *Copies.* Lines with equal token sets are one class; all but its first line go.
2. *Prefix filter.* Tokens are ordered by rarity: counts by hash over all documents (ties
   by hash, so that the order is total and no pair is lost). Two similar sets share a
   token among the first n - ceil(n * percent / 100) + 1 of each. A token with a count
   above `hot` would join too many lines; there the key is a pair of tokens, since similar
   sets share two within one token more (lines of more than `long` tokens keep single
   tokens, among themselves). Keys go once a class and slice of a task, packed by groups
   of keys, whose number follows the count of all tokens.
3. *Candidates.* Classes that share a key are candidates if their sizes allow the
   similarity (length filter), if what follows the shared token in both does (positional
   filter), and if the parities of 128 hashed token counts do: each differing bit is a token
   that only one of the two has. Of a class with more than `kept`
   candidates under a key that are nearly surely similar, so many are kept, and under a key
   with very many alike classes only the first such one; a mark tells where more may exist.
4. *Verification.* Full token sets of the classes in question are compared. Marked classes
   of which no candidate was confirmed then meet all earlier classes of those keys. A bitmap
   of fixed size tells each task which lines' sets to send; a line too many does no harm.

Tokens and classes are 64-bit hashes (128 bits for copies). Null texts, lines without words
and rows with null ids have no lines that count; repeated rows with one doc_id are that
document again. An empty table gives no rows. Lines may be of any length. Other columns are
passed through by `without_lines`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import contains, let_go, marked, small_batches, texts, written

PERCENT, WIDTH, BUCKETS = 75, 1, 1 << 22
_CELL, _HELD, _CHUNK = 1 << 12, 1 << 19, 1 << 19
#: How many tokens only one of two lines has, as the number of differing parities tells, and the share of all up to which a pair is nearly sure.
_APART, _SURE = np.append(-64 * np.log1p(-np.arange(64) / 64), np.full(65, np.inf)), 0.1
_STEPS = 7  # counts are told apart by steps of a seventh of a doubling
_U = np.uint64


class Limits(NamedTuple):
    """Where the work is divided; the result does not depend on these."""

    hot: int = 1 << 12  # tokens with a larger count are keys in pairs
    long: int = 128  # but not in lines of more tokens
    split: int = 1 << 20  # a key whose token has a larger count is dealt over parts
    kept: int = 32  # candidates of a key and class, if all are nearly sure; others are left to the second pass
    many: int = 512  # classes under a key from which on, if they look alike, they are compared one with all


LIMITS = Limits()


class Lines:
    """Distinct tokens of each line that has some (``hash``, sorted in a line; lines begin at ``at``), and each line's text and place."""

    def __init__(self, column: pa.Array, width: int):
        w = K.Words(column, K.ALNUM)
        d = w.data
        breaks = np.concatenate([[0], np.cumsum(d == 10)]) if len(d) else np.zeros(1, np.int64)
        first = breaks[w.text_at[:-1]] + np.arange(len(column))  # number of each text's first line among all lines
        line = breaks[w.start] + w.owner()
        h = w.hash
        if width > 1:
            g = K.runs(h, width)
            ok = line[: len(g)] == line[len(line) - len(g) :]
            begin = np.flatnonzero(np.diff(line, prepend=-1))
            n = np.diff(np.append(begin, len(line)))
            few = n < width
            part = np.repeat(few, n)
            whole = K.mix(K.mix(h[part], 5) * (_U(2) * _rank(n[few]).astype(_U) + _U(3)), 6)
            whole = np.add.reduceat(whole, np.cumsum(n[few]) - n[few]) if few.any() else whole
            line, h = np.concatenate([line[: len(g)][ok], line[begin[few]]]), np.concatenate([g[ok], whole])
        bits = max(1, int(line.max()).bit_length()) if len(line) else 1
        order = np.argsort((line.astype(_U) << _U(64 - bits)) | (h >> _U(bits)))
        line, h = line[order], h[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        line, self.hash = line[new], h[new]
        self.at = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(line))
        which = line[self.at[:-1]]
        self.text = np.searchsorted(first, which, "right") - 1
        self.place = which - first[self.text]
        self.size = np.diff(self.at)

    def summed(self, values: np.ndarray, how=np.add) -> np.ndarray:
        return how.reduceat(values, self.at[:-1]) if len(self.hash) else np.zeros(0, _U)

    def identity(self, salt: int) -> np.ndarray:
        return self.summed(K.mix(self.hash, salt))

    def parities(self) -> list[np.ndarray]:
        """128 bits: of how many tokens a hash to it the parity."""
        bit = _U(1) << (self.hash & _U(63))
        high = (self.hash >> _U(6)) & _U(1) == 1
        return [self.summed(np.where(high, _U(0), bit), np.bitwise_xor), self.summed(np.where(high, bit, _U(0)), np.bitwise_xor)]


def _rank(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each stretch of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _reading(width: int):
    """A row for each line (its identity), and at a task's end the counts of its tokens by hash bucket, where not 0."""

    def run(batches):
        seen, held, n = np.zeros(BUCKETS, np.int64), [], 0
        names = ["doc_id", "line", "s1", "s2", "cell", "n"]

        def count():
            nonlocal seen
            seen += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=BUCKETS)
            held.clear()

        for b in K.slices(batches, "text"):
            x = Lines(b.column("text"), width)
            held.append((x.hash % _U(BUCKETS)).astype(np.int64))
            n += len(x.hash)
            if n > BUCKETS:
                count()
                n = 0
            k = len(x.size)
            doc = pa.array(b.column("doc_id").to_numpy()[x.text])
            none = pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())
            yield pa.RecordBatch.from_arrays([doc, pa.array(x.place), K.signed(x.identity(21)), K.signed(x.identity(22)), *none], names)
        count()
        some = np.flatnonzero(seen)
        pairs = np.stack([some % _CELL, seen[some]], axis=1)
        cell, at = np.unique(some // _CELL, return_index=True)
        null = pa.nulls(len(cell), pa.int64())
        packed = K.packed(pairs.ravel(), 2 * np.diff(np.append(at, len(some))))
        yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array(cell), packed], names)

    return run


def _summing(table: pa.Table) -> pa.Table:
    n = np.zeros(_CELL, np.int64)
    for x in table.column("n"):
        at, count = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2).T
        n[at] += count
    level = np.minimum(np.round(_STEPS * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)
    cell = table.column("cell")[0].as_py()
    return pa.table({"cell": [cell], "level": pa.array([level.tobytes()], pa.binary()), "n": [int(n.sum())]})


class Keys:
    """The keys of the lines of a slice: hash, line, place of its first token in the line's order, parts."""

    def __init__(self, x: Lines, some: np.ndarray, levels: np.ndarray, mean: int, percent: int, limits: Limits):
        size = x.size[some]
        h = x.hash[np.repeat(some, x.size)]
        of, n = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
        level = levels[(h % _U(BUCKETS)).astype(np.int64)]
        order = np.argsort((of << 8) | level, kind="stable")  # hashes are in order already
        h, pos = h[order], _rank(size)
        count = np.exp2(level[order] / _STEPS)
        least = -(-n * percent // 100)
        hot = (count > limits.hot) & (percent >= 67)  # there lines with partners share at least two tokens with them
        single = (pos <= n - least) & (~hot | (n * 100 >= limits.long * percent))
        # pairs of tokens: the first is hot, the second is within one token more
        mine, first, second = [np.flatnonzero(single & ~hot)], [], []
        lone = np.flatnonzero(single & hot)
        paired = hot & (n <= limits.long) & (pos <= n - least + 1)
        i = np.flatnonzero(paired & (pos <= n - least))
        step = 1
        while len(i):
            i = i[i + step < len(h)]
            i = i[paired[i + step] & (of[i + step] == of[i])]
            first.append(i)
            second.append(i + step)
            step += 1
        a = np.concatenate([*mine, lone, *first])
        key = [K.mix(h[mine[0]], 12), K.mix(h[lone], 13)]
        if first:
            f, s = np.concatenate(first), np.concatenate(second)
            key.append(K.mix(K.mix(h[f], 14) + h[s], 15))
        self.key, self.line, self.pos = np.concatenate(key), of[a], pos[a]
        parts = np.maximum(count[a] - 4 * mean, 0).astype(np.int64) // limits.split + 1
        self.parts = np.where(hot[a], parts, 1)
        self.n = len(a)


_NAMES = ["group", "key", "s1", "doc_id", "line", "size", "pos", "p1", "p2", "flag"]
_TYPES = [np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.uint32, _U, _U, np.uint8]
_PART, _PROBE = 1, 2  # flags: only a part of the key's lines is in the group; a line to be compared with the group's lines


def _sending(percent: int, width: int, limits: Limits, shared, groups: int):
    """Per group of keys, packed: key, class, its place, size, place of the token, parities and flags."""

    def chosen(b: pa.RecordBatch):
        levels, mean, wanted, probes = shared.value
        x = Lines(b.column("text"), width)
        s1, doc = x.identity(21), b.column("doc_id").to_numpy()[x.text]
        order = np.lexsort((x.place, doc, s1))
        some = np.zeros(len(s1), bool)
        some[order[np.append(True, s1[order][1:] != s1[order][:-1])[: len(order)]]] = True  # copies count once: the first
        some &= 100 * x.size >= percent * (x.size + 1)  # smaller sets are similar to their copies only
        k = Keys(x, some, levels, mean, percent, limits)
        s1, doc, place, size, p1, p2 = (c[some][k.line] for c in (s1, doc, x.place, x.size, *x.parities()))
        cell = (K.mix(s1, 9) % k.parts.astype(_U)).astype(np.int64)
        flag = np.where(k.parts > 1, _PART, 0)
        at = np.arange(k.n)
        if wanted is not None:
            at = at[contains(wanted, (k.key >> _U(32)).astype(np.int64))]
            again = at[contains(probes, doc[at], place[at])]
            n = k.parts[again]
            cell, flag = np.concatenate([cell[at], _rank(n)]), np.concatenate([flag[at], np.full(int(n.sum()), _PROBE)])
            at = np.concatenate([at, np.repeat(again, n)])
        group = (K.mix(k.key[at] + cell.astype(_U), 16) % _U(groups)).astype(np.int32)
        cols = (k.key[at] >> _U(32), s1[at].view(np.int64), doc[at], place[at], size[at], k.pos[at], p1[at], p2[at], flag)
        return [group, *cols]

    def packing(held: list):
        group, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(group, kind="stable")
        group = group[order]
        at = np.flatnonzero(np.diff(group, prepend=-1))
        n = np.diff(np.append(at, len(group)))
        columns = [K.packed(c[order].astype(t), n) for c, t in zip(columns, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(group[at]), *columns], _NAMES)

    def run(batches):
        held, n = [], 0
        for b in K.slices(batches, "text"):
            held.append(chosen(b))
            n += len(held[-1][0])
            if n >= _HELD:
                yield packing(held)
                held, n = [], 0
        if n:
            yield packing(held)

    return run


def _stretches(at: np.ndarray, n: np.ndarray):
    """(left, right) index arrays, in chunks of bounded size: each at with the n places behind it."""
    total = np.cumsum(n)
    lo = 0
    while lo < len(at):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + _CHUNK, "right")))
        left = np.repeat(at[lo:hi], n[lo:hi])
        yield left, left + 1 + _rank(n[lo:hi])
        lo = hi


class Group:
    """The lines of some keys, in order of key and size; pairs of them that pass the filters."""

    def __init__(self, table: pa.Table, percent: int, limits: Limits):
        read = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        cols = [read(c, t) for c, t in zip(_NAMES[1:], _TYPES, strict=True)]
        key, s1, doc, line, size, _, _, _, flag = cols
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order].astype(np.int64)) == 0
        order = order[np.append(False, same) | np.append(same, False) | ((flag[order] & _PART) > 0)]
        order = order[np.lexsort((line[order], doc[order], s1[order], flag[order] & _PROBE, key[order]))]
        key, s1, probe = key[order], s1[order], flag[order] & _PROBE
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (s1[1:] != s1[:-1]) | (probe[1:] != probe[:-1])
        order = order[new]
        order = order[np.argsort((cols[0][order].astype(_U) << _U(32)) | size[order], kind="stable")]
        self.key, self.s1, self.doc, self.line, self.size, pos, self.p1, self.p2, self.flag = (c[order] for c in cols)
        self.size = self.size.astype(np.int64)
        self.left = self.size - pos
        self.rank = np.empty(len(order), np.int64)  # by place; copies of one place are equal in doc_id and line
        self.rank[np.lexsort((self.line, self.doc))] = np.arange(len(order))
        self.percent, self.limits = percent, limits

    def fits(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of a and b (lines; one of them may be a single one) the filters let be similar, and if they nearly must be."""
        a, b = np.broadcast_arrays(a, b)
        p, both = self.percent, self.size[a] + self.size[b]
        at = np.flatnonzero(p * both <= (100 + p) * np.minimum(self.left[a], self.left[b]))
        a, b, both = a[at], b[at], both[at]
        apart = np.bitwise_count(self.p1[a] ^ self.p1[b]).astype(np.int32) + np.bitwise_count(self.p2[a] ^ self.p2[b])
        n = self.size[a]
        ok = (100 + p) * apart <= (100 - p) * both
        ok &= 100 * np.minimum(n, both - n) >= p * np.maximum(n, both - n)
        ok &= (2 * n != both) | ((100 + p) * (n - 1) >= p * both)  # they are not equal
        return at[ok], _APART[apart[ok]] <= _SURE * both[ok]

    def first_candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """later, earlier (-1: none here) and if the later one may have more under this key."""
        begin = np.flatnonzero(np.diff(self.key.astype(np.int64), prepend=-1))
        n = np.diff(np.append(begin, len(self.key)))
        # larger lines come behind; how large they may be follows from the size and from what follows the shared token
        most = np.maximum(self.left * (100 + self.percent) // self.percent - self.size, 0)
        both, top = ((self.key.astype(_U) << _U(32)) | x.astype(_U) for x in (self.size, np.minimum(most, 2**32 - 1)))
        swept = [(at, k) for at, k in zip(begin, n, strict=True) if k > self.limits.many and self._alike(at, k)]
        flat = most >= self.size
        for at, k in swept:
            flat[at : at + k] = False
        here = np.flatnonzero(flat)
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)]
        for left, right in _stretches(here, np.maximum(np.searchsorted(both, top[here], "right") - here - 1, 0)):
            ok, sure = self.fits(left, right)
            found.append((left[ok], right[ok], sure))
        left, right, sure = (np.concatenate(x) for x in zip(*found, strict=True))
        swap = self.rank[left] > self.rank[right]
        out = [self._few(np.where(swap, left, right), np.where(swap, right, left), sure)]
        for at, k in swept:
            out += self._sweep(np.arange(at, at + k))
        part = np.flatnonzero(self.flag & _PART)
        out.append((part, np.full(len(part), -1), np.ones(len(part), bool)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _alike(self, at: int, k: int) -> bool:
        """If some of the k lines of a key may be similar to many others, so that pairs are too many."""
        some = np.arange(at, at + k, max(1, k // 32))
        return sum(len(self.fits(int(i), np.arange(at, at + k))[0]) - 1 for i in some) * 50 > len(some) * k

    def _few(self, later, earlier, sure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All earlier ones of each, but only `kept` where so many are nearly sure."""
        order = np.lexsort((self.rank[earlier], ~sure, later))
        later, earlier, sure = later[order], earlier[order], sure[order]
        begin = np.flatnonzero(np.diff(later, prepend=-1))
        n = np.diff(np.append(begin, len(later)))
        kept = self.limits.kept
        many = np.repeat((n > kept) & sure[begin + np.minimum(n, kept) - 1], n)
        keep = ~many | (_rank(n) < kept)
        return later[keep], earlier[keep], many[keep]

    def _sweep(self, at: np.ndarray) -> list:
        """A key with very many lines: each goes to the first open line that it is nearly surely similar to, or under a key
        with even more lines may be similar to; open ones are compared with all."""
        at = at[np.argsort(self.rank[at])]
        free, out, k = np.ones(len(at), bool), [], 0
        while k < len(at):
            ok, sure = self.fits(int(at[k]), at)
            before = ok < k
            if before.any():
                out.append(self._few(np.full(int(before.sum()), at[k]), at[ok[before]], sure[before]))
            behind = ok[(ok > k) & (sure | (len(at) > 32 * self.limits.many))]
            behind = behind[free[behind]]
            free[behind] = False
            out.append((at[behind], np.full(len(behind), at[k]), np.ones(len(behind), bool)))
            for step in (1, 2, 4, 8, 16):  # and with some of those that go to it before them
                later, earlier = at[behind[step:]], at[behind[:-step]]
                ok, _ = self.fits(later, earlier)
                out.append((later[ok], earlier[ok], np.ones(len(ok), bool)))
            rest = np.flatnonzero(free[k + 1 :])
            k = k + 1 + int(rest[0]) if len(rest) else len(at)
        return out

    def all_candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every pair of a probe and an earlier line of its key."""
        begin = np.flatnonzero(np.diff(self.key.astype(np.int64), prepend=-1))
        n = np.diff(np.append(begin, len(self.key)))
        probe = (self.flag & _PROBE) > 0
        found = [np.zeros((2, 0), np.int64)]
        for at, k in zip(begin, n, strict=True):
            base = np.arange(at, at + k)[~probe[at : at + k]]
            for i in np.arange(at, at + k)[probe[at : at + k]]:
                ok = base[self.fits(int(i), base)[0]]
                ok = ok[(self.doc[ok] < self.doc[i]) | ((self.doc[ok] == self.doc[i]) & (self.line[ok] < self.line[i]))]
                found.append(np.stack([np.full(len(ok), i), ok]))
        later, earlier = np.concatenate(found, axis=1)
        return later, earlier, np.zeros(len(later), bool)


_PAIRS = "b long, b_doc long, b_line long, a long, a_doc long, a_line long, key long"


def _comparing(percent: int, limits: Limits, again: bool):
    """Pairs (b later, a earlier) of one group; a key is given where b may have more partners under it."""

    def run(table: pa.Table) -> pa.Table:
        g = Group(table, percent, limits)
        later, earlier, more = g.all_candidates() if again else g.first_candidates()
        null = earlier < 0
        order = np.lexsort((~more, g.s1[earlier], null, g.s1[later]))
        later, earlier, more, null = later[order], earlier[order], more[order], null[order]
        b, a = g.s1[later], g.s1[earlier]
        one = np.ones(len(later), bool)  # a pair once, and for each key that it is marked under
        one[1:] = (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (null[1:] != null[:-1])
        one = (one | more) & (null | (a != b))
        later, earlier, more, null = later[one], earlier[one], more[one], null[one]
        side = lambda i: [g.s1[i], g.doc[i], g.line[i].astype(np.int64)]
        cols = [pa.array(c) for c in side(later)] + [pa.array(c, mask=null) for c in side(earlier)]
        cols.append(pa.array(g.key[later].astype(np.int64), mask=~more))
        return pa.Table.from_arrays(cols, [x.split()[0] for x in _PAIRS.split(", ")])

    return run


def _sets(width: int, shared):
    """(s1, tokens) of the lines in the bitmap."""

    def run(batches):
        for b in K.slices(batches, "text"):
            texts, doc = b.column("text"), b.column("doc_id").to_numpy()
            data, at = K.raw(texts)
            ends = np.sort(np.concatenate([np.flatnonzero(data == 10), at[1:]]), kind="stable")  # of each line
            of = np.repeat(np.arange(len(doc)), 1 + np.diff(np.searchsorted(np.flatnonzero(data == 10), at)))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            place = np.arange(len(of)) - first[of]
            start = np.where(place == 0, at[of], np.append(0, ends[:-1]) + 1)
            some = np.flatnonzero(contains(shared.value, doc[of], place))
            whole = data.tobytes() if len(some) else b""
            x = Lines(pa.array([whole[i:j] for i, j in zip(start[some], ends[some], strict=True)], pa.binary()).cast(pa.string()), width)
            yield pa.RecordBatch.from_arrays([K.signed(x.identity(21)), K.packed(x.hash, x.size)], ["s1", "tokens"])

    return run


def _similar(percent: int):
    def run(batches):
        for b in batches:
            n, m, both = K.overlaps(b.column("ta"), b.column("tb"))
            yield b.select(["b"]).filter(pa.array(100 * both >= percent * (n + m - both)))

    return run


def _copies(ids: DataFrame) -> DataFrame:
    """doc_id, line of all lines but the first of each class."""
    s = ["s1", "s2"]
    lead = ids.groupBy(*s).agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("n"))
    lead = written(lead.where("n > 1").drop("n"), "leads")  # so that the join can split a hot line
    places = written(ids.join(lead, s), "copies")
    own = places.where("doc_id = d")
    first = own.groupBy(*s).agg(F.min("line").alias("l"))
    return places.where("doc_id <> d").select("doc_id", "line").unionByName(own.join(first, s).where("line <> l").select("doc_id", "line"))


def removed_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = PERCENT,
    width: int = WIDTH,
    limits: Limits = LIMITS,
) -> DataFrame:
    """doc_id, line (from 0): the lines that go."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    small_batches(spark)
    docs = texts(docs, id_col, text_col).where("doc_id is not null")
    kinds = "doc_id long, line long, s1 long, s2 long, cell long, n binary"
    read = written(docs.mapInArrow(_reading(width), kinds), "lines")
    cells = read.where("cell is not null").select("cell", "n").groupBy("cell").applyInArrow(_summing, "cell long, level binary, n long")
    levels, total = np.zeros((BUCKETS // _CELL, _CELL), np.uint8), 0
    for r in cells.collect():  # a table of fixed size
        levels[r["cell"]] = np.frombuffer(r["level"], np.uint8)
        total += r["n"]
    levels, mean = levels.ravel(), total // BUCKETS
    copies = _copies(read.where("doc_id is not null").select("doc_id", "line", "s1", "s2"))
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - percent) // 100 // _HELD)
    sent = "group int, " + ", ".join(f"{c} binary" for c in _NAMES[1:])

    def compared(wanted, probes) -> DataFrame:
        model = share((levels, mean, wanted, probes))
        rows = docs.mapInArrow(_sending(percent, width, limits, model, groups), sent)
        out = written(rows.groupBy("group").applyInArrow(_comparing(percent, limits, wanted is not None), _PAIRS), "pairs")
        model.destroy()
        let_go(spark)
        return out

    def confirmed(pairs: DataFrame) -> DataFrame:
        two = pairs.where("a is not null")
        side = lambda i: two.select(F.col(i).alias("s1"), F.col(f"{i}_doc").alias("doc_id"), F.col(f"{i}_line").alias("line"))
        ends = written(side("a").unionByName(side("b")).distinct(), "ends")
        model = share(marked(ends.select("doc_id", "line")))
        sets = docs.mapInArrow(_sets(width, model), "s1 long, tokens binary")
        sets = written(sets.join(ends.select("s1").distinct(), "s1", "left_semi").dropDuplicates(["s1"]), "sets")
        model.destroy()
        of = lambda i: sets.select(F.col("s1").alias(i), F.col("tokens").alias(f"t{i}"))
        both = two.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
        good = both.select("b", "ta", "tb").mapInArrow(_similar(percent), "b long").distinct()
        return written(two.select("b", "b_doc", "b_line").distinct().join(good, "b"), "gone")

    pairs = compared(None, None)
    gone = confirmed(pairs)
    open_ = written(pairs.where("key is not null").join(gone.select("b"), "b", "left_anti"), "open")
    if not open_.isEmpty():
        wanted = marked(open_.select("key"))
        probes = marked(open_.select("b_doc", "b_line"))
        gone = gone.unionByName(confirmed(compared(wanted, probes)))
    return copies.unionByName(gone.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line"))).distinct()


def _cutting(batches):
    for b in K.slices(batches, "text"):
        out = []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            if gone and text is not None:
                drop = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "text"])


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of docs; texts without the lines that go."""
    gone = removed_lines(docs, id_col, text_col, **options)
    gone = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("gone"))
    blank = [F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*blank).alias("row"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    kind = f"row {docs.schema.simpleString()}, text string"
    cut = rows.join(gone, "__id", "left").select("row", "text", "gone").mapInArrow(_cutting, kind)
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, removed (line numbers in order), n_removed: a row for each document that loses lines."""
    gone = removed_lines(docs, id_col, text_col, **options)
    per = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    return per.withColumn("n_removed", F.size("removed").cast("long"))


_W = r"regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH l AS (SELECT doc_id, line, list_sort(list_distinct({_W})) AS w
  FROM (SELECT doc_id, unnest(s) AS l, unnest(range(len(s))) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS id, len(w) AS n FROM l WHERE len(w) > 0),
t AS (SELECT id, n, unnest(w) AS w FROM k),
f AS (SELECT w, count(*) AS c FROM t GROUP BY w),
p AS (SELECT id, n, w FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY c, t.w) AS r FROM t JOIN f ON t.w = f.w)
      WHERE r <= n - ceil(n * {PERCENT} / 100.0) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND b.id < a.id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
g AS (SELECT DISTINCT a FROM (SELECT c.a, ka.n + kb.n AS s, len(list_intersect(ka.w, kb.w)) AS i FROM c JOIN k ka ON ka.id = c.a JOIN k kb ON kb.id = c.b)
      WHERE 100 * i >= {PERCENT} * (s - i))
SELECT doc_id, list_sort(list(CAST(line AS BIGINT))) AS removed, count(*) AS n_removed FROM g JOIN k ON k.id = g.a GROUP BY doc_id
"""
