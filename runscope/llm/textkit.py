"""Vectorised word, shingle and hash helpers for Arrow batches of texts.

Everything here works on one Arrow batch inside a task. A batch is cut into
slices of half a megabyte, so the memory of a task does not depend on how many
rows Spark puts into a batch; a single text longer than a slice is a slice of
its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10  # what the processor's caches hold with its hashes
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE, _POWERS = _U(0x9E3779B97F4A7C15), {}

_ALL = np.arange(256)
#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACED = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z: digits, letters and all of non-ASCII.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; wraps around like every sum and product here."""
    x = x + _U(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p", (np.zeros(0, np.uint64),))[0]
    if len(have) < n:
        n = max(n, SLICE_BYTES + 1)
        inverse = _U(pow(int(_BASE), -1, 2**64))
        grow = lambda b: np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
        _POWERS["p"] = grow(_BASE), grow(inverse)
    return _POWERS["p"]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and where each begins and the last one ends."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offs[0] : offs[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


class Words:
    """The words of some texts: ``hash`` and byte span of each, and where each text's words begin."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray = SPACED):
        self.data, self.text_at = raw(texts)
        n = len(self.data)
        w = np.zeros(n + 2, bool)
        w[1:-1] = is_word[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.text_at] = True
        self.start = np.flatnonzero(w[1:] & (~w[:-1] | edge))
        self.end = np.flatnonzero(w[:-1] & (~w[1:] | edge))
        self.at = np.searchsorted(self.start, self.text_at)
        up, down = _powers(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=c[1:])
        self.hash = mix((c[self.end] - c[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of k words of one text, and the place of its first word among all words."""
        g = runs(self.hash, k)
        ok = np.zeros(len(self.hash), bool)
        if len(g):
            left = np.repeat(self.at[1:], self.counts) - np.arange(len(self.hash))
            ok = left >= k
            return g[ok[: len(g)]], np.flatnonzero(ok)
        return g, np.flatnonzero(ok)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; log2(k) passes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    g, size = mix(h, 7), 1
    while size < k:
        step = min(size, k - size)
        g = mix(g[: len(g) - step] * _U(0xD6E8FEB86659FD93) + g[step:], 11 + size + step)
        size += step
    return g


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of every distinct shingle, in order of both. A text of fewer words, but not none, is one shingle."""
    g, at = words.grams(k)
    owner = words.owner()
    rows, vals = [owner[at]], [g]
    for m in range(1, k):
        few = np.flatnonzero(words.counts == m)
        if len(few):
            h = words.hash[words.at[few][:, None] + np.arange(m)]
            acc = mix(h[:, 0], 7)
            for j in range(1, m):
                acc = mix(acc * _U(0xD6E8FEB86659FD93) + h[:, j], 100 + m)
            rows.append(few)
            vals.append(mix(acc, 1000 + m))
    r, v = np.concatenate(rows), np.concatenate(vals)
    bits = max(1, len(words.at).bit_length())
    order = np.argsort((r.astype(np.uint64) << _U(64 - bits)) | (v >> _U(bits)))
    r, v = r[order], v[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[new], v[new]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column has at most so many bytes in each, but one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(part, part[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive stretches of a numpy array as binary values; lengths in items."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * values.itemsize, out=offs[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def overlaps(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of each two packed sets of 64-bit hashes, and how many values they share; one sort for all."""
    size = lambda c: pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    n, m = size(a), size(b)
    pair = np.arange(len(n), dtype=np.uint64)
    own = mix(np.concatenate([np.repeat(pair, n), np.repeat(pair, m)]), 91)
    flat = [np.frombuffer(b"".join(c.to_pylist()), np.uint64) for c in (a, b)]
    value = mix(np.concatenate(flat) ^ own, 92)
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    first = np.minimum(order[1:][same], order[:-1][same])
    return n, m, np.bincount(np.searchsorted(np.cumsum(n), first, "right"), minlength=len(n))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def per_slice(column: str, names: list[str], make: Callable[[pa.RecordBatch], list]) -> Callable:
    """A mapInArrow function that turns each slice into one record batch of the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(b)], names)

    return run
