"""Packing against the tokenizers library."""

import time
import zlib

import numpy as np
import pytest

from runscope.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [
    None, "", "plain words, and more of them", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x" * 30_000, "\t" * 12_000 + "end",
    " " * 2_000_000, "é नि ‍\U0001f468‍\U0001f469  　x", "plain words, and more of them", "word " * 5000,
]


def test_long_runs_of_blanks_take_linear_time():
    encode = packing._encoder(packing.VOCABULARY)
    for text in ("x".join([" " * 9_000] * 50), "x".join(["\n" * 9_999] * 100), "x".join([" " * 299] * 3_000)):
        began = time.process_time()
        assert encode(text)
        assert time.process_time() - began < 12  # was 13 and 35 s for the first two


def test_ids_and_places_equal_the_tokenizer(spark, tokenizer):
    rows = [(i, t, "s", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "s", 0), (2, "another text of this id", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")
    got = packing.pack(docs).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda x: (x[0] is None, *x[1:], x[0] or 0)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(x[3] for x in want) // 2048) + 1
