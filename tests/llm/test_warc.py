"""Archives with the magic inside payloads, in files of many splits, against what was written."""

import base64
import gzip
import hashlib
import tempfile

import pytest

from runscope.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
SCHEMA = "page_id long, url string, html string, record_type string, payload string"


def made():
    rows = [(1, "u", "x"), (2, "a b\r\nWARC-Type: evil", FAKE * 3), (3, None, None), (4, "u", ""), (5, "u", "x"), (None, "u", "x"), (7, "u", "WARC/1.1")]
    rows += [(8, "u", "é WARC/1. WARC/1.0\r\n\r\n"), (9, "u", "WARC/1.0\r\nContent-Length: 5000\r\n\r\n"), (5, "u", "x"), (1, "u", "x"), (10, "u", "z" * 30_000 + FAKE)]
    rows += [(11, "u", FAKE), (None, "v", FAKE), (12, "q", "\r\n\r\n"), (13, "q", "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n")]
    return rows + [(100 + i, "u", f"{i} " + "y" * (i * 7 % 400) + (FAKE if i % 3 == 0 else "")) for i in range(60)]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, t in rows:
        if i is not None and i < first.get(t or "", i + 1):
            first[t or ""] = i
    out = []
    for i, _, t in rows:
        f = first.get(t or "")
        again = f is not None and f != i
        out.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", f if again else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "z", "p") for r in made()], SCHEMA)


def test_query_equals_brute_force(pages):
    got = warc.archive_digests(pages.repartition(3))
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(made())


def split_small(spark, size, read):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, (str(size), "1"), strict=True):
            spark.conf.set(k, v)
        return read()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [900, 5000])
def test_files_of_many_splits(spark, pages, size):
    path = tempfile.mkdtemp() + "/a"
    warc.write_archive(pages.coalesce(2), path, compression="none")
    got = split_small(spark, size, lambda: warc.verified(warc.read_archive(spark, path)).collect())
    assert all(r["ok"] for r in got)
    written = sorted((str(i), t or "") for i, _, t in made())
    assert len(got) == len(written)
    assert set((str(r["page_id"]), bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response") <= set(written)
    assert [r["url"] for r in got if r["page_id"] in (2, 3)].count(None) == 1
    assert "a%20b%0D%0AWARC-Type:%20evil" in [r["url"] for r in got]
    assert {r["page_id"] for r in got}.isdisjoint({99})


def test_least_bytes(spark, pages):
    path = tempfile.mkdtemp() + "/a"
    warc.write_archive(pages, path, least_bytes=2)
    kinds = [(r["page_id"], r["record_type"]) for r in warc.read_archive(spark, path).collect()]
    assert kinds.count((5, "response")) == 2  # one byte only
    assert (None, "revisit") in kinds  # the copy of a longer one


def test_archives_of_other_writers(spark, tmp_path):
    """Lower-case fields, version 1.0, a payload that isn't UTF-8, and a file that ends within a record."""
    whole = lambda i, block: b"WARC/1.0\r\nwarc-type: response\r\nwarc-record-id: <urn:page:%d>\r\ncontent-length: %d\r\n\r\n" % (i, len(block)) + block + b"\r\n\r\n"
    http = b"HTTP/1.0 200 OK\r\ncontent-length: 4\r\n\r\n"
    good = whole(1, http + b"\xff\xfe\x00a") + whole(2, http + b"bcde")
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(good + whole(3, http + b"wxyz")[:-6])
    (tmp_path / "b.warc").write_bytes(b"junk WARC/1.0\r\nContent-Length: 1\r\n\r\na\r\n\r\n")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert got == {1: b"\xff\xfe\x00a", 2: b"bcde"}


def test_chains_of_fakes_are_jumped_over(spark):
    """Hundreds of whole records inside one payload, and long paths of landing places."""
    rows = [(i, "u", FAKE * (i % 5) + "WARC/1.0\r\n" * (i % 3) + str(i)) for i in range(150)] + [(500, "u", FAKE * 400)]
    d = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).coalesce(1)
    assert sorted(repr(tuple(r)) for r in warc.archive_digests(d).collect()) == expected(rows)


def test_empty_table(spark):
    assert warc.archive_digests(spark.createDataFrame([], SCHEMA)).count() == 0
