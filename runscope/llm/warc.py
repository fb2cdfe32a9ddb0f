"""WARC archives: pages written as records with revisits, and read back by verified chains of record boundaries.

Writing. A row becomes one record, ``WARC/1.1``, header fields, and a block that holds an
HTTP head and the page. Of records with equal payloads the one of the smallest page_id is a
response; the others are revisits whose block holds the head only. Spark's text writer puts
the records one after another, with the empty line between them as its line separator, so
an archive can be on any store that Spark writes to.

Reading. Files are cut at the magic ``WARC/1.`` by Spark's text reader, large ones in
splits. Every magic is a candidate, for a page may hold that text, too; its header says where the
next record would begin. Offsets are prefix sums: of the candidates of a split, and of the
splits of a file. Then the chain is verified:

1. Candidates that follow each other without a gap within a split are one segment: if one is a
   record, all after it are.
2. A segment's last candidate leads to a landing place, a candidate further on. Landing places are
   joined to the ones that they lead to, and pointer jumping from the start of the file (the
   reach grows, every pointer doubles) finds those that are reached, in a number of steps that
   grows with the logarithm of the longest path.
3. What is not reached is text of a payload, or beyond a gap in a damaged file, and no record.
   A record counts if its successor is a candidate or the end of the file.

Only offsets and lengths take part in this. Records of several pieces (magic inside) are put
together from them; all others go straight from the table of pieces to the result.

Null html is an empty payload. Null page_ids come last among equals; the record of one has an empty
id and is read as null. Rows that repeat a page_id and its payload are that page again: all of the
smallest page_id are responses. Empty tables give an empty archive, and an empty or missing archive
gives no rows. Other columns than page_id, url and html aren't looked at. In urls white space and control
characters are percent-encoded, as a header field is one line; a null url is no field. Payloads
may be of any length that a row can have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written

# fixed values of the format: magic, line end, separator of records, digits of base 32
MAGIC, NEWLINE, GAP = "WARC/1.", "\r\n", "\r\n\r\n"
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD = "page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1, in four parts of 40 bits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _clean(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%00")


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE)))


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the page whose payload a row repeats, or null.

    Payloads aren't shuffled for this unless the table of repeated digests is too large for a broadcast.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    groups = p.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(groups.where("n > 1 and first is not null").select("digest", "first"), "warc-first")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def record(date: str) -> Column:
    """The text of a record of `planned` rows, from its magic to the end of its block."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), F.octet_length("payload"), F.lit(GAP))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload").cast("long"))
    fields = [
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", urn("page_id")),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _clean(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Refers-To", F.when(revisit, urn("refers_to"))),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", size.cast("string")),
    ]
    return F.concat(F.lit(f"{MAGIC}1{NEWLINE}"), F.concat_ws("", *fields), F.lit(NEWLINE), http, F.when(revisit, "").otherwise(F.col("payload")))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes the pages as archive files under a path. Payloads of fewer bytes than least_bytes are never revisits.

    Compressed files aren't split when they are read; with compression "none" they are.
    """
    planned(pages, least_bytes).select(record(date).alias("value")).write.option("lineSep", GAP).option("compression", compression).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text after every magic, in a table: file, block (where its split begins), at (its order there), head, length, size, value.

    head is null where no header follows; length is what it gives as the length of the block.
    """
    v = F.col("value")
    head = F.when(v.rlike(r"\A[01]\r\n") & F.contains(v, F.lit(GAP)), F.substring_index(v, GAP, 1))
    got = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    got = got.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), v, head.alias("head"))
    length = _value("Content-Length").try_cast("long")
    return written(got.select("file", "block", "at", "head", length.alias("length"), F.octet_length(v).cast("long").alias("size"), "value"), "warc-pieces")


def _value(name: str) -> Column:
    """A header field's value; names in any case."""
    return F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(table: DataFrame) -> DataFrame:
    """file, block, at, offset, next (null without a header), and segment, of every piece; the first piece of a file has no magic.

    next is where the record after it would begin. The end of a file is a candidate, too (at is null).
    """
    light = table.select("file", "block", "at", F.octet_length("head").alias("head"), "length", "size")
    in_split = Window.partitionBy("file", "block").orderBy("at")
    blocks = light.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    in_file = Window.partitionBy("file")
    blocks = blocks.withColumns({"base": F.sum("bytes").over(in_file.orderBy("block")) - F.col("bytes"), "end": F.sum("bytes").over(in_file) - len(MAGIC), "least": F.min("block").over(in_file)})
    # a piece begins after its magic: that is where its record begins
    before = F.sum(F.col("size") + len(MAGIC)).over(in_split) - F.col("size") - len(MAGIC)
    rows = light.withColumn("before", before).join(blocks, ["file", "block"])
    offset = F.col("base") + F.col("before") - len(MAGIC)
    size = len(MAGIC) + F.col("head") + len(GAP) + F.col("length") + len(GAP)
    rows = rows.select("file", "block", "at", offset.alias("offset"), (offset + size).alias("next")).where("offset >= 0")
    ends = blocks.where("block = least").select("file", F.col("end").alias("offset"))
    gap = F.coalesce(F.lag("next").over(in_split) != F.col("offset"), F.lit(True))
    rows = rows.withColumn("gap", gap).withColumn("segment", F.sum(F.col("gap").cast("long")).over(in_split)).drop("gap")
    return rows.unionByName(ends, allowMissingColumns=True)


def reached(found: DataFrame) -> DataFrame:
    """The landing places (file, block, segment, offset) on the path from the start of each file, by pointer jumping."""
    place = found.where("at is not null")
    last = place.groupBy("file", "block", "segment").agg(F.max_by("next", "offset").alias("to"))
    starts = place.where("offset = 0").select("file", F.lit(0).cast("long").alias("to"))
    land = last.where("to is not null").select("file", "to").unionByName(starts).distinct()
    land = land.join(place.withColumnRenamed("offset", "to").select("file", "to", "block", "segment"), ["file", "to"])
    land = written(land.withColumnRenamed("to", "offset"), "warc-landings")
    ahead = land.join(last, ["file", "block", "segment"]).select("file", "offset", "to")
    known = land.select("file", F.col("offset").alias("to"))
    jump = written(ahead.join(known, ["file", "to"], "left_semi"), "warc-jumps")
    reach = written(land.where("offset = 0").select("file", "offset"), "warc-reach")
    while jump.take(1):
        more = reach.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reach = written(reach.unionByName(more).distinct(), "warc-reach")
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.offset")))
        jump = written(twice.select("a.file", "a.offset", "b.to"), "warc-jumps")
    return land.join(reach, ["file", "offset"], "left_semi")


def boundaries(found: DataFrame) -> DataFrame:
    """file, at, offset of each piece, with owner: the offset of the record that it is of (its own, if it begins one), or null."""
    entry = reached(found).select("file", "block", "segment", F.col("offset").alias("entry"))
    rows = found.where("at is not null").join(entry, ["file", "block", "segment"], "left")
    on_path = F.coalesce(F.col("offset") >= F.col("entry"), F.lit(False))
    ends = found.select("file", F.col("offset").alias("next"), F.lit(True).alias("boundary")).distinct()
    rows = rows.select("file", "block", "at", "offset", "next", on_path.alias("on_path"))
    rows = rows.join(ends, ["file", "next"], "left").withColumn("starts", F.col("on_path") & F.coalesce("boundary", F.lit(False)))
    # the record before each piece: within its split, else the last one of the splits before
    holder = F.when(F.col("starts"), F.struct("offset", "next"))
    so_far = Window.partitionBy("file", "block").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    splits_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file", "block").agg(F.max_by(holder, F.when(F.col("starts"), F.col("offset"))).alias("h"))
    carried = carried.select("file", "block", F.last("h", True).over(splits_before).alias("carried"))
    rows = rows.withColumn("holder", F.last(holder, True).over(so_far)).join(carried, ["file", "block"])
    rows = rows.withColumn("holder", F.coalesce("holder", "carried"))
    owner = F.when(F.col("offset") < F.col("holder.next"), F.col("holder.offset"))
    return rows.select("file", "at", "offset", owner.alias("owner"))


def _records(rows: DataFrame) -> DataFrame:
    """Rows (head, value) of whole records without their magic as records."""
    of_page = lambda name: F.regexp_extract(_value(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    data = F.col("value").cast("binary")
    skip = F.octet_length("head") + len(GAP)
    block = F.substring(data, skip + 1, F.col("length").cast("int"))
    http = F.substring_index(block.cast("string"), GAP, 1)
    kind = _value("WARC-Type")
    payload = F.when(kind == "response", F.substring(block, F.octet_length(http) + len(GAP) + 1, F.col("length").cast("int")))
    said = F.regexp_extract(http, r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("long")
    return rows.select(
        of_page("WARC-Record-ID").alias("page_id"),
        kind.alias("record_type"),
        _value("WARC-Target-URI").alias("url"),
        F.when(kind == "revisit", of_page("WARC-Refers-To")).alias("refers_to"),
        F.replace(_value("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        said.alias("payload_bytes"),
        payload.alias("payload"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files under a path, in the columns of RECORD; payload is null for revisits.

    payload_digest and payload_bytes are what the record says of its full payload; `verified` compares them.
    """
    table = pieces(spark, path)
    places = boundaries(candidates(table))
    alone = Window.partitionBy("file", "owner")
    odd = places.withColumn("many", F.count(F.lit(1)).over(alone)).where("owner is null or many > 1")
    odd = written(odd.select("file", "at", "owner", F.lit(True).alias("odd")), "warc-odd")
    rows = table.join(odd, ["file", "at"], "left")
    single = rows.where("odd is null and head is not null").select("head", "length", "value")
    parts = rows.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "head", "length", "value"))).alias("p"))
    whole = parts.select(F.col("p")[0]["head"].alias("head"), F.col("p")[0]["length"].alias("length"), F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    return _records(single.unionByName(whole))


def verified(records: DataFrame) -> DataFrame:
    """Records with ok: a response's payload has the length and digest that its header says; of revisits neither is known here."""
    same = (F.octet_length("payload") == F.col("payload_bytes")) & (base32_sha1(F.col("payload")) == F.col("payload_digest"))
    return records.withColumn("ok", F.coalesce(same, F.lit(True)))


def archive_digests(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new archive in the shared folder, reads it back and gives the query's columns.

    Length and digest of a response are those of the payload that was read, of a revisit what its record says.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/runscope-warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    r = read_archive(spark, path)
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    digest = F.coalesce(base32_sha1(F.col("payload")), F.col("payload_digest"))
    return r.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first, sha1(t) AS h FROM p),
d AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, strlen(t) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM d"""
