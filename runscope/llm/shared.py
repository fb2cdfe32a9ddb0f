"""Written intermediate tables, input cleaning, bitmaps of keys and the connected components of a link table."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import mix


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="runscope-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts takes: long texts come few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows as a Parquet table in the shared folder: it cuts the lineage, and lost executors do not lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/runscope-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Asks the driver for a garbage collection: only then does Spark remove the shuffle files of steps that are done."""
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the text operators read, under fixed names; whatever else the table has can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_BITS, _BYTES = (1 << 20, 1 << 28), 1 << 13


def _bit(columns: tuple, bits: int) -> np.ndarray:
    h = np.uint64(0)
    for c in columns:
        h = mix(h + c.astype(np.int64).view(np.uint64), 31)
    return h % np.uint64(bits)


def contains(bitmap: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Which rows may be among those that the bitmap was made of; all that are, and few others."""
    bit = _bit(columns, 8 * len(bitmap))
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _setting(bits: int):
    def run(batches):
        for b in batches:
            bit = _bit(tuple(c.to_numpy() for c in b.columns), bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit // (8 * _BYTES)), pa.array(bit % (8 * _BYTES))], ["cell", "bit"])

    return run


def _cell(table: pa.Table) -> pa.Table:
    on = np.zeros(8 * _BYTES, bool)
    on[table.column("bit").to_numpy()] = True
    bits = np.packbits(on, bitorder="little").tobytes()
    return pa.table({"cell": [table.column("cell")[0].as_py()], "bits": pa.array([bits], pa.binary())})


def marked(rows: DataFrame) -> np.ndarray:
    """A bitmap by hash of rows of longs without nulls, for `contains`: some 32 bits a row, 32 MB at most.

    Tasks test rows of their own with it, so that large ones needn't be shuffled to a join.
    """
    bits = min(_BITS[1], max(_BITS[0], 1 << (32 * rows.count()).bit_length()))
    out = np.zeros((bits // 8 // _BYTES, _BYTES), np.uint8)
    cells = rows.mapInArrow(_setting(bits), "cell long, bit long").distinct()
    for r in cells.groupBy("cell").applyInArrow(_cell, "cell long, bits binary").collect():  # of bounded size
        out[r["cell"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label): the smallest node that each node of links(a, b) reaches.

    Alternates large-star and small-star steps; every step is a few grouped
    minima and joins whose result is written, and the number of steps grows with
    the logarithm of the longest path. A node with very many neighbours is a
    grouped minimum (combined before the shuffle) and a join that adaptive
    execution can split. Links with nulls are left out; no links, no rows.
    """
    e = links.where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    swapped = lambda d: d.select(F.col("b").alias("a"), F.col("a").alias("b"))
    while True:
        # the minima are tables of their own, so that the joins can split a hub
        low = e.unionByName(swapped(e)).groupBy("a").agg(F.min("b").alias("m"))
        low = written(low.select("a", F.least("m", "a").alias("m")), name)
        # large-star: larger neighbours of a node go to the smallest one around it
        large = swapped(e).join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, name)
        # small-star: smaller neighbours and the node itself go to the smallest
        down = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        other = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(other.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), name)
        # a forest of stars: every node has one parent, and no parent has one itself
        many = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        deep = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if not many.limit(1).unionByName(deep.limit(1)).take(1):
            return after.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        e = after
