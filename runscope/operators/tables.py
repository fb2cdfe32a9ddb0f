"""Tables that several steps read, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table under spark.checkpoint.dir: written now, read as often as needed, lost with no executor.

    A local master without that setting writes to a temporary folder; a cluster must set it. The table stays until its folder is cleared.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="runscope-")
    path = f"{where.rstrip('/')}/runscope-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
