"""Pieces that several operators share: tables, shared storage, folds, blocks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a fresh local one only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="shared-"))
    return _own_dir[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    It cuts the lineage: what follows survives lost executors without
    repeating what went before, and several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table that ``stored`` wrote and nothing reads any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % parts


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def single_threaded() -> None:
    """Called in Python workers: parallelism comes from Spark's tasks."""
    for name in ("TOKENIZERS_PARALLELISM", "OMP_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ[name] = "false" if name.startswith("TOK") else "1"


#: Keys that rows may crowd on, at most, and the fewest rows that make a crowd.
CROWDS, CROWD = 10_000, 10_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, n_rows: str) -> DataFrame:
    """Inner join on ``key``, in which no task gathers the rows of a frequent key.

    ``facts`` says in ``n_rows`` how many of ``rows`` have its key.  Keys with
    10,000 rows and a ten-thousandth of all rows at least are met where their
    rows lie; there are 10,000 of them at most, which bounds what is broadcast.
    The other keys are shuffled.
    """
    total, most, fewest = facts.agg(F.sum(n_rows), F.max(n_rows), F.min(n_rows)).first()
    least = max(CROWD, (total or 0) // CROWDS)
    if (most or 0) < least:
        return rows.join(facts.drop(n_rows), key)
    if fewest >= least:
        return rows.join(F.broadcast(facts.drop(n_rows)), key)
    many, few = facts.where(F.col(n_rows) >= least).drop(n_rows), facts.where(F.col(n_rows) < least).drop(n_rows)
    apart = rows.join(F.broadcast(many.select(key).distinct()), key, "left_anti")
    return rows.join(F.broadcast(many), key).unionByName(apart.join(few, key))
