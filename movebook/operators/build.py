"""From targets to a published book: what to read, what is left over, what is recorded.

A published book is a folder of versions and a pointer to the one that counts.
A version holds the book and the manifest of its sources, so that both become
visible in one step: a crash leaves the old version, never a book whose sources
are not recorded.  Runs, tallies of a build that was cut short, lie beside the
versions until a version takes them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import book as B
from . import catalog as C

BOOK, SOURCES = "state string, move string, n long", "filename string, seq long"


def resolved_targets(targets: DataFrame, files: DataFrame, dumps: DataFrame) -> DataFrame:
    """``seq, target, rank, filename, outcome`` of ``seq, target``.

    A target that is a file is itself, wherever it lies; any other one is a
    part of tags, of which those count whose dump is downloaded.
    """
    name = F.element_at(F.split("target", "/"), -1)
    have = files.select(F.col("filename").alias("have")).distinct()
    asked = targets.join(have, F.col("target") == F.col("have"), "left")
    own = asked.where("have is not null").select("seq", "target", F.lit(0).alias("rank"), name.alias("filename"), F.lit("file").alias("outcome"))
    others = asked.where("have is null").select("seq", "target")
    hits = others.join(C.matched(others.select(F.col("target").alias("q")).distinct(), dumps).withColumnRenamed("q", "target"), "target", "left")
    named = hits.join(dumps.select("rank", "filename"), "rank", "left").join(have, F.col("filename") == F.col("have"), "left")
    outcome = F.when(F.col("rank").isNull(), "no match").when(F.col("have").isNull(), "not downloaded").otherwise("dump")
    return own.unionByName(named.select("seq", "target", "rank", "filename", outcome.alias("outcome")))


def inputs(resolved: DataFrame) -> DataFrame:
    """``filename, seq, rank`` of what can be read, each file at its first place."""
    ready = resolved.where("outcome in ('file', 'dump')")
    return ready.groupBy("filename").agg(F.min(F.struct("seq", "rank")).alias("first")).select("filename", "first.seq", "first.rank")


def caught_up(files: DataFrame, manifest: DataFrame, fresh: bool = False) -> DataFrame:
    """``filename, seq``: downloads that the book does not hold yet, by name."""
    from pyspark.sql import Window

    waiting = B.pending(C.downloaded(files.select("filename")), manifest.select("filename"), "filename", fresh)
    return waiting.select("filename", (F.row_number().over(Window.orderBy("filename")) - 1).cast("long").alias("seq"))


def recorded_after_resume(manifest: DataFrame, waiting: DataFrame, targets: DataFrame) -> DataFrame:
    """``filename, seq``: what was recorded, then downloads that were not, then targets by the names of their dumps."""
    more = targets.select(C.manifest_name("target").alias("filename"), "seq")
    return C.manifest_union(C.manifest_union(manifest, waiting), more)


def _pointer(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/CURRENT")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return hadoop, system.makeQualified(at), system


def current_version(spark: SparkSession, path: str) -> int | None:
    """The version that counts; None before the first."""
    hadoop, at, system = _pointer(spark, path)
    if not system.exists(at):
        return None
    return int(spark.read.text(f"{path}/CURRENT").first().value)


def _point_at(spark: SparkSession, path: str, version: int) -> None:
    """Write the pointer beside its place and move it there, over the old one, in one step."""
    hadoop, at, system = _pointer(spark, path)
    beside = system.makeQualified(hadoop.Path(f"{path}/CURRENT.next"))
    out = system.create(beside, True)
    out.write(bytearray(str(version).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    renames = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, at, renames)


def publish(book: DataFrame, manifest: DataFrame, path: str, files: int = 8) -> int:
    """Write a new version, sorted by state, with its manifest, and let it count; its number.  Older versions stay."""
    spark = book.sparkSession
    version = (current_version(spark, path) or 0) + 1
    B.publish(book, f"{path}/book", version, files)
    manifest.select("filename", "seq").coalesce(1).write.mode("overwrite").parquet(f"{path}/sources/v={version}")
    _point_at(spark, path, version)
    return version


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The book and the manifest that count; empty ones before the first version."""
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], BOOK), spark.createDataFrame([], SOURCES)
    return spark.read.schema(BOOK).parquet(f"{path}/book/v={version}"), spark.read.schema(SOURCES).parquet(f"{path}/sources/v={version}")


def build(tallies: DataFrame, names: DataFrame, path: str, fresh: bool = False, files: int = 8) -> int:
    """Fold the tallies ``source, state, move, n`` of the files ``filename, seq`` into the published book.

    What is named is folded, recorded or not: naming a source again counts it
    again.  ``fresh`` starts from nothing.  Nothing to fold is an error.
    """
    spark = tallies.sparkSession
    if names.isEmpty():
        raise ValueError("nothing to process")
    old, recorded = published(spark, path)
    if fresh:
        old, recorded = old.limit(0), recorded.limit(0)
    new = tallies.join(names.select(F.col("filename").alias("source")).distinct(), "source", "left_semi")
    return publish(B.merged(old, new), C.manifest_union(recorded, names), path, files)


def leave_run(tally: DataFrame, path: str, number: int) -> None:
    """A part of a build, kept until it is merged."""
    tally.select("state", "move", "n").write.mode("overwrite").parquet(f"{path}/runs/run={number}")


def resume(spark: SparkSession, path: str, record: DataFrame, fresh: bool = False, files: int = 8) -> int:
    """Fold the runs that a build left into the published book, record ``filename, seq``, and remove the runs.

    No runs is an error.
    """
    hadoop, at, system = _pointer(spark, path)
    runs = hadoop.Path(f"{path}/runs")
    if not system.exists(runs) or not len(system.listStatus(runs)):
        raise ValueError("no runs to resume")
    old, recorded = published(spark, path)
    if fresh:
        old, recorded = old.limit(0), recorded.limit(0)
    left = spark.read.schema(BOOK).option("recursiveFileLookup", "true").parquet(f"{path}/runs")
    version = publish(B.merged(old, left), C.manifest_union(recorded, record), path, files)
    system.delete(runs, True)
    return version
