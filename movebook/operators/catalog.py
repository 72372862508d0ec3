"""Dumps: listing, tags, status, selection and the manifest of what the book holds."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The names of monthly dumps.
DUMP_PREFIX, DUMP_SUFFIX = "lichess_db_standard_rated_", ".pgn.zst"


def tag_of(filename: Column | str) -> Column:
    """The first year and month in a name; empty where there is none."""
    return F.regexp_extract(filename, "([0-9]{4}-[0-9]{2})", 1)


def dump_list(lines: DataFrame) -> DataFrame:
    """``rank, tag, url, filename`` from ``rank, url``; blank lines and lines without a tag go."""
    named = lines.select("rank", F.trim("url").alias("url")).withColumn("filename", F.element_at(F.split("url", "/"), -1))
    return named.withColumn("tag", tag_of("filename")).where("url <> '' and tag <> ''").select("rank", "tag", "url", "filename")


def downloaded(names: DataFrame) -> DataFrame:
    """Finished downloads of ``filename``, sorted by name; partial ones do not count."""
    return names.where(F.col("filename").endswith(".pgn") | F.col("filename").endswith(".pgn.zst")).distinct()


def local_files(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, size`` of a folder on the driver's host; a missing folder is empty."""
    found = [(e.name, e.stat().st_size) for e in os.scandir(folder)] if os.path.isdir(folder) else []
    return downloaded(spark.createDataFrame(found, "filename string, size long"))


def manifest_name(target: Column | str) -> Column:
    """A file's own name; for a tag the name of that month's dump."""
    name = F.element_at(F.split(target, "/"), -1)
    return F.when(name.endswith(".pgn") | name.endswith(".pgn.zst"), name).otherwise(F.concat(F.lit(DUMP_PREFIX), name, F.lit(DUMP_SUFFIX)))


def status(dumps: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``rank, tag, filename, downloaded, processed, size``: a dump without a file is not processed or pending, but absent."""
    marked = dumps.join(files, "filename", "left").join(manifest.select("filename", F.lit(True).alias("recorded")).distinct(), "filename", "left")
    have = F.col("size").isNotNull()
    state = F.when(F.col("recorded"), "yes").when(have, "pending").otherwise("-")
    return marked.select("rank", "tag", "filename", F.when(have, "yes").otherwise("-").alias("downloaded"), state.alias("processed"), "size")


def summary(states: DataFrame) -> DataFrame:
    return states.agg(F.count(F.lit(1)).alias("months"), F.count_if(F.col("downloaded") == "yes").alias("n_downloaded"), F.count_if(F.col("processed") == "yes").alias("n_processed"))


def listed(dumps: DataFrame, query: str = "") -> DataFrame:
    """Case-sensitive: tags that contain the text."""
    return dumps.where(F.col("tag").contains(query))


def matched(queries: DataFrame, dumps: DataFrame) -> DataFrame:
    """``q, rank, tag`` and the queries' other columns: tags that contain the query in any case; ``latest`` is the first entry alone."""
    latest = F.lower("q") == "latest"
    hit = (latest & (F.col("rank") == F.col("first_rank"))) | (~latest & F.contains(F.lower("tag"), F.lower("q")))
    first = dumps.agg(F.min("rank").alias("first_rank")).first()[0]
    others = [c for c in queries.columns if c != "q"]
    return queries.join(dumps.withColumn("first_rank", F.lit(first)), hit).select(*others, "q", "rank", "tag")


def chosen(matches: DataFrame) -> DataFrame:
    """``tag, seq, rank``: each tag once, at its place in the order of the queries (``seq``) and then of the list."""
    return matches.groupBy("tag").agg(F.min(F.struct("seq", "rank")).alias("first")).select("tag", "first.seq", "first.rank")


def to_download(matches: DataFrame, dumps: DataFrame, files: DataFrame) -> DataFrame:
    """``tag, seq, rank, filename`` of what was chosen and is not there yet."""
    return chosen(matches).join(dumps.select("tag", "filename"), "tag").join(files.select("filename"), "filename", "left_anti").select("tag", "seq", "rank", "filename")


def read_dump_list(spark: SparkSession, path: str) -> DataFrame:
    """``rank, tag, url, filename`` of a list file with one URL a line, newest first."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rank", "url"))
    return dump_list(lines)


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, size`` of the finished downloads in a folder of any file system; their contents are not read."""
    listed = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"))
    return listed.where(F.col("filename").endswith(".pgn") | F.col("filename").endswith(".pgn.zst"))


def manifest_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """``filename, seq``: names once, old ones first, each at its earliest place."""
    end = old.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    both = old.select("filename", "seq").unionByName(new.select("filename", (F.col("seq") + F.lit(end)).alias("seq")))
    return both.where(F.trim("filename") != "").groupBy("filename").agg(F.min("seq").alias("seq"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``filename, seq`` of a manifest file, trimmed, blank lines dropped; what can't be read is empty."""
    try:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("seq", "line"))
        return lines.select(F.trim("line").alias("filename"), F.col("seq").cast("long").alias("seq")).where("filename <> ''")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "filename string, seq long")


def manifest_path(book: str) -> str:
    """Beside the book, with a suffix."""
    return book + ".sources"


def newest_first(dumps: DataFrame) -> DataFrame:
    return dumps.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tag"))))
