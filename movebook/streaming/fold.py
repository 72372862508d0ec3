"""Folding newly arrived dumps into the book, as a stream.

The file source's checkpoint remembers which files were taken.  A batch may run
twice, so it replaces the tally of its own files and nothing else: folding a
file again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.pgn import chess_tally, game_plies, replayed


def _replace(tally: DataFrame, path: str) -> None:
    tally.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def fold_games(spark: SparkSession, folder: str, tally_path: str, checkpoint: str, any_ending: bool = False, files_per_batch: int = 8) -> StreamingQuery:
    """Take every PGN file that the folder holds by now; a tally by source is at ``tally_path``."""

    def fold(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("at", F.monotonically_increasing_id())
        _replace(chess_tally(game_plies(replayed(rows, any_ending=any_ending))), tally_path)

    stream = spark.readStream.format("text").option("lineSep", "\n[Event ").option("maxFilesPerTrigger", files_per_batch).load(folder)
    text = F.when(F.col("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value")))
    games = stream.select(F.col("_metadata.file_name").alias("source"), text.alias("text"))
    return games.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_tallies(spark: SparkSession, folder: str, schema: str, tally_path: str, checkpoint: str, files_per_batch: int = 8) -> StreamingQuery:
    """The same for Parquet files of ``state, move, n`` records."""

    def fold(batch: DataFrame, _: int) -> None:
        _replace(batch.groupBy("source", "state", "move").agg(F.sum("n").alias("n")), tally_path)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("source", F.col("_metadata.file_name"))
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serving_book(spark: SparkSession, tally_path: str) -> DataFrame:
    """The book over all sources."""
    tally = spark.read.parquet(tally_path)
    keys = [c for c in ("pos_key", "move_idx", "state", "move") if c in tally.columns]
    return tally.groupBy(*keys).agg(F.sum("n").alias("n"))
