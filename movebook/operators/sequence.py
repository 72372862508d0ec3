"""Sequences from event rows, and their plies.

A sequence is gathered once, by one shuffle on its key, as an ordered array.
Validity, length and ending are decided on that row, so that rejected sequences
never make plies.  States are derived from the array by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Separates the moves in a state's text.
SEP = ">"


def gathered(rows: DataFrame, game: Sequence[str], order: Sequence[str], move: str, last: Sequence[str] = ()) -> DataFrame:
    """``<game...>, moves, n_plies, last``: ``last`` is a struct of the named columns at the final ply."""
    step = F.struct(*[F.col(o) for o in order], F.expr(move).alias("move"), *[F.col(c) for c in last if c not in order])
    steps = rows.groupBy(*game).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return steps.select(*game, F.col("steps.move").alias("moves"), F.size("steps").alias("n_plies"), F.element_at("steps", -1).alias("last"))


def qualified(sequences: DataFrame, ending: Column, any_ending: bool = False) -> DataFrame:
    """Sequences with at least one ply whose final state ends as required."""
    return sequences.where((F.col("n_plies") > 0) & (F.lit(True) if any_ending else F.coalesce(ending, F.lit(False))))


def capped(sequences: DataFrame, most: int, mode: str = "drop") -> DataFrame:
    """``drop``: sequences longer than ``most`` go whole.  ``truncate``: they lose their later plies.  0 is no cap."""
    if mode not in ("drop", "truncate"):
        raise ValueError(mode)
    if most <= 0:
        return sequences
    if mode == "drop":
        return sequences.where(F.col("n_plies") <= most)
    return sequences.withColumn("moves", F.slice("moves", 1, most)).withColumn("n_plies", F.least(F.col("n_plies"), F.lit(most)))


def first_per_source(sequences: DataFrame, source: str, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` sequences of each source, counted before any filter."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return sequences.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def plies(sequences: DataFrame, keep: Sequence[str] = (), transposing: bool = False) -> DataFrame:
    """``<keep...>, ply, state, move``: one row a ply, with the state before the move.

    The state is the moves so far, in order; ``transposing`` sorts them, so
    that different ways to the same multiset meet.  The final state has no row.
    """
    each = sequences.select(*keep, "moves", F.posexplode("moves").alias("at", "move"))
    prior = F.slice("moves", F.lit(1), F.col("at"))
    state = F.array_join(F.array_sort(prior) if transposing else prior, SEP)
    return each.select(*keep, (F.col("at") + 1).alias("ply"), state.alias("state"), "move")


def kept_and_skipped(sequences: DataFrame, source: str, ending: Column) -> DataFrame:
    ok = (F.col("n_plies") > 0) & F.coalesce(ending, F.lit(False))
    return sequences.groupBy(source).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))
