"""The book: how often each move was made in each state.

The flat tally ``state, move, n`` is what is stored and merged; nested and
ranked forms are views of it.  Merging is a bag union and a sum, whose partial
sums run before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probes that are broadcast to the book; more are joined by a shuffle.
BROADCAST_PROBES = 10_000


def tally(plies: DataFrame, weight: Column | str | None = None, state: str = "state", move: str = "move") -> DataFrame:
    """One count a ply, or the sum of a weight.  A sequence that repeats a state and move counts each time."""
    n = F.count(F.lit(1)) if weight is None else F.sum(F.expr(weight) if isinstance(weight, str) else weight)
    return plies.groupBy(F.col(state).alias("state"), F.col(move).alias("move")).agg(n.cast("long").alias("n"))


def merged(*books: DataFrame) -> DataFrame:
    """Bag union of books, counts summed."""
    every = reduce(lambda a, b: a.unionByName(b), [b.select("state", "move", "n") for b in books])
    return every.groupBy("state", "move").agg(F.sum("n").alias("n"))


def pending(available: DataFrame, recorded: DataFrame, on: str, fresh: bool = False) -> DataFrame:
    """Sources that the manifest does not name; all of them with ``fresh``."""
    return available if fresh else available.join(recorded, on, "left_anti")


def by_state() -> Window:
    return Window.partitionBy("state")


def ranked(book: DataFrame) -> DataFrame:
    """``state, rank, move, n``: most played first, ties to the smaller move."""
    return book.withColumn("rank", F.row_number().over(by_state().orderBy(F.desc("n"), "move")))


def nested(book: DataFrame) -> DataFrame:
    """``state, total, moves``: the moves as an array of (move, n), most played first."""
    entry = F.struct((-F.col("n")).alias("less"), F.col("move"))
    lists = book.groupBy("state").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("by"))
    return lists.select("state", "total", F.transform("by", lambda e: F.struct(e["move"].alias("move"), (-e["less"]).alias("n"))).alias("moves"))


def flattened(nested_book: DataFrame) -> DataFrame:
    each = nested_book.select("state", F.posexplode("moves").alias("at", "entry"))
    return each.select("state", (F.col("at") + 1).alias("rank"), F.col("entry.move").alias("move"), F.col("entry.n").alias("n"))


def stats(book: DataFrame, root: str = "") -> DataFrame:
    """One row: distinct states, entries, moves and total at the root.  The total counts visits, not sequences."""
    at_root = F.col("state") == root
    by = book.groupBy("state").agg(F.count(F.lit(1)).alias("moves"), F.sum("n").alias("total"))
    return by.agg(
        F.count(F.lit(1)).alias("positions"),
        F.coalesce(F.sum("moves"), F.lit(0)).alias("entries"),
        F.coalesce(F.max(F.when(at_root, F.col("moves"))), F.lit(0)).alias("root_moves"),
        F.coalesce(F.max(F.when(at_root, F.col("total"))), F.lit(0)).alias("root_total"),
    )


def share_text(n: Column, total: Column) -> Column:
    """Rounded per cent from one per cent up, ``<1%`` below, empty without a total."""
    part = F.try_divide(n, total)
    return F.when(F.coalesce(total, F.lit(0)) <= 0, "").when(part >= 0.01, F.concat(F.floor(part * 100 + 0.5).cast("string"), F.lit("%"))).otherwise("<1%")


def lookup(book: DataFrame, probes: DataFrame, n_probes: int | None = None, legal: DataFrame | None = None) -> DataFrame:
    """``state, total, move, n, share, bar`` for each probed state; unknown ones give one row of total 0.

    The total is the sum over all recorded moves.  ``legal`` (a table of
    moves, or of states and their moves) leaves out moves that do not resolve,
    after the total is made.
    """
    keys = probes.select("state").distinct()
    few = n_probes is not None and n_probes <= BROADCAST_PROBES
    hits = book.join(F.broadcast(keys) if few else keys, "state")
    told = hits.withColumn("total", F.sum("n").over(by_state()))
    if legal is not None:
        totals = told.groupBy("state").agg(F.first("total").alias("total"))
        on = [c for c in ("state", "move") if c in legal.columns]
        named = hits.join(legal.select(*on).distinct(), on, "left_semi")
        told = totals.join(named, "state", "left")
    full = keys.join(told, "state", "left")
    top = F.max("n").over(by_state())
    return full.select("state", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "move", "n", share_text(F.col("n"), F.col("total")).alias("share"), (F.col("n") / top * 100).alias("bar"))


def lookup_nested(book: DataFrame, probes: DataFrame) -> DataFrame:
    """``state, total, moves``, as a lookup service answers; an empty array where nothing is known."""
    keys = probes.select("state").distinct()
    empty = F.array().cast("array<struct<move:string,n:bigint>>")
    found = keys.join(nested(book), "state", "left")
    return found.select("state", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce(F.col("moves").cast("array<struct<move:string,n:bigint>>"), empty).alias("moves"))


def publish(book: DataFrame, path: str, version: int, files: int) -> str:
    """Write a version sorted by state, so that point lookups read few row groups; returns its folder."""
    target = f"{path}/v={version}"
    book.repartitionByRange(files, "state").sortWithinPartitions("state").write.mode("overwrite").parquet(target)
    return target
