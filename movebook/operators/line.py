"""Walking the book: phases, forced playout, history, takeback, rows and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .sequence import SEP


def next_state(state: Column, move: Column) -> Column:
    return F.when(state == "", move).otherwise(F.concat_ws(SEP, state, move))


def phases(book: DataFrame, states: DataFrame) -> DataFrame:
    """``state, choices, phase``: dry without a known move, forced with one distinct move, else choose."""
    known = book.groupBy("state").agg(F.count(F.lit(1)).alias("choices"))
    found = states.select("state").distinct().join(known, "state", "left").withColumn("choices", F.coalesce("choices", F.lit(0)))
    return found.withColumn("phase", F.when(F.col("choices") == 0, "dry").when(F.col("choices") == 1, "forced").otherwise("choose"))


def forced(book: DataFrame) -> DataFrame:
    """``state, move, n`` where exactly one distinct move is known, however often it was played."""
    one = book.groupBy("state").agg(F.count(F.lit(1)).alias("k"), F.first("move").alias("move"), F.first("n").alias("n"))
    return one.where("k = 1").select("state", "move", "n")


def doubled(steps_ahead: DataFrame, most: int | None = None) -> DataFrame:
    """``state, to, steps``: where single steps ``state, to, steps`` lead in the end, or after ``most`` of them.

    A line that comes back to itself has no end: jumps stop when they are as
    long as there are steps, and then lead to a state that still has a step.
    """
    jump = materialised(steps_ahead, "jumps")
    reach = longest = 1
    last = jump.count()
    while longest == reach and reach <= last and (most is None or 2 * reach <= most):
        ahead = jump.select(F.col("state").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        jump = materialised(jump.join(ahead, "to", "left").select("state", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "jumps")
        reach *= 2
        longest = jump.agg(F.max("steps")).first()[0]
    return jump


def forced_playout(book: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """``start, end, steps, phase``: where forced moves lead from each start.

    Jumps are doubled: a table of forced states that leads one step ahead is
    joined with itself to lead two, four, ... ahead, until the longest stops
    growing, so the number of joins is the logarithm of the longest line or of
    ``most`` (a power of two), where that is given.  Each table is written, so
    that the next round reads it twice instead of making it twice.  A state
    grows with each move, so the one cycle there can be is a move that leads
    back to its own state; it is no step.
    """
    edges = forced(book)
    ahead = edges.select("state", next_state(F.col("state"), F.col("move")).alias("to"), F.lit(1).alias("steps"))
    jump = doubled(ahead.where("to <> state"), most)
    played = starts.select(F.col("state").alias("start")).distinct().join(jump.withColumnRenamed("state", "start"), "start", "left")
    ends = played.select("start", F.coalesce("to", "start").alias("end"), F.coalesce("steps", F.lit(0)).alias("steps"))
    at_end = phases(book, ends.select(F.col("end").alias("state"))).select(F.col("state").alias("end"), "phase")
    return ends.join(at_end, "end").select("start", "end", "steps", "phase")


def history(plies: DataFrame, book: DataFrame, game: str) -> DataFrame:
    """``<game>, ply, state, move, n, total, choices`` of each ply, as the book knows them."""
    state = Window.partitionBy("state")
    known = book.select("state", "move", "n", F.sum("n").over(state).alias("total"), F.count(F.lit(1)).over(state).alias("choices"))
    none = F.lit(0).cast("long")
    told = plies.join(known, ["state", "move"], "left")
    return told.select(game, "ply", "state", "move", *[F.coalesce(c, none).alias(c) for c in ("n", "total", "choices")])


def narrowing(rows: DataFrame, game: str) -> DataFrame:
    """Adds ``delta``: how far the total fell since it was last above zero; null unless it fell to above zero."""
    before = Window.partitionBy(game).orderBy("ply").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("total") > 0, F.col("total")), ignorenulls=True).over(before)
    fell = (prev > 0) & (F.col("total") > 0) & (F.col("total") < prev)
    return rows.withColumn("delta", F.when(fell, prev - F.col("total")))


def takeback(rows: DataFrame, game: str) -> DataFrame:
    """``<game>, n_plies, back_to, popped``: rewind to the last ply with a choice, else to the first; one goes at least."""
    last = F.max(F.when(F.col("choices") > 1, F.col("ply")))
    each = rows.groupBy(game).agg(F.max("ply").alias("n_plies"), F.coalesce(last, F.lit(1)).alias("back_to"))
    return each.withColumn("popped", F.col("n_plies") - F.col("back_to") + 1)


def move_rows(plies: DataFrame, game: str, white: Column) -> DataFrame:
    """``<game>, row, white, black``: a white move opens a row, a black one fills it; a leading black one opens row 1."""
    order = Window.partitionBy(game).orderBy("ply")
    opens = F.when(white | (F.row_number().over(order) == 1), 1).otherwise(0)
    numbered = plies.withColumn("__white", white).withColumn("__opens", opens).withColumn("row", F.sum("__opens").over(order))
    return numbered.groupBy(game, "row").agg(F.max(F.when(F.col("__white"), F.col("move"))).alias("white"), F.max(F.when(~F.col("__white"), F.col("move"))).alias("black"))


def targets(moves: DataFrame) -> DataFrame:
    """``from_sq, to_sq, total, options``: counts summed over moves that share both squares; options by count."""
    entry = F.struct((-F.col("n")).alias("less"), F.col("uci"))
    grouped = moves.groupBy(F.substring("uci", 1, 2).alias("from_sq"), F.substring("uci", 3, 2).alias("to_sq")).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("by"))
    return grouped.select("from_sq", "to_sq", "total", F.array_join(F.transform("by", lambda e: e["uci"]), ",").alias("options"))
