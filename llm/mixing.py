"""Temperature mixing of sources to target weights, in DataFrame operations only.

A source's share p of the tokens gets the weight p**t / sum(p**t).  The exponent
t lies between 0 (all sources alike) and 1 (as they come); bisection finds the
largest that reaches a target entropy, then, if a source would repeat too
often, the smallest that keeps the repetition limit.  Weights are realised as
block permutations: each pass over a source orders its blocks anew, whole
passes take every document, and the last pass stops at the source's budget.

Where that last pass stops is one string a source: documents have a sort key
that starts with their block's place in the pass, and those up to the string
are in.  It is found from sums by block, by part of the block where the budget
ends, and by document of the part where it ends, so no task gathers a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bisection steps that one job evaluates, and jobs.
LEVELS, ROUNDS = 4, 8
#: Largest table of sources that is broadcast; larger ones are joined with salt.
BROADCAST_SOURCES = 100_000
SALTS = 32


@dataclass(frozen=True)
class Mix:
    """``entropy``: target as a share of the greatest possible.  ``repeats``: most passes over a source.
    ``budget``: tokens as a multiple of the input's, or None for the least budget that takes every source whole once."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: float | None = 1.0
    seed: str = "mix"


def word_tokens(text: Column | str) -> Column:
    """Words and one end; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)) + 1).cast("long")


def _named(source: Column | str) -> Column:
    """A key that is never null: sources without a name are one source."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string") if isinstance(source, str) else source), F.lit("n"))


def _curve(sources: DataFrame, total: float, exponents: list[float], mix: Mix) -> dict[float, tuple[float, float]]:
    """Entropy and most repeats at each exponent; one aggregation, one row an exponent."""
    p = F.col("tokens") / F.lit(total)
    points = sources.select(F.log(p).alias("lp"), F.explode(F.array(*[F.lit(t) for t in exponents])).alias("t"))
    rows = (
        points.groupBy("t")
        .agg(F.sum(F.exp(F.col("t") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("t") * F.col("lp")) * F.col("lp")).alias("zl"), F.max((F.col("t") - 1) * F.col("lp")).alias("most"), F.max((1 - F.col("t")) * F.col("lp")).alias("least"))
        .collect()
    )
    found = {}
    for r in rows:
        entropy = math.log(r.z) - r.t * r.zl / r.z
        # Repeats of a source: budget * p**(t-1) / z, or p**(t-1) over its least value.
        found[r.t] = (entropy, math.exp(r.most + r.least) if mix.budget is None else mix.budget * math.exp(r.most) / r.z)
    return found


def bisect(curve, passes, lowest_that: bool) -> float:
    """The end of the bracket on the side where ``passes`` holds; ``curve`` evaluates several points at once."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        n = 2**LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        values = curve(points)
        i, j = 0, n
        while j - i > 1:
            mid = (i + j) // 2
            up = passes(values[points[mid - 1]])
            if up == lowest_that:
                j = mid
            else:
                i = mid
        low, high = low + (high - low) * i / n, low + (high - low) * j / n
    return high if lowest_that else low


def exponent(sources: DataFrame, mix: Mix) -> tuple[float, float, int]:
    """The exponent, the total of tokens and the number of sources of ``name, tokens``."""
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0, 0, 0
    target = mix.entropy * math.log(n)

    def curve(points):
        return _curve(sources, float(total), points, mix)

    ends = curve([0.0, 1.0])
    t = 1.0 if ends[1.0][0] >= target - 1e-12 else bisect(curve, lambda v: v[0] >= target, False)
    if curve([t])[t][1] > mix.repeats:
        t = 1.0 if ends[1.0][1] > mix.repeats else bisect(curve, lambda v: v[1] <= mix.repeats, True)
    return t, total, n


def source_plan(sized: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """``name, weight, passes, stop`` for each source of ``name, key, tokens``, and their number.

    ``passes`` whole passes, then the documents whose place in the next pass is
    at most ``stop``.
    """
    sources = stored(sized.groupBy("name").agg(F.sum("tokens").alias("tokens")), "sources")
    t, total, n = exponent(sources, mix)
    share = F.col("tokens") / F.lit(float(total or 1))
    z, most = sources.agg(F.sum(F.pow(share, F.lit(t))), F.max(F.pow(share, F.lit(1 - t)))).first()
    budget = (mix.budget * total if mix.budget is not None else total * z * most) if n else 0.0
    quota = (
        sources.select("name", "tokens", (F.pow(share, F.lit(t)) / F.lit(float(z or 1))).alias("weight"))
        .withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)))
        .withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
        .withColumn("left", F.col("quota") - F.col("passes") * F.col("tokens"))
        .select("name", "weight", "passes", "left")
    )
    quota = stored(quota, "quotas")

    def where_it_ends(rows: DataFrame, unit: str) -> DataFrame:
        """Per source the first unit that does not fit whole, and what is left when it begins."""
        sums = rows.groupBy("name", "left", unit).agg(F.sum("tokens").alias("tokens"))
        upto = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("name").orderBy(unit)))
        over = upto.where(F.col("upto") > F.col("left")).groupBy("name").agg(F.min(F.struct(F.col(unit).alias("unit"), (F.col("left") - F.col("upto") + F.col("tokens")).alias("left"))).alias("e"))
        return over.select("name", F.col("e.unit").alias("unit"), F.col("e.left").alias("left"))

    def looked_up(rows: DataFrame, small: DataFrame) -> DataFrame:
        return with_source(rows, small, n)

    placed = looked_up(sized, quota.where("left > 0")).withColumn("place", place("name", "key", "passes", mix))
    blocks = stored(where_it_ends(placed.select("name", "left", "tokens", F.substring("place", 1, 35).alias("unit")), "unit"), "end-blocks")
    inside = looked_up(placed.select("name", "tokens", "place"), blocks).where(F.col("place").startswith(F.col("unit"))).select("name", "left", "tokens", "place")
    parts = stored(where_it_ends(inside.select("name", "left", "tokens", F.substring("place", 1, 38).alias("unit")), "unit"), "end-parts")
    last = looked_up(inside.select("name", "tokens", "place"), parts).where(F.col("place").startswith(F.col("unit")))
    by_place = last.groupBy("name", "left", "unit", "place").agg(F.sum("tokens").alias("tokens"))
    fits = by_place.withColumn("upto", F.sum("tokens").over(Window.partitionBy("name").orderBy("place")))
    ends = fits.groupBy("name").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("place"))), F.first("unit")).alias("stop"))
    plan = quota.join(ends, "name", "left").select("name", "weight", "passes", F.coalesce("stop", F.lit("")).alias("stop"))
    return stored(plan, "source-plan"), n


def document_key(id_col: str, mix: Mix) -> Column:
    return F.md5(F.concat_ws("|", F.lit(mix.seed), F.col(id_col).cast("string")).cast("binary"))


def place(name: str, key: str, turn: Column | str, mix: Mix) -> Column:
    """A document's place in a pass: its block's place (a digest), then its own key, which its block's name starts."""
    turn = F.col(turn) if isinstance(turn, str) else turn
    block = F.substring(key, 1, 3)
    return F.concat(F.md5(F.concat_ws("|", F.lit(mix.seed), turn.cast("string"), F.col(name), block).cast("binary")), F.col(key))


def with_source(rows: DataFrame, small: DataFrame, n_sources: int) -> DataFrame:
    """Join rows to a table of sources: broadcast up to a checked size, else with salt against hot sources."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), "name")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["name", "__salt"]).drop("__salt")


def placed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``row, pass, block, place, weight``: the rows of ``docs``, as a struct, as the mix takes them.

    A row comes once for each pass that takes it.  ``place`` sorts the rows of
    a source within a pass, its blocks in the pass's own order; ``weight`` is
    the source's.  Tokens are words and one end, so empty and null texts count
    one.  Rows without a source are one source.  Rows with one id, or none,
    stand and fall together in a pass.  No rows give no rows.  Columns of
    ``docs`` may have any names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("row"), _named(source_col).alias("name"), document_key(id_col, mix).alias("key"))
    sized = stored(docs.select(_named(source_col).alias("name"), document_key(id_col, mix).alias("key"), word_tokens(text_col).alias("tokens")), "sized")
    plan, n = source_plan(sized, mix)
    told = with_source(named, plan, n)
    more = (place("name", "key", "passes", mix) <= F.col("stop")).cast("int")
    times = told.withColumn("times", F.col("passes") + more).where("times > 0")
    each = times.select("row", "name", "key", "weight", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
    return each.select("row", "pass", F.substring("key", 1, 3).alias("block"), place("name", "key", "pass", mix).alias("place"), "weight")


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as the mix takes them (see ``placed``), with their own columns."""
    return placed(docs, mix, id_col, source_col, text_col).select("row.*")


def mixture(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``<id>, <source>, pass, block, place, weight`` for every row and pass of the mix; the weight to six decimals.

    In the order of pass and place, a source's rows are its block permutations.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = placed(narrow, mix, "id", "source", "text")
    return rows.select(F.col("row.id").alias(id_col), F.col("row.source").alias(source_col), "pass", "block", "place", F.round("weight", 6).alias("weight"))
