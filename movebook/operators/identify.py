"""Which sequence a line comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import SEP

#: Longest line that is asked for, and the ply whose state is looked at.
LONGEST, DEPTH = 1024, 49


def anchored(lines: DataFrame, transposing: bool = True) -> DataFrame:
    """``line, state, target, winner`` of lines ``line, moves, winner``; lines of no or too many moves go."""
    at = F.least(F.size("moves") - 1, F.lit(DEPTH))
    prior = F.slice("moves", F.lit(1), at)
    ok = lines.where((F.size("moves") >= 1) & (F.size("moves") <= LONGEST))
    state = F.array_join(F.array_sort(prior) if transposing else prior, SEP)
    return ok.select("line", state.alias("state"), F.element_at("moves", (at + 1).cast("int")).alias("target"), "winner")


def passing(games: DataFrame, depth: int = DEPTH, transposing: bool = True) -> DataFrame:
    """``game, winner, state, target`` for each ply up to the depth that a line can be anchored at."""
    each = games.select("game", "winner", "moves", F.posexplode(F.slice("moves", 1, depth + 1)).alias("at", "target"))
    prior = F.slice("moves", F.lit(1), F.col("at"))
    return each.select("game", "winner", F.array_join(F.array_sort(prior) if transposing else prior, SEP).alias("state"), "target")


def resolved(asked: DataFrame, passing_games: DataFrame) -> DataFrame:
    """``line, game, exact`` from ``line, state, target, winner`` and ``game, winner, state, target``.

    Games are counted by state, target and winner before they meet the lines,
    so that a state which many games and many lines share joins a few rows.
    """
    sums = passing_games.groupBy("state", "target", F.col("winner").alias("won")).agg(F.count(F.lit(1)).alias("k"), F.min("game").alias("g"))
    hits = asked.join(sums, ["state", "target"], "left")
    same = F.col("won") == F.col("winner")
    found = hits.groupBy("line").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.min("g").alias("only"), F.sum(F.when(same, F.col("k"))).alias("n_same"), F.min(F.when(same, F.col("g"))).alias("only_same"))
    game = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_same") == 1, F.col("only_same"))
    return found.select("line", game.alias("game"), (F.col("n") == 1).alias("exact"))


def identified(lines: DataFrame, games: DataFrame, transposing: bool = True) -> DataFrame:
    """``line, game, exact``: the game that alone plays the target in the state, or alone does so with the line's winner."""
    return resolved(anchored(lines, transposing), passing(games, transposing=transposing))


def only_candidate(recent: DataFrame, top: DataFrame) -> DataFrame:
    """``line, n, game``: candidates of two lists together, not made distinct; a game only where there is one."""
    both = recent.unionAll(top)
    counted = both.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("game").alias("game"))
    return counted.select("line", "n", F.when(F.col("n") == 1, F.col("game")).alias("game"))


def too_short_or_long(lines: DataFrame) -> DataFrame:
    """``line, error`` of lines ``line, moves`` that can't be asked for."""
    n = F.coalesce(F.size("moves"), F.lit(0))
    return lines.where((n < 1) | (n > LONGEST)).select("line", F.when(n < 1, "no moves").otherwise("too many moves").alias("error"))


PLAYER = "struct<name:string,rating:int>"
GAME = f"struct<uci:string,id:string,white:{PLAYER},black:{PLAYER},winner:string,speed:string,month:string>"
#: What an explorer of games answers about a position, as JSON.
ANSWER = f"struct<moves:array<struct<uci:string,white:bigint,draws:bigint,black:bigint,game:{GAME}>>,recentGames:array<{GAME}>,topGames:array<{GAME}>>"


def from_answers(asked: DataFrame) -> DataFrame:
    """``line, game`` (a struct with ``exact``, or null) from ``line, target, winner, answer``.

    The first entry of the target has a count of white, draws and black, where
    what is missing is zero; the game it names counts outright.  Else the
    recent and the top games of the target that end as the line does are
    candidates, both lists together, and only one alone counts.  A game needs
    an id and both names.  It is exact if the entry's count is one.
    """
    whole = lambda g: g["id"].isNotNull() & g["white"]["name"].isNotNull() & g["black"]["name"].isNotNull()
    plain = lambda g: F.when(whole(g), F.struct(*[g[c].alias(c) for c in ("id", "white", "black", "winner", "speed", "month")]))
    entry = F.try_element_at(F.filter("answer.moves", lambda m: m["uci"] == F.col("target")), F.lit(1))
    listed = F.concat(*[F.coalesce(F.col(f"answer.{c}"), F.array().cast(f"array<{GAME}>")) for c in ("recentGames", "topGames")])
    fits = F.filter(listed, lambda g: (g["uci"] == F.col("target")) & whole(g) & g["winner"].eqNullSafe(F.col("winner")))
    found = asked.select("line", entry.alias("entry"), fits.alias("fits"))
    count = sum((F.coalesce(F.col(f"entry.{c}"), F.lit(0)) for c in ("white", "draws", "black")), F.lit(0))
    alone = F.when(F.size("fits") == 1, plain(F.try_element_at("fits", F.lit(1))))
    game = F.when(F.col("entry").isNotNull(), F.coalesce(plain(F.col("entry.game")), alone))
    told = found.select("line", game.alias("game"), (count == 1).alias("exact"))
    return told.select("line", F.when(F.col("game").isNotNull(), F.col("game").withField("exact", F.col("exact"))).alias("game"))
