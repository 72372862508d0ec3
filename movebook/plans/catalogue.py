"""The registered queries, on the driver's tables.

A customer's orders are a sequence: orders by date and key are plies, the first
character of the priority is the move, and it ends well if its last status is F.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fmt, moves
from ..operators import book as B
from ..operators import catalog as C
from ..operators import identify as I
from ..operators import line as L
from ..operators import sequence as S
from ..session import materialised, shared_dir
from ..sources import bookfile, pgn


def _ended():
    return F.col("last.o_orderstatus") == "F"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sequences(spark, sf_dir) -> DataFrame:
    return S.gathered(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "substr(o_orderpriority, 1, 1)", ["o_orderstatus"])


def _by_segment(spark, sf_dir) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return _sequences(spark, sf_dir).join(customers, "o_custkey")


def _qualified(spark, sf_dir) -> DataFrame:
    return S.qualified(_sequences(spark, sf_dir), _ended())


def _plies(spark, sf_dir, transposing=False) -> DataFrame:
    return S.plies(_qualified(spark, sf_dir), ["o_custkey"], transposing)


def _book(spark, sf_dir, transposing=False) -> DataFrame:
    return B.tally(_plies(spark, sf_dir, transposing))


def seq_plies(spark, sf_dir):
    return S.plies(_sequences(spark, sf_dir), ["o_custkey"])


def seq_events_plies(spark, sf_dir):
    """Users' events, cut after each purchase; open tails are sequences of their own."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(order), F.lit(0)).cast("int")
    rows = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").withColumn("segment", cut)
    games = S.qualified(S.gathered(rows, ["user_id", "segment"], ["ts", "event_id"], "event_type"), F.element_at("moves", -1) == "purchase")
    return B.tally(S.plies(S.capped(games, 4, "truncate")))


def seq_conversations(spark, sf_dir):
    games = S.gathered(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")
    return B.tally(S.plies(S.qualified(games, F.element_at("moves", -1) == "assistant")))


def seq_qualify(spark, sf_dir):
    return S.kept_and_skipped(_by_segment(spark, sf_dir), "c_mktsegment", _ended())


def seq_any_ending(spark, sf_dir):
    return B.tally(S.plies(S.qualified(_sequences(spark, sf_dir), _ended(), any_ending=True), transposing=True))


def seq_max_ply_drop(spark, sf_dir):
    return S.plies(S.capped(_qualified(spark, sf_dir), 8, "drop"), ["o_custkey"])


def seq_max_ply_truncate(spark, sf_dir):
    return S.plies(S.capped(_qualified(spark, sf_dir), 8, "truncate"), ["o_custkey"])


def seq_limit_per_source(spark, sf_dir):
    first = S.first_per_source(_by_segment(spark, sf_dir), "c_mktsegment", ["o_custkey"], 20)
    return S.qualified(first, _ended()).select("c_mktsegment", "o_custkey", "n_plies")


def book_tally(spark, sf_dir):
    return _book(spark, sf_dir)


def book_transposition(spark, sf_dir):
    return _book(spark, sf_dir, True)


def book_weighted(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select(F.concat_ws(S.SEP, "l_returnflag", "l_linestatus").alias("state"), F.year("l_shipdate").cast("string").alias("move"), "l_quantity")
    return B.tally(lines, "cast(l_quantity as bigint)")


def book_nested_ranked(spark, sf_dir):
    return B.flattened(B.nested(_book(spark, sf_dir, True)))


def book_ranked_top(spark, sf_dir):
    return B.ranked(_book(spark, sf_dir, True)).where("rank <= 3")


def book_merge_two(spark, sf_dir):
    games = S.qualified(_sequences(spark, sf_dir), _ended())
    early = F.year("last.o_orderdate") < 1998
    return B.merged(*[B.tally(S.plies(games.where(part), transposing=True)) for part in (early, ~early)])


def book_merge_many(spark, sf_dir):
    games = S.qualified(_sequences(spark, sf_dir), _ended())
    runs = S.plies(games.withColumn("run", F.col("o_custkey") % 4), ["run"], transposing=True).groupBy("run", "state", "move").agg(F.count(F.lit(1)).alias("n"))
    return B.merged(runs)


def _by_year(spark, sf_dir):
    games = S.qualified(_sequences(spark, sf_dir), _ended()).withColumn("source", F.year("last.o_orderdate").cast("string"))
    return S.plies(games, ["source"], transposing=True)


def book_incremental_left_anti(spark, sf_dir):
    manifest = spark.createDataFrame([("1995",), ("1996",), ("1997",)], "source string")
    return B.tally(B.pending(_by_year(spark, sf_dir), manifest, "source"))


def book_double_count(spark, sf_dir):
    """Building a source again by name adds it again."""
    rows = _by_year(spark, sf_dir)
    return B.merged(B.tally(rows), B.tally(rows.where("source = '1998'")))


def book_stats(spark, sf_dir):
    return B.stats(_book(spark, sf_dir, True))


PROBES = ["", "1", "1>2", "1>2>3", "5>5>5>5", "9", "1>1>2>3"]


def _probes(spark):
    return spark.createDataFrame([(p,) for p in PROBES], "state string")


def lookup_point(spark, sf_dir):
    return B.lookup(_book(spark, sf_dir, True), spark.createDataFrame([("1>2",)], "state string"), 1)


def lookup_batch(spark, sf_dir):
    return B.lookup(_book(spark, sf_dir, True), _probes(spark), len(PROBES))


def lookup_nested(spark, sf_dir):
    found = B.lookup_nested(_book(spark, sf_dir, True), _probes(spark))
    return found.select("state", "total", F.array_join(F.transform("moves", lambda m: F.concat_ws(":", m["move"], m["n"].cast("string"))), ",").alias("moves"))


def lookup_unresolved_total(spark, sf_dir):
    legal = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "move string")
    return B.lookup(_book(spark, sf_dir, True), _probes(spark), len(PROBES), legal).select("state", "total", "move", "n")


def forced_states(spark, sf_dir):
    return L.forced(_book(spark, sf_dir))


def forced_playout(spark, sf_dir):
    book = _book(spark, sf_dir)
    starts = book.where(F.size(F.split("state", S.SEP)) == 4).select("state").distinct()
    return L.forced_playout(book, starts)


def phase_of_state(spark, sf_dir):
    book = _book(spark, sf_dir)
    after = _plies(spark, sf_dir).select(L.next_state(F.col("state"), F.col("move")).alias("state"))
    return L.phases(book, after.union(book.select("state")))


def _history(spark, sf_dir):
    return L.history(_plies(spark, sf_dir, True), _book(spark, sf_dir, True), "o_custkey")


def line_history(spark, sf_dir):
    return _history(spark, sf_dir)


def line_history_delta(spark, sf_dir):
    return L.narrowing(_history(spark, sf_dir), "o_custkey").select("o_custkey", "ply", "total", "delta")


def line_takeback(spark, sf_dir):
    return L.takeback(_history(spark, sf_dir), "o_custkey")


def line_ended_here(spark, sf_dir):
    """The count of the last move of a line, which is the total that a finished line shows."""
    rows = _history(spark, sf_dir)
    return rows.groupBy("o_custkey").agg(F.max(F.struct("ply", "n")).alias("e")).select("o_custkey", F.col("e.n").alias("total"))


def line_move_rows(spark, sf_dir):
    rows = _plies(spark, sf_dir).select("o_custkey", "ply", "move")
    return L.move_rows(rows, "o_custkey", (F.col("ply") + F.col("o_custkey")) % 2 == 0)


def _games(spark, sf_dir):
    rows = _qualified(spark, sf_dir)
    return rows.select(F.col("o_custkey").alias("game"), "moves", F.when(F.col("n_plies") % 3 == 0, "draw").otherwise(F.when(F.col("n_plies") % 2 == 0, "black").otherwise("white")).alias("winner"))


def identify_unique(spark, sf_dir):
    games = _games(spark, sf_dir)
    return I.identified(games.select(F.col("game").alias("line"), "moves", "winner"), games)


def identify_candidates(spark, sf_dir):
    games = _games(spark, sf_dir)
    lines = games.select(F.array_join(F.slice("moves", 1, 3), S.SEP).alias("line"), "game", F.size("moves").alias("n"))
    return I.only_candidate(lines.where("n >= 5").select("line", "game"), lines.where("game % 2 = 0").select("line", "game"))


def targets_grouped(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 8).cast("int").alias("a"), (F.col("l_suppkey") % 8).cast("int").alias("b"), (F.col("l_linenumber") % 4).cast("int").alias("c")
    )
    name = lambda c: F.substring(F.lit("abcdefgh"), c + 1, 1)
    uci = F.concat(name(F.col("a")), F.lit("7"), name(F.col("b")), F.lit("8"), F.substring(F.lit("nbrq"), F.col("c") + 1, 1))
    return L.targets(rows.select(uci.alias("uci")).groupBy("uci").agg(F.count(F.lit(1)).alias("n")))


MONTHS = ["2013-03", "2013-02", "2013-01", "2012-12", "", "notes"]
FILES = [("lichess_db_standard_rated_2013-02.pgn.zst", 3_500_000), ("lichess_db_standard_rated_2013-01.pgn.zst", 900), ("lichess_db_standard_rated_2012-12.pgn.zst.part", 7), ("extra.pgn", 2048)]
RECORDED = ["lichess_db_standard_rated_2013-01.pgn.zst", "lichess_db_standard_rated_2012-12.pgn.zst"]


def _dumps(spark):
    urls = [(i, f"https://host/standard/lichess_db_standard_rated_{m}.pgn.zst" if m[:1] == "2" else m) for i, m in enumerate(MONTHS)]
    return C.dump_list(spark.createDataFrame(urls, "rank int, url string"))


def _status(spark):
    names = spark.createDataFrame([(f,) for f, _ in FILES], "filename string")
    files = C.downloaded(names).join(spark.createDataFrame(FILES, "filename string, size long"), "filename")
    return C.status(_dumps(spark), files, spark.createDataFrame([(r,) for r in RECORDED], "filename string"))


def dump_status(spark, sf_dir):
    return _status(spark).withColumn("size_text", F.when(F.col("size").isNotNull(), fmt.human_size(F.col("size"))))


def dump_summary(spark, sf_dir):
    return C.summary(_status(spark))


def dump_match(spark, sf_dir):
    queries = spark.createDataFrame([("2013",), ("LATEST",), ("12",), ("-",), ("1999",)], "q string")
    return C.matched(queries, _dumps(spark))


def dump_pending(spark, sf_dir):
    names = C.downloaded(spark.createDataFrame([(f,) for f, _ in FILES], "filename string"))
    return B.pending(names, spark.createDataFrame([(r,) for r in RECORDED], "filename string"), "filename")


def manifest_union(spark, sf_dir):
    old = spark.createDataFrame([(r, i) for i, r in enumerate(RECORDED)], "filename string, seq long")
    new = spark.createDataFrame([("extra.pgn", 0), (RECORDED[0], 1), ("2013-02", 2), ("", 3)], "filename string, seq long")
    return C.manifest_union(old, new.withColumn("filename", F.when(F.col("filename") == "", "").otherwise(C.manifest_name("filename"))))


def fmt_compact(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    n = F.floor(F.col("o_totalprice") * F.pow(F.lit(10), (F.col("o_orderkey") % 7 - 2).cast("double"))).cast("long")
    return orders.select("o_orderkey", n.alias("n"), fmt.compact_count(n).alias("compact"), fmt.grouped_digits(n).alias("digits"))


def fmt_month(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return _read(spark, sf_dir, "orders").select("o_orderkey", fmt.month_label(month).alias("label"), fmt.month_label(F.col("o_orderstatus")).alias("other"))


def human_size(spark, sf_dir):
    n = (F.col("l_orderkey") * F.col("l_partkey") * F.pow(F.lit(8), (F.col("l_linenumber") - 2).cast("double"))).cast("long")
    return _read(spark, sf_dir, "lineitem").select(n.alias("n")).distinct().select("n", fmt.human_size(F.col("n")).alias("size"))


def move_pack_unpack(spark, sf_dir):
    squares = spark.range(64 * 64 * 5).select((F.col("id") % 64).cast("int").alias("origin"), (F.floor(F.col("id") / 64) % 64).cast("int").alias("target"), F.floor(F.col("id") / 4096).cast("int").alias("k"))
    packed = squares.select("origin", "target", F.when(F.col("k") > 0, F.col("k") + 1).otherwise(0).cast("int").alias("promotion"))
    p = packed.withColumn("packed", moves.pack(F.col("origin"), F.col("target"), F.col("promotion")))
    c = F.col("packed")
    return p.select("packed", moves.origin_of(c).alias("origin"), moves.target_of(c).alias("target"), moves.promotion_of(c).alias("promotion"), moves.uci_of(c).alias("uci"))


#: Games with known endings: name, extra tags, moves.
GAMES = [
    ("fool", "", "1. f3 e5 2. g4 Qh4# 0-1"),
    ("scholar", "", "1. e4 e5 2. Bc4 Nc6 3. Qh5 Nf6 4. Qxf7# 1-0"),
    ("stalemate", "", "1. e3 a5 2. Qh5 Ra6 3. Qxa5 h5 4. Qxc7 Rah6 5. h4 f6 6. Qxd7+ Kf7 7. Qxb7 Qd3 8. Qxb8 Qh7 9. Qxc8 Kg6 10. Qe6 1/2-1/2"),
    ("resigned", "", "1. e4 e5 1-0"),
    ("empty", "", "1-0"),
    ("wrong result", '[Result "1-0"]', "1. f3 e5 2. g4 Qh4# 1-0"),
    ("bad san", "", "1. e4 e5 2. Ke3 1-0"),
    ("atomic", '[Variant "Atomic"]', "1. f3 e5 2. g4 Qh4# 0-1"),
    ("fen", '[FEN "8/8/8/8/8/8/8/8 w - - 0 1"]', "1. f3 e5 2. g4 Qh4# 0-1"),
    ("comments", "", "1. f3 {x} $1 (1. e4 e5) 1... e5 2. g4? Qh4#"),
    ("repetition", "", "1. Nf3 Nf6 2. Ng1 Ng8 3. f3 e5 4. g4 Qh4# 0-1"),
]


def _chess_games(spark, **how):
    rows = [("embedded", i, f'[Event "{name}"]\n{tags}\n\n{moves}\n') for i, (name, tags, moves) in enumerate(GAMES)]
    return pgn.replayed(spark.createDataFrame(rows, "source string, at bigint, text string"), **how)


def chess_replay(spark, sf_dir):
    return _chess_games(spark).select(F.col("headers")["Event"].alias("event"), "verdict", "n_plies", "ending", "winner", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


def chess_kept_skipped(spark, sf_dir):
    return _chess_games(spark).groupBy("source").agg(F.count_if(F.col("verdict") == "ok").alias("kept"), F.count_if(F.col("verdict") != "ok").alias("skipped"))


def chess_book(spark, sf_dir):
    """Moves by ply and count, without the keys, which are this engine's own."""
    plies = pgn.game_plies(_chess_games(spark))
    counts = pgn.chess_tally(plies)
    return counts.groupBy("uci").agg(F.count(F.lit(1)).alias("positions"), F.sum("n").alias("n"))


def chess_lookup(spark, sf_dir):
    fens = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "8/8/8/8/8/8/8/8 w - - 0 1", "not a fen"]
    book = pgn.chess_tally(pgn.game_plies(_chess_games(spark)))
    return pgn.lookup_fens(book, spark.createDataFrame([(f,) for f in fens], "fen string"))


def chess_legal_index(spark, sf_dir):
    fen = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    told = pgn.fen_facts(spark.createDataFrame([(fen,)], "fen string"))
    return told.select(F.explode("facts.legal").alias("m")).select("m.idx", "m.uci", "m.san")


def chess_identify(spark, sf_dir):
    games = _chess_games(spark)
    lines = games.where("verdict = 'ok'").select(F.col("headers")["Event"].alias("line"), "ucis")
    return pgn.identify_lines(lines, games)


def chess_material(spark, sf_dir):
    """Missing pieces and their worth, from the text of the board."""
    fens = spark.createDataFrame([("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR",), ("5bnr/4p1pq/4Qpkr/7p/7P/4P3/PPPP1PP1/RNB1KBNR",), ("k7/8/8/8/8/8/8/KQQ5",)], "board string")
    worth = (("p", 8, 1), ("n", 2, 3), ("b", 2, 3), ("r", 2, 5), ("q", 1, 9))
    lost = lambda piece, n: F.greatest(F.lit(0), F.lit(n) - (F.length("board") - F.length(F.replace("board", F.lit(piece), F.lit("")))))
    side = lambda f: sum((lost(f(p), n) * v for p, n, v in worth[1:]), lost(f(worth[0][0]), worth[0][1]))
    return fens.select("board", side(str.upper).alias("white_lost"), side(str.lower).alias("black_lost")).withColumn("difference", F.col("black_lost") - F.col("white_lost"))


def bookfile_roundtrip(spark, sf_dir):
    """The tally written as segments of a compact book file and read back; hashes of states stand for keys."""
    bookfile.register(spark)
    book = materialised(_book(spark, sf_dir, True).withColumn("pos_key", F.xxhash64("state")), "tally")
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/games-{uuid.uuid4().hex}"
    bookfile.write_book(book.select("pos_key", F.col("move").cast("int").alias("move_idx"), "n"), path, 4)
    back = spark.read.format("bookfile").load(path).join(book.select("pos_key", "state").distinct(), "pos_key")
    return back.select("state", F.col("move_idx").cast("string").alias("move"), "n")


QUERIES = [
    chess_replay, chess_kept_skipped, chess_book, chess_lookup, chess_legal_index, chess_identify, chess_material, bookfile_roundtrip,
    seq_plies, seq_events_plies, seq_conversations, seq_qualify, seq_any_ending, seq_max_ply_drop, seq_max_ply_truncate, seq_limit_per_source,
    book_tally, book_transposition, book_weighted, book_nested_ranked, book_ranked_top, book_merge_two, book_merge_many, book_incremental_left_anti,
    book_double_count, book_stats, lookup_point, lookup_batch, lookup_nested, lookup_unresolved_total, forced_states, forced_playout, phase_of_state,
    line_history, line_history_delta, line_takeback, line_ended_here, line_move_rows, identify_unique, identify_candidates, targets_grouped,
    dump_status, dump_summary, dump_match, dump_pending, manifest_union, fmt_compact, fmt_month, human_size, move_pack_unpack,
]


def queries() -> dict:
    from . import more

    return {f.__name__: f for f in QUERIES + more.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay, qualify, tally and rank: the book, most played first."""
    return B.ranked(_book(spark, sf_dir, True))
