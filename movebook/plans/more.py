"""Registered queries on builds, catalogs, answers and positions, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import book as B
from ..operators import build as U
from ..operators import catalog as C
from ..operators import identify as I
from ..operators import line as L
from ..operators import sequence as S
from ..session import shared_dir
from ..sources import bookfile, pgn
from ..streaming import fold
from . import catalogue as Q
from .oracles import DUMPS, GAMES, MULTI, ROWS, SHARE, TOLD

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _tallies(spark, sf_dir) -> DataFrame:
    return Q._by_year(spark, sf_dir).groupBy("source", "state", "move").agg(F.count(F.lit(1)).alias("n"))


def _names(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], U.SOURCES)


def _built(spark, sf_dir) -> str:
    """A book of all years in two versions: some years by name, the others by catching up."""
    path, tallies = _folder(spark, "published"), _tallies(spark, sf_dir)
    U.build(tallies, _names(spark, "1997", "1995", "1996"), path, files=2)
    files = tallies.select(F.concat("source", F.lit(".pgn")).alias("filename")).distinct()
    _, recorded = U.published(spark, path)
    left = U.caught_up(files, recorded.withColumn("filename", F.concat("filename", F.lit(".pgn"))))
    U.build(tallies, left.withColumn("filename", F.replace("filename", F.lit(".pgn"), F.lit(""))), path, files=2)
    return path


def build_published(spark, sf_dir):
    return U.published(spark, _built(spark, sf_dir))[0]


def build_manifest(spark, sf_dir):
    return U.published(spark, _built(spark, sf_dir))[1]


def build_resume(spark, sf_dir):
    """A published book of early years, and two runs that a cut-short build left."""
    path, rows = _folder(spark, "resumed"), Q._by_year(spark, sf_dir)
    U.publish(B.tally(rows.where("source < '1998'")), _names(spark, "1995", "1996", "1997"), path, files=2)
    for number, part in enumerate(("move < '3'", "move >= '3'")):
        U.leave_run(B.tally(rows.where("source >= '1998'").where(part)), path, number)
    U.resume(spark, path, _names(spark, "1998"), files=2)
    return U.published(spark, path)[0]


def resume_manifest(spark, sf_dir):
    recorded = _names(spark, "lichess_db_standard_rated_2013-01.pgn.zst", "old.pgn")
    waiting = U.caught_up(spark.createDataFrame([(f,) for f, _ in Q.FILES], "filename string"), recorded)
    return U.recorded_after_resume(recorded, waiting, spark.createDataFrame([("2012-12", 0), ("dir/extra.pgn", 1), ("2013-02", 2)], "target string, seq long"))


TARGETS = ["2013-0", "extra.pgn", "2011-01", "LATEST", "2013-01", "extra.pgn"]


def _resolved(spark) -> DataFrame:
    targets = spark.createDataFrame([(i, t) for i, t in enumerate(TARGETS)], "seq int, target string")
    return U.resolved_targets(targets, C.downloaded(spark.createDataFrame([(f,) for f, _ in Q.FILES], "filename string")), Q._dumps(spark))


def target_resolution(spark, sf_dir):
    return _resolved(spark)


def build_inputs(spark, sf_dir):
    return U.inputs(_resolved(spark))


def lookup_published(spark, sf_dir):
    """A point lookup in a published book, whose files are sorted by state."""
    book, _ = U.published(spark, _built(spark, sf_dir))
    return B.lookup(book.where("state = '1>2'"), spark.createDataFrame([("1>2",)], "state string"))


def lookup_json(spark, sf_dir):
    found = B.lookup_nested(Q._book(spark, sf_dir, True), Q._probes(spark))
    return found.select("state", F.to_json(F.struct(F.col("state").alias("fen"), "total", F.transform("moves", lambda m: F.struct(m["move"].alias("uci"), m["n"].alias("count"))).alias("moves"))).alias("answer"))


def dump_list_query(spark, sf_dir):
    return C.listed(Q._status(spark), "2013-0")


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([(0, "12"), (1, "2013"), (2, "latest"), (3, "1999")], "seq int, q string")


def dump_chosen(spark, sf_dir):
    return C.chosen(C.matched(_asked(spark), Q._dumps(spark)))


def dump_get(spark, sf_dir):
    files = C.downloaded(spark.createDataFrame([(f,) for f, _ in Q.FILES], "filename string"))
    return C.to_download(C.matched(_asked(spark), Q._dumps(spark)), Q._dumps(spark), files)


def _written(spark, name: str, text: str) -> str:
    """A small text file in a folder of its own."""
    path = _folder(spark, "text")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


def dump_list_file(spark, sf_dir):
    lines = "https://host/lichess_db_standard_rated_2013-02.pgn.zst\n\n  https://host/x/lichess_db_standard_rated_2013-01.pgn.zst \nhttps://host/readme.txt"
    return C.read_dump_list(spark, _written(spark, "list", lines))


def folder_scan(spark, sf_dir):
    """Listed without reading a file: parts of a table stand for downloads."""
    path = _folder(spark, "downloads")
    spark.range(3).coalesce(1).write.json(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(str(s.getPath().getName()) for s in system.listStatus(at) if str(s.getPath().getName()).startswith("part-"))
    system.rename(hadoop.Path(f"{path}/{part}"), hadoop.Path(f"{path}/b_2013-01.pgn"))
    return C.folder_files(spark, path)


def manifest_read(spark, sf_dir):
    return C.read_manifest(spark, _written(spark, "manifest", "a.pgn\n\n  b.pgn.zst \nc.pgn"))


def unsigned_order(spark, sf_dir):
    """Keys by their unsigned value: those with the highest bit come last."""
    from pyspark.sql import Window

    keys = Q._read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2 - 30000 - F.when(F.col("o_orderkey") % 2 == 0, F.lit(2**62)).otherwise(0)).alias("pos_key")).distinct()
    return keys.select("pos_key", F.row_number().over(Window.orderBy(bookfile.unsigned())).cast("long").alias("place"))


def identify_lengths(spark, sf_dir):
    lines = spark.createDataFrame([("none", []), ("one", ["a"]), ("most", ["a"] * 1024), ("more", ["a"] * 1025), ("null", None)], "line string, moves array<string>")
    ok = I.anchored(lines.withColumn("winner", F.lit("draw")))
    return I.too_short_or_long(lines).unionByName(ok.select("line", F.concat(F.lit("asks at "), F.size(F.filter(F.split("state", S.SEP), lambda m: m != "")).cast("string")).alias("error")))


def identify_by_ending(spark, sf_dir):
    """Lines of the first three moves, whose candidates end as the line does."""
    games = Q._games(spark, sf_dir)
    lines = games.select(F.array_join(F.slice("moves", 1, 3), S.SEP).alias("state"), "game", "winner")
    each = lines.groupBy("state", "winner").agg(F.count(F.lit(1)).alias("n"), F.min("game").alias("game"))
    return each.select("state", "winner", "n", F.when(F.col("n") == 1, F.col("game")).alias("game"))


ANSWERS = [
    ("own", "e2e4", "white", '{"moves":[{"uci":"e2e4","white":1,"game":{"id":"g1","white":{"name":"A","rating":2000},"black":{"name":"B"},"winner":"black"}}]}'),
    ("several", "e2e4", "white", '{"moves":[{"uci":"d2d4"},{"uci":"e2e4","white":2,"draws":1,"black":4}],"recentGames":[{"uci":"e2e4","id":"g2","white":{"name":"A"},"black":{"name":"B"},"winner":"white","month":"2013-01"}],"topGames":[{"uci":"e2e4","id":"g3","white":{"name":"C"},"black":{"name":"D"},"winner":"black"}]}'),
    ("twice", "e2e4", "white", '{"moves":[{"uci":"e2e4","white":2}],"recentGames":[{"uci":"e2e4","id":"g2","white":{"name":"A"},"black":{"name":"B"},"winner":"white"}],"topGames":[{"uci":"e2e4","id":"g2","white":{"name":"A"},"black":{"name":"B"},"winner":"white"}]}'),
    ("nameless", "e2e4", None, '{"moves":[{"uci":"e2e4","draws":1,"game":{"id":"g1","white":{"name":"A"},"black":{}}}],"topGames":[{"uci":"e2e4","id":"g5","white":{"name":"E"},"black":{"name":"F"}},{"uci":"e2e4","white":{"name":"E"},"black":{"name":"F"}}]}'),
    ("other move", "a2a3", "white", '{"moves":[{"uci":"e2e4"}],"recentGames":[{"uci":"a2a3","id":"g2","white":{"name":"A"},"black":{"name":"B"},"winner":"white"}]}'),
    ("nothing", "e2e4", "white", "{}"),
]


def identify_answers(spark, sf_dir):
    asked = spark.createDataFrame(ANSWERS, "line string, target string, winner string, json string").withColumn("answer", F.from_json("json", I.ANSWER))
    return I.from_answers(asked).select("line", "game.id", F.col("game.white.name").alias("white"), F.col("game.white.rating").alias("rating"), "game.winner", "game.month", "game.exact")


def line_delta_zero(spark, sf_dir):
    """Totals of prices in steps, some of them zero: the fall is from the last total above zero."""
    rows = Q._read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("game"), F.col("o_orderkey").alias("ply"), (F.col("o_orderkey") % 7 * (F.col("o_orderkey") % 3)).alias("total"))
    return L.narrowing(rows, "game")


def phase_over(spark, sf_dir):
    """States in which a customer's line has ended well are over, whatever the book knows of them."""
    games = Q._qualified(spark, sf_dir)
    ended = games.select(F.array_join("moves", S.SEP).alias("state")).distinct()
    known = L.phases(Q._book(spark, sf_dir), ended.unionByName(Q._book(spark, sf_dir).select("state")))
    return known.join(ended.withColumn("over", F.lit(True)), "state", "left").select("state", F.when(F.col("over"), "over").otherwise(F.col("phase")).alias("phase"))


def stream_fold(spark, sf_dir):
    """Yearly tallies arrive as files, are folded, and folded again by a new checkpoint: each counts once."""
    inbox, folded = _folder(spark, "inbox"), _folder(spark, "folded")
    _tallies(spark, sf_dir).select("state", "move", "n").repartition(3).write.parquet(inbox)
    for _ in range(2):
        fold.fold_tallies(spark, inbox, U.BOOK, folded, _folder(spark, "checkpoint")).awaitTermination()
    return fold.serving_book(spark, folded)


def game_split(spark, sf_dir):
    """Games of a text that has two without an Event tag, read a part at a time and split by their headers."""
    text = '[Event "a"]\n\n1. e4 *\n\n[Event "b"]\n[Site "x"]\n\n1. d4 *\n\n[Site "y"]\n\n1. c4 {c} d5 *\n'
    games = pgn.replayed(pgn.read_games(spark, _written(spark, "games", text)), any_ending=True)
    return games.select(F.col("headers")["Event"].alias("event"), F.col("headers")["Site"].alias("site"), F.array_join("ucis", ",").alias("play"))


def chess_playout(spark, sf_dir):
    games = Q._chess_games(spark, any_ending=True)
    starts = {
        "start": START,
        "after f3": "rnbqkbnr/pppppppp/8/8/8/5P2/PPPPP1PP/RNBQKBNR b KQkq - 0 1",
        "after e4": "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1",
        "unknown": "4k3/8/8/8/8/8/8/4K2R w K - 0 1",
        "stalemated": "5bnr/4p1pq/4Qpkr/7p/7P/4P3/PPPP1PP1/RNB1KBNR b KQ - 2 10",
        "mating": "rnbqkbnr/pppp1ppp/8/4p3/6P1/5P2/PPPPP2P/RNBQKBNR b KQkq g3 0 2",
    }
    keys = pgn.position_facts(spark.createDataFrame(list(starts.items()), "name string, fen string")).select("name", F.col("facts.pos_key").alias("start"))
    return keys.join(pgn.playout(games, keys), "start").select("name", "steps", "phase")


def chess_keys(spark, sf_dir):
    """Positions with the same pieces, turn, castling and legal en passant have one key."""
    fens = [
        ("a", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"), ("b", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1"),
        ("c", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 5 9"), ("d", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQk - 0 1"),
        ("e", "rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3"), ("f", "rnbqkbnr/1pp1pppp/p7/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq - 0 3"),
        ("g", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 1"),
    ]
    keys = pgn.position_facts(spark.createDataFrame(fens, "name string, fen string")).groupBy("facts.pos_key").agg(F.array_join(F.array_sort(F.collect_list("name")), "").alias("names"))
    return keys.select("names")


def chess_positions(spark, sf_dir):
    """FEN written again, ending, king in check, result and castling moves (packed as the king taking its rook)."""
    fens = [
        ("both", "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1"), ("mate", "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3"), ("stale", "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1"),
        ("bare", "8/8/4k3/8/8/3K4/8/8 w - - 0 1"), ("check", "4k3/8/8/8/8/8/4R3/4K3 b - - 0 1"), ("no ep", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1"), ("bad", "8/8"), ("two kings", "kk6/8/8/8/8/8/8/K7 w - - 0 1"),
    ]
    told = pgn.position_facts(spark.createDataFrame(fens, "name string, given string").withColumnRenamed("given", "fen"))
    castling = F.array_join(F.transform("facts.castling", lambda m: F.concat_ws(":", m["packed"].cast("string"), m["uci"], m["san"])), ",")
    return told.select("name", "facts.error", F.col("facts.fen").alias("fen"), "facts.ending", "facts.check_square", "facts.result", castling.alias("castling"))


def chess_movetext(spark, sf_dir):
    lines = [("fool", "1. f3 e5 2. g4?! Qh4# 0-1"), ("castle", "1. e4 e5 2. Nf3 Nc6 3. Bc4 Bc5 4. O-O *"), ("none", "1-0"), ("bad", "1. e4 e5 2. Ke3")]
    return pgn.movetext_lines(spark.createDataFrame(lines, "line string, movetext string"))


def fmt_month_forms(spark, sf_dir):
    forms = ["2012-12", "2012-1", "2012-12-05", "2012-13", "2012-00", "2012", "", "x-3", "-7", "2012-a", "12-007"]
    return spark.createDataFrame([(f,) for f in forms], "month string").select("month", fmt.month_label(F.col("month")).alias("label"))


QUERIES = [
    build_published, build_manifest, build_resume, resume_manifest, target_resolution, build_inputs, lookup_published, lookup_json, dump_list_query, dump_chosen, dump_get, dump_list_file,
    folder_scan, manifest_read, unsigned_order, identify_lengths, identify_by_ending, identify_answers, line_delta_zero, phase_over, stream_fold, game_split, chess_playout, chess_keys,
    chess_positions, chess_movetext, fmt_month_forms,
]

YEARS = "y AS (SELECT DISTINCT CAST(year(final_date) AS VARCHAR) AS y FROM q)"
ASKED = "a AS (SELECT * FROM (VALUES (0, '12'), (1, '2013'), (2, 'latest'), (3, '1999')) v(seq, q)), hit AS (SELECT a.seq, d.rank, d.tag, d.filename FROM a JOIN d ON CASE WHEN a.q = 'latest' THEN d.rank = 0 ELSE contains(d.tag, a.q) END), c AS (SELECT tag, CAST(min(seq) AS INTEGER) AS seq, arg_min(rank, seq * 100 + rank) AS rank, min(filename) AS filename FROM hit GROUP BY tag)"
RESOLVED = f"""{DUMPS}, t AS (SELECT * FROM (VALUES (0, '2013-0'), (1, 'extra.pgn'), (2, '2011-01'), (3, 'LATEST'), (4, '2013-01'), (5, 'extra.pgn')) v(seq, target)),
    res AS (
        SELECT CAST(seq AS INTEGER) AS seq, target, CAST(0 AS INTEGER) AS rank, target AS filename, 'file' AS outcome FROM t WHERE target IN (SELECT filename FROM f)
        UNION ALL
        SELECT CAST(t.seq AS INTEGER), t.target, d.rank, d.filename, CASE WHEN d.rank IS NULL THEN 'no match' WHEN f.filename IS NULL THEN 'not downloaded' ELSE 'dump' END
        FROM t LEFT JOIN d ON CASE WHEN lower(t.target) = 'latest' THEN d.rank = 0 ELSE contains(lower(d.tag), lower(t.target)) END LEFT JOIN f ON f.filename = d.filename WHERE t.target NOT IN (SELECT filename FROM f)
    )"""

ORACLES = {
    "build_published": f"WITH {MULTI} SELECT * FROM book",
    "build_manifest": f"""WITH {ROWS}, {YEARS}, o AS (SELECT y AS filename, CASE y WHEN '1997' THEN 0 WHEN '1995' THEN 1 WHEN '1996' THEN 2 END AS named FROM y UNION SELECT * FROM (VALUES ('1997', 0), ('1995', 1), ('1996', 2)))
        SELECT filename, CAST(coalesce(named, 3 + row_number() OVER (PARTITION BY named IS NULL ORDER BY filename) - 1) AS BIGINT) AS seq FROM o""",
    "build_resume": f"WITH {MULTI} SELECT * FROM book",
    "resume_manifest": """SELECT filename, CAST(seq AS BIGINT) AS seq FROM (VALUES ('lichess_db_standard_rated_2013-01.pgn.zst', 0), ('old.pgn', 1), ('extra.pgn', 2),
        ('lichess_db_standard_rated_2013-02.pgn.zst', 3), ('lichess_db_standard_rated_2012-12.pgn.zst', 4)) v(filename, seq)""",
    "target_resolution": f"WITH {RESOLVED} SELECT * FROM res",
    "build_inputs": f"WITH {RESOLVED} SELECT filename, arg_min(seq, seq * 100 + rank) AS seq, arg_min(rank, seq * 100 + rank) AS rank FROM res WHERE outcome IN ('file', 'dump') GROUP BY filename",
    "lookup_published": f"WITH {MULTI}, {TOLD} SELECT '1>2' AS state, CAST(coalesce(b.total, 0) AS BIGINT) AS total, b.move, b.n, {SHARE} AS share, b.n / b.top * 100 AS bar FROM (SELECT 1) LEFT JOIN told b ON b.state = '1>2'",
    "lookup_json": f"""WITH {MULTI}, probes AS (SELECT unnest(['', '1', '1>2', '1>2>3', '5>5>5>5', '9', '1>1>2>3']) AS state)
        SELECT p.state, '{{"fen":"' || p.state || '","total":' || CAST(coalesce(sum(n), 0) AS BIGINT) || ',"moves":[' || coalesce(string_agg('{{"uci":"' || move || '","count":' || n || '}}', ',' ORDER BY n DESC, move), '') || ']}}' AS answer
        FROM probes p LEFT JOIN book b ON b.state = p.state GROUP BY p.state""",
    "dump_list_query": f"WITH {DUMPS} SELECT * FROM st WHERE contains(tag, '2013-0')",
    "dump_chosen": f"WITH {DUMPS}, {ASKED} SELECT tag, seq, rank FROM c",
    "dump_get": f"WITH {DUMPS}, {ASKED} SELECT tag, seq, rank, filename FROM c WHERE filename NOT IN (SELECT filename FROM f)",
    "dump_list_file": """SELECT CAST(rank AS INTEGER) AS rank, tag, url, filename FROM (VALUES (0, '2013-02', 'https://host/lichess_db_standard_rated_2013-02.pgn.zst', 'lichess_db_standard_rated_2013-02.pgn.zst'),
        (2, '2013-01', 'https://host/x/lichess_db_standard_rated_2013-01.pgn.zst', 'lichess_db_standard_rated_2013-01.pgn.zst')) v(rank, tag, url, filename)""",
    "folder_scan": """SELECT 'b_2013-01.pgn' AS filename, CAST(3 * length('{"id":0}' || chr(10)) AS BIGINT) AS size""",
    "manifest_read": "SELECT filename, CAST(seq AS BIGINT) AS seq FROM (VALUES ('a.pgn', 0), ('b.pgn.zst', 2), ('c.pgn', 3)) v(filename, seq)",
    "unsigned_order": """WITH k AS (SELECT DISTINCT o_orderkey * 2 - 30000 - CASE WHEN o_orderkey % 2 = 0 THEN 4611686018427387904 ELSE 0 END AS pos_key FROM orders)
        SELECT CAST(pos_key AS BIGINT) AS pos_key, CAST(row_number() OVER (ORDER BY CASE WHEN pos_key < 0 THEN CAST(pos_key AS HUGEINT) + 18446744073709551616 ELSE pos_key END) AS BIGINT) AS place FROM k""",
    "identify_lengths": "SELECT * FROM (VALUES ('none', 'no moves'), ('null', 'no moves'), ('one', 'asks at 0'), ('most', 'asks at 49'), ('more', 'too many moves')) v(line, error)",
    "identify_by_ending": f"""WITH {GAMES} SELECT array_to_string(moves[1:3], '>') AS state, winner, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN min(game) END AS game FROM g GROUP BY 1, 2""",
    "identify_answers": """SELECT line, id, white, CAST(rating AS INTEGER) AS rating, winner, month, exact FROM (VALUES ('own', 'g1', 'A', 2000, 'black', NULL, true), ('several', 'g2', 'A', NULL, 'white', '2013-01', false),
        ('twice', NULL, NULL, NULL, NULL, NULL, NULL), ('nameless', 'g5', 'E', NULL, NULL, NULL, true), ('other move', NULL, NULL, NULL, NULL, NULL, NULL), ('nothing', NULL, NULL, NULL, NULL, NULL, NULL)) v(line, id, white, rating, winner, month, exact)""",
    "line_delta_zero": """WITH r AS (SELECT o_custkey AS game, o_orderkey AS ply, o_orderkey % 7 * (o_orderkey % 3) AS total FROM orders), s AS (
            SELECT *, max(CASE WHEN total > 0 THEN ply END) OVER (PARTITION BY game ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM r)
        SELECT s.game, s.ply, s.total, CASE WHEN s.total > 0 AND b.total > s.total THEN b.total - s.total END AS delta FROM s LEFT JOIN r b ON b.game = s.game AND b.ply = s.at""",
    "phase_over": f"""WITH {ROWS}, book AS (SELECT pstate AS state, count(DISTINCT move) AS choices FROM q GROUP BY 1), e AS (SELECT DISTINCT array_to_string(list(move ORDER BY ply), '>') AS state FROM q GROUP BY o_custkey)
        SELECT state, 'over' AS phase FROM e UNION ALL SELECT state, CASE WHEN choices = 1 THEN 'forced' ELSE 'choose' END FROM book WHERE state NOT IN (SELECT state FROM e)""",
    "stream_fold": f"WITH {MULTI} SELECT * FROM book",
    "game_split": "SELECT * FROM (VALUES ('a', NULL, 'e2e4'), ('b', 'x', 'd2d4'), (NULL, 'y', 'c2c4,d7d5')) v(event, site, play)",
    "chess_playout": "SELECT name, CAST(steps AS INTEGER) AS steps, phase FROM (VALUES ('start', 0, 'choose'), ('after f3', 3, 'over'), ('after e4', 6, 'over'), ('unknown', 0, 'dry'), ('stalemated', 0, 'over'), ('mating', 1, 'over')) v(name, steps, phase)",
    "chess_keys": "SELECT unnest(['abc', 'd', 'e', 'f', 'g']) AS names",
    "chess_positions": f"""SELECT * FROM (VALUES
        ('both', NULL, 'r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1', 'none', NULL, '', '{4}:e1c1:O-O-O,{4 + 7 * 64}:e1g1:O-O'), ('mate', NULL, 'rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3', 'mate', 'e1', 'Checkmate: black wins', ''),
        ('stale', NULL, '7k/5Q2/6K1/8/8/8/8/8 b - - 0 1', 'stalemate', NULL, 'Stalemate', ''), ('bare', NULL, '8/8/4k3/8/8/3K4/8/8 w - - 0 1', 'none', NULL, 'Draw by insufficient material', ''),
        ('check', NULL, '4k3/8/8/8/8/8/4R3/4K3 b - - 0 1', 'none', 'e8', '', ''), ('no ep', NULL, 'rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1', 'none', NULL, '', ''),
        ('bad', 'invalid FEN', NULL, NULL, NULL, NULL, ''), ('two kings', 'illegal position', NULL, NULL, NULL, NULL, '')) v(name, error, fen, ending, check_square, result, castling)""",
    "chess_movetext": """SELECT line, CAST(plies AS INTEGER) AS plies, play, before_last, last FROM (VALUES ('fool', 4, 'f2f3,e7e5,g2g4,d8h4', 'rnbqkbnr/pppp1ppp/8/4p3/6P1/5P2/PPPPP2P/RNBQKBNR b KQkq - 0 2', 'd8h4'),
        ('castle', 7, 'e2e4,e7e5,g1f3,b8c6,f1c4,f8c5,e1g1', 'r1bqk1nr/pppp1ppp/2n5/2b1p3/2B1P3/5N2/PPPP1PPP/RNBQK2R w KQkq - 4 4', 'e1g1'), ('none', 0, '', 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1', NULL), ('bad', NULL, NULL, NULL, NULL)) v(line, plies, play, before_last, last)""",
    "fmt_month_forms": "SELECT * FROM (VALUES ('2012-12', 'Dec 2012'), ('2012-1', 'Jan 2012'), ('2012-12-05', 'Dec 2012'), ('2012-13', '2012-13'), ('2012-00', '2012-00'), ('2012', '2012'), ('', ''), ('x-3', 'Mar x'), ('-7', 'Jul '), ('2012-a', '2012-a'), ('12-007', 'Jul 12')) v(month, label)",
}
