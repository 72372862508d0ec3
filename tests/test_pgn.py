import subprocess

import pytest
import zstandard
from movebook.functions.chess import START
from movebook.sources import pgn
from pyspark.sql import functions as F

FOOL, FAST = "1. f3 e5 2. g4 Qh4# 0-1", "1. e3 a5 2. Qh5 Ra6 3. Qxa5 h5 4. Qxc7 Rah6 5. h4 f6 6. Qxd7+ Kf7 7. Qxb7 Qd3 8. Qxb8 Qh7 9. Qxc8 Kg6 10. Qe6 1/2-1/2"
GAMES = [
    ("fool", "", FOOL),
    ("scholar", "", "1. e4 e5 2. Bc4 Nc6 3. Qh5 Nf6 4. Qxf7# 1-0"),
    ("stalemate", "", FAST),
    ("resigned", "", "1. e4 e5 1-0"),
    ("empty", "", "1-0"),
    ("wrong result", '[Result "1-0"]\n', FOOL),
    ("bad san", "", "1. e4 e5 2. Ke3 1-0"),
    ("atomic", '[Variant "Atomic"]\n', FOOL),
    ("standard", '[Variant "Standard"]\n', FOOL),
    ("fen", f'[FEN "{START}"]\n', FOOL),
    ("comments", "", "1. f3 {x (y} $1 (1. e4 (1. d4) e5) 1... e5 2. g4? ; note\nQh4#"),
    ("repetition", "", "1. Nf3 Nf6 2. Ng1 Ng8 3. f3 e5 4. g4 Qh4# 0-1"),
]
VERDICTS = {"fool": "ok", "scholar": "ok", "stalemate": "ok", "resigned": "unfinished", "empty": "no moves", "wrong result": "ok", "bad san": "bad san", "atomic": "variant", "standard": "ok", "fen": "fen", "comments": "ok", "repetition": "ok"}


def text(games=GAMES):
    return "\n".join(f'[Event "{name}"]\n[Site "?"]\n{tags}\n{moves}\n' for name, tags, moves in games)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a_2013-01.pgn").write_text(text())
    (tmp_path / "b_2013-02.pgn.zst").write_bytes(zstandard.compress(text(GAMES[:3]).encode()))
    return str(tmp_path)


def test_replay(spark, folder):
    games = pgn.replayed(pgn.read_games(spark, folder))
    rows = games.collect()
    assert {r.headers["Event"]: r.verdict for r in rows if "01" in r.source} == VERDICTS
    assert {r.headers["Event"]: r.n_plies for r in rows if "02" in r.source} == {"fool": 4, "scholar": 7, "stalemate": 19}
    by = {r.headers["Event"]: r for r in rows if "01" in r.source}
    assert by["comments"].ucis == by["fool"].ucis and by["comments"].keys == by["fool"].keys
    assert (by["stalemate"].ending, by["stalemate"].winner, by["fool"].winner) == ("stalemate", "draw", "black")


def test_tally_counts_plies_not_games(spark, folder):
    plies = pgn.game_plies(pgn.replayed(pgn.read_games(spark, folder).where("source like '%-01%' and text like '%repetition%'")))
    book = pgn.chess_tally(plies)
    root = plies.where("ply = 1").first().pos_key
    assert sorted((r.uci, r.n) for r in book.where(F.col("pos_key") == root).collect()) == [("f2f3", 1), ("g1f3", 1)]
    assert plies.count() == 8 and plies.select("pos_key").distinct().count() == 7


def test_limits_and_caps(spark, folder):
    first = pgn.read_games(spark, folder, limit=2)
    assert sorted(r.headers["Event"] for r in pgn.replayed(first).collect()) == ["fool", "fool", "scholar", "scholar"]
    games = pgn.read_games(spark, folder).where("source like '%-01%'")
    kept = lambda **k: {r.headers["Event"]: r.n_plies for r in pgn.replayed(games, **k).where("verdict = 'ok'").collect()}
    assert set(kept(max_ply=3)) == set() and set(kept(max_ply=4)) == {"fool", "wrong result", "standard", "comments"}
    assert kept(max_ply=3, mode="truncate", any_ending=True)["stalemate"] == 3
    assert "resigned" in kept(any_ending=True) and "empty" not in kept(any_ending=True)


def test_games_without_an_event_tag_are_split():
    found = list(pgn.split_games('[Site "a"]\n\n1. e4 *\n\n[Site "b"]\n\n1. d4 *\n'))
    assert [(h["Site"], pgn.main_line(m)) for h, m in found] == [("a", ["e4"]), ("b", ["d4"])]


def test_lookup(spark, folder):
    book = pgn.chess_tally(pgn.game_plies(pgn.replayed(pgn.read_games(spark, folder))))
    fens = spark.createDataFrame([(START,), ("8/8/8/8/8/8/8/8 w - - 0 1",), ("nonsense",), ("4k3/8/8/8/8/8/8/4K2R w K - 0 1",)], "fen string")
    rows = pgn.lookup_fens(book, fens).collect()
    start = sorted((r.uci, r.san, r.n) for r in rows if r.fen == START)
    # Five games open so, and one comes back to the start and does.
    assert start == [("e2e3", "e3", 2), ("e2e4", "e4", 2), ("f2f3", "f3", 6), ("g1f3", "Nf3", 1)]
    assert {r.total for r in rows if r.fen == START} == {11}
    assert {(r.error, r.total) for r in rows if r.fen != START} == {("illegal position", 0), ("invalid FEN", 0), (None, 0)}
    unresolved = book.union(spark.createDataFrame([("x", book.where("uci = 'e2e4'").first().pos_key, 250, "", 7)], book.schema))
    assert {r.total for r in pgn.lookup_fens(unresolved, fens).where(F.col("fen") == START).collect()} == {18}


def test_identify(spark, folder):
    games = pgn.replayed(pgn.read_games(spark, folder).where("source like '%-01%'")).where("headers['Event'] in ('scholar', 'fool', 'standard', 'stalemate')").cache()
    by = {r.headers["Event"]: r for r in games.collect()}
    lines = spark.createDataFrame([("one", by["scholar"].ucis), ("two", by["fool"].ucis), ("none", ["a2a3"]), ("bad", ["a2a5"])], "line string, ucis array<string>")
    got = {r.line: (r.at, r.exact) for r in pgn.identify_lines(lines, games).collect()}
    assert got == {"one": (by["scholar"].at, True), "two": (None, False), "none": (None, False), "bad": (None, False)}


def test_stream_fold_is_idempotent(spark, tmp_path):
    from movebook.streaming.fold import fold_games, serving_book

    inbox, tally = tmp_path / "in", str(tmp_path / "tally")
    inbox.mkdir()
    (inbox / "2013-01.pgn").write_text(text())
    fold_games(spark, str(inbox), tally, str(tmp_path / "c1")).awaitTermination()
    once = {tuple(r) for r in serving_book(spark, tally).collect()}
    fold_games(spark, str(inbox), tally, str(tmp_path / "c2")).awaitTermination()  # a new checkpoint takes the file again
    assert {tuple(r) for r in serving_book(spark, tally).collect()} == once
    (inbox / "2013-02.pgn").write_text(text(GAMES[:1]))
    fold_games(spark, str(inbox), tally, str(tmp_path / "c2")).awaitTermination()
    more = serving_book(spark, tally).agg(F.sum("n")).first()[0]
    assert more == sum(r[2] for r in once) + 4


def test_stream_fold_of_tallies(spark, tmp_path):
    from movebook.streaming.fold import fold_tallies, serving_book

    for i in range(2):
        spark.createDataFrame([("", "a", 1 + i), ("a", "b", 2)], "state string, move string, n long").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(2):
        part = next((tmp_path / f"in{i}").glob("part-*.parquet"))
        subprocess.run(["cp", str(part), str(inbox / f"{i}.parquet")], check=True)
    fold_tallies(spark, str(inbox), "state string, move string, n long", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in serving_book(spark, str(tmp_path / "t")).collect()} == {("", "a", 3), ("a", "b", 4)}
