import pytest
from movebook import config
from movebook.functions import moves
from movebook.operators import book as B
from movebook.operators import build as U
from movebook.operators import catalog as C
from movebook.operators import line as L
from movebook.operators import sequence as S
from pyspark.sql import functions as F


def book(spark, rows):
    return spark.createDataFrame(rows, "state string, move string, n long")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_merging_sums_by_state_and_move(spark):
    north = book(spark, [("a", "left", 2), ("a", "right", 7), ("b", "left", 1)])
    south = book(spark, [("a", "left", 5), ("c", "stay", 3), ("b", "right", 1), ("a", "right", 0)])
    got = B.merged(north, south)
    assert as_set(got) == {("a", "left", 7), ("a", "right", 7), ("b", "left", 1), ("b", "right", 1), ("c", "stay", 3)}
    # Equal counts go by move; a total is the sum over what was merged, in any order and grouping.
    assert [(r.rank, r.move) for r in B.flattened(B.nested(got)).where("state in ('a', 'b')").orderBy("state", "rank").collect()] == [(1, "left"), (2, "right")] * 2
    assert as_set(B.merged(south, B.merged(north))) == as_set(got)
    assert as_set(B.merged(north, north).where("state = 'a'")) == {("a", "left", 4), ("a", "right", 14)}


def test_lookup_of_nothing(spark):
    probes = spark.createDataFrame([("x",)], "state string")
    assert as_set(B.lookup(book(spark, []), probes)) == {("x", 0, None, None, "", None)}
    assert as_set(B.lookup_nested(book(spark, []), probes).select("state", "total", F.size("moves"))) == {("x", 0, 0)}
    assert B.stats(book(spark, [])).first().asDict() == {"positions": 0, "entries": 0, "root_moves": 0, "root_total": 0}


def test_shares(spark):
    df = spark.createDataFrame([(1, 200), (2, 200), (1, 8), (0, 0)], "n long, total long")
    assert [r.s for r in df.select(B.share_text(F.col("n"), F.col("total")).alias("s")).collect()] == ["<1%", "1%", "13%", ""]


def test_forced_cycles_end(spark):
    loop = book(spark, [("", "a", 3), ("a", "b", 2), ("a>b", "c", 1), ("a>b", "d", 1)])
    starts = spark.createDataFrame([("",), ("zz",)], "state string")
    assert as_set(L.forced_playout(loop, starts)) == {("", "a>b", 2, "choose"), ("zz", "zz", 0, "dry")}
    long = book(spark, [(">".join("x" * i), "x", 1) for i in range(1, 300)] + [("", "x", 1)])
    assert L.forced_playout(long, starts.limit(1), most=16).first().steps == 16


def test_forced_lines_play_on(spark):
    long = book(spark, [(">".join("x" * i), "x", 1) for i in range(300)])
    starts = spark.createDataFrame([("",), ("x",)], "state string")
    end = ">".join("x" * 300)
    assert as_set(L.forced_playout(long, starts)) == {("", end, 300, "dry"), ("x", end, 299, "dry")}
    loop = book(spark, [("a", None, 1), ("b", "a", 1)])
    assert as_set(L.forced_playout(loop, spark.createDataFrame([("a",), ("b",)], "state string"))) == {("a", "a", 0, "forced"), ("b", "b>a", 1, "dry")}


def test_caps(spark):
    rows = spark.createDataFrame([(1, i, "m") for i in range(5)] + [(2, 0, "m")], "g int, t int, move string")
    games = S.gathered(rows, ["g"], ["t"], "move")
    assert [r.g for r in S.capped(games, 4).collect()] == [2]
    assert {r.g: r.n_plies for r in S.capped(games, 4, "truncate").collect()} == {1: 4, 2: 1}
    assert S.capped(games, 0).count() == 2
    with pytest.raises(ValueError):
        S.capped(games, 1, "other")


def test_canonical_index(spark):
    df = spark.createDataFrame([([30, 10, 20], 20), ([30], 5)], "legal array<int>, m int")
    assert [tuple(r) for r in df.select(moves.canonical_index(F.col("legal"), F.col("m")), moves.resolve(F.col("legal"), F.col("m"))).collect()] == [(1, 20), (None, None)]


def test_publish_prunes(spark, tmp_path):
    rows = spark.range(2000).selectExpr("lpad(id, 5, '0') as state", "'m' as move", "id as n")
    path = B.publish(rows, str(tmp_path), 1, 4)
    back = spark.read.parquet(path)
    assert back.count() == 2000
    spans = [(r.a, r.b) for r in back.groupBy(F.input_file_name()).agg(F.min("state").alias("a"), F.max("state").alias("b")).collect()]
    spans.sort()
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_manifest(spark, tmp_path):
    (tmp_path / "games.book.sources").write_text("a.pgn\n\n  b.pgn.zst \n")
    got = C.read_manifest(spark, C.manifest_path(str(tmp_path / "games.book")))
    assert [r.filename for r in got.orderBy("seq").collect()] == ["a.pgn", "b.pgn.zst"]
    assert C.read_manifest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "x_2013-01.pgn").write_text("")
    (tmp_path / "x_2013-01.pgn.part").write_text("")
    assert [r.filename for r in C.local_files(spark, str(tmp_path)).collect()] == ["x_2013-01.pgn"]
    assert C.local_files(spark, str(tmp_path / "gone")).count() == 0
    dumps = spark.createDataFrame([("2013-01", 0), ("2013-02", 1)], "tag string, rank int")
    found = C.matched(spark.createDataFrame([(0, "02"), (1, "2013"), (2, "latest")], "seq int, q string"), dumps)
    assert as_set(C.chosen(found)) == {("2013-01", 1, 0), ("2013-02", 0, 1)} and C.listed(dumps, "02").count() == 1


def test_cycles_have_no_end(spark):
    steps = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "y", 1), ("y", "z", 1), ("in", "a", 1)], "state string, to string, steps int")
    got = {r.state: (r.to, r.steps) for r in L.doubled(steps).collect()}
    assert got["x"] == ("z", 2) and got["y"] == ("z", 1) and {got[s][0] for s in ("a", "b", "c", "in")} <= {"a", "b", "c"}


def test_builds_count_what_is_named_and_resume_what_is_left(spark, tmp_path):
    path = str(tmp_path / "p")
    tallies = spark.createDataFrame([("one", "", "a", 2), ("two", "", "a", 3), ("two", "a", "b", 1)], "source string, state string, move string, n long")
    names = lambda *n: spark.createDataFrame([(x, i) for i, x in enumerate(n)], U.SOURCES)
    assert U.current_version(spark, path) is None and U.published(spark, path)[0].count() == 0
    assert U.build(tallies, names("two"), path, files=1) == 1
    assert U.build(tallies, names("one", "two"), path, files=1) == 2  # named again, counted again
    book, sources = U.published(spark, path)
    assert as_set(book) == {("", "a", 8), ("a", "b", 2)} and [r.filename for r in sources.orderBy("seq").collect()] == ["two", "one"]
    with pytest.raises(ValueError):
        U.build(tallies, names(), path)
    with pytest.raises(ValueError):
        U.resume(spark, path, names())
    U.leave_run(B.tally(spark.createDataFrame([("", "z")], "state string, move string")), path, 7)
    U.resume(spark, path, names("three"), files=1)
    book, sources = U.published(spark, path)
    assert as_set(book) == {("", "a", 8), ("a", "b", 2), ("", "z", 1)} and sources.count() == 3
    with pytest.raises(ValueError):
        U.resume(spark, path, names("three"))
    U.build(tallies, names("one"), path, fresh=True, files=1)
    assert as_set(U.published(spark, path)[0]) == {("", "a", 2)}


def test_settings(tmp_path, monkeypatch):
    monkeypatch.delenv("MOVEBOOK_CONFIG", raising=False)
    file, deep = tmp_path / "config.toml", tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    file.write_text('[storage]\ndownloads = "/d"\n[source]\nlist_url = "u"\n')
    found = config.load(start=str(deep))
    assert (found.book_path, found.serving_path, found.manifest_path(), found.manifest_path("/x/o.book"), found.list_url) == ("/d/known.book", "/d/known.book", "/d/known.book.sources", "/x/o.book.sources", "u")
    other = tmp_path / "other.toml"
    other.write_text('[storage]\nbook = "x"\n')
    with pytest.raises(ValueError):
        config.load(str(other))
    other.write_text('[server]\nbook = "s"\n')
    monkeypatch.setenv("MOVEBOOK_CONFIG", str(other))
    assert config.load(start=str(deep)).serving_path == "s" and config.load(str(file)).downloads == "/d"
    monkeypatch.delenv("MOVEBOOK_CONFIG")
    with pytest.raises(FileNotFoundError):
        config.load(start="/proc")
