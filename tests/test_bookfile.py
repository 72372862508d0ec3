import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from movebook.sources import bookfile as bf
from pyspark.sql import functions as F


def sample_keys(n, seed):
    """Distinct unsigned keys all over the range, its ends among them."""
    rng = random.Random(seed)
    return sorted({0, 2**64 - 1, 2**63 - 1, 2**63} | {rng.getrandbits(rng.choice((8, 40, 64))) for _ in range(n)})


def sample_book(n, seed):
    rng = random.Random(-seed)
    return [(k, bf.ordered({m: rng.choice((1, rng.randrange(1, 50), 10**9)) for m in rng.sample(range(218), rng.choice((1, 1, 1, 2, 9)))})) for k in sample_keys(n, seed)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 63)), max_size=30), st.lists(st.integers(1, 2**64 - 1), max_size=30))
def test_codes_come_back(gaps, counts):
    bits = bf.Bits()
    for v, k in gaps:
        bits.rice(v, k)
    for v in counts:
        bits.gamma(v)
    r = bf.Reading(bits.bytes())
    assert [r.rice(k) for _, k in gaps] == [v for v, _ in gaps] and [r.gamma() for _ in counts] == counts


def test_codes_around_the_escape():
    for k in range(64):
        for q in (bf.ESCAPE - 1, bf.ESCAPE, bf.ESCAPE + 1):
            v = min((q << k) + (1 << k) - 1, 2**64 - 1)
            bits = bf.Bits()
            bits.rice(v, k)
            assert bf.Reading(bits.bytes()).rice(k) == v and bits.size == (bf.ESCAPE + 64 if v >> k >= bf.ESCAPE else (v >> k) + 1 + k)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1300])
def test_lookups_agree_with_the_scan(n):
    entries = sample_book(n, n) if n else []
    book = bf.BookBytes(bf.encode(entries))
    assert list(book) == entries and book.count == len(entries)
    known = dict(entries)
    probes = {p % 2**64 for k in known for p in (k - 1, k, k + 1)} | {5, 2**62}
    assert all(book.lookup(p) == known.get(p, []) for p in probes)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.dictionaries(st.integers(0, 217), st.integers(1, 2**40), min_size=1, max_size=5), max_size=40))
def test_any_book_comes_back(sums):
    entries = [(k, bf.ordered(sums[k])) for k in sorted(sums)]
    assert list(bf.BookBytes(bf.encode(entries))) == entries
    assert list(bf.BookBytes(bf.encode(entries, 10**9))) == entries


def summed(books):
    sums = {}
    for book in books:
        for key, moves in book:
            for move, n in moves:
                sums.setdefault(key, {})
                sums[key][move] = sums[key].get(move, 0) + n
    return [(k, bf.ordered(sums[k])) for k in sorted(sums)]


@pytest.mark.parametrize("n_books", [1, 2, 7])
def test_joined_books_are_their_sums(tmp_path, n_books):
    books = [sample_book(400, 3) if i % 3 == 0 else sample_book(300, i) for i in range(n_books)]
    paths = [str(tmp_path / f"{i}.book") for i in range(n_books)]
    for path, book in zip(paths, books):
        bf._write(path, book, len(book))
    target = str(tmp_path / "all")
    assert bf.join_books(paths, target) == len(summed(books))
    assert list(bf.opened(target)) == summed(books)
    bf.join_books([target], target)  # over itself
    assert list(bf.opened(target)) == summed(books) and not list(tmp_path.glob("*.part"))
    with open(target, "rb") as f:
        assert f.read() == bf.encode(summed(books))


def test_a_stream_holds_one_block():
    spool = io.BytesIO()
    stream = bf.BookStream(spool, 10**6)
    for i in range(10_000):
        stream.put(7 * i, [(0, 1)])
        assert len(stream.waiting) < 256
    assert list(bf.BookBytes(stream.head() + spool.getvalue()))[-1] == (69_993, [(0, 1)])
    with pytest.raises(ValueError):
        stream.put(3, [(0, 1)])


def test_bad_files():
    good = bf.encode(sample_book(300, 1))
    for raw, error in ((b"", bf.Truncated), (good[:30], bf.Truncated), (b"X" + good[1:], bf.Corrupt), (good[:8] + b"\1" + good[9:], bf.Corrupt), (good[:20] + b"\x40" + good[21:], bf.Corrupt)):
        with pytest.raises(error):
            bf.BookBytes(raw)
    with pytest.raises(bf.Corrupt):
        list(bf.BookBytes(good[: -len(good) // 2]))


def test_data_source(spark, tmp_path):
    bf.register(spark)
    path = str(tmp_path / "games")
    book = sample_book(2000, 9)
    rows = [(bf.signed(k), m, n) for k, moves in book for m, n in moves]
    twice = rows + [(k, m, 4) for k, m, _ in rows[::3]] + [(None, 1, 1), (1, None, 1)]
    bf.write_book(spark.createDataFrame(twice, bf.SCHEMA).repartition(5), path, 4)
    want = {(k, m): n + 4 * (i % 3 == 0) for i, (k, m, n) in enumerate(rows)}
    back = spark.read.format("bookfile").option("blockspertask", "2").load(path)
    assert {(r.pos_key, r.move_idx): r.n for r in back.collect()} == want and back.count() == len(want)
    parts = bf.segments(path)
    assert len(parts) == 4 and [p.name for p in (tmp_path / "games").iterdir() if p.suffix != ".book"] == []
    firsts = [bf.opened(p).firsts[0] for p in parts]
    assert firsts == sorted(firsts) and firsts[0] == 0
    key = rows[len(rows) // 2][0]
    assert {(r.move_idx, r.n) for r in back.where(F.col("pos_key") == key).collect()} == {(m, n) for (k, m), n in want.items() if k == key}
    assert back.where("pos_key = 123456789").count() == 0
    bf.write_book(spark.createDataFrame(rows[:3], bf.SCHEMA), path, 1)  # replaces all segments
    assert sorted(map(tuple, spark.read.format("bookfile").load(path).collect())) == sorted(rows[:3])
    single = str(tmp_path / "one.book")
    bf.join_books([path], single)
    assert sorted(map(tuple, spark.read.format("bookfile").load(single).collect())) == sorted(rows[:3])


def test_unsorted_rows_are_refused(spark, tmp_path):
    bf.register(spark)
    df = spark.createDataFrame([(5, 0, 1), (3, 0, 1)], bf.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="ascend"):
        df.write.format("bookfile").mode("overwrite").save(str(tmp_path / "x"))
