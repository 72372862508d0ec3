"""The compact book file, as a Spark data source for reading and writing.

Entries are sorted by key, unsigned, in blocks of 256.  A block starts at a
whole byte with its first key in the index; keys then follow as Rice-coded
gaps, moves as an index byte and an Elias-gamma count, bits from low to high.

A book is one file, or a folder of segments, whole book files that follow each
other in key order.  ``write_book`` deals a tally by ranges of unsigned keys,
and each task streams one segment; ``join_books`` streams books into one file.
Readers read a header and an index and then seek to the blocks that they need.
Paths are those of pyarrow's file systems: local or shared folders, hdfs://,
s3:// and the like.
"""

from __future__ import annotations

import heapq
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, VERSION, BLOCK, ESCAPE = b"KNCHESS2", 2, 256, 24
HEADER, RECORD = struct.Struct("<8sIQB3x"), struct.Struct("<QQ")
SCHEMA = "pos_key bigint, move_idx int, n bigint"
_TOP = 2**64


class Corrupt(ValueError):
    """Not a book of this version."""


class Truncated(ValueError):
    """The file ends before its header or index does."""


class Bits:
    """Collects bits, low ones first."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= (value & (1 << n) - 1) << self.size
        self.size += n

    def ones(self, n: int) -> None:
        """``n`` ones and a zero."""
        self.put((1 << n) - 1, n + 1)

    def rice(self, v: int, k: int) -> None:
        q = v >> k
        if q < ESCAPE:
            self.ones(q)
            self.put(v, k)
        else:
            self.put((1 << ESCAPE) - 1, ESCAPE)
            self.put(v, 64)

    def gamma(self, v: int) -> None:
        n = v.bit_length() - 1
        self.ones(n)
        self.put(v - (1 << n), n)

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


class Reading:
    """Takes bits, low ones first; past the end they are zero."""

    def __init__(self, data: bytes):
        self.value, self.at = int.from_bytes(data, "little"), 0

    def get(self, n: int) -> int:
        out = self.value >> self.at & (1 << n) - 1
        self.at += n
        return out

    def ones(self, most: int) -> int:
        n = 0
        while n < most and self.get(1):
            n += 1
        return n

    def rice(self, k: int) -> int:
        q = self.ones(ESCAPE)
        return self.get(64) if q == ESCAPE else q << k | self.get(k)

    def gamma(self) -> int:
        n = self.ones(64)
        return 1 << n | self.get(n)


def rice_parameter(n: int) -> int:
    return 63 if not n else max(1, (_TOP - 1) // n).bit_length() - 1


def encoded_block(entries: list[tuple[int, list[tuple[int, int]]]], k: int) -> bytes:
    """The bits of up to 256 entries; the first key is the index's."""
    bits, before = Bits(), None
    for key, moves in entries:
        if before is not None:
            bits.rice(key - before - 1, k)
        before = key
        bits.gamma(len(moves))
        for move, count in moves:
            bits.put(move, 8)
            bits.gamma(count)
    return bits.bytes()


class BookStream:
    """Writes a book while its entries come, in ascending order of keys.

    Blocks go to ``spool`` as they fill up; the index is held, 16 bytes for 256
    entries.  ``expected`` entries set the code's parameter.
    """

    def __init__(self, spool, expected: int):
        self.spool, self.k = spool, rice_parameter(expected)
        self.index, self.size, self.count = bytearray(), 0, 0
        self.waiting: list = []
        self.last = -1

    def put(self, key: int, moves: list[tuple[int, int]]) -> None:
        if key <= self.last:
            raise ValueError("keys must ascend (unsigned); write_book sorts them")
        self.last = key
        self.waiting.append((key, moves))
        self.count += 1
        if len(self.waiting) == BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            body = encoded_block(self.waiting, self.k)
            self.index += RECORD.pack(self.waiting[0][0], self.size)
            self.spool.write(body)
            self.size += len(body)
            self.waiting = []

    def head(self) -> bytes:
        """Header and index, once all entries are in."""
        self._flush()
        return HEADER.pack(MAGIC, VERSION, self.count, self.k) + bytes(self.index)


def encode(entries: Iterable[tuple[int, list[tuple[int, int]]]], expected: int | None = None) -> bytes:
    """A small book as bytes."""
    import io

    entries, spool = list(entries), io.BytesIO()
    stream = BookStream(spool, len(entries) if expected is None else expected)
    for key, moves in entries:
        stream.put(key, moves)
    return stream.head() + spool.getvalue()


class Book:
    """A book in a file that can seek: header and index are read and checked, blocks are read when asked for."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        self.end = file.tell()
        file.seek(0)
        head = file.read(HEADER.size)
        if len(head) < HEADER.size:
            raise Truncated("header")
        magic, version, self.count, self.k = HEADER.unpack(head)
        if magic != MAGIC or version != VERSION or self.k >= 64:
            raise Corrupt("header")
        n = -(-self.count // BLOCK)
        self.data = HEADER.size + n * RECORD.size
        if self.end < self.data:
            raise Truncated("index")
        records = list(RECORD.iter_unpack(file.read(n * RECORD.size)))
        self.firsts, self.offsets = [r[0] for r in records], [r[1] for r in records] + [self.end - self.data]

    def block(self, i: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        start, stop = self.offsets[i], self.offsets[i + 1]
        if not 0 <= start <= stop <= self.end - self.data:
            raise Corrupt("index")
        self.file.seek(self.data + start)
        bits, key = Reading(self.file.read(stop - start)), self.firsts[i]
        for j in range(min(BLOCK, self.count - i * BLOCK)):
            if j:
                key = (key + 1 + bits.rice(self.k)) % _TOP
            yield key, [(bits.get(8), bits.gamma()) for _ in range(bits.gamma())]

    def __iter__(self):
        for i in range(len(self.firsts)):
            yield from self.block(i)

    def lookup(self, key: int) -> list[tuple[int, int]]:
        """The moves of a key: only the block whose first key comes last before it can hold it."""
        at = bisect_right(self.firsts, key)
        return dict(self.block(at - 1)).get(key, []) if at else []


class BookBytes(Book):
    def __init__(self, raw: bytes):
        import io

        super().__init__(io.BytesIO(raw))


def signed(key: int) -> int:
    return key - _TOP if key >= _TOP // 2 else key


def ordered(moves: dict[int, int]) -> list[tuple[int, int]]:
    """Most played first, ties to the smaller index."""
    return sorted(moves.items(), key=lambda m: (-m[1], m[0]))


def merged_entries(books: Iterable[Iterable]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Entries of several books by key, counts summed; one entry of each book is held."""
    for key, group in groupby(heapq.merge(*books, key=lambda e: e[0]), key=lambda e: e[0]):
        sums: dict[int, int] = {}
        for _, moves in group:
            for move, n in moves:
                sums[move] = sums.get(move, 0) + n
        yield key, ordered(sums)


def _system(path: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def segments(path: str) -> list[str]:
    """The files of a book: itself, or those of its folder by name, which is by key."""
    from pyarrow import fs

    system, at = _system(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".book"))
    return [f"{path}/{name}" for name in names]


def opened(path: str) -> Book:
    system, at = _system(path)
    return Book(system.open_input_file(at))


def _write(path: str, entries: Iterable, expected: int) -> int:
    """Stream entries into one file; blocks are spooled in a temporary file of the task, then follow header and index."""
    import shutil
    import tempfile

    with tempfile.TemporaryFile() as spool:
        stream = BookStream(spool, expected)
        for key, moves in entries:
            stream.put(key, moves)
        head = stream.head()
        spool.seek(0)
        system, at = _system(path)
        with system.open_output_stream(at) as out:
            out.write(head)
            shutil.copyfileobj(spool, out, 1 << 20)
    return stream.count


def join_books(paths: list[str], target: str) -> int:
    """Books, or folders of segments, merged into one file in bounded memory; how many keys it has.

    The file is written beside the target and takes its name when it is whole.
    """
    books = [opened(part) for path in paths for part in segments(path)]
    beside = f"{target}.{uuid.uuid4().hex}.part"
    count = _write(beside, merged_entries(books), sum(b.count for b in books))
    system, at = _system(target)
    system.move(_system(beside)[1], at)
    return count


class _Blocks(InputPartition):
    def __init__(self, path: str, first: int, last: int, key: int | None):
        self.path, self.first, self.last, self.key = path, first, last, key


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task, self.key = path, per_task, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("pos_key",):
                self.key = f.value % _TOP
            yield f  # Spark applies it again

    def partitions(self):
        """Ranges of blocks; of a single key, the one segment that can hold it."""
        found = []
        for path in segments(self.path):
            book = opened(path)
            n = len(book.firsts)
            if self.key is None:
                found += [_Blocks(path, i, min(n, i + self.per_task), None) for i in range(0, n, self.per_task)]
            elif n and book.firsts[0] <= self.key:
                found = [_Blocks(path, 0, 0, self.key)]
        return found or [_Blocks("", 0, 0, None)]

    def read(self, part: _Blocks):
        if not part.path:
            return
        book = opened(part.path)
        if part.key is not None:
            for move, n in book.lookup(part.key):
                yield signed(part.key), move, n
            return
        for i in range(part.first, part.last):
            for key, moves in book.block(i):
                for move, n in moves:
                    yield signed(key), move, n


class _Message(WriterCommitMessage):
    def __init__(self, part: str | None, first: int):
        self.part, self.first = part, first


class _Writer(DataSourceWriter):
    """Each task streams its rows, which ascend by unsigned key, into a segment; the commit gives segments their names."""

    def __init__(self, path: str, expected: int):
        self.path, self.expected = path, expected

    def write(self, rows):
        keys = []

        def entries():
            for key, group in groupby(rows, key=lambda r: r[0] % _TOP):
                sums: dict[int, int] = {}
                for _, move, n in group:
                    sums[move] = sums.get(move, 0) + n
                if not keys:
                    keys.append(key)
                yield key, ordered(sums)

        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        name = f"{self.path}/{uuid.uuid4().hex}.part"
        if not _write(name, entries(), self.expected):
            system.delete_file(f"{at}/{name.rsplit('/', 1)[1]}")
            return _Message(None, 0)
        return _Message(name, keys[0])

    def commit(self, messages):
        system, at = _system(self.path)
        done = sorted((m.first, m.part) for m in messages if m and m.part)
        for old in segments(self.path) if done else []:
            system.delete_file(_system(old)[1])
        for i, (_, part) in enumerate(done):
            system.move(_system(part)[1], f"{at}/{i:06d}.book")

    def abort(self, messages):
        import contextlib

        for m in messages:
            if m and m.part:
                with contextlib.suppress(FileNotFoundError):
                    system, at = _system(m.part)
                    system.delete_file(at)


class BookSource(DataSource):
    """``spark.read.format("bookfile").load(path)``; ``write_book`` writes."""

    @classmethod
    def name(cls) -> str:
        return "bookfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("blockspertask", "4096")))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("expected", str(2**20))))


def unsigned(key: str = "pos_key"):
    """Sorts keys as unsigned integers."""
    return F.col(key).bitwiseXOR(F.lit(-(2**63)))


def write_book(tally: DataFrame, path: str, files: int) -> None:
    """A tally ``pos_key, move_idx, n`` as a folder of segments; rows of one key and move are summed.  Null rows go.

    Keys are dealt by ranges, so that segments follow each other; no task holds
    more than a block and an index.
    """
    register(tally.sparkSession)
    rows = tally.select(F.col("pos_key").cast("bigint").alias("pos_key"), F.col("move_idx").cast("int").alias("move_idx"), F.col("n").cast("bigint").alias("n")).dropna()
    summed = rows.groupBy("pos_key", "move_idx").agg(F.sum("n").alias("n"))
    dealt = summed.withColumn("order_", unsigned()).repartitionByRange(files, "order_").sortWithinPartitions("order_")
    expected = max(1, tally.count() // files)
    dealt.select("pos_key", "move_idx", "n").write.format("bookfile").option("expected", str(expected)).mode("overwrite").save(path)


def register(spark) -> None:
    spark.dataSource.register(BookSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
