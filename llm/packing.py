"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths, which is what block-diagonal attention pays).  An item's
demand in all three follows from its length alone, so items of equal length are
interchangeable and the packing of a whole corpus is the packing of a histogram
with one entry a length.  The driver packs the histogram, whose size is bounded
by the token capacity whatever the corpus holds, by vector best-fit on lengths
in descending order.  Bins with the same history form one class with a
multiplicity.  Each item then reads its place from its rank among the items of
its length: no item is shuffled, and a length that a third of all rows share
costs no more than any other.

With the default capacities only tokens can bind: no 2048 pieces are shorter
than a token, and lengths that add up to 2048 have squares that add up to less
than its square.  The other two bind where they are set tighter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import Tokenizer, default_path, kept


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


@dataclass
class _Class:
    """Bins that hold the same lengths in the same order."""

    count: int
    used: tuple[int, int, int]
    #: (length, offset, first rank) of each item put into these bins, in order.
    items: tuple = field(default=())


def best_fit(histogram: dict[int, int], capacity: Capacity = Capacity(), weights=(1.0, 0.25, 0.25), rule: str = "norm") -> list[_Class]:
    """Pack ``histogram[length]`` items of each length; every item gets a place.

    Lengths go from long to short.  An item goes to the open bin that fits it
    under every capacity and scores best: with ``rule="norm"`` the least
    weighted norm of what would remain, with ``"dot"`` the greatest weighted
    dot-product of demand and residual, both relative to the capacities.  A new
    bin opens only when none fits.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(rule)
    cap = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    w = np.asarray(weights, float)
    classes: list[_Class] = []
    residual = np.zeros((0, 3))
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > cap).any():
            raise ValueError(f"length {length} is beyond a bin's capacity")
        while left:
            fits = np.nonzero((residual >= need).all(axis=1))[0]
            if len(fits):
                rest = residual[fits] / cap
                score = -(w * (rest - need / cap) ** 2).sum(axis=1) if rule == "norm" else (w * rest * (need / cap)).sum(axis=1)
                at = int(fits[int(score.argmax())])
            else:
                at = len(classes)
                each = int(min(cap // need))
                classes.append(_Class(max(1, left // each), (0, 0, 0)))
                residual = np.vstack([residual, cap])
            bins = classes[at]
            each = min(int(min(residual[at] // need)), max(1, left // bins.count))
            take = min(bins.count, left)
            if take < bins.count:  # only some of these bins get one: they become a class of their own
                classes.append(_Class(bins.count - take, bins.used, _after(bins.items, take)))
                residual = np.vstack([residual, residual[at]])
                bins.count = take
            tokens, docs, cost = bins.used
            for k in range(each):
                bins.items += ((length, tokens + k * length, rank + k * take),)
            bins.used = (tokens + each * length, docs + each, cost + each * length * length)
            residual[at] = residual[at] - each * need
            left -= take * each
            rank += take * each
    return classes


def _after(items: tuple, skip: int) -> tuple:
    """The items of a class without its first ``skip`` bins."""
    return tuple((length, offset, first + skip) for length, offset, first in items)


def slots(classes: list[_Class]) -> dict[int, np.ndarray]:
    """Per length the sorted rows (first rank, bin of the first rank, offset)."""
    found: dict[int, list] = {}
    first_bin = 0
    for c in classes:
        for length, offset, rank in c.items:
            found.setdefault(length, []).append((rank, first_bin, offset))
        first_bin += c.count
    return {length: np.array(sorted(rows), np.int64) for length, rows in found.items()}


def tokenised_pieces(docs: DataFrame, path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, block, local``; local ranks equal lengths in a block."""

    def cut(batches):
        from pyspark import TaskContext

        tokenizer, block = kept(Tokenizer, path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            out = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                body = (tokenizer.packed(text) if text else b"") + b"\0\0\0\0"
                total = len(body) // 4
                start, piece = 0, 0
                stop = total % size or size
                while start < total:
                    stop = min(stop, total)
                    n = stop - start
                    out.append((doc, piece, start, n, zlib.crc32(body[4 * start : 4 * stop]), block, int(seen[n])))
                    seen[n] += 1
                    start, stop, piece = stop, stop + size, piece + 1
            columns = list(zip(*out)) or [()] * 7
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "piece", "start", "length", "ids_crc32", "block", "local"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, block int, local bigint")


def pack(
    docs: DataFrame,
    capacity: Capacity = Capacity(),
    weights=(1.0, 0.25, 0.25),
    rule: str = "norm",
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all rows and their places in packed sequences.

    A document is its token ids and a closing id 0.  Only documents longer than
    a sequence are cut, from the end, into pieces of the full size; the first
    piece takes the rest.  Returns id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``.  Null and empty texts are
    one closing id; repeated rows are packed as often as they occur; null ids
    stay null; other columns are not read; no rows give no rows.
    """
    size = capacity.tokens
    pieces = stored(tokenised_pieces(docs, tokenizer_path or default_path(), size, id_col, text_col), "pieces")
    by_block = stored(pieces.groupBy("length", "block").count(), "lengths")
    # At most ``size`` rows reach the driver.
    histogram = {r.length: r.n for r in by_block.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(slots(best_fit(histogram, capacity, weights, rule)))

    # Ranks of a length go through the blocks in turn; the blocks' counts, not the items, are summed up.
    turn = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_block.select("block", "length", F.coalesce(F.sum("count").over(turn), F.lit(0)).alias("base"))

    def place(table, bases):
        length = table.column("length").to_numpy()
        first = np.zeros(size + 1, np.int64)
        first[bases.column("length").to_numpy()] = bases.column("base").to_numpy()
        rank = first[length] + table.column("local").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        lengths, firsts = np.unique(length[order], return_index=True)
        for n, rows in zip(lengths.tolist(), np.split(order, firsts[1:])):
            segments = places.value[n]
            at = np.searchsorted(segments[:, 0], rank[rows], "right") - 1
            sequence[rows] = segments[at, 1] + rank[rows] - segments[at, 0]
            offset[rows] = segments[at, 2]
        return table.select(["id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # A block is what one task has read; it has a base for each length that it holds, ``size`` at most.
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return pieces.groupBy("block").cogroup(base.groupBy("block")).applyInArrow(place, schema).withColumnRenamed("id", id_col)
