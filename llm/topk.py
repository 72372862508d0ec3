"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks by their hash.  A block keeps one list a
dimension, its vectors sorted by that component.  For a query the lists are
walked in step, from the end where the query's weight gains most; every vector
that comes up is scored in full.  The walk ends when the threshold, the best
score that anything not yet seen could have, is below the kth best score, or
when nothing is left unseen.  Scores are integers, so results are exact.

Equal vectors count as one with many ids: of those ids only the k + 1 smallest
can be in an answer, so a vector that a third of all rows share costs one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

#: Components of a block of vectors and of a batch of queries, and batches that meet a block in one task.
BLOCK, BATCH, TOGETHER = 4096 * 64, 1024 * 64, 16


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, taken as double; null unless every component is finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class SortedLists:
    """One block of distinct integer vectors with a sorted list for each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.exact = _exact(vectors)
        self.vectors = vectors.astype(self.exact)
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of all vectors that can be among the k best.

        The walk goes on while the threshold is at least the kth score, so that
        ties are found whole.
        """
        n, query = len(self.vectors), query.astype(self.exact)
        used = np.nonzero(query)[0]
        if not len(used):  # every score is zero
            return np.arange(n), np.zeros(n, self.exact)
        down, up = used[query[used] > 0], used[query[used] < 0]
        seen, places, scores = np.zeros(n, bool), [], []
        best, unseen = np.zeros(0, self.exact), n
        depth, step = 0, 8
        while unseen:
            stop = min(n, depth + step)
            before = seen.copy()
            seen[self.order[n - stop : n - depth, down]] = True
            seen[self.order[depth:stop, up]] = True
            new = np.flatnonzero(seen & ~before)
            if len(new):
                s = self.vectors[new] @ query
                places.append(new)
                scores.append(s)
                unseen -= len(new)
                best = np.concatenate([best, s])
                if len(best) > k:
                    best = np.partition(best, len(best) - k)[len(best) - k :]
            # The threshold at this depth; no vector further down can score more.
            limit = self.values[n - stop, down] @ query[down] + self.values[stop - 1, up] @ query[up]
            if len(best) >= k and limit < best.min():
                break
            depth, step = stop, step * 2
        return np.concatenate(places), np.concatenate(scores)


def _exact(vectors: np.ndarray):
    """Floats where they hold all sums of products exactly, else 64-bit integers, else Python's."""
    most = float(np.abs(vectors.astype(float)).max(initial=0.0))
    bound = most * most * max(1, vectors.shape[1])
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def search_block(vectors: np.ndarray, ids: list, queries: np.ndarray, k: int) -> list[list[tuple]]:
    """For each query the k best (score, id) of the block, best first, ties to the smaller id."""
    exact = _exact(np.concatenate([vectors, queries]))
    lists = SortedLists(vectors)
    lists.exact, lists.vectors, lists.values = exact, lists.vectors.astype(exact), lists.values.astype(exact)
    out = []
    for q in queries:
        places, scores = lists.search(q, k)
        if len(places) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= kth
            places, scores = places[near], scores[near]
        hits = [(int(s), i) for p, s in zip(places.tolist(), scores.tolist()) for i in ids[p]]
        out.append(sorted(hits, key=lambda h: (-h[0], h[1]))[:k])
    return out


def packed_vector(v: np.ndarray) -> bytes:
    """Integers of 2 bytes where they all fit, else of 8; the first byte says which.  Equal vectors pack alike."""
    small = v.astype(np.int16)
    return b"\2" + small.tobytes() if np.array_equal(small, v) else b"\x08" + v.astype(np.int64).tobytes()


def unpacked_vectors(packed: list[bytes]) -> np.ndarray:
    """One row a vector; all have the same number of components."""
    return np.array([np.frombuffer(p, np.int16 if p[0] == 2 else np.int64, offset=1) for p in packed], np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id>, score`` for every row that ``is_query`` selects.

    Candidates are all rows but the query's own id; fewer than k candidates
    give fewer rows.  Vectors that are null, hold null or non-finite components
    or no component, and rows without an id, take no part.  Queries meet the
    candidates with as many components as they have.  A repeated id counts once
    for each distinct vector it comes with.
    """
    spark = vectors.sparkSession
    need = k + 1
    ints = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null and size(v) > 0")

    def packed(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets)
            ends = ends - ends[0]
            v = [packed_vector(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(v, pa.binary()), batch.column(2)], ["id", "width", "v", "asks"])

    rows = stored(ints.mapInArrow(packed, "id bigint, width bigint, v binary, asks boolean"), "packed")

    # Equal vectors become one; first within a task, then across tasks.
    def smallest(batches):
        kept: dict[tuple, list] = {}

        def out():
            names = [(w, v, i) for (w, v), ids in kept.items() for i in ids]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*names)) or [()] * 3, [pa.int64(), pa.binary(), pa.int64()])], ["width", "v", "id"])

        for batch in batches:
            for x, width, v in zip(*(c.to_pylist() for c in batch.columns)):
                ids = kept.setdefault((width, v), [])
                if x not in ids:
                    ids.append(x)
                    ids.sort()
                    del ids[need:]
            if len(kept) >= 32_768:
                yield out()
        yield out()

    # A vector has at most k + 1 rows a task from here on, however many share it.
    parts = rows.select("id", "width", "v").mapInArrow(smallest, "width bigint, v binary, id bigint")
    firsts = parts.distinct().withColumn("n", F.row_number().over(Window.partitionBy("width", "v").orderBy("id"))).where(F.col("n") <= need)
    distinct = stored(firsts.groupBy("width", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asked = rows.where("asks").select("id", "width", "v").distinct()
    queries = stored(asked.groupBy("width", "v").agg(F.count(F.lit(1)).alias("n_rows")), "queries")

    def compare(key, block, batch):
        if not len(block) or not len(batch):
            return batch.slice(0, 0).select(["v"]).append_column("id", pa.array([], pa.int64())).append_column("score", pa.array([], pa.int64()))
        names = batch.column("v").to_pylist()
        found = search_block(unpacked_vectors(block.column("v").to_pylist()), block.column("ids").to_pylist(), unpacked_vectors(names), need)
        hits = [(v, i, s) for v, best in zip(names, found) for s, i in best]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*hits)) or [()] * 3, [pa.binary(), pa.int64(), pa.int64()])], names=["v", "id", "score"])

    # Blocks and batches are numbered by hash; a block meets so many batches of its width in one group.
    n_blocks = F.ceil(F.lit(distinct.count()) * F.col("width") / BLOCK).cast("long")
    n_groups = F.ceil(F.lit(queries.count()) * F.col("width") / (BATCH * TOGETHER)).cast("long")
    pick = lambda n: F.pmod(F.xxhash64("v"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = distinct.select("width", "v", "ids", pick(n_blocks).alias("b"), every(n_groups).alias("g"))
    batches = queries.select("width", "v", pick(n_groups).alias("g"), every(n_blocks).alias("b"))
    met = blocks.groupBy("width", "b", "g").cogroup(batches.groupBy("width", "b", "g"))
    hits = met.applyInArrow(compare, "v binary, id bigint, score bigint")
    best = Window.partitionBy("v").orderBy(F.desc("score"), "id")
    top = stored(hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= need).select("v", "id", "score"), "top")
    # Only the query's own id can drop out of its vector's k + 1 best.
    own = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "id")
    facts = top.join(queries.select("v", "n_rows"), "v")
    answers = spread_join(asked.select(F.col("id").alias("query_id"), "v"), facts, "v", "n_rows").where("query_id <> id")
    ranked = answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
