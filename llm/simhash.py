"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed where the texts are read.  Equal fingerprints are one
node.  Nodes are put into groups by the population counts of their 64-bit
fingerprints, and every pair of groups whose counts lie within the radius is
compared exactly in one task, tile by tile, by numpy exclusive-or and bit
counts; tiles whose counts rule each other out are skipped.  A task keeps only
a spanning forest of the links it finds, so a group of thousands of near copies
costs its number of nodes, not of pairs, and no link is lost.  The forests are
merged by alternating large-star and small-star steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, spread_join, stored

#: Rows of a group that are compared, or skipped, together: a tile.
TILE = 256
#: Nodes of a group that is compared with another in one task, and the least number of groups.
GROUP, GROUPS = 131_072, 8


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; none for a text without a word."""
    import xxhash

    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def majority_bits(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def shingle_fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles, each counted as often as it occurs."""
    return majority_bits(shingle_hashes(text, words))


def remixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Hashes independent of the given ones, for each ``turn`` (the finaliser of splitmix64)."""
    h = h + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(h: np.ndarray, length: int) -> np.ndarray:
    """SimHash of ``length`` 64-bit words of distinct hashes; the first is their plain fingerprint."""
    return np.array([majority_bits(remixed(h, i) if i else h) for i in range(length)], np.uint64)


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint's 64 bits as a long.  Null texts count as empty: zero."""

    def compute(batches):
        for batch in batches:
            fp = np.array([shingle_fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(compute, f"id {kind}, fp bigint")


def population(fp: Column | str, part: int | None = None) -> Column:
    """Number of ones in the fingerprint, or in its 16-bit ``part``."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    return F.bit_count(fp if part is None else F.shiftrightunsigned(fp, 16 * part).bitwiseAND(F.lit(65535)))


class Forest:
    """Union-find over a task's nodes, fed with whole arrays of links."""

    def __init__(self, n: int):
        self.parent, self.linked = np.arange(n), False

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                self.parent[x] = r
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b, self.linked = a[apart], b[apart], True
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)
            a, b = low, high


def part_counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts, one row a fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def links_between(a: np.ndarray, b: np.ndarray, radius: int, same: bool, into: Forest, offset: int, rests: tuple | None = None) -> None:
    """Link every pair (i, offset + j) at ``radius`` bits or fewer, unless it is joined already.

    A tile's fingerprints lie in a box of partial population counts; the sum
    of the gaps between two boxes bounds the distance of any pair from below.
    ``rests`` has the longer fingerprints of both sides and how many of all
    bits may differ; pairs within the radius must pass that too.
    """

    def tiles(x):
        c = part_counts(x)
        return [(s, x[s : s + TILE], c[s : s + TILE].min(0), c[s : s + TILE].max(0), int(c[s : s + TILE].sum(1).min()), int(c[s : s + TILE].sum(1).max())) for s in range(0, len(x), TILE)]

    right = tiles(b)
    for i, x, low, high, least, most in tiles(a):
        here = np.arange(i, i + len(x))
        for j, y, ylow, yhigh, yleast, ymost in right:
            if same and j < i or least - ymost > radius or yleast - most > radius:
                continue
            if np.maximum(np.maximum(low - yhigh, ylow - high), 0).sum() > radius:
                continue
            if into.linked:
                root = into.roots(np.concatenate([here, np.arange(offset + j, offset + j + len(y))]))
                if (root == root[0]).all():
                    continue
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            p, q = np.nonzero(near)
            if rests and len(p):
                ra, rb, limit = rests
                close = np.bitwise_count(x[p] ^ y[q]) + np.bitwise_count(ra[i + p] ^ rb[j + q]).sum(axis=1, dtype=np.int64) <= limit
                p, q = p[close], q[close]
            if len(p):
                into.link(i + p, offset + j + q)


def forest_rows(a: np.ndarray, b: np.ndarray | None, radius: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within ``a``, or between ``a`` and ``b``.

    Both are fingerprints, or rows of a node, its fingerprint and the words
    that follow it, of which ``limit`` bits may differ.
    """
    rest = None
    if a.ndim == 1:
        nodes, fa, fb = (a if b is None else np.concatenate([a, b])), a, a if b is None else b
    else:
        other = a if b is None else b
        nodes, fa, fb = (a[:, 0] if b is None else np.concatenate([a[:, 0], b[:, 0]])), a[:, 1].copy(), other[:, 1].copy()
        rest = (a[:, 2:], other[:, 2:], limit)
    forest = Forest(len(nodes))
    links_between(fa, fb, radius, b is None, forest, 0 if b is None else len(a), rest)
    root = forest.roots(np.arange(len(nodes)))
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[root[moved]], nodes[moved]


def in_order(rows: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Places of the rows by the population counts of their fingerprints, whole and in part."""
    counts = part_counts(fp)
    return np.lexsort((counts[:, 2], counts[:, 1], counts[:, 0], counts.sum(axis=1)))


def population_spans(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """(least, most, parts): neighbouring population counts put together until they hold ``size`` nodes; parts of a size each."""
    spans: list[list[int]] = []
    for p in sorted(counts):
        if not spans or spans[-1][2] >= size:
            spans.append([p, p, 0])
        spans[-1][1] = p
        spans[-1][2] += counts[p]
    return [(least, most, -(-n // size)) for least, most, n in spans]


def close_links(nodes: DataFrame, radius: int = 4, size: int | None = None) -> DataFrame:
    """``a, b``: for distinct fingerprints ``fp``, links that join exactly what radius joins.

    A group holds about ``size`` nodes (131,072 at most) of neighbouring
    population counts; nodes of one count beyond that are dealt by hash.  The
    groups that a node meets follow from the 65 counts alone.  A node travels
    once for each group that it meets, and each pair of groups is a task.
    """
    counts = {r.p: r["count"] for r in nodes.groupBy(population("fp").alias("p")).count().collect()}
    size = size or max(1, min(GROUP, -(-sum(counts.values()) // GROUPS)))
    spans = population_spans(counts, size)
    first = np.cumsum([0] + [parts for *_, parts in spans]).tolist()
    of = [next((i for i, (least, most, _) in enumerate(spans) if least <= p <= most), 0) for p in range(65)]
    near = [[j for j, (least, most, _) in enumerate(spans) if least - spans[i][1] <= radius and spans[i][0] - most <= radius] for i in range(len(spans))] or [[0]]
    told = lambda values: F.get(F.array(*map(F.lit, values)), F.get(F.array(*map(F.lit, of)), population("fp")))
    parts = [p for *_, p in spans] or [1]
    own = told(first[: len(parts)]) + F.pmod(F.xxhash64("fp"), told(parts))
    reach = F.sequence(told([first[n[0]] for n in near]), told([first[n[-1]] + parts[n[-1]] - 1 for n in near]))
    met = nodes.select("fp", own.cast("int").alias("g"), F.explode(reach.cast("array<int>")).alias("h"))
    g, h = F.col("g"), F.col("h")
    work = met.select(F.least(g, h).alias("i"), F.greatest(g, h).alias("j"), (g > h).alias("right"), "fp")

    def compare(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        order = in_order(fp, fp)
        fp, right = fp[order], table.column("right").to_numpy()[order]
        low, high = forest_rows(fp[~right], None if key[0].as_py() == key[1].as_py() else fp[right], radius)
        return pa.table({"a": low.view(np.int64), "b": high.view(np.int64)})

    return work.groupBy("i", "j").applyInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that links lead to, for every node with a link.

    Large-star then small-star until nothing changes.  Each round halves the
    depth of the trees; a round is two minima by key, each met by the rows of
    its key where they lie if they are many, and tables in the shared folder,
    of which the last one stays.  No neighbour list is ever gathered.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n_rows"))
        # Large star: every larger neighbour of u moves under u's minimum.
        large = stored(spread_join(both, least, "u", "n_rows").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        # Small star: u and its smaller neighbours move under the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n_rows"))
        moved = spread_join(large, small, "u", "n_rows").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        seen = Observation()
        stars = stored(moved.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")), "stars")
        discard(large)
        discard(edges)
        edges, state = stars, (seen.get["n"], seen.get["digest"])
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id that can be reached over links between
    fingerprints at ``radius`` or fewer differing bits.  Texts without a word,
    empty and null ones among them, have fingerprint zero and link like any
    other.  Repeated rows stay rows; a null id keeps its row and is never a
    component's id unless nothing else is in the component.  Columns other than
    the two that are named are not read.
    """
    marked = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n_rows")), "nodes")
    roots = components(close_links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", "n_rows", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    classes = stored(spread_join(placed, smallest, "root", "members").select("fp", "n_rows", "component_id"), "classes")
    return spread_join(marked, classes, "fp", "n_rows").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Shingle sets up to this size are compared at wider bounds.
SHORT = 32
#: Nodes that share a band on average, pairs at the similarity that no band may catch, and the least words of a sketch.
BUCKET, MISSED, LEAST_WORDS = 1024, 0.002, 4
#: Nodes of a bucket that are compared with each other in one task.
CROWDED = 8192
#: Nodes, and bytes of shingles, of a block of candidates that is verified in one task.
BLOCK, BLOCK_BYTES = 2048, 64 * 2**20


def differing_share(similarity: float, short: bool) -> float:
    """Bits of SimHashes that differ in the mean at a Jaccard similarity, at most.

    Sets of Jaccard similarity J have a cosine of 2J / (1 + J) or more, so that
    arccos(cosine) / pi of the bits differ; ties add to it, by at most 3% from
    32 shingles on and by 25% below (counted for J = 0.8).
    """
    return math.acos(2 * similarity / (1 + similarity)) / math.pi * (1.25 if short else 1.03)


class Bands:
    """How sketches are cut into bands: candidates agree in all bits of one band at least.

    A band has so many bits that ``BUCKET`` of ``n`` nodes share its value on
    average, and there are so many bands that a pair at the similarity agrees in
    none with a chance of ``MISSED``.  Both follow from the number of nodes by
    one rule at every size; a sketch is as long as its bands need.
    """

    def __init__(self, n: int, similarity: float):
        self.similarity = similarity
        self.bits = max(4, min(32, math.ceil(math.log2(max(2, n / BUCKET)))))
        self.a_word = 64 // self.bits
        self.numbers = {short: math.ceil(math.log(MISSED) / math.log(1 - (1 - differing_share(similarity, short)) ** self.bits)) for short in (False, True)}
        self.words = max(LEAST_WORDS, -(-max(self.numbers.values()) // self.a_word))

    def bounds(self, short: bool) -> tuple[int, int]:
        """Bits that may differ in a sketch's first word and in all of it: 3.5 (short: 4) and 5 deviations over the mean."""
        share = differing_share(self.similarity, short)
        bound = lambda bits, by: int(min(bits, bits * share + by * math.sqrt(bits * share * (1 - share))))
        return bound(64, 4 if short else 3.5), bound(64 * self.words, 5)

    def keys(self, sketch: Column, short: bool) -> Column:
        """One number for each band of an array of words."""
        mask = F.lit((1 << self.bits) - 1).cast("long")
        return F.array(*[
            F.shiftrightunsigned(F.get(sketch, F.lit(k // self.a_word)), k % self.a_word * self.bits).bitwiseAND(mask) + F.lit(k << self.bits).cast("long")
            for k in range(self.numbers[short])
        ])


def sketch_rows(table: pa.Table, words: int) -> np.ndarray:
    """node and the sketch's words, one row a node."""
    rows = np.empty((len(table), words + 1), np.uint64)
    rows[:, 0] = table.column("node").to_numpy().view(np.uint64)
    rows[:, 1:] = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), words)
    return rows


def candidate_links(nodes: DataFrame, bands: Bands, short: bool) -> DataFrame:
    """``a, b``: links of ``node, sketch`` that agree in a band and differ within the bounds, as spanning forests.

    A bucket, the nodes of one band's value, is compared tile by tile in one
    task; a crowded one is dealt into parts, and each pair of parts is a task.
    """
    radius, limit = bands.bounds(short)
    keyed = nodes.select("node", "sketch", F.explode(bands.keys(F.col("sketch"), short)).alias("key"))
    crowded = stored(keyed.groupBy("key").count().where(F.col("count") > CROWDED).select("key", F.ceil(F.col("count") / CROWDED).cast("int").alias("parts")), "crowded-bands")
    # AQE splits the crowded keys' rows; their list has at most a row for each 8192 rows.
    placed = keyed.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    g, h = F.col("g"), F.col("h")
    met = placed.withColumn("g", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    work = met.select("key", F.least(g, h).alias("i"), F.greatest(g, h).alias("j"), (g > h).alias("right"), "node", "sketch")

    def compare(key, table):
        rows, right = sketch_rows(table, bands.words), table.column("right").to_numpy()
        order = in_order(rows, rows[:, 1].copy())
        rows, right = rows[order], right[order]
        low, high = forest_rows(rows[~right], None if key[1].as_py() == key[2].as_py() else rows[right], radius, limit)
        return pa.table({"a": low.view(np.int64), "b": high.view(np.int64)})

    return work.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def verified_pairs(sets: list[np.ndarray], sketches: np.ndarray, right: np.ndarray | None, bands: Bands) -> list[tuple[int, int]]:
    """Links that join what pairs of the similarity or more join, within all sets or between left and ``right``.

    Pairs beyond the sketch bounds are not looked at, nor are pairs that links
    found so far have joined.
    """
    n, similarity = np.array([len(x) for x in sets], np.int64), bands.similarity
    widest, limits = SHORT / similarity, [bands.bounds(short)[1] for short in (False, True)]
    group, found = np.arange(len(sets)), []
    left = None if right is None else np.flatnonzero(~right)
    for x in range(len(sets)) if right is None else np.flatnonzero(right).tolist():
        others = np.arange(x) if left is None else left
        apart = np.bitwise_count(sketches[others] ^ sketches[x]).sum(axis=1, dtype=np.int64)
        low, high = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
        near = (apart <= np.where(high <= widest, limits[1], limits[0])) & (low >= high * similarity - 1e-6)
        others = others[near][np.argsort(apart[near], kind="stable")]
        others = others[group[others] != group[x]]
        while len(others):
            y, others = int(others[0]), others[1:]
            if jaccard(sets[x], sets[y]) >= similarity:
                found.append((y, x))
                group[group == group[x]] = group[y]
                others = others[group[others] != group[x]]
    return found


def verified_links(candidates: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, bands: Bands) -> DataFrame:
    """``a, b``: links between nodes of ``node, least_id, n, sketch`` whose shingle sets are alike.

    ``candidates`` joins all that may be; only texts of its components are read
    again, one a node.  A large component is cut into blocks, and each pair of
    blocks is verified in a task of its own.
    """
    loose = components(candidates)
    members = loose.union(loose.select(F.col("root").alias("node"), "root")).distinct()
    asked = stored(members.join(nodes, "node").select("node", "root", "least_id", "n", "sketch"), "candidates")

    def compute(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_digest, found), pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["node", "shingles"])

    wanted = asked.select(F.col("least_id").alias("wanted")).distinct()
    read = texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("id", "text").mapInArrow(compute, "node bigint, shingles binary")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    sizes = asked.groupBy("root").agg(parts.alias("parts"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    blocks = spread_join(asked.select("node", "root", "sketch"), sizes, "root", "n_rows").withColumn("g", F.pmod(F.xxhash64("node"), F.col("parts")))
    each = blocks.join(read.groupBy("node").agg(F.first("shingles").alias("shingles")), "node")
    g, h = F.col("g"), F.col("h")
    met = each.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    work = met.select("root", F.least(g, h).alias("i"), F.greatest(g, h).alias("j"), (g > h).alias("right"), "node", "sketch", "shingles")

    def verify(key, table):
        rows = sketch_rows(table, bands.words)
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        right = None if key[1].as_py() == key[2].as_py() else table.column("right").to_numpy()
        pairs = np.array(verified_pairs(sets, rows[:, 1:], right, bands), np.int64).reshape(-1, 2)
        node = table.column("node").to_numpy()
        return pa.table({"a": pa.array(node[pairs[:, 0]], pa.int64()), "b": pa.array(node[pairs[:, 1]], pa.int64())})

    return work.groupBy("root", "i", "j").applyInArrow(verify, "a bigint, b bigint")


def set_digest(h: np.ndarray) -> int:
    """64 bits, as a long, of a sorted set of hashes; among n sets two are mistaken for one with a chance of n**2 / 2**65."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), 42)], np.uint64).view(np.int64)[0])


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, component_id, node, survivor``: groups of texts whose shingle sets are ``similarity`` alike (Jaccard) or more.

    Equal sets are one node.  SimHashes choose candidates, which agree in a
    band of their bits and differ little in all of them (``Bands``); candidates
    are verified by the exact Jaccard similarity of their sets.  Rows without a
    word are alike.  Nulls, ties and repeats as in ``near_duplicates``; the
    survivor is the node of the row that stands for the group, the one with the
    smallest id and, of rows of that id, the smallest node.
    """
    bands = Bands(docs.count(), similarity)

    def compute(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint64), *(sketch(h, bands.words) for h in sets)]).view(np.int64)
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands.words, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(set_digest, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), sketches], ["id", "node", "n", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stored(texts.mapInArrow(compute, f"id {kind}, node bigint, n bigint, sketch array<bigint>"), "sketches")
    nodes = stored(marked.groupBy("node").agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n_rows")), "sketch-nodes")
    # Sets of a pair differ in size by the similarity at most, so every pair lies in one of the two ranges whole.
    short, long = nodes.where(F.col("n") <= SHORT / similarity), nodes.where(F.col("n") >= SHORT)
    candidates = candidate_links(short, bands, True).union(candidate_links(long, bands, False))
    roots = components(verified_links(candidates, nodes, texts, words, bands))
    placed = nodes.join(roots, "node", "left").select("node", "least_id", "n_rows", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min_by("node", F.struct(F.col("least_id").isNull(), "least_id", "node")).alias("survivor"), F.count(F.lit(1)).alias("members"))
    classes = stored(spread_join(placed, smallest, "root", "members").select("node", "n_rows", "component_id", "survivor"), "classes")
    return spread_join(marked.select("id", "node"), classes, "node", "n_rows").select(F.col("id").alias(id_col), "component_id", "node", "survivor")


def one_of_each(docs: DataFrame, groups: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``docs`` that stands for its group in ``groups`` (of ``similar_groups``), all columns kept.

    Rows of an id that repeats, or of none, are told apart by their texts: rows
    with different texts stand for groups of their own, and of rows with the
    same id and text one stays.
    """
    told = stored(groups.select(F.col(id_col).alias("id"), "component_id", "node", "survivor"), "groups")
    stands = told.where(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("survivor")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vague = stored(told.groupBy("id").agg(F.countDistinct("node").alias("nodes"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "nodes"), "vague-ids")
    if vague.isEmpty():
        wanted = stands.select(F.col("id").alias("wanted")).distinct()
        return rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("row.*")
    key = vague.select(F.col("id").alias("vague"))
    clear = stands.join(key, F.col("id").eqNullSafe(F.col("vague")), "left_anti").select(F.col("id").alias("wanted"))
    one = rows.join(clear, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("row")

    def digests(batches):
        for batch in batches:
            found = [set_digest(np.unique(shingle_hashes(t, words))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["row", "id", "node"])

    named = rows.join(key, F.col("id").eqNullSafe(F.col("vague")), "left_semi").select("row", "id", "text")
    marked = named.mapInArrow(digests, f"row {rows.schema['row'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, node bigint")
    wanted = stands.select(F.col("id").alias("wanted"), F.col("node").alias("wanted_node")).distinct()
    met = marked.join(wanted, F.col("id").eqNullSafe(F.col("wanted")) & (F.col("node") == F.col("wanted_node")), "left_semi")
    return one.unionByName(met.dropDuplicates(["id", "node"]).select("row")).select("row.*")
