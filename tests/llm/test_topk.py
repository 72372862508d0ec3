import math

import numpy as np
import pytest
from llm.topk import SortedLists, search_block, top_k
from pyspark.sql import functions as F


def brute(rows, asks, k=5):
    sound = [(i, np.array([math.floor(256 * float(x)) for x in v], object)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in sound:
        if not asks(q):
            continue
        hits = sorted(((int((qv * v).sum()), i) for i, v in sound if i != q and len(v) == len(qv)), key=lambda h: (-h[0], h[1]))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_threshold_walk_is_exact(seed):
    rng = np.random.default_rng(seed)
    spread = [3, 40, 300][seed % 3]
    vectors = np.unique(rng.integers(-spread, spread, (500, 6)), axis=0)
    queries = rng.integers(-spread, spread, (20, 6))
    queries[0] = 0
    got = search_block(vectors, [[i] for i in range(len(vectors))], queries, 4)
    for q, hits in zip(queries, got):
        scores = vectors @ q
        want = sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda h: (-h[0], h[1]))[:4]
        assert hits == want


def test_walk_stops_early():
    vectors = np.arange(4000)[:, None] * np.ones(3, int)
    lists = SortedLists(vectors)
    places, _ = lists.search(np.array([1, 2, 3]), 4)
    assert len(places) < 100


def test_large_components_stay_exact():
    vectors = np.array([[2**40, 1], [2**40, 0], [-(2**40), 5]], object)
    assert search_block(vectors, [[0], [1], [2]], np.array([[2**40, 1]], object), 2) == [[(2**80 + 1, 0), (2**80, 1)]]


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = top_k(df, F.col("vec_id") % 50 == 0).collect()
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 50 == 0)
    assert sorted(tuple(r) for r in got) == want


def test_odd_rows(spark):
    schema = "v int, vec_id long, embedding array<float>, id string, score long"
    nan, inf = float("nan"), float("inf")
    vs = [(0, [1.0, 0.5])] + [(i, [0.5, 0.5]) for i in range(1, 30)] + [(50, [0.5, 0.5]), (51, [-1.0, 2.0]), (52, [nan, 1.0]), (53, [inf, 1.0]), (54, None), (55, [None, 1.0]), (100, [0.0, 0.0]), (150, [3.0]), (200, []), (7, [0.5, 0.5])]
    df = spark.createDataFrame([(0, i, v, "", 0) for i, v in vs] + [(0, None, [1.0, 1.0], "", 0)], schema)
    got = top_k(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(vs[:-1], lambda i: i % 50 == 0)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_the_bound_ends_walks_where_few_components_matter():
    """Sparse queries on vectors with a steep spectrum: the threshold falls below the kth score early."""
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(0, 1, (4096, 16)) * 0.5 ** np.arange(16)).astype(int)
    lists = SortedLists(vectors)
    shares = []
    for _ in range(20):
        q = vectors[rng.integers(0, 4096)]
        places, scores = lists.search(q, 6)
        shares.append(len(places) / 4096)
        assert sorted(scores)[-6:] == sorted(vectors @ q)[-6:]
    assert np.median(shares) < 0.9


def test_walks_without_a_bound_see_everything():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-100, 100, (500, 64))
    places, _ = SortedLists(vectors).search(vectors[0], 6)
    assert sorted(places) == list(range(500))


def test_without_broadcast_and_with_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4 + i % 2)]) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 900)] + [(900, rows[1][1])] * 3 + [(900, rows[2][1])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(17)
        got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).where("query_id <> 900").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute([(i, list(np.float32(v))) for i, v in dict(rows).items() if i != 900] + [(900, list(np.float32(rows[1][1]))), (900, list(np.float32(rows[2][1])))], lambda i: i % 100 == 0 and i != 900)
    assert got == want


def test_packed_vectors():
    from llm.topk import packed_vector, unpacked_vectors

    vs = [np.array([1, -5, 300]), np.array([2**40, 0, -7])]
    assert unpacked_vectors([packed_vector(v) for v in vs]).tolist() == [v.tolist() for v in vs]
    assert len(packed_vector(vs[0])) == 7
