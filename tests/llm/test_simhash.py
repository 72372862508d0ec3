import numpy as np
import pytest
from llm.simhash import Forest, forest_rows, near_duplicates, one_of_each, shingle_fingerprint, similar_groups


def brute(fps, ids, radius=4):
    root = list(range(len(fps)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[up(i)] = up(j)
    least = {}
    for i, x in enumerate(ids):
        least[up(i)] = min(least.get(up(i), x), x)
    return {x: least[up(i)] for i, x in enumerate(ids)}


def test_fingerprint_of_one_shingle_is_its_hash():
    import xxhash

    assert shingle_fingerprint("A b\tC") == xxhash.xxh64_intdigest(b"a b c", 42)
    assert shingle_fingerprint("a b c d") == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert shingle_fingerprint("") == shingle_fingerprint(None) == shingle_fingerprint(" \n") == 0


def test_fingerprint_majority():
    import xxhash

    words = "x y z x y z x Ä".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert shingle_fingerprint("x y  z x\ny z X Ä") == expected


@pytest.mark.parametrize("seed", range(3))
def test_tiles_find_every_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    x = np.unique(np.concatenate([base, near]))
    x = x[np.lexsort((x, np.bitwise_count(x)))]
    cut = 400
    forest = Forest(len(x))
    at = {int(v): i for i, v in enumerate(x)}
    for low, high in (forest_rows(x[:cut], None, 4), forest_rows(x[cut:], None, 4), forest_rows(x[:cut], x[cut:], 4)):
        forest.link(np.array([at[int(v)] for v in low], int), np.array([at[int(v)] for v in high], int))
    got = forest.roots(np.arange(len(x)))
    want = brute([int(v) for v in x], list(range(len(x))))
    assert [want[i] for i in range(len(x))] == got.tolist()


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    fps = [shingle_fingerprint(r.text) for r in rows]
    want = brute(fps, [r.doc_id for r in rows])
    assert {k: v.component_id for k, v in got.items()} == want
    assert all(int(got[r.doc_id].fingerprint, 16) == f and len(got[r.doc_id].fingerprint) == 16 for r, f in zip(rows, fps))


def test_odd_rows(spark):
    schema = "text string, fp string, doc_id long, component_id int, root string"
    rows = [(None, "x", 5, 1, "y"), ("", "x", 3, 1, "y"), (" ", None, 9, 1, "y"), ("a b c d e", "", 4, 1, "y"), ("a b c d e", "", 2, 1, "y"), ("w " * 40000, "", 7, 1, "y"), ("a b c d e", "", 2, 1, "y")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(2, 2), (2, 2), (3, 3), (4, 2), (5, 3), (7, 7), (9, 3)]
    kept = one_of_each(df, similar_groups(df))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]
    empty = spark.createDataFrame([], schema)
    assert near_duplicates(empty).count() == 0 and similar_groups(empty).count() == 0 and one_of_each(empty, similar_groups(empty)).count() == 0
    same = sorted((r.doc_id, r.component_id) for r in similar_groups(df).select("doc_id", "component_id").collect())
    assert same == [(2, 2), (2, 2), (3, 3), (4, 2), (5, 3), (7, 7), (9, 3)]


def test_chain_is_one_component(spark):
    from llm.simhash import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_similar_groups_against_jaccard(spark):
    rng = np.random.default_rng(5)
    rows, clear = [], []
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        rows.append((3 * i, " ".join(words)))
        few = list(words)
        few[50] = few[200] = "x"  # ten of 296 shingles: Jaccard 0.93
        rows.append((3 * i + 1, " ".join(few)))
        many = list(words)
        for k in range(0, 300, 10):  # half of all shingles: Jaccard 0.33
            many[k] = "y"
        rows.append((3 * i + 2, " ".join(many)))
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[3 * i] == 3 * i and got[3 * i + 1] == 3 * i and got[3 * i + 2] == 3 * i + 2 for i in range(60))


def test_similarity_is_verified(spark):
    from llm.simhash import shingle_hashes

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 9))]
    texts.append(" ".join(texts[0].split()[:8]))  # 4 of 5 shingles
    for changed in [*range(3, 13)] * 6:  # some above, some below
        words = [f"w{x}" for x in rng.integers(0, 10**6, 304)]
        texts.append(" ".join(words))
        for at in rng.choice(300, changed, replace=False):
            words[at] = "other%d" % rng.integers(0, 10**6)
        texts.append(" ".join(words))
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 10 < sum(x >= 0.8 for x in alike) < 50 and sum(0.6 < x < 0.8 for x in alike) > 10
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(len(alike))] == [x >= 0.8 for x in alike]


def test_blocks_are_verified_whole(spark, monkeypatch):
    from llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 3)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words, f"end{i}"]) for i in range(20)]
    got = similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, 0) for i in range(20)]


def test_population_spans():
    from llm.simhash import population_spans

    assert population_spans({30: 5, 31: 5, 32: 50, 33: 1}, 10) == [(30, 31, 1), (32, 32, 5), (33, 33, 1)]
    assert population_spans({}, 10) == []


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_groups_find_every_link(spark, size):
    from llm.simhash import close_links, components

    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64) for _ in range(4)]
    x = np.unique(np.concatenate([base, base ^ flips[0] ^ flips[1], base[:60] ^ flips[0][:60] ^ flips[1][:60] ^ flips[2][:60] ^ flips[3][:60], [np.uint64(0)]])).view(np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in x], "fp long")
    got = {r.node: r.root for r in components(close_links(nodes, 4, size)).collect()}
    want = brute([int(v) for v in x.view(np.uint64)], [int(v) for v in x])
    assert {int(v): got.get(int(v), int(v)) for v in x} == want


def test_crowded_keys_join_where_they_lie(spark, monkeypatch):
    from llm import common
    from llm.simhash import components

    monkeypatch.setattr(common, "CROWD", 5)
    links = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 40)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in [*range(1, 40), *range(101, 140)]} | {501: 500}
    docs = spark.createDataFrame([(i, "same words in all of these") for i in range(30)] + [(99, "others")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()) == [(i, 0) for i in range(30)] + [(99, 99)]


def test_bands_catch_what_they_should():
    from llm.simhash import Bands, differing_share

    for n in (100, 10**6, 10**10):
        bands = Bands(n, 0.8)
        for short in (False, True):
            hit = (1 - differing_share(0.8, short)) ** bands.bits
            assert (1 - hit) ** bands.numbers[short] <= 0.002 and -(-bands.numbers[short] // bands.a_word) <= bands.words
    assert Bands(100, 0.8).bits == 4 and Bands(10**6, 0.8).bits == 10


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    schema = "row string, doc_id long, text string, wanted int, node string, survivor int"
    rows = [("a", 1, "one two three four five six", 0, "", 0), ("b", 1, "quite other words than the first row has", 0, "", 0), ("c", None, "some third text that has no id", 0, "", 0), ("d", None, "a fourth one, without id as well", 0, "", 0)]
    rows += [("e", 2, "one two three four five six", 0, "", 0), ("f", None, "some third text that has no id", 0, "", 0), ("g", 3, "alone among all the rows here", 0, "", 0), ("a", 1, "one two three four five six", 0, "", 0)]
    df = spark.createDataFrame(rows, schema)
    kept = one_of_each(df, similar_groups(df))
    got = sorted(r.row for r in kept.collect())
    assert kept.columns == df.columns and [x for x in got if x not in "cf"] == ["a", "b", "d", "g"] and len(got) == 5
