import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm.packing import Capacity, best_fit, pack, slots
from llm.tokens import default_path, library_ids, load


def place_all(histogram, capacity, rule):
    classes = best_fit(histogram, capacity, rule=rule)
    table = slots(classes)
    bins = defaultdict(list)
    for length, n in histogram.items():
        s = table[length]
        for rank in range(n):
            at = np.searchsorted(s[:, 0], rank, "right") - 1
            bins[int(s[at, 1] + rank - s[at, 0])].append((int(s[at, 2]), length))
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(8))
def test_histogram_packing(rule, seed):
    rng = np.random.default_rng(seed)
    capacity = Capacity(100, int(rng.integers(3, 30)), int(rng.integers(10_000, 12_000)))
    histogram = {int(k): int(rng.integers(1, 60)) for k in rng.choice(np.arange(1, 101), 40, False)}
    bins = place_all(histogram, capacity, rule)
    assert sum(map(len, bins.values())) == sum(histogram.values())
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(items) <= capacity.documents and sum(n * n for _, n in items) <= capacity.attention


def test_attention_capacity_binds():
    bins = place_all({10: 9}, Capacity(100, 100, 300), "norm")
    assert sorted(map(len, bins.values())) == [3, 3, 3]


def test_close_to_the_least_number():
    rng = np.random.default_rng(1)
    histogram = defaultdict(int)
    for n in np.minimum(rng.lognormal(6, 1, 20_000), 2048).astype(int) + 1:
        histogram[min(int(n), 2048)] += 1
    total = sum(k * v for k, v in histogram.items())
    used = sum(c.count for c in best_fit(dict(histogram)))
    assert used <= 1.01 * -(-total // 2048)


def check(rows, packed, size):
    tok = load(default_path())
    want = defaultdict(list)
    for doc, text in rows:
        want[doc].append(library_ids(tok, text or "") + [0])
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for doc, all_ids in want.items():
        pieces = sorted(by_doc[doc], key=lambda r: (r.piece, r.start))
        assert sum(r.length for r in pieces) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            ids = all_ids[0]
            assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // size)
            assert all(r.length == size for r in pieces[1:])
            for r in pieces:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert set(by_doc) == set(want)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = pack(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], packed, 2048)
    assert len({r.sequence_id for r in packed}) <= 1 + 1.02 * sum(r.length for r in packed) / 2048


def test_odd_rows(spark):
    schema = "length string, text string, doc_id long, id int, piece string, block int"
    rows = [("x", None, 1, 0, "", 0), ("x", "", 2, 0, "", 0), ("x", "same text", 3, 0, "", 0), ("x", "same text", 3, 0, "", 0), (None, "w é " * 9000, 4, 0, "", 0), ("x", "a", None, 0, "", 0)]
    df = spark.createDataFrame(rows, schema)
    check([(r[2], r[1]) for r in rows], pack(df).collect(), 2048)
    assert pack(spark.createDataFrame([], schema)).count() == 0
