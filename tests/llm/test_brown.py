import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm import brown
from llm.brown import END, FACTS, UNIT, Frequent, _chunks, exchange, fit_model, likelihood, score_texts, word_facts, words_of
from pyspark.sql import functions as F


def base_scores(rows, held):
    count = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    n, v = sum(count.values()), len(count)
    return {i: (len(words_of(t)), sum(count[w] > 0 for w in words_of(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words_of(t))) for i, t in rows}


def is_held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_exchange_separates_two_vocabularies_and_never_falls():
    rng = np.random.default_rng(0)
    text = []
    for _ in range(400):
        low = 0 if rng.random() < 0.5 else 10
        text += [20, *rng.integers(low, low + 10, 8)]
    pairs = np.zeros((22, 22))
    np.add.at(pairs, (text[:-1], text[1:]), 1)
    before = None
    for sweeps in range(5):
        cls = exchange(pairs, 2, sweeps)
        now = likelihood(pairs, cls, 2)
        assert before is None or now >= before - 1e-6
        before = now
    assert len(set(cls[:10])) == 1 and len(set(cls[10:])) == 1 and cls[0] != cls[10]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    follows = rng.integers(0, 50, (5, 5)).astype(float)
    follows[:, -1] = 0
    m = fit_model(follows, np.minimum(follows, 3), int(follows.sum()), 9)
    size = follows[:, :-1].sum(axis=0)
    assert np.allclose((10 ** m.step[:, :-1] * size).sum(axis=1) + 10 ** m.step[:, -1], 1)


def test_against_brute_force_counts_and_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = base_scores([(r.doc_id, r.text) for r in docs.collect()], is_held)
    got = score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(r.doc_id), n, known, train)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def model_by_hand(rows, held, classes, most):
    """Scores by the definition, one word at a time; only the exchange itself is the operator's."""
    texts = {i: words_of(t) for i, t in rows}
    learn = [w for i, w in texts.items() if not held(i)]
    count = Counter(w for t in learn for w in t)
    frequent = sorted((w for w in count if w != END), key=lambda w: (-count[w], w))[:most]
    n = len(frequent)
    at = {w: i for i, w in enumerate(frequent)} | {END: n}
    pairs = np.zeros((n + 2, n + 2))
    for t in learn:
        for v, w in zip([END, *t], t):
            pairs[at.get(v, n + 1), at.get(w, n + 1)] += 1
    full = [*exchange(pairs, classes).tolist(), classes, classes + 1]
    joint = np.full((classes + 2, classes + 2), 0.1)
    for i, a in enumerate(full):
        for j, b in enumerate(full):
            joint[a, b] += pairs[i, j]
    left, right = joint.sum(axis=1), joint.sum(axis=0)
    kind = lambda w: full[at[w]] if w in at else classes + 1
    gains = {w: np.zeros(classes) for w in count if w not in at}
    for t in learn:
        for v, w, x in zip([END, *t], t, [*t[1:], END]):
            if w in gains:
                a, b = kind(v), kind(x)
                gains[w] += [np.rint(UNIT * (math.log(joint[a, c]) + math.log(joint[c, b]) - math.log(left[c]) - math.log(right[c]))) for c in range(classes)]
    cls = {w: kind(w) if w in at else int(gains[w].argmax()) for w in count}
    unseen, k = classes + 1, classes + 2
    context = lambda v: cls[v] if count[v] > 1 or v == END else unseen
    follows, singles = np.zeros((k, k)), np.zeros((k, k))
    for t in learn:
        for v, w in zip([END, *t], t):
            follows[context(v), cls[w]] += 1
            singles[context(v), cls[w]] += count[w] == 1
    m = fit_model(follows, singles, sum(count.values()), len(count))
    return {i: sum(m.step[context(v), cls.get(w, unseen)] + math.log10(max(1, count[w])) for v, w in zip([END, *t], t)) for i, t in texts.items()}


def test_scores_by_hand_however_the_input_is_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = model_by_hand(rows, is_held, 4, 50)
    for parts, tokens in ((1, 2_000_000), (4, 3000), (41, 500)):
        got = score_texts(docs.repartition(parts), held, classes=4, frequent=50, block_tokens=tokens).collect()
        assert len(got) == len(rows)
        for r in got:
            assert abs(r.score - want[r.doc_id]) < 1e-6 * abs(r.score)


def test_words_that_crowd_a_block_and_span_batches(spark):
    """Sums of gains instead of neighbours, and one word in very many blocks, change no score."""
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, range(1, 301), k=400))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = model_by_hand(rows, is_held, 3, 10)
    for tokens in (2_000_000, 300):
        for r in score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, classes=3, frequent=10, block_tokens=tokens).collect():
            assert abs(r.score - want[r.doc_id]) < 1e-6 * abs(r.score)


def test_facts_of_words_that_span_batches():
    import pyarrow as pa

    class Shared:
        value = Frequent([b"often"], np.array([1]), 2, np.arange(32).reshape(4, 4, 2).astype(np.int64))

    class Rows:
        def mapInArrow(self, f, schema):
            return f

    gather = word_facts(Rows(), Shared)
    sides = lambda *p: bytes(x for pair in p for x in pair)
    sums = np.array([0, 100], np.int64).tobytes()
    rows = [(b"a", 1, 0, 2, sides((0, 1), (1, 0)), None), (b"b", 1, 1, 1, sides((3, 3)), None), (b"b", 2, 0, 70, b"", sums), (b"b", 3, 0, 0, b"", None), (b"often", 2, 1, 5, b"", None), (b"zero", 3, 1, 0, b"", None)]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["word", "block", "code", "n", "near", "gains"]

    def batches(size):
        for i in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], names)

    def facts(size, chunk):
        found, fresh = {}, 0
        with pytest.MonkeyPatch.context() as m:
            m.setattr(brown, "_chunks", lambda b, n: _chunks(b, chunk))
            for out in gather(batches(size)):
                for block, packed, n in zip(*(c.to_pylist() for c in out.columns)):
                    fresh += n
                    found |= {(block, int(f["code"])): (int(f["n"]), int(f["cls"])) for f in np.frombuffer(packed, FACTS)}
        return found, fresh

    want = {(1, 0): (2, 1), (1, 1): (71, 1), (2, 0): (71, 1), (3, 0): (71, 1), (2, 1): (5, 1), (3, 1): (0, 3)}, 3
    assert all(facts(size, chunk) == want for size in (1, 2, 6) for chunk in (1, 2, 50))


def test_odd_rows(spark):
    schema = "held string, text string, doc_id long, block int"
    rows = [("", None, 1, 0), ("", "", 2, 0), ("", "A b\x0bc", 3, 0), ("", "a b c", 3, 0), ("", "never seen", 10, 0), ("", "w " * 30_000, 5, 0), ("", "a", None, 0)]
    df = spark.createDataFrame(rows, schema)
    got = score_texts(df, F.col("doc_id") == 10, classes=3).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 2, 2), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (5, 30_001, 30_001), (10, 3, 1)]
    assert {r.train_tokens for r in got} == {30_001 + 1 + 1 + 4 + 4 + 2} and all(math.isfinite(r.score) for r in got)
    assert score_texts(df.limit(0), F.lit(False)).count() == 0
    alone = score_texts(df.where("doc_id = 10"), F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score) and math.isfinite(alone.base_score)


def test_frequent_words_do_not_depend_on_blocks(spark):
    from llm.brown import coded_blocks, frequent_words
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "often " * 7 + f"rare{i} twice{i // 2}") for i in range(20)], "doc_id long, text string")
    got = [frequent_words(coded_blocks(docs.repartition(n, "doc_id"), F.lit(False), "doc_id", "text", tokens), 3) for n, tokens in ((1, 1000), (10, 1000), (4, 1))]
    assert got[0] == got[1] == got[2] == [b"often", b"twice0", b"twice1"]


def test_frequent_words_are_the_most_frequent(spark):
    from llm.brown import coded_blocks, frequent_words

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    count = Counter(w for r in docs.collect() for w in words_of(r.text) if w != END)
    want = sorted(count, key=lambda w: (-count[w], w))
    for most in (7, 200, 10**6):
        assert frequent_words(coded_blocks(docs.repartition(11), F.lit(False), "doc_id", "text", 1500), most) == want[:most]
    with pytest.raises(ValueError):
        score_texts(docs, F.lit(False), classes=254)
