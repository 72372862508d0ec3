import hashlib
import math
from collections import Counter, defaultdict

import pytest
from llm.mixing import Mix, exponent, mixed, mixture, word_tokens

SCHEMA = "doc_id long, text string, source string, name int, tokens string, key int"


def brute(rows, mix):
    """Rows (id, text, source) -> Counter of (id, source, pass)."""
    name = lambda s: "n" if s is None else "s" + s
    tokens = lambda t: len((t or "").split()) + 1
    md5 = lambda *x: hashlib.md5("|".join(x).encode()).hexdigest()
    sums = Counter()
    for _, t, s in rows:
        sums[name(s)] += tokens(t)
    total = sum(sums.values())
    p = {s: n / total for s, n in sums.items()}

    def at(t):
        z = sum(x**t for x in p.values())
        w = {s: x**t / z for s, x in p.items()}
        budget = max(sums[s] / w[s] for s in p) if mix.budget is None else mix.budget * total
        return -sum(x * math.log(x) for x in w.values()), max(w[s] * budget / sums[s] for s in p), w, budget

    def search(ok, lowest):
        low, high = 0.0, 1.0
        for _ in range(32):
            mid = (low + high) / 2
            if ok(at(mid)) == lowest:
                high = mid
            else:
                low = mid
        return high if lowest else low

    target = mix.entropy * math.log(len(p))
    t = 1.0 if at(1.0)[0] >= target - 1e-12 else search(lambda v: v[0] >= target, False)
    if at(t)[1] > mix.repeats:
        t = 1.0 if at(1.0)[1] > mix.repeats else search(lambda v: v[1] <= mix.repeats, True)
    _, _, w, budget = at(t)
    out = Counter()
    for s in p:
        quota = math.floor(w[s] * budget + 1e-6)
        whole, left = divmod(quota, sums[s])
        group = defaultdict(list)
        for i, text, src in rows:
            if name(src) == s:
                key = md5(mix.seed, *([] if i is None else [str(i)]))
                group[md5(mix.seed, str(whole), s, key[:3]) + key].append((i, src, tokens(text)))
                for e in range(whole):
                    out[i, src, e] += 1
        upto = 0
        for key in sorted(group):
            upto += sum(g[2] for g in group[key])
            if upto > left:
                break
            for i, src, _ in group[key]:
                out[i, src, whole] += 1
    return out, t


@pytest.mark.parametrize("mix", [Mix(), Mix(entropy=0.8, budget=0.3), Mix(entropy=1.0, repeats=1.5), Mix(entropy=1.0, repeats=2.0, budget=None)])
def test_against_brute_force(spark, mix):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then 'hot' when doc_id % 50 = 1 then null else source end as source")
    want, _ = brute([tuple(r) for r in docs.collect()], mix)
    got = Counter((r.doc_id, r.source, r["pass"]) for r in mixture(docs, mix).collect())
    assert got == want


def test_limits_hold(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "name string, tokens long")
    t, _, _ = exponent(sources, Mix(entropy=0.9, repeats=1e9))
    p = [1000 / 1110, 100 / 1110, 10 / 1110]
    z = sum(x**t for x in p)
    assert abs(-sum(x**t / z * math.log(x**t / z) for x in p) - 0.9 * math.log(3)) < 1e-6
    t, _, _ = exponent(sources, Mix(entropy=1.0, repeats=2.0, budget=None))
    assert abs(100 ** (1 - t) - 2) < 1e-6
    assert exponent(sources, Mix(entropy=0.0))[0] == 1.0
    assert exponent(sources.limit(0), Mix()) == (1.0, 0, 0)


def test_odd_rows(spark):
    rows = [(1, None, None, 0, "", 0), (2, "", None, 0, "", 0), (None, "a b", "x", 0, "", 0), (3, "w " * 60_000, "y", 0, "", 0), (4, "a", "x", 0, "", 0), (4, "a", "x", 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.n for r in df.select(word_tokens("text").alias("n")).collect()] == [1, 1, 3, 60_001, 2, 2]
    mix = Mix(entropy=1.0, repeats=3.0, budget=None)
    want, _ = brute([(r[0], r[1], r[2]) for r in rows], mix)
    clashing = df.selectExpr("*", "1 as pass", "2 as row", "3 as __pass", "4 as weight", "5 as place")
    got = mixed(clashing, mix)
    assert got.columns == clashing.columns
    want_rows = Counter()
    for (doc, source, _), n in want.items():
        want_rows[doc, source] += n
    assert Counter((r.doc_id, r.source) for r in got.collect()) == want_rows
    assert Counter((r.doc_id, r.source, r["pass"]) for r in mixture(clashing, mix).collect()) == want
    assert {k[:2] for k in want} == {(r[0], r[2]) for r in rows}
    assert mixture(df.limit(0)).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    from llm import mixing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = sorted(map(tuple, mixture(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixture(docs).collect())) == before


def test_passes_are_permutations_of_blocks(spark):
    docs = spark.createDataFrame([(i, "a b c", "x") for i in range(3000)] + [(i, "a", "y") for i in range(3000, 3300)], "doc_id long, text string, source string")
    rows = mixture(docs, Mix(entropy=1.0, repeats=3.0, budget=None)).collect()
    orders = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.source, r["pass"], r.place)):
        if not orders[r.source, r["pass"]] or orders[r.source, r["pass"]][-1] != r.block:
            orders[r.source, r["pass"]].append(r.block)
    assert all(len(set(o)) == len(o) for o in orders.values())  # a block's documents stand together
    first, second = orders["y", 0], orders["y", 1]
    assert set(first) >= set(second) and [b for b in first if b in set(second)] != second
    assert abs(sum({r.source: r.weight for r in rows}.values()) - 1) < 1e-5
