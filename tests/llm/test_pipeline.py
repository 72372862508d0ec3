import corpus_pipeline
from llm.common import stored
from llm.simhash import similar_groups
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_each_stage_against_what_it_should_keep(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = ({r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}, docs.count())
        assert seen[name][1] <= seen[name][0]
    before, after, _ = seen["language"]
    assert len(after) >= 0.98 * len(before)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(SF + "/labels.parquet").collect()}
    before, after, _ = seen["toxicity"]
    assert not [i for i in before - after if labels.get(i) == 0]
    assert sum(labels[i] for i in after if i in labels) < 0.5 * sum(labels[i] for i in before if i in labels)
    before, after, _ = seen["near_duplicates"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    assert len({texts[i] for i in after}) == len(after)
    assert {texts[i] for i in after} <= {texts[i] for i in before}
    before, after, n = seen["mixing"]
    assert after == before and len(after) <= n <= 2 * len(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    per_sequence = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per_sequence.where("n <> end or n > 2048").count() == 0
    assert packed.where("piece = 0").count() == n


def test_near_duplicates_by_jaccard(spark):
    """Every group that links of 0.8 or more join is found whole, and no other link is made."""
    docs = spark.read.parquet(SF + "/documents.parquet")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in ((r.doc_id, r.text.encode().lower().split()) for r in docs.collect())}
    by_shingle = {}
    for i, s in sorted(sets.items()):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = []
    for i in sets:
        shared = {}
        for x in sets[i]:
            for j in by_shingle[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                linked.append((i, j))
                a, b = sorted((up(i), up(j)))
                root[b] = a
    want = {i: up(i) for i in sets}
    got = {r.doc_id: r.component_id for r in similar_groups(docs, words=5, similarity=0.8).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    assert len(linked) > 50 and sum(got[i] == got[j] for i, j in linked) >= 0.99 * len(linked)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_an_empty_table_stays_empty(spark, tmp_path):
    empty = spark.read.parquet(SF + "/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(SF + "/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and ids, and extra columns whose names the stages use themselves."""
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "the cat " * 20_000, "en", "a", 9), (4, "und der hund", "de", "b", 1), (4, "und der hund", "de", "b", 1), (5, "the dog", None, "b", None)]
    rows += [(None, "some words of a row without an id", "en", "a", 1), (None, "other words of another such row", "en", None, 1), (6, "one text of this id", "en", "a", 1), (6, "and another of the same", "en", "a", 1)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, node int, name string, row int, pass int, __keep int, key string, part string, id int, length int, block int"
    spark.createDataFrame([(*r, 1, "n", 2, 3, 4, "k", "p", 5, 6, 7) for r in rows], extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0), (4, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in extra.split(", ")]
    texts = sorted({r.text[:30] for r in docs.select("text").collect()})
    assert texts == sorted(x[:30] for x in ["the cat " * 4, "und der hund", "the dog", *(r[1] for r in rows[6:])])
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {3, 4, 5, 6, None}
