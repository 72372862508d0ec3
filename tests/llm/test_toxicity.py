import numpy as np
from llm.queries import op6_toxicity_pu
from llm.toxicity import document_features, fit_nn_pu, loss, nn_pu_risk, score, train, without_toxic


def test_risk_by_hand():
    gp, gu = np.array([2.0, -1.0]), np.array([0.5, -3.0, 0.0])
    first, second = nn_pu_risk(gp, gu, 0.3)
    plain = lambda z: 1 / (1 + np.exp(z))
    assert np.isclose(first, 0.3 * plain(gp).mean())
    assert np.isclose(second, plain(-gu).mean() - 0.3 * plain(-gp).mean())
    assert np.isclose(loss(np.array([0.0]))[0], 0.5)


def test_separates_positives_hidden_among_unlabelled():
    rng = np.random.default_rng(3)
    names = {f"w{i}": i for i in range(23)}

    def doc(bad):
        return np.append(rng.choice(20, 2, False), [20 + rng.integers(3)] if bad else []).astype(int)

    model = fit_nn_pu([doc(True) for _ in range(200)], [doc(i % 10 == 0) for i in range(1000)], names, 0.1)

    def value(d):
        return model.bias + model.weights[d].sum()

    assert np.mean([value(doc(True)) > 0 for _ in range(100)]) > 0.95
    assert np.mean([value(doc(False)) > 0 for _ in range(100)]) < 0.05


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = op6_toxicity_pu(spark, sf)
    labels = spark.read.parquet(sf + "/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    # About 300 confirmed examples do not show every word of every language.
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_odd_rows(spark):
    schema = "text string, doc_id long, toxic int, score string, id int"
    rows = [(f"clean words {i}", i, 0, "", 0) for i in range(30)] + [(f"such scum {i}", 100 + i, 1, "", 0) for i in range(30)]
    rows += [(None, 200, None, None, 0), ("", 201, 1, None, 0), ("scum " * 60_000, None, None, None, 0), ("scum", 200, 7, None, 0)]
    df = spark.createDataFrame(rows, schema)
    model = train(df, df)
    got = score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = without_toxic(df, model)
    assert kept.columns == df.columns and {"clean words 3", None, ""} <= {r.text for r in kept.collect()}
    nothing = train(df.limit(0), df.limit(0))
    assert all(r.score < 0.5 for r in score(df, nothing).collect()) and score(df.limit(0), model).count() == 0
    assert document_features(None) == set()


def test_scores_by_hand(spark):
    rows = [(i, f"calm text number {i} about rivers", 0) for i in range(40)] + [(100 + i, f"vile scumbags {i} are here", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train(df, df)
    assert model.names
    texts = {1: "Scumbags!", 2: "rivers", 3: "", 4: "vile rivers vile", 5: None}
    asked = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    for r in score(asked, model).collect():
        words = {"".join(c for c in w if c.isalpha()) for w in (texts[r.doc_id] or "").lower().split()} - {""}
        features = {f for w in words for f in ["=" + w, *(w[:n] for n in (4, 5, 6) if len(w) >= n)]}
        g = model.bias + sum(model.weights[model.names[f]] for f in features if f in model.names)
        assert abs(r.score - 1 / (1 + np.exp(-(model.scale * g + model.shift)))) < 1e-12


def test_a_repeated_id_teaches_once(spark):
    rows = [(i, f"calm text {i}", 0) for i in range(40)] + [(100, "vile scumbags", 1)] * 500 + [(101, "vile scum", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    once = df.dropDuplicates()
    a, b = train(df, df), train(once, once)
    assert a.names == b.names and np.allclose(a.weights, b.weights)
