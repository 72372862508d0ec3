import numpy as np
from llm.language import UNKNOWN, Labeller, Network, identify, in_known_language, train
from llm.queries import op5_language_gru

SCHEMA = "text string, doc_id long, lang string, lang_pred int, score string"


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    net = Network.fresh(["a", "b", "c"], 5, 3)
    x, y = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, y)
    for w, g in zip(net.weights(), grads):
        for _ in range(5):
            i = tuple(rng.integers(0, s) for s in w.shape)
            if w.shape[0] == 256:
                i = (x[rng.integers(4), rng.integers(6)], i[1])
            old = w[i]
            w[i] = old + 1e-5
            up = net.gradients(x, y)[0]
            w[i] = old - 1e-5
            down = net.gradients(x, y)[0]
            w[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_words_may_be_long_and_repeat():
    labeller = Labeller(Network.fresh(["x", "y"], 4).as_type(np.float32))
    (a, p), (b, q), (c, r) = labeller(["Ab " * 3, "ab", "z" * 5000])
    assert a == b and abs(p - q) < 1e-6 and c in "xy" and 0 < r < 1
    assert labeller([None, "", "12 ..", "½"]) == [(UNKNOWN, 0.0)] * 4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = op5_language_gru(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [("the cat and the dog", 1, "en", 0, ""), ("le chat et la souris", 2, "fr", 0, ""), (None, 3, None, 0, ""), ("", 4, "en", 0, ""), ("12", None, "en", 0, ""), ("the " * 50_000, 1, None, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    net = train(df, steps=60)
    assert net.langs == ["en", "fr"]
    got = identify(df, net).collect()
    assert [r.lang_pred for r in got][:2] == ["en", "fr"] and [r.lang_pred for r in got][2:5] == ["und"] * 3 and len(got) == 6
    kept = in_known_language(df, net)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2]
    none = train(df.limit(0))
    assert none is None and {r.lang_pred for r in identify(df, none).collect()} == {"und"}
    assert sorted(r.doc_id for r in in_known_language(df, none).collect()) == [1, 1, 2]
    assert identify(df.limit(0), net).count() == 0
    one = train(df.where("doc_id = 1"), steps=5)
    assert identify(df, one).first().lang_pred == "en"


def test_document_probabilities_by_running_every_word():
    import re

    net = Network.fresh(["a", "b", "c"], 5, 2)
    labeller = Labeller(net)
    texts = ["The cat, the CAT and the dog's über-cat", "é " * 7 + "x" * 61, "1 2 three"]
    for text, (lang, score) in zip(texts, labeller(texts)):
        total, n = np.zeros(3), 0
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            whole = b" " + word.encode() + b" "
            for s in range(0, len(whole), 24):
                piece = whole[s : s + 24]
                p = net.positions(np.frombuffer(piece, np.uint8).reshape(1, -1))[0][:, 0]
                for byte, probabilities in zip(piece, p):
                    if byte != 32:
                        total, n = total + probabilities, n + 1
        assert lang == net.langs[total.argmax()] and abs(score - total.max() / n) < 1e-5


def test_every_language_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)} {chr(97 + i // 26)}x", f"l{i}") for i in range(300)]
    net = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=2)
    assert len(net.langs) == 300
