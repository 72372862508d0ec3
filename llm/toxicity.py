"""Toxicity by non-negative positive-unlabelled learning.

Some documents are confirmed toxic; the rest of the training text is unlabelled
and holds toxic and clean documents alike.  A linear classifier in numpy
minimises the non-negative PU risk with the sigmoid loss l(z) = 1/(1+exp(z)):

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

with pi the share of toxic documents.  Where the second term turns negative the
step goes the other way, which keeps the classifier from fitting the sample's
noise.  Features are the distinct words of the whole text and their beginnings,
those that set the confirmed examples apart from unlabelled text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .sampling import stratified
from .tokens import kept
from .words import letter_words

#: Lengths of the beginnings of words that count as features.
BEGINNINGS = (4, 5, 6)
MEMO_WORDS = 500_000


def word_features(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return ["=" + word] + [word[:n] for n in BEGINNINGS if len(word) >= n]


def document_features(text: str | None) -> set[str]:
    return {f for w in set(letter_words(text)) for f in word_features(w)} if text else set()


def loss(z):
    return 0.5 - 0.5 * np.tanh(0.5 * z)


def nn_pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the corrected negative part before it is held at zero."""
    return prior * loss(gp).mean(), loss(-gu).mean() - prior * loss(-gp).mean()


@dataclass
class PuModel:
    names: dict[str, int]
    weights: np.ndarray
    bias: float
    #: Maps the classifier's value g to a probability: 1 / (1 + exp(-(scale * g + shift))).
    scale: float = 1.0
    shift: float = 0.0

    def value(self, features: set[str]) -> float:
        return float(self.bias + sum(self.weights[self.names[f]] for f in features if f in self.names))

    def probability(self, g):
        return 0.5 + 0.5 * np.tanh(0.5 * (self.scale * np.asarray(g) + self.shift))


def _entries(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return rows, np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)


def fit_nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: dict[str, int], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> PuModel:
    """Learns from documents given as the numbers of their features; ``prior`` is the class prior pi."""
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return PuModel({}, np.zeros(0), -1.0)
    (pr, pc), (ur, uc) = _entries(positive), _entries(unlabelled)
    w, b = np.zeros(len(names)), -1.0
    state = [np.zeros(len(names) + 1), np.zeros(len(names) + 1)]

    def values(rows, cols, n):
        return b + np.bincount(rows, w[cols], n)

    def slope(g):  # derivative of loss(z)
        s = loss(g)
        return -s * (1 - s)

    for step in range(1, steps + 1):
        gp, gu = values(pr, pc, n_p), values(ur, uc, n_u)
        _, negative = nn_pu_risk(gp, gu, prior)
        dp, du = np.zeros(n_p), np.zeros(n_u)
        if negative >= 0:
            dp += prior * slope(gp) / n_p
        sign = 1.0 if negative >= 0 else -1.0
        dp += sign * prior * slope(-gp) / n_p
        du -= sign * slope(-gu) / n_u
        grad = np.append(np.bincount(pc, dp[pr], len(names)) + np.bincount(uc, du[ur], len(names)) + decay * w, dp.sum() + du.sum())
        state[0] += 0.1 * (grad - state[0])
        state[1] += 0.01 * (grad * grad - state[1])
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        b -= float(move[-1])
    return PuModel(names, w, b)


def calibrate(model: PuModel, values: np.ndarray, labels: np.ndarray, steps: int = 50) -> PuModel:
    """Fit scale and shift by Newton's method on labelled training rows, with smoothed targets."""
    if not 0 < labels.sum() < len(labels):
        return model
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([values, np.ones_like(values)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 0.5 + 0.5 * np.tanh(0.5 * (x @ theta))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * len(labels) * np.eye(2)
        theta -= np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-6 * len(labels) * (theta - [1.0, 0.0])), -1, 1)
    model.scale, model.shift = max(1e-3, float(theta[0])), float(theta[1])
    return model


def feature_counts(sample: DataFrame) -> DataFrame:
    """``feature, in_p, in_u``: numbers of confirmed and of unlabelled documents of the sample that have it."""

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            names = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][f] for f in names], pa.int64()), pa.array([seen[1][f] for f in names], pa.int64())], ["feature", "in_p", "in_u"])
            seen[0].clear()
            seen[1].clear()
            return batch

        for batch in batches:
            for text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != "0":
                    seen[part == "u"].update(document_features(text))
                if len(seen[0]) + len(seen[1]) > MEMO_WORDS:
                    yield rows()
        yield rows()

    counted = sample.select("text", "part").mapInArrow(count, "feature string, in_p bigint, in_u bigint")
    return counted.groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))


def train(
    docs: DataFrame, labels: DataFrame, positives: int = 2000, others: int = 6000, least_z: float = 4.0, most_features: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> PuModel:
    """Learns from the texts of ``docs`` and the ``labels`` (id, 0 or 1) of some of them.

    About ``positives`` ids of each label and ``others`` of all are drawn by
    hash, which bounds the sample; the clean labels serve the calibration only.
    Ids are drawn first and their texts are read where they lie.  Features are
    counted there too; those that set the confirmed examples apart by
    ``least_z`` deviations, and the sample as feature numbers, reach the driver
    (``most_features`` bounds them further, where it is given).  The prior is
    the label's share among all labels, which stand for the unlabelled mass.
    An id teaches once, by its least text; labelled both ways it is toxic.
    Null texts count as empty; null labels are no labels.  Without a confirmed
    example every text scores alike and low.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").cast("string").alias("part")).where("part in ('0', '1')").groupBy("id").agg(F.max("part").alias("part"))
    counts = {r.part: r["count"] for r in told.groupBy("part").count().collect()}
    prior = min(0.9, max(1e-4, counts.get("1", 0) / max(1, sum(counts.values()))))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = F.broadcast(stratified(told, "part", positives, "id"))  # about 2 * positives ids, each once
    rest = stratified(texts.withColumn("part", F.lit("u")), "part", others, "id")
    both = texts.join(drawn, "id").select("id", "text", "part").union(rest)
    sample = stored(both.groupBy("id", "part").agg(F.min("text").alias("text")).select("id", "text", "part"), "toxic-sample")
    sizes = {r.part: r["count"] for r in sample.groupBy("part").count().collect()}
    n_p, n_u = sizes.get("1", 0), sizes.get("u", 0)
    if not n_p or not n_u:
        return PuModel({}, np.zeros(0), -1.0)
    pooled = (F.col("in_p") + F.col("in_u") + 1) / F.lit(float(n_p + n_u + 2))
    z = (F.col("in_p") / F.lit(float(n_p)) - F.col("in_u") / F.lit(float(n_u))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n_p + 1 / n_u))
    chosen = feature_counts(sample).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature")
    names = {r.feature: i for i, r in enumerate((chosen.limit(most_features) if most_features else chosen).collect())}
    shared = sample.sparkSession.sparkContext.broadcast(names)

    def number(batches):
        for batch in batches:
            found = [sorted(i for f in document_features(t) if (i := shared.value.get(f)) is not None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["id", "part", "found"])

    kind = sample.schema["id"].dataType.simpleString()
    docs: dict[str, list] = {"0": [], "1": [], "u": []}
    for r in sample.mapInArrow(number, f"id {kind}, part string, found array<int>").orderBy("part", "id", "found").toLocalIterator():
        docs[r.part].append(np.array(r.found, np.int64))
    model = fit_nn_pu(docs["1"], docs["u"], names, prior)
    told = docs["1"] + docs["0"]
    return calibrate(model, np.array([model.bias + model.weights[d].sum() for d in told]), np.array([1] * len(docs["1"]) + [0] * len(docs["0"])))


class Scorer:
    """Probabilities of whole texts; each distinct word is looked up once while the table holds it."""

    def __init__(self, model: PuModel):
        self.model = model
        self.memo: dict[str, tuple] = {}

    def __call__(self, text: str | None) -> float:
        names, memo, found = self.model.names, self.memo, set()
        for word in set(letter_words(text)) if text else ():
            hit = memo.get(word)
            if hit is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                hit = memo[word] = tuple(names[f] for f in word_features(word) if f in names)
            if hit:
                found.update(hit)
        g = self.model.bias + sum(self.model.weights[i] for i in sorted(found))
        return float(self.model.probability(g))


def score(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``score``; empty and null texts score as texts without any feature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        scorer = kept(Scorer, shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(rate, f"id {kind}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: PuModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches):
        scorer = kept(Scorer, shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < threshold for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
