"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a word (a run of letters, in lower case)
with a space on either side, forwards and backwards, and labels every byte with
a distribution over languages; a document's probabilities are the mean over all
bytes of its words.  State starts anew at each word, so a word's labels are the
same wherever it stands: a worker process runs the network once for each
distinct word it holds and weights the result by the word's frequency in the
document.  Words of more than 24 bytes are read in stretches, in training too.  Training is
backpropagation through time in numpy, on the driver, over a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import stratified
from .tokens import kept
from .words import letter_words

#: Bytes the network reads at a stretch; longer words are read in stretches.
STRETCH = 24
#: Entries in a worker's table of words.
MEMO_WORDS = 500_000
UNKNOWN = "und"


def stretches(word: bytes) -> list[bytes]:
    """The word between spaces, cut where it is longer than the network reads at once."""
    whole = b" " + word + b" "
    return [whole[s : s + STRETCH] for s in range(0, len(whole), STRETCH)]


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Gru:
    """One direction.  ``table``: what each byte adds to update, reset and candidate, bias included."""

    table: np.ndarray
    recur: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, rng, hidden: int) -> Gru:
        scale = 1 / np.sqrt(hidden)
        return cls(rng.normal(0, 0.3, (256, 3 * hidden)), rng.uniform(-scale, scale, (hidden, 3 * hidden)), np.zeros(hidden))

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte, (steps, words, hidden), for words of one length."""
        n, steps = x.shape
        h = self.recur.shape[0]
        state, out = np.zeros((n, h), self.table.dtype), np.empty((steps, n, h), self.table.dtype)
        for t in range(steps):
            a, u = self.table[x[:, t]], state @ self.recur
            gates = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            update, reset, inner = gates[:, :h], gates[:, h:], u[:, 2 * h :] + self.bias
            new = np.tanh(a[:, 2 * h :] + reset * inner)
            if keep is not None:
                keep.append((state, update, reset, inner, new))
            state = new + update * (state - new)
            out[t] = state
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, recur and bias, given those of the states."""
        d_table, d_recur, d_bias = np.zeros_like(self.table), np.zeros_like(self.recur), np.zeros_like(self.bias)
        later = np.zeros_like(d_out[0])
        for t in range(x.shape[1] - 1, -1, -1):
            before, update, reset, inner, new = kept[t]
            d = d_out[t] + later
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (before - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            d_inner = d_new * reset
            d_u = np.concatenate([d_update, d_reset, d_inner], axis=1)
            np.add.at(d_table, x[:, t], np.concatenate([d_update, d_reset, d_new], axis=1))
            d_recur += before.T @ d_u
            d_bias += d_inner.sum(axis=0)
            later = d * update + d_u @ self.recur.T
        return [d_table, d_recur, d_bias]


@dataclass
class Network:
    langs: list[str]
    ahead: Gru
    back: Gru
    out_ahead: np.ndarray
    out_back: np.ndarray
    out_bias: np.ndarray
    moments: list = field(default_factory=list)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = 16, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        k = len(langs)
        return cls(langs, Gru.fresh(rng, hidden), Gru.fresh(rng, hidden), rng.normal(0, 0.2, (hidden, k)), rng.normal(0, 0.2, (hidden, k)), np.zeros(k))

    def weights(self) -> list[np.ndarray]:
        a, b = self.ahead, self.back
        return [a.table, a.recur, a.bias, b.table, b.recur, b.bias, self.out_ahead, self.out_back, self.out_bias]

    def as_type(self, dtype) -> Network:
        a, b, c, d, e, f, g, h, i = (w.astype(dtype) for w in self.weights())
        return Network(self.langs, Gru(a, b, c), Gru(d, e, f), g, h, i)

    def positions(self, x: np.ndarray, keep: tuple[list, list] | None = None):
        """Label distributions, (steps, words, languages), and the states they come from."""
        left = self.ahead.forward(x, keep and keep[0])
        right = self.back.forward(x[:, ::-1], keep and keep[1])[::-1]
        logits = left @ self.out_ahead + right @ self.out_back + self.out_bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, left, right

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        keep: tuple[list, list] = ([], [])
        p, left, right = self.positions(x, keep)
        rows = np.arange(len(y))
        count = x.size
        loss = -np.log(p[:, rows, y] + 1e-12).sum() / count
        d = p.copy()
        d[:, rows, y] -= 1
        d /= count
        k, h = d.shape[2], left.shape[2]
        flat = d.reshape(-1, k)
        head = [left.reshape(-1, h).T @ flat, right.reshape(-1, h).T @ flat, flat.sum(axis=0)]
        first = self.ahead.backward(x, keep[0], d @ self.out_ahead.T)
        second = self.back.backward(x[:, ::-1], keep[1], (d @ self.out_back.T)[::-1])
        return float(loss), first + second + head

    def fit(self, words: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = 900, size: int = 256, rate: float = 0.02, seed: int = 1) -> None:
        """Adam over batches of words of one length, drawn by weight; lengths are drawn by their share of weighted bytes."""
        rng = np.random.default_rng(seed)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        lengths = sorted(by_length)
        groups = {n: (np.frombuffer(b"".join(words[i] for i in by_length[n]), np.uint8).reshape(-1, n), labels[by_length[n]], np.cumsum(weights[by_length[n]])) for n in lengths}
        share = np.array([n * groups[n][2][-1] for n in lengths], float)
        share /= share.sum()
        first, second = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()]
        for step in range(1, steps + 1):
            x, y, upto = groups[lengths[rng.choice(len(lengths), p=share)]]
            at = np.minimum(np.searchsorted(upto, rng.random(size) * upto[-1], "right"), len(y) - 1)
            _, grads = self.gradients(x[at], y[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(self.weights(), grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum over its bytes, not the spaces around it, of the label distributions."""
        total = np.zeros((len(words), len(self.langs)))
        pieces = [(i, piece) for i, w in enumerate(words) for piece in stretches(w)]
        pieces.sort(key=lambda p: len(p[1]))
        at = 0
        while at < len(pieces):
            n = len(pieces[at][1])
            end = at
            while end < len(pieces) and end - at < 4096 and len(pieces[end][1]) == n:
                end += 1
            x = np.frombuffer(b"".join(p for _, p in pieces[at:end]), np.uint8).reshape(-1, n)
            letters = (x != 32).T[:, :, None]  # no word holds a space
            np.add.at(total, [i for i, _ in pieces[at:end]], (self.positions(x)[0] * letters).sum(axis=0))
            at = end
        return total


def train(labelled: DataFrame, per_language: int = 300, hidden: int = 12, steps: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Learns from about ``per_language`` rows of each language, chosen by hash.

    That bound on the sample keeps the driver's work the same at every size;
    every language of the rows is learned.  A kind of word is drawn by the
    square root of its count.  Rows without text or language teach nothing;
    without any such row there is no network.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    seen: dict[str, Counter] = {}
    for r in stratified(rows, "lang", per_language, "id").orderBy("id", "text", "lang").toLocalIterator():
        seen.setdefault(r.lang, Counter()).update(piece for w in letter_words(r.text) for piece in stretches(w.encode()))
    seen = {k: v for k, v in seen.items() if v}
    if not seen:
        return None
    langs = sorted(seen)
    words, labels, weights = [], [], []
    for k, lang in enumerate(langs):
        kinds = sorted(seen[lang])
        n = np.sqrt(np.array([seen[lang][w] for w in kinds], float))
        words += kinds
        labels += [k] * len(kinds)
        weights.append(n / n.sum())
    network = Network.fresh(langs, hidden)
    if len(langs) > 1:
        network.fit(words, np.array(labels), np.concatenate(weights), steps)
    return network.as_type(np.float32)


class Labeller:
    """Document probabilities; each distinct word goes through the network once while the table holds it."""

    def __init__(self, network: Network):
        self.network = network
        self._reset()

    def _reset(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.network.langs) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(self.at) + len(words) > MEMO_WORDS:
            self._reset()
        encoded = [w.encode() for w in words]
        while len(self.at) + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        span = slice(len(self.at), len(self.at) + len(words))
        self.rows[span, :-1] = self.network.sums(encoded)
        self.rows[span, -1] = [len(w) if any(map(str.isalpha, t)) else 0 for w, t in zip(encoded, words)]
        self.at.update((w, span.start + i) for i, w in enumerate(words))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [Counter(letter_words(t)) if t else Counter() for t in texts]
        found: list[tuple[str, float]] = []
        for at in range(0, len(counts), 512):
            part = counts[at : at + 512]
            if new := set().union(*part).difference(self.at):
                known = len(self.at)
                self._learn(sorted(new))
                if len(self.at) < known + len(new):  # the table was emptied: what this part needs anew
                    self._learn(sorted(set().union(*part).difference(self.at)))
            for c in part:
                if not c:
                    found.append((UNKNOWN, 0.0))
                    continue
                rows = self.rows[np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))]
                total = (np.fromiter(c.values(), np.float64, len(c))[:, None] * rows * (rows[:, -1:] > 0)).sum(axis=0)
                if total[-1] <= 0:
                    found.append((UNKNOWN, 0.0))
                    continue
                best = int(total[:-1].argmax())
                found.append((self.network.langs[best], float(min(1.0, max(0.0, total[best] / total[-1])))))
        return found


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (the language's share of the positions).

    ``und`` with score 0 where the text is null or has no letter, and everywhere
    if there is no network.  Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def label(batches):
        labeller = kept(Labeller, shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = labeller(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(label, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def in_known_language(docs: DataFrame, network: Network | None, surplus: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text has letters and speaks for a language.

    That is, one language holds ``surplus`` of the positions more than all
    would if they were spread evenly; the whole, if there is but one.  Without
    a network every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    least = 1 / len(network.langs) + surplus * (1 - 1 / len(network.langs)) if network else 0.0

    def choose(batches):
        labeller = kept(Labeller, shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            if labeller:
                stay = [lang != UNKNOWN and score >= least - 1e-6 for lang, score in labeller(texts)]
            else:
                stay = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
