"""Class-based n-gram scores: exchange clustering, class transitions, word emissions.

Every word of the training texts gets a class.  The words that are frequent in
the corpus are clustered on the driver by the exchange algorithm on their
bigram counts; every other word is then put, by one exchange step against those
classes, where its own neighbours say.  A text's probability is the product of
class transitions and word emissions,

    P(w | v) = (1 - u(v)) * T(class(w) | class(v)) * N(w) / N(class(w)),

and u(v) for a word that training never saw, by Good-Turing from the words seen
once.  T is smoothed towards the classes' own frequencies.  For each context
the probabilities of all known words and of the unknown word sum to one.

Texts are coded once into blocks: word codes and the block's own dictionary.
Dictionaries, not tokens, meet in the one shuffle by word, which brings a word
its count over all documents and its class; a word has at most one row a block
there, of bounded size, however frequent it is.  Counts and gains are whole
numbers, so that sums, and with them the model, do not depend on how the input
is split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, stored

#: Tokens of a block, after which it ends with the document.
BLOCK_TOKENS = 2_000_000
#: Occurrences of a word in a block whose neighbours travel as they are; of more, the sums of their gains travel.
NEAR = 64
#: Gains are whole multiples of this part of one.
UNIT = 2**20
#: Words that are broadcast to be counted; more of them are met by a shuffle.
MOST_BROADCAST = 200_000
#: Classes are bytes, and three of them are the end, the other words and the unseen.
MOST_CLASSES = 253
#: The token that ends a text; no word holds white space.
END = b"\n"


class _Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z, words between ASCII white space, then the end."""
    return (text or "").encode("utf-8").lower().split() + [END]


def coded_blocks(docs: DataFrame, held: Column, id_col: str, text_col: str, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``block, ids, held, ends, codes, words, train``; a row holds whole documents, and ends when it has so many tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def code(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        table, ids, out, ends, codes = _Codes(), [], [], [], []
        total, id_type = 0, None

        def block():
            nonlocal table, ids, out, ends, codes, total, serial
            all_codes = np.concatenate(codes)
            learn = np.repeat(~np.array(out, bool), np.diff(ends, prepend=0))
            train = np.bincount(all_codes[learn], minlength=len(table))
            names = ["block", "ids", "held", "ends", "codes", "words", "train"]
            arrays = [
                pa.array([part * 2**32 + serial], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([out], pa.list_(pa.bool_())),
                pa.array([ends], pa.list_(pa.int64())),
                pa.array([all_codes.tobytes()], pa.binary()),
                pa.array([list(table)], pa.list_(pa.binary())),
                pa.ListArray.from_arrays(pa.array([0, len(train)], pa.int32()), pa.array(train, pa.int64())),
            ]
            table, ids, out, ends, codes, total, serial = _Codes(), [], [], [], [], 0, serial + 1
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text, apart in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                codes.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
                total += len(words)
                ids.append(doc)
                out.append(bool(apart))
                ends.append(total)
                if total >= tokens:
                    yield block()
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    return rows.mapInArrow(code, f"block bigint, ids array<{kind}>, held array<boolean>, ends array<bigint>, codes binary, words array<binary>, train array<bigint>")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each word, by moving one word at a time to where the bigram likelihood is greatest.

    ``pairs[i, j]`` counts word i before word j; the last two rows and columns
    are the end and all other words, whose classes stay their own.  Words start
    in classes by their rank in frequency.  Stops when a sweep moves nothing.
    """
    n = len(pairs) - 2
    total = classes + 2
    cls = np.append(np.arange(n) % classes, [classes, classes + 1])
    order = np.argsort(-pairs[:n].sum(axis=1), kind="stable")
    cls[order] = np.arange(n) % classes
    member = np.zeros((n + 2, total))
    member[np.arange(n + 2), cls] = 1
    after, before = pairs @ member, pairs.T @ member  # of each word: following and preceding classes
    joint = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            old = cls[w]
            itself = pairs[w, w]
            s, p = after[w].copy(), before[w].copy()
            s[old] -= itself
            p[old] -= itself
            joint[old] -= s
            joint[:, old] -= p
            joint[old, old] -= itself
            base = _xlogx(joint)
            rows = _xlogx(joint + s[None, :]) - base
            cols = _xlogx(joint + p[:, None]) - base
            diag = np.diag(joint)
            gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + _xlogx(diag + s + p + itself) - _xlogx(diag)
            left, right = joint.sum(axis=1), joint.sum(axis=0)
            gain -= _xlogx(left + s.sum() + itself) - _xlogx(left) + _xlogx(right + p.sum() + itself) - _xlogx(right)
            # While w is out, the links to its own class are counted with it.
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            joint[new] += s
            joint[:, new] += p
            joint[new, new] += itself
            if new != old:
                moved += 1
                cls[w] = new
                after[:, old] -= pairs[:, w]
                after[:, new] += pairs[:, w]
                before[:, old] -= pairs[w]
                before[:, new] += pairs[w]
        if not moved:
            break
    return cls[:n]


def likelihood(pairs: np.ndarray, cls: np.ndarray, classes: int) -> float:
    """What exchange maximises, for tests."""
    full = np.append(cls, [classes, classes + 1])
    member = np.zeros((len(pairs), classes + 2))
    member[np.arange(len(pairs)), full] = 1
    joint = member.T @ pairs @ member
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=0)).sum() - _xlogx(joint.sum(axis=1)).sum())


@dataclass
class Frequent:
    """The frequent words, their classes, and what one exchange step gains per neighbour."""

    words: list[bytes]
    cls: np.ndarray
    classes: int
    #: gain[a, b, c]: of a word between classes a and b, for class c, in units.
    gain: np.ndarray


def frequent_words(blocks: DataFrame, most: int) -> list[bytes]:
    """The ``most`` words with the greatest training counts over all blocks, ties to the smaller word; the end is none.

    In three steps, so that rare words don't travel.  The greatest counts of
    each block, added up, give a count that ``most`` words reach.  A word that
    reaches it too has, in one block at least, its share of a block.  Words
    that do are counted over all blocks.
    """

    def some(pick):
        def rows(batches):
            for batch in batches:
                for words, train in zip(batch.column(0), batch.column(1)):
                    n = train.values.to_numpy()
                    at = pick(n)
                    yield pa.RecordBatch.from_arrays([words.values.take(pa.array(at)), pa.array(n[at])], ["word", "n"])

        return blocks.select("words", "train").mapInArrow(rows, "word binary, n bigint").where((F.col("n") > 0) & (F.col("word") != F.lit(END)))

    def top(rows):
        return rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()

    first = top(some(lambda n: np.argpartition(-n, most)[: most + 1] if len(n) > most + 1 else np.arange(len(n))))
    if not first:
        return []
    reached = first[-1].n if len(first) == most else 0
    share = max(1, -(-reached // blocks.count()))
    wanted = stored(some(lambda n: np.flatnonzero(n >= share)).select("word").distinct(), "wanted")
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    each = blocks.select(F.explode(F.arrays_zip("words", "train")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.train").alias("n")).where("n > 0")
    return [bytes(r.word) for r in top(each.join(wanted, "word", "left_semi"))]


def _rows(batch: pa.RecordBatch):
    """Of each block: held, ends, codes as arrays, and the row's other columns by name."""
    at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(len(batch)):
        held = at["held"][i].values.to_numpy(zero_copy_only=False).astype(bool)
        ends = at["ends"][i].values.to_numpy()
        codes = np.frombuffer(at["codes"][i].as_buffer(), np.int32)
        yield held, ends, codes, {name: column[i] for name, column in at.items()}


def _neighbours(kind_of_code: np.ndarray, codes: np.ndarray, ends: np.ndarray, end_kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of each token, of the one before (the end, for a first token) and of the one after."""
    now = kind_of_code[codes]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    first = np.concatenate([[0], ends[:-1]])
    before[first] = end_kind
    after = np.empty_like(now)
    after[:-1] = now[1:]
    after[ends - 1] = end_kind
    return now, before, after


def _kinds(words: pa.Array, known: list[bytes], kind: np.ndarray, end: int, other: int) -> np.ndarray:
    """``kind`` of each word that is known, ``end`` of the end, ``other`` of all others."""
    found = pc.fill_null(pc.index_in(words, value_set=pa.array([*known, END], pa.binary())), -1).to_numpy()
    return np.append(kind, [end, other]).astype(np.int32)[found]


def cluster(blocks: DataFrame, classes: int, most: int, sweeps: int) -> Frequent:
    """Exchange clustering of the frequent words; at most (most + 2)**2 pairs reach the driver."""
    spark = blocks.sparkSession
    words = frequent_words(blocks, most)
    n = len(words)
    shared = spark.sparkContext.broadcast(words)

    def count(batches):
        known, own = shared.value, np.arange(n)
        for batch in batches:
            for held, ends, codes, row in _rows(batch):
                now, before, _ = _neighbours(_kinds(row["words"].values, known, own, n, n + 1), codes, ends, n)
                learn = np.repeat(~held, np.diff(ends, prepend=0))
                pair, times = np.unique(before[learn].astype(np.int64) * (n + 2) + now[learn], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int64())], ["pair", "n"])

    rows = blocks.select("held", "ends", "codes", "words").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.zeros((n + 2, n + 2))
    for batch in rows.toArrow().to_batches():
        at = batch.column(0).to_numpy()
        pairs[at // (n + 2), at % (n + 2)] = batch.column(1).to_numpy()
    cls = exchange(pairs, classes, sweeps) if n else np.zeros(0, np.int64)
    member = np.zeros((n + 2, classes + 2))
    member[np.arange(n + 2), np.append(cls, [classes, classes + 1])] = 1
    joint = member.T @ pairs @ member + 0.1
    log = np.log(joint)
    left, right = np.log(joint.sum(axis=1)), np.log(joint.sum(axis=0))
    # First order of the exchange gain, exact as the word's counts become small beside the classes'.
    gain = log[:, None, :classes] + log.T[None, :, :classes] - left[:classes] - right[:classes]
    return Frequent(words, cls, classes, np.rint(gain * UNIT).astype(np.int64))


def _summed(gain: np.ndarray, sides: np.ndarray, owner: np.ndarray, into: np.ndarray) -> None:
    """Add to ``into[owner]`` the gains of the class pairs ``sides``; owners ascend."""
    for s in range(0, len(sides), 100_000):
        part, who = sides[s : s + 100_000], owner[s : s + 100_000]
        cut = np.flatnonzero(np.diff(who, prepend=-1))
        into[who[cut]] += np.add.reduceat(gain[part[:, 0], part[:, 1]], cut, axis=0)


def word_rows(blocks: DataFrame, frequent) -> DataFrame:
    """``word, block, code, n, near, gains``: a row for each word of a block.

    ``near`` has two bytes an occurrence, the classes on either side, for words
    whose class is sought and that occur at most NEAR times in the block; where
    they occur more often, ``gains`` has their sums by class.
    """

    def rows(batches):
        f = frequent.value
        for batch in batches:
            for held, ends, codes, row in _rows(batch):
                words = row["words"].values
                kinds = _kinds(words, f.words, f.cls, f.classes, f.classes + 1)
                now, before, after = _neighbours(kinds, codes, ends, f.classes)
                at = np.flatnonzero(np.repeat(~held, np.diff(ends, prepend=0)) & (now == f.classes + 1))
                at = at[np.argsort(codes[at], kind="stable")]
                both = np.stack([before[at], after[at]], axis=1).astype(np.uint8)
                times = np.bincount(codes[at], minlength=len(words))
                often = np.flatnonzero(times > NEAR)
                gains = pa.nulls(len(words), pa.binary())
                if len(often):
                    sums, much = np.zeros((len(words), f.classes), np.int64), (times > NEAR)[codes[at]]
                    _summed(f.gain, both[much], codes[at][much], sums)
                    mask = pa.array(times > NEAR)
                    gains = pc.replace_with_mask(gains, mask, pa.array([sums[i].tobytes() for i in often.tolist()], pa.binary()))
                    both, times = both[~much], np.where(times > NEAR, 0, times)
                offsets = np.concatenate([[0], 2 * np.cumsum(times)]).astype(np.int32)
                near = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(both.tobytes())])
                block, code = pa.array(np.full(len(words), row["block"].as_py())), pa.array(np.arange(len(words), dtype=np.int32))
                whole = pa.RecordBatch.from_arrays([words, block, code, row["train"].values, near, gains], ["word", "block", "code", "n", "near", "gains"])
                for s in range(0, len(words), 20_000):
                    yield whole.slice(s, 20_000)

    return blocks.mapInArrow(rows, "word binary, block bigint, code int, n bigint, near binary, gains binary")


FACTS = np.dtype([("code", "<i4"), ("n", "<i8"), ("cls", "u1")])
#: Facts that a task holds before it hands them on.
HELD_FACTS = 2_000_000


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all bytes of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.diff(offsets), np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)


def word_facts(rows: DataFrame, frequent) -> DataFrame:
    """``block, facts, fresh``: packed (code, count, class) of a block's words; ``fresh`` words counted here.

    Rows come sorted by word, and are taken up a few at a time: of a word that
    spans them, its sums so far are held and where it occurs.  Words without a
    training occurrence get the class after all others.
    """

    def gather(batches):
        f = frequent.value
        own_classes = dict(zip(f.words, f.cls.tolist())) | {END: f.classes}
        done: list[tuple] = []
        held = fresh = 0

        def settle(names, n, gains, block, code, group):
            nonlocal fresh, held
            own = np.fromiter((own_classes.get(w, -1) for w in names), np.int64, len(names))
            cls = np.where(own >= 0, own, np.where(n == 0, f.classes + 1, gains.argmax(axis=1)))
            fresh += int((n > 0).sum())
            out = np.zeros(len(block), FACTS)
            out["code"], out["n"], out["cls"] = code, n[group], cls[group]
            done.append((block, out))
            held += len(block)

        def handed():
            nonlocal fresh, held
            block, facts = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(block, kind="stable")
            names, cuts = np.unique(block[order], return_index=True)
            packed = [part.tobytes() for part in np.split(facts[order], cuts[1:])]
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary()), pa.array([fresh] + [0] * (len(names) - 1), pa.int64())], ["block", "facts", "fresh"])
            done.clear()
            fresh = held = 0
            return batch

        open_word = None  # name, n, gains, blocks, codes
        for batch in filter(len, _chunks(batches, 50_000)):
            words, block, code = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            new = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            names = words.take(pa.array(starts)).to_pylist()
            n, gains = np.add.reduceat(batch.column(3).to_numpy(), starts), np.zeros((len(starts), f.classes), np.int64)
            sizes, sides = _bytes_of(batch.column(4))
            _summed(f.gain, sides.reshape(-1, 2), np.repeat(group, sizes // 2), gains)
            sizes, sums = _bytes_of(batch.column(5))
            np.add.at(gains, group[sizes > 0], sums.view(np.int64).reshape(-1, f.classes))
            blocks_before, codes_before = [], []
            if open_word and open_word[0] == names[0]:
                n[0] += open_word[1]
                gains[0] += open_word[2]
                blocks_before, codes_before = open_word[3], open_word[4]
            elif open_word:
                name, count, gain, at, which = open_word
                at, which = np.concatenate(at), np.concatenate(which)
                settle([name], np.array([count]), gain[None], at, which, np.zeros(len(at), np.int64))
            last = starts[-1]
            if len(starts) > 1:
                before = sum(map(len, blocks_before))
                settle(names[:-1], n[:-1], gains[:-1], np.concatenate([*blocks_before, block[:last]]), np.concatenate([*codes_before, code[:last]]), np.concatenate([np.zeros(before, np.int64), group[:last]]))
                blocks_before, codes_before = [], []
            open_word = (names[-1], n[-1], gains[-1], [*blocks_before, block[last:].copy()], [*codes_before, code[last:].copy()])
            if held >= HELD_FACTS:
                yield handed()
        if open_word:
            name, count, gain, at, which = open_word
            at, which = np.concatenate(at), np.concatenate(which)
            settle([name], np.array([count]), gain[None], at, which, np.zeros(len(at), np.int64))
        if done:
            yield handed()

    return rows.mapInArrow(gather, "block bigint, facts binary, fresh bigint")


def _chunks(batches, rows: int):
    """Batches put together until they have so many rows."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def classed_blocks(blocks: DataFrame, facts: DataFrame, classes: int) -> DataFrame:
    """``ids, held, ends, cls, once, known, base, emit``: class of each token and whether its word was
    seen at most once, and per document the known tokens and sums of log10(count + 1) and log10(count)."""
    kind = blocks.schema["ids"].dataType.simpleString()
    by_block = facts.groupBy("block").agg(F.collect_list("facts").alias("facts"))

    def join(batches):
        for batch in batches:
            for i, (_, ends, codes, row) in enumerate(_rows(batch)):
                told = np.concatenate([np.frombuffer(x, FACTS) for x in row["facts"].as_py()])
                n, cls = np.zeros(len(told), np.int64), np.zeros(len(told), np.uint8)
                n[told["code"]], cls[told["code"]] = told["n"], told["cls"]
                starts = np.concatenate([[0], ends[:-1]])
                count = n[codes]
                per_doc = lambda x: np.add.reduceat(x, starts).tolist()
                whole = [batch.column(name).slice(i, 1) for name in ("ids", "held", "ends")]
                arrays = [[cls[codes].tobytes()], [np.packbits(count <= 1).tobytes()], [per_doc((count > 0).astype(np.int64))], [per_doc(np.log10(count + 1.0))], [per_doc(np.log10(np.maximum(count, 1)))]]
                kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([*whole, *(pa.array(a, k) for a, k in zip(arrays, kinds))], ["ids", "held", "ends", "cls", "once", "known", "base", "emit"])

    rows = blocks.select("block", "ids", "held", "ends", "codes").join(by_block, "block").drop("block")
    return rows.mapInArrow(join, f"ids {kind}, held array<boolean>, ends array<bigint>, cls binary, once binary, known array<bigint>, base array<double>, emit array<double>")


def _contexts(row, unseen: int) -> tuple:
    """Class of each token and the context it stands in: the class before it, words seen at most once being one."""
    ends = np.array(row["ends"], np.int64)
    cls = np.frombuffer(row["cls"], np.uint8).astype(np.int64)
    once = np.unpackbits(np.frombuffer(row["once"], np.uint8), count=len(cls)).astype(bool)
    as_context = np.where(once & (cls != unseen - 1), unseen, cls)
    context = np.empty_like(cls)
    context[1:] = as_context[:-1]
    context[np.concatenate([[0], ends[:-1]])] = unseen - 1  # the end of another text
    return ends, cls, once, context


@dataclass
class Model:
    """log10 of transition times emission's denominator, [context, class]; the last class is the unseen word's."""

    step: np.ndarray
    tokens: int
    types: int


def fit_model(follows: np.ndarray, follows_once: np.ndarray, tokens: int, types: int, smooth: float = 5.0) -> Model:
    """``follows[context, class]`` and, of these, words seen once; contexts and classes end with the unseen."""
    known = follows[:, :-1]
    size = known.sum(axis=0)
    own = (size + 1e-9) / max(1e-9, (size + 1e-9).sum())
    n = known.sum(axis=1, keepdims=True)
    transition = (known + smooth * own) / (n + smooth)
    unseen = (follows_once.sum(axis=1) + 0.5) / (n[:, 0] + 1.0)
    with np.errstate(divide="ignore"):
        step = np.log10((1 - unseen)[:, None] * transition) - np.log10(np.maximum(size, 1e-9))
    return Model(np.column_stack([step, np.log10(unseen)]), tokens, types)


def score_texts(
    docs: DataFrame, held: Column, classes: int = 32, frequent: int = 1500, sweeps: int = 12, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows for which ``held`` is not true are learned from.  ``base_score`` is
    the add-one unigram's log10 probability, ``score`` the class model's.  Null
    and empty texts are one end.  Repeated rows count as often as they occur;
    other columns are not read.  With nothing to learn from, every word is
    unseen; no rows give no rows.
    """
    if not 1 <= classes <= MOST_CLASSES:
        raise ValueError(f"classes: 1 to {MOST_CLASSES}")
    spark = docs.sparkSession
    blocks = stored(coded_blocks(docs, F.coalesce(held, F.lit(False)), id_col, text_col, block_tokens), "blocks")
    clustered = cluster(blocks, classes, frequent, sweeps)
    shared = spark.sparkContext.broadcast(clustered)
    width = shuffle_width(spark)
    rows = word_rows(blocks.select("block", "held", "ends", "codes", "words", "train"), shared)
    facts = stored(word_facts(rows.repartition(width, "word").sortWithinPartitions("word"), shared), "facts")
    types = facts.agg(F.sum("fresh")).first()[0] or 0
    classed = stored(classed_blocks(blocks, facts, classes), "classed")
    k = classes + 2

    def transitions(batches):
        follows, singles = np.zeros((k, k), np.int64), np.zeros((k, k), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ends, cls, once, context = _contexts(row, classes + 1)
                learn = np.repeat(~np.array(row["held"], bool), np.diff(ends, prepend=0))
                cell = context * k + cls
                follows += np.bincount(cell[learn], minlength=k * k).reshape(k, k)
                singles += np.bincount(cell[learn & once], minlength=k * k).reshape(k, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(follows.ravel()), pa.array(singles.ravel())], ["cell", "n", "once"])

    sums = classed.select("held", "ends", "cls", "once").mapInArrow(transitions, "cell bigint, n bigint, once bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()
    follows, singles = np.zeros(k * k), np.zeros(k * k)
    for r in sums:
        follows[r.cell], singles[r.cell] = r.n, r.once
    tokens = int(follows.sum())
    model = spark.sparkContext.broadcast(fit_model(follows.reshape(k, k), singles.reshape(k, k), tokens, types))

    def score(batches):
        m = model.value
        for batch in batches:
            for row in batch.to_pylist():
                ends, cls, _, context = _contexts(row, classes + 1)
                starts = np.concatenate([[0], ends[:-1]])
                n = ends - starts
                steps = np.add.reduceat(m.step[context, cls], starts)
                base = np.array(row["base"]) - n * np.log10(m.tokens + m.types + 1)
                arrays = [row["ids"], row["held"], n, row["known"], np.full(len(n), m.tokens), base, steps + np.array(row["emit"])]
                kinds = [batch.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds)], names)

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    scored = classed.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
