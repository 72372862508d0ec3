from functools import cache

import numpy as np
import pytest
from llm.token_counts import PieceCounter, token_counts
from llm.tokens import Recent, Tokenizer, _unsettled, default_path, kept, library_ids, load

ODD = [
    "", "a", " ", "  a", " a  b ", "a\n b", "x \ny", "a\n\n b\n", "don't 's 've", "<|endoftext|> x", "x<|endoftext|>", "\0 a b", "日本語 テスト", "x  y", "１２ 3٣",
    "tab\t x", " lead", "trail ", "a b c", "a   b", "é è́ ñ", "😀 😀😀", "word," * 50, "x" * 5000, "a\r\n b", "​ zero",
]


@cache
def library():
    return load(default_path())


@cache
def ours():
    return Tokenizer(default_path())


@cache
def counter():
    return PieceCounter(default_path())


@pytest.mark.parametrize("text", ODD)
def test_ids_and_counts_are_the_librarys(text):
    want = library_ids(library(), text)
    assert np.frombuffer(ours().packed(text), "<u4").tolist() == want
    assert counter()(text) == len(want)


def test_table_of_chunks_may_overflow():
    texts = [" ".join(f"w{i * j}" for i in range(40)) for j in range(20)] + ODD
    tokenizer, counter = load(default_path()), PieceCounter(default_path())
    counter.pieces = Recent(counter._of_chunk, 10)
    assert [counter(t) for t in texts] == [len(library_ids(tokenizer, t)) for t in texts]
    assert len(counter.pieces) <= 10 and len(counter.pieces.old) <= 10


def test_both_libraries_read_settled_characters_alike():
    ours, library = Tokenizer(default_path()), load(default_path())
    settled = [c for c in map(chr, (*range(0x250), *range(0x370, 0x530), *range(0x2000, 0x2100), *range(0x3000, 0x3100), *range(0x4E00, 0x9FFF, 7), *range(0xAC00, 0xD7A4, 7))) if not _unsettled(c)]
    assert len(settled) > 2500 and ours.fast is not None
    texts = ["".join(f"{c}a1 {c}{c} {c} a{c}'s\n{c}" for c in settled[i : i + 20]) for i in range(0, len(settled), 20)]
    for text in texts:
        assert ours.plain(text) and ours.ids(text) == library_ids(library, text)


def test_merges_out_of_order_go_to_the_library(tmp_path):
    import json

    with open(default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[5], merges[6] = merges[6], merges[5]
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert Tokenizer(path).fast is None and Tokenizer(path).ids("some words here") == library_ids(load(path), "some words here")


def test_one_tool_is_kept():
    class Thing:
        def __init__(self, source):
            self.source = source

    a, b = [1], [1]
    first = kept(Thing, a)
    assert kept(Thing, a) is first and kept(Thing, b) is not first and kept(Thing, "x") is kept(Thing, "".join(["x"]))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = load(default_path())
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    for r in docs.collect():
        n = len(library_ids(tokenizer, r.text))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 512)


def test_other_tokenizers(spark):
    import public_tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        tokenizer = load(path)
        want = sorted((r.doc_id, len(library_ids(tokenizer, r.text))) for r in docs.collect())
        assert sorted((r.doc_id, r.n_tokens) for r in token_counts(docs, path).collect()) == want


def test_odd_rows(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(ODD)] + [(None, None, 7, "x"), (3, "w " * 50_000, 7, "x"), (3, "w " * 50_000, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, id string")
    got = token_counts(df, limit=100).collect()
    assert len(got) == len(rows)
    for (doc, text, *_), r in zip(rows, got):
        assert (r.doc_id, r.n_bytes) == (doc, len((text or "").encode())) and r.over_limit == (r.n_tokens > 100)
    assert token_counts(df.limit(0)).count() == 0
