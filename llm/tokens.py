"""Public tokenizers in Python workers.

The library decides what a token is: ``tokenizers`` for .json files,
``sentencepiece`` for .model files.  For a byte-level BPE whose merges are
numbered in the order of their ids, the same merges are also run by
``tiktoken``, which is several times faster, on texts whose characters all lie
in ranges that both libraries' tables class alike; texts with other characters
or with an added token's string go to the library.

A text can also be cut in front of every space: a space only starts a
pre-token, so the tokens of a text are those of its chunks, unless white space
touches white space.  That is what counting by pre-token rests on.

Workers are reused, so what is expensive to set up is kept in the process.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

from .common import single_threaded

#: The pre-tokenizer of byte-level BPE (a fixed value of the format).
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A character outside of blocks that have long been settled: Latin, Greek, Cyrillic, kana, Han, Hangul, punctuation.
_unsettled = re.compile("[^\x00-ɏΑ-ωА-я‐-›ぁ-ゖァ-ヺ一-龥가-힣]").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    single_threaded()
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    raise ValueError(f"neither .json nor .model: {path}")


def library_ids(tokenizer, text: str) -> list[int]:
    if hasattr(tokenizer, "encode_batch"):
        return tokenizer.encode(text, add_special_tokens=False).ids
    return tokenizer.encode(text, num_threads=1)


def byte_of_character() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(merge) -> str:
    return "".join(merge if isinstance(merge, list) else merge.split(" ", 1))


class Tokenizer:
    """Ids of whole texts, as the library gives them."""

    def __init__(self, path: str):
        if not path.endswith((".json", ".model")):
            raise ValueError(f"neither .json nor .model: {path}")
        self.path, self._library = path, None
        self.added: list[str] = []
        self.fast: Callable[[str], list[int]] | None = None
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.added = [t["content"] for t in spec.get("added_tokens", [])]
            if _plain_byte_level(spec):
                self.fast = _merger(spec, set(self.added))

    @property
    def library(self):
        if self._library is None:
            self._library = load(self.path)
        return self._library

    def plain(self, text: str) -> bool:
        """Whether merges alone decide and both libraries read every character alike."""
        return self.fast is not None and (text.isascii() or not _unsettled(text)) and not any(a in text for a in self.added)

    def ids(self, text: str) -> list[int]:
        return self.fast(text) if self.plain(text) else library_ids(self.library, text)

    def packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian integers."""
        return np.array(self.ids(text), "<u4").tobytes()


def _plain_byte_level(spec: dict) -> bool:
    """Byte-level BPE in which a space can only start a pre-token and nothing else changes the text."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )


def _merger(spec: dict, added: set[str]):
    """The vocabulary's merges in ``tiktoken``, if a merge comes before another exactly when its id does."""
    vocabulary, back = spec["model"]["vocab"], byte_of_character()
    made = [vocabulary.get(_joined(m), -1) for m in spec["model"]["merges"]]
    pieces = {w: i for w, i in vocabulary.items() if w not in added}
    if made != sorted(set(made)) or -1 in made or len(made) + 256 != len(pieces) or not all(c in back for w in pieces for c in w):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    ranks = {bytes(back[c] for c in w): i for w, i in pieces.items()}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


_kept: dict = {}


def kept(make, source):
    """``make(source)``, once in this process; one tool is kept, and another one takes its place.

    ``source`` is compared by identity, or by value if it is a string.  It is
    held with the tool, so that its identity stays its own.
    """
    same = _kept.get("make") is make and (_kept["source"] is source or isinstance(source, str) and _kept["source"] == source)
    if not same:
        _kept.clear()
        _kept.update(make=make, source=source, tool=make(source))
    return _kept["tool"]


class Recent(dict):
    """Values by key, made when they are first asked for.

    At most two times ``size`` entries: when it is full the table becomes the
    old one, and what is asked for again moves over.  Memory is bounded, and no
    result depends on what is held.
    """

    def __init__(self, make, size: int = 200_000):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
