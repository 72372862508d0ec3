"""Token counts without ids: pieces per distinct pre-token, joined to frequencies.

For each text the operator takes the frequency of every chunk (a pre-token, or
a few that no space parts), looks up how many pieces the chunk has, and sums
frequency times pieces.  How many pieces a chunk has is a pure function of its
characters, so a worker process works it out when it first meets the chunk and
keeps it for its later tasks; the join needs no shuffle, and texts never leave
the task that read them.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Recent, Tokenizer, default_path, kept


class PieceCounter:
    """Counts tokens of whole texts; ``self.pieces`` has one entry a distinct chunk."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer(path)
        self.pieces = Recent(self._of_chunk)

    def _of_chunk(self, chunk: str) -> int | None:
        """None for chunks whose tokens depend on what stands beside them."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        free = body and not body[0].isspace() and not body[-1].isspace()
        return len(self.tokenizer.ids(chunk)) if free or not chunk else None

    def __call__(self, text: str) -> int:
        t = self.tokenizer
        if t.fast is not None and "\0" not in text and not any(a in text for a in t.added):
            try:
                pieces = self.pieces
                return sum([n * pieces[c] for c, n in Counter(text.replace(" ", "\0 ").split("\0")).items()])
            except TypeError:
                pass
        return len(t.ids(text))


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit``).

    Null texts count as empty (0 bytes, 0 tokens); repeated and null ids stay
    rows of their own; other columns are not read, whatever their names.
    """
    path = tokenizer_path or default_path()

    def count(batches):
        counter = kept(PieceCounter, path)
        for batch in batches:
            n = [counter(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = texts.mapInArrow(count, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
