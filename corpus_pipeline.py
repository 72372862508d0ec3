"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept, written as Parquet
and read again, and all but the last return the columns of ``documents``:

1. language: documents without a letter go, and those whose letters speak for no
   language more than for the others.
2. toxicity: documents that the classifier holds to be toxic go.
3. near_duplicates: of each group of texts at a similarity of 0.8 or more on
   shingles of five words, the document with the smallest id stays.  Documents
   that share an id, or have none, are told apart by their texts.
4. mixing: sources are weighed by temperature; every document is taken at least
   once, and documents of small sources up to twice.
5. packing: everything is packed into sequences of 2048 tokens.

Null texts have no letter and go in the first stage.  Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import language, toxicity
from llm.common import stored, table
from llm.mixing import Mix, mixed
from llm.packing import pack
from llm.simhash import one_of_each, similar_groups


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.in_known_language(docs, language.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels), 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, similar_groups(docs, words=5, similarity=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, Mix(entropy=1.0, repeats=2.0, budget=None))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
