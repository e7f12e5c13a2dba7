"""The corpus pipeline: from `documents` to token ids, one operator a stage.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import bpe_encode
from quillon.llm.decontaminate import drop_contaminated
from quillon.llm.ngram_join import drop_near_duplicates
from quillon.llm.suffix_dedup import cut_repeated_passages
from quillon.llm.toxicity import drop_toxic, learn
from quillon.session import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; its lexicon is learned from `labels`.

    Null, empty and wordless texts stay, as do rows without an id; repeated rows
    stay or go together. Without labels the written lexicon decides alone.
    """
    return drop_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    Null, empty and wordless texts resemble nothing and stay, as do rows without
    an id. Rows that repeat an id and a text are one document and stay or go
    together. Ties don't occur: every link counts, and ids decide who stays.
    """
    return drop_near_duplicates(docs, n=3, threshold=0.5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only in the document with the least id that has them.

    Null, empty and short texts, and rows without an id, stay as they are. A
    document of which nothing is left goes.
    """
    return cut_repeated_passages(docs, min_words=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts, and rows without an id, stay; rows that repeat an id
    go together. An empty benchmark leaves all.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids (doc_id, tokens, n_tokens, exact); null and empty texts have none, repeated rows are encoded each for itself."""
    return bpe_encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", decontamination),
    ("bpe", encoding),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each on what the one before kept.

    Nulls, empty and very long texts, ties and repeated rows have the results
    that the stages state. Columns that documents has besides its own five go
    through all stages but the last, whatever their names. Empty tables give an
    empty result.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
