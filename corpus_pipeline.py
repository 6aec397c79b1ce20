"""Corpus pipeline over `documents`: toxic documents go, one document of each group of near-duplicates stays, repeated passages go,
personal data is replaced, and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of `documents`, with `n_chars` as the text now is. Null texts, empty texts, null ids, repeated rows,
empty tables and further columns are treated as each operator states; near-duplicate removal keeps one of several equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.llm import near_copies, packing, privacy, spans, toxicity
from thermaline.llm.common import staged


def _rewritten(out: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the input with the new text and its length; `out` holds the input row in `kept`."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new.get(c, F.col("kept")[c]).alias(c) for c in columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5; it learns from the labelled ones that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored(docs, labels).where(F.col("score") < 0.5).select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five-word shingles, similarity 0.8, candidates by SimHash)."""
    return near_copies.representatives(docs)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentence spans that occur earlier; a document of which nothing is left goes."""
    out = spans.remove_repeats(docs, keep=tuple(docs.columns))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike("\\S"), F.lit(False))
    return _rewritten(out.where(~emptied), docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    return _rewritten(privacy.replace(docs, keep=tuple(docs.columns)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in training sequences."""
    return packing.op4(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_spans),
    ("pii", replace_private),
    ("packing", pack),
]

#: The learned classifier, fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
