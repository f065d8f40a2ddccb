"""A corpus in five stages; each takes and returns documents, the last returns pieces of packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from lodestone.llm.queries import WORD_BPE, tokenizer_path
from lodestone.llm.runtime import numbered, save, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; the model is learned from all labels.

    A null or empty text is scored like any other, as is each of several rows of an id; without labels all stay. An empty table
    gives an empty one, and extra columns go through whatever their names.
    """
    plain, name = numbered(docs)
    scored = toxicity.score_toxicity(plain, table(spark, sf_dir, "labels"), doc_id=name("doc_id"), text=name("text"), carry=tuple(plain.columns), label_id="doc_id")
    return scored.where(F.col("score") < toxicity.THRESHOLD).drop("score").toDF(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that read like one of the languages that ``lang`` names.

    Null, empty and letterless texts go. Each of several rows of an id is judged by its own text, ties go to the first language in
    order. Where no row names a language nothing can be judged, and all stay. An empty table gives an empty one, and extra columns
    go through whatever their names.
    """
    plain, name = numbered(docs)
    if not plain.where(F.col(name("lang")).isNotNull()).limit(1).count():
        return docs
    found = language_id.identify_language(plain, doc_id=name("doc_id"), text=name("text"), lang=name("lang"), carry=tuple(plain.columns))
    return found.where("known").select(*plain.columns).toDF(*docs.columns)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id; nulls and rows that repeat are as ``drop_exact_duplicates`` has them."""
    return exact_dedup.drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a Jaccard similarity of 0.8 or more, that of the smallest
    id; nulls and rows that repeat are as ``drop_near_duplicates`` has them."""
    return ngram_join.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens; nulls and rows that repeat are as ``pack_documents`` has them."""
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("language_id", keep_known_languages),
    ("exact_dedup", remove_copies),
    ("ngram_join", remove_near_copies),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
