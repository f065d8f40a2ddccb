"""Extension points: external proposals are data, acceptance is a deterministic gate.

Each hook takes DataFrames and returns one; the defaults propose nothing, so every pipeline runs without models or network.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import citation_flow, edits, retrieval


class Proposer(Protocol):
    """From rows (key, text) to proposals (key, proposal, confidence)."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def nothing(rows: DataFrame) -> DataFrame:
    """The default hook: no proposal."""
    return rows.select(rows.columns[0], F.lit(None).cast("string").alias("proposal"), F.lit(0.0).alias("confidence")).where(F.lit(False))


def accept_edits(rows: DataFrame, proposals: DataFrame, key: str, text: str, locale: str = "en-US", least: float = 0.5) -> DataFrame:
    """Each text with its edit where a proposal passes all gates; ``reason`` names the gate that rejected one, or ``low-confidence``.

    Rows may have ``kind``, ``evidence_ids``, ``ingredients`` and ``fixed`` (see ``edits.rejection_reason``); a row without them is a
    text of its own source.
    """
    both = rows.join(proposals, key, "left")
    held = lambda name, default: F.col(name) if name in rows.columns else default
    none = F.array().cast("array<string>")
    gate = edits.rejection_reason(F.col(text), F.col("proposal"), F.lit(locale), held("kind", F.lit("text")), held("evidence_ids", F.array(F.lit("source"))), held("ingredients", none), held("fixed", none))
    reason = F.when(F.col("proposal").isNull(), F.lit(None)).when(F.col("confidence") < least, "low-confidence").otherwise(gate)
    return both.withColumn("reason", reason).withColumn("accepted", F.col("proposal").isNotNull() & F.col("reason").isNull()).withColumn("result", F.when(F.col("accepted"), F.col("proposal")).otherwise(F.col(text)))


def accept_fields(products: DataFrame, patches: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Patches (key, field, value) whose value the product's own corpus (key, text) contains, or covers by two thirds of its terms."""
    from lodestone.operators.retrieval import token_overlap_ratio

    both = patches.join(products.select(key), key, "left_semi").join(corpus, key)
    value, text = T.fingerprint(F.col("value"), 1 << 20), T.fingerprint(F.col("text"), 1 << 20)
    backed = F.contains(text, value) | ((F.length(value) >= 12) & (token_overlap_ratio(T.terms(F.col("value")), T.terms(F.col("text"))) >= 0.66))
    return both.withColumn("_ok", backed).groupBy(key, "field", "value").agg(F.max("_ok").alias("accepted"))


def retrieve_with(queries: DataFrame, chunks: DataFrame, k: int, hook=None) -> DataFrame:
    """``query_id, chunk_id, score, rank``: a caller's retrieval (query_id, chunk_id, score), of known queries and chunks only, scores within
    0 and 1, the best k of each query; without a hook the hybrid one."""
    if hook is None:
        return retrieval.hybrid_topk(queries, chunks, k).select("query_id", "chunk_id", "score", "rank")
    found = hook(queries, chunks).select("query_id", "chunk_id", T.clamp(F.col("score")).alias("score"))
    found = found.join(queries.select("query_id"), "query_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi").where("score is not null")
    return retrieval.top_k(retrieval.merge_best(found, ["query_id", "chunk_id"], "score", "chunk_id"), ["query_id"], "score", "chunk_id", k)


def reason_with(products: DataFrame, chunks: DataFrame, angle: str, hook=None) -> DataFrame:
    """A caller's reasoning (doc_id and what it adds) for each product, else the deterministic one."""
    own = citation_flow.reasoning(products, chunks, angle)
    return own if hook is None else own.join(hook(products, chunks), "doc_id", "left")


def draft_with(briefs: DataFrame, hook=None) -> DataFrame:
    """``doc_id, title, body, unsupported, accepted``: a caller's drafts (doc_id, title, body) with the wording that their briefs do not carry; no drafts without a hook."""
    drafts = hook(briefs) if hook else briefs.select("doc_id", F.lit("").alias("title"), F.lit("").alias("body")).where(F.lit(False))
    both = drafts.join(briefs.select("doc_id", "claims"), "doc_id")
    both = both.withColumn("unsupported", citation_flow.unsupported_claims(F.concat_ws("\n", "title", "body"), F.col("claims")))
    return both.select("doc_id", "title", "body", "unsupported", (F.size("unsupported") == 0).alias("accepted"))
