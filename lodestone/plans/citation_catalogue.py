"""Registered queries of the citation flow over a small fixture; what must come out was worked out by hand from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import citation_flow
from lodestone.plans import hooks
from lodestone.plans.catalogue import query
from lodestone.plans.fixtures import expected

PRODUCTS = (("d1", "Dew Cream", "Moss", "cream", "A cream.", ["soft skin"], [], ["water"], ["absorbs"]), ("d2", "Tide", None, None, None, [], [], [], []))
PRODUCT = "doc_id string, name string, brand string, category string, description string, benefits array<string>, effects array<string>, ingredients array<string>, review_keywords array<string>"
EVIDENCE = (
    ("d1", 0, "product-1", None, "Dew Cream keeps skin soft.", "product", None, None),
    ("d1", 1, "review-1", None, "It absorbs at once.", "review", None, "2026-01-02"),
    ("d1", 2, "custom-1", None, "Nothing here.", "none", None, None),
    ("d2", 0, "x-1", None, "Words about other things.", "none", None, None),
)
ITEM = "doc_id string, ord int, evidence_id string, title string, text string, source_type string, published_at string, observed_at string"


def tables(spark):
    return spark.createDataFrame(PRODUCTS, PRODUCT), spark.createDataFrame(EVIDENCE, ITEM)


# terms of d1: dew cream moss soft skin water absorbs, seven in all. product-1 shares dew, cream, skin, soft: 4/7 + 0.07; no term of
# more than five letters is in it. review-1 shares absorbs: 1/7 + 0.1 + 0.06 + 0.05. custom-1 shares none: 0.04, too little.
# d2 finds nothing (0.04), so its first chunk stands in.
@query(expected("doc_id, chunk_id, score, rank", [("d1", "product-1:chunk:1", 0.641429, 1), ("d1", "review-1:chunk:1", 0.352857, 2), ("d2", "x-1:chunk:1", 0.05, 1)]))
def citation_chunks(spark, sf_dir):
    """The chunks that a product's terms find, or its first ones."""
    made = citation_flow.retrieved(*tables(spark))
    return made.select("doc_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


CLAIMS = (("d1", "soft skin", "product-1", "medium"), ("d1", "water is part of the product evidence", "", "low"), ("d1", "A cream.", "product-1", "medium"))


@query(expected("doc_id, claim, refs, confidence", CLAIMS))
def brief_claims(spark, sf_dir):
    """A product's claims with the evidence that carries each."""
    products, evidence = tables(spark)
    made = citation_flow.briefs(products, citation_flow.evidence_maps(evidence, citation_flow.retrieved(products, evidence)))
    return made.select("doc_id", F.inline("claims")).select("doc_id", "claim", F.array_join("refs", ",").alias("refs"), "confidence")


@query(
    expected(
        "doc_id, intent, caveats",
        [
            ("d1", "is Dew Cream worth it|best cream for soft skin|Dew Cream reviews and caveats", "|".join((citation_flow.NO_EVIDENCE, citation_flow.REVIEW_CAVEAT, citation_flow.MARKETING_CAVEAT))),
            ("d2", "is Tide worth it|best product for the stated use case|Tide reviews and caveats", citation_flow.MARKETING_CAVEAT),
        ],
    )
)
def brief_caveats(spark, sf_dir):
    """What is asked of a product, and what has to be said with care."""
    products, evidence = tables(spark)
    made = citation_flow.briefs(products, citation_flow.evidence_maps(evidence, citation_flow.retrieved(products, evidence)))
    return made.select("doc_id", F.array_join("search_intent", "|").alias("intent"), F.array_join("caveats", "|").alias("caveats"))


@query(expected("doc_id, terms, types", [("d1", "Dew Cream|cream|soft skin|absorbs", "product|review"), ("d2", "Tide", "none")]))
def citation_reasoning(spark, sf_dir):
    """Query terms, and the types of the evidence that was chosen."""
    products, evidence = tables(spark)
    made = hooks.reason_with(products, citation_flow.retrieved(products, evidence), "comparison")
    return made.select("doc_id", F.array_join("terms", "|").alias("terms"), F.array_join("types", "|").alias("types"))


DRAFTS = (
    ("Soft cream. Evidence refs: product-1, review-2.\nGood.", "Soft cream.\nGood."),
    ("Caveat: Review patterns are useful, not definitive.\nReview patterns are useful, not definitive.", "Review patterns are useful, not definitive.\n"),
    ("For Reddit users comparing products and evidence.", "For careful readers."),
    ("INGREDIENTS: WATER, GLYCERIN, X\nEnd", "the full ingredient list\nEnd"),
    ("See review-1:chunk:2 for more", "See for more"),
    ("Same line of nothing at all here\nSame line of nothing at all here", "Same line of nothing at all here\nSame line of nothing at all here"),
)


@query(expected("id, text", [(i, b.strip()) for i, (_, b) in enumerate(DRAFTS)]))
def public_texts(spark, sf_dir):
    """Drafts without what is not for the public."""
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(DRAFTS)], "id long, draft string")
    return rows.select("id", citation_flow.public_text(F.col("draft"), F.lit("careful readers")).alias("text"))


@query(expected("doc_id, unsupported, accepted", [("d1", "guaranteed", False), ("d2", "", True)]))
def drafts(spark, sf_dir):
    """Drafts of a caller with the wording that their briefs do not carry."""
    products, evidence = tables(spark)
    made = citation_flow.briefs(products, citation_flow.evidence_maps(evidence, citation_flow.retrieved(products, evidence)))
    hook = lambda b: b.select("doc_id", F.lit("Title").alias("title"), F.when(F.col("doc_id") == "d1", "Guaranteed glow").otherwise("A note").alias("body"))
    return hooks.draft_with(made, hook).select("doc_id", F.array_join("unsupported", ",").alias("unsupported"), "accepted")


@query(expected("query_id, chunk_id, rank", [("q", "a", 1), ("q", "c", 2)]))
def hooked_retrieval(spark, sf_dir):
    """A caller's retrieval: known chunks, each once, the best two."""
    queries, chunks = spark.createDataFrame([("q", "x")], "query_id string, text string"), spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, text string")
    rows = spark.createDataFrame([("q", "a", 7.0), ("q", "a", 0.2), ("q", "b", 0.1), ("q", "c", 0.4), ("q", "unknown", 0.9), ("other", "a", 1.0)], "query_id string, chunk_id string, score double")
    return hooks.retrieve_with(queries, chunks, 2, lambda q, c: rows).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(expected("doc_id, name, ord, text", [("d", "product", 0, "Section"), ("d", "review", 1, "Nice"), ("d", "image", 0, "On the box")]))
def extraction_evidence(spark, sf_dir):
    """Evidence rows of an extraction's arrays."""
    rows = spark.createDataFrame([("d", ["Section"], ["", "Nice"], ["On the box"])], "doc_id string, sections array<string>, reviews array<string>, image_texts array<string>")
    made = citation_flow.evidence_buckets(rows, "doc_id")
    return made.select("doc_id", "name", F.col("ord").cast("long").alias("ord"), "text")
