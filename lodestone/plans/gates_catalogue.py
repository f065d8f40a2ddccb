"""Registered queries of the claim, edit and evidence gates over fixtures; what must come out was worked out by hand from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import claims, edits
from lodestone.plans import fixtures
from lodestone.plans.catalogue import query
from lodestone.plans.fixtures import expected


@query(expected("claim_id, reason", [(i, c[3]) for i, c in enumerate(fixtures.CLAIMS)]))
def claim_support(spark, sf_dir):
    """The gate that each claim fails on its cited evidence."""
    c = fixtures.claims(spark)
    return c.select("claim_id", claims.support_reason(F.col("claim"), F.col("cited"), F.col("product"), F.col("audited")).alias("reason"))


@query(expected("claim_id, numbers", [(i, c[4]) for i, c in enumerate(fixtures.CLAIMS)]))
def claim_numbers(spark, sf_dir):
    """Whether the numbers of each claim are supported: values, clauses or metric groups, study scopes."""
    c = fixtures.claims(spark)
    return c.select("claim_id", claims.numbers_supported(F.col("claim"), F.col("cited")).alias("numbers"))


@query(expected("edit_id, reason", [(i, e[7]) for i, e in enumerate(fixtures.EDITS)]))
def edit_gates(spark, sf_dir):
    """The gate that each proposed edit fails."""
    e = fixtures.edits(spark)
    reason = edits.rejection_reason(F.col("before"), F.col("after"), F.col("locale"), F.col("kind"), F.col("evidence_ids"), F.array(F.lit("ginseng")), F.col("fixed"), F.col("marks_only"))
    return e.select("edit_id", reason.alias("reason"))


def _column(spark, kinds: str, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {kinds}")


TOKENS = (
    ("Hydrating serums for dryness", "hydrat,serum,drynes", "hydr,drynes"),
    ("The studies mentioned calming boxes", "study,mention,calm,box", "study,mention,calm,boxe"),
    ("피부에서는 보습이 되었습니다", "피부,보습,되었습니다", "피부,보습"),
    ("", "", ""),
)


@query(expected("id, substance, meaning", [(i, a, b) for i, (_, a, b) in enumerate(TOKENS)]))
def stripped_tokens(spark, sf_dir):
    """Words of content as edits and as claims strip them."""
    t = _column(spark, "text string", [(x[0],) for x in TOKENS])
    return t.select("id", F.array_join(edits.substantive_tokens(F.col("text")), ",").alias("substance"), F.array_join(claims.claim_tokens(F.col("text")), ",").alias("meaning"))


PAIRS = (
    # texts, too similar, within one edit, scripts differ, a context or cause is added, an unsupported number
    ("Soft serum for dry skin", "soft SERUM for dry skin!", True, False, False, False, False),
    ("", "anything", False, False, False, False, False),
    ("gentle foam cleans pores", "cleaning pores with gentle foams", True, False, False, False, False),
    ("moisturzing", "moisturizing", False, True, False, False, False),
    ("serum", "serums", True, True, False, False, False),
    ("건조한 피부용", "for dry skin", False, False, True, False, False),
    ("Best in winter", "For dry skin", False, False, False, True, False),
    ("Soft because of ginseng", "Soft ginseng", False, False, False, True, False),
    ("Firmer after 4 weeks, 30% better", "30 % better after 4  weeks", True, False, False, False, True),
    ("Firmer after 4 weeks", "firmer  AFTER 4 weeks it was", True, False, False, False, False),
)


@query(expected("id, similar, near, scripts, added, unsupported", [(i, *p[2:]) for i, p in enumerate(PAIRS)]))
def text_pairs(spark, sf_dir):
    """Similarity, edit distance, scripts, added context and unsupported numbers of pairs of texts."""
    a, b = F.col("a"), F.col("b")
    return _column(spark, "a string, b string", [p[:2] for p in PAIRS]).select("id", claims.too_similar(a, b).alias("similar"), edits.within_one_edit(a, b).alias("near"), claims.different_script(a, b).alias("scripts"), claims.adds_context(a, b).alias("added"), claims.unsupported_claim_tokens(a, b).alias("unsupported"))


FAQS = (
    (("Is it soft?", "feel", "daily"), ("is it SOFT", "other", ""), True),
    (("What does it do?", "benefit", "dry skin"), ("Which benefit has it?", "Benefit", "Dry skin!"), True),
    (("What does it do for skin?", "", ""), ("What does it do for dry skin?", "", ""), True),
    (("How is it used?", "usage", ""), ("Who should use it?", "usage", ""), False),
)


@query(expected("id, same", [(i, x[2]) for i, x in enumerate(FAQS)]))
def faq_pairs(spark, sf_dir):
    """Questions that stand for each other."""
    kind = "struct<question:string,intent:string,cep:string>"
    return _column(spark, f"a {kind}, b {kind}", [x[:2] for x in FAQS]).select("id", claims.faq_equivalent(F.col("a"), F.col("b")).alias("same"))


LONG = "The serum holds ginseng root extract and niacinamide and it was measured by twenty women for a month"
LONGER = "Skin was rated softer and firmer by all of them after a month of use twice a day at home and at work"
DESCRIPTIONS = (
    (f"This product page covers the jar and its lid. {LONG}. {LONGER}.", f"A serum. {LONG}. {LONGER}.", False),
    (f"The serum. {LONG}. {LONGER}.", f"A serum for all. {LONG}. {LONGER}.", True),
    (LONG, LONG.upper(), True),
    (f"{LONG} and more", LONG, True),
    ("Short page", "Short product", False),
    ("", "", False),
)


@query(expected("id, similar", [(i, x[2]) for i, x in enumerate(DESCRIPTIONS)]))
def description_pairs(spark, sf_dir):
    """Page and product descriptions that say the same."""
    return _column(spark, "page string, product string", [x[:2] for x in DESCRIPTIONS]).select("id", edits.descriptions_too_similar(F.col("page"), F.col("product")).alias("similar"))


NUMBERS = (
    ("Rose 20 % in 4 weeks, and 1,000 users said 3.0 of 5", "20%|4week|1000user|3|5", "20%,4week|1000user,3,5"),
    ("v2 and 12abc; 2 hrs. 3 layers of 5 KRW", "2hour|3층|5", "2hour|3층,5"),
    ("30명이 2주 사용", "2주", "2주"),
    ("none", "", ""),
)


@query(expected("id, claims, clauses", [(i, a, b) for i, (_, a, b) in enumerate(NUMBERS)]))
def claim_number_tokens(spark, sf_dir):
    """Claimed numbers with their units, all and by clause."""
    t = _column(spark, "text string", [(x[0],) for x in NUMBERS])
    groups = F.array_join(F.transform(T.numeric_claim_groups(F.col("text")), lambda g: F.array_join(g, ",")), "|")
    return t.select("id", F.array_join(T.numeric_claims(F.col("text")), "|").alias("claims"), groups.alias("clauses"))


ATOMS = (("p1", 1, "e1", "Ginseng root"), ("p1", 2, "e2", "Soft skin after use"), ("p1", 3, "e3", "ginseng"), ("p2", 1, "e9", "Ginseng root"))
NAMED = (("p1", "Ginseng ROOT extract", "e1,e3"), ("p1", "soft skin", "e2"), ("p2", "nothing", ""), ("p3", "Ginseng root", ""))


@query(expected("key, text, ids", NAMED))
def evidence_matches(spark, sf_dir):
    """Atoms of a product that equal, hold or lie in a text."""
    made = claims.matching_evidence(spark.createDataFrame([x[:2] for x in NAMED], "key string, text string"), spark.createDataFrame(ATOMS, "key string, ord long, evidence_id string, text string"), "key")
    return made.select("key", "text", F.array_join("evidence_ids", ",").alias("ids"))
