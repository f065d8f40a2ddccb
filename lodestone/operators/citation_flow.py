"""From a product and its evidence to a citation brief: chunks, retrieval with a fallback, linked claims, caveats, and text fit for the public.

A product's evidence is a few dozen items, so after retrieval its map is an array in the product's row and all else is a row's own affair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import text as T
from lodestone.operators import chunking, retrieval

#: Chunks of a product, the least score, and the chunks and score that stand in where none is found.
MOST_CHUNKS, LEAST_SCORE, FALLBACK_CHUNKS, FALLBACK_SCORE = 8, 0.06, 6, 0.05
TERM_LISTS = ("benefits", "effects", "ingredients", "review_keywords")


def evidence_buckets(products: DataFrame, key: str) -> DataFrame:
    """Evidence rows ``key, name, ord, text`` of an extraction's arrays: sections as product evidence, reviews, image texts, in this order."""
    parts = (("product", "sections"), ("review", "reviews"), ("image", "image_texts"))
    rows = [products.select(key, F.lit(name).alias("name"), F.posexplode(F.coalesce(c, F.array().cast("array<string>"))).alias("ord", "text")) for name, c in parts]
    return reduce(DataFrame.unionByName, rows).where(F.trim("text") != "")


def query_terms(*values: Column) -> Column:
    """Distinct terms of a product's fields and lists, in order."""
    return F.array_distinct(F.flatten(F.transform(F.filter(F.array(*values), lambda x: x.isNotNull()), T.terms)))


def product_terms() -> Column:
    return query_terms(*[F.col(c) for c in ("name", "brand", "category", "description")], *[F.array_join(F.coalesce(c, F.array()), " ") for c in TERM_LISTS])


def retrieved(products: DataFrame, evidence: DataFrame) -> DataFrame:
    """``doc_id, evidence_id, chunk_id, text, score, rank``: the best eight chunks of each product's evidence, or its first six where none scores enough.

    products: doc_id, name, brand, category, description and lists of benefits, effects, ingredients, review_keywords; evidence:
    doc_id, ord, evidence_id, title, text, source_type, published_at, observed_at.
    """
    rows = evidence.select("doc_id", "ord", "evidence_id", "title", "source_type", (F.coalesce("observed_at", "published_at").isNotNull()).alias("dated"), F.posexplode(chunking.evidence_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    words = T.keywords(F.concat_ws(" ", "title", "chunk"))
    scored = rows.join(products.select("doc_id", product_terms().alias("terms")), "doc_id")
    scored = scored.withColumn("score", F.round(retrieval.evidence_score(F.col("terms"), F.col("title"), F.col("chunk"), words, S.source_boost(F.col("source_type")), F.col("dated")), 9))
    place = Window.partitionBy("doc_id")
    at = F.struct("ord", "chunk_no")
    scored = scored.withColumns({"rank": F.row_number().over(place.orderBy(F.desc("score"), at)), "first": F.row_number().over(place.orderBy(at)), "best": F.max("score").over(place)})
    found = (F.col("score") >= LEAST_SCORE) & (F.col("rank") <= MOST_CHUNKS)
    stand_in = (F.col("best") < LEAST_SCORE) & (F.col("first") <= FALLBACK_CHUNKS)
    kept = scored.where(found | stand_in).withColumn("rank", F.when(F.col("best") < LEAST_SCORE, F.col("first")).otherwise(F.col("rank")))
    name = F.concat("evidence_id", F.lit(":chunk:"), (F.col("chunk_no") + 1).cast("string"))
    return kept.select("doc_id", "evidence_id", name.alias("chunk_id"), F.col("chunk").alias("text"), F.when(F.col("best") < LEAST_SCORE, FALLBACK_SCORE).otherwise(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"), "source_type")


def evidence_maps(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, map``: the evidence items of a product's chunks in their order, as an array."""
    rows = evidence.join(chunks.select("doc_id", "evidence_id").distinct(), ["doc_id", "evidence_id"], "left_semi")
    fields = [c for c in ("evidence_id", "source_type", "title", "text", "rating", "published_at", "observed_at") if c in evidence.columns]
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("map"))


NO_EVIDENCE = "No direct supporting evidence was selected for this claim."


def linked_claims(claims: Column, items: Column, most: int = 8, refs: int = 3) -> Column:
    """``array<struct<claim, refs, confidence, caveat>>``: the first distinct claims, each with the items that share most terms with it."""
    def linked(c: Column) -> Column:
        own = F.array_distinct(T.terms(c))
        shared = F.transform(items, lambda x, i: F.struct((-F.size(F.array_intersect(own, T.terms(F.concat_ws(" ", x["title"], x["text"]))))).alias("n"), i.alias("i"), x["evidence_id"].alias("id")))
        ids = F.transform(F.slice(F.array_sort(F.filter(shared, lambda s: s["n"] < 0)), 1, refs), lambda s: s["id"])
        return T.let(ids, lambda r: F.struct(c.alias("claim"), r.alias("refs"), F.when(F.size(r) >= 2, "high").when(F.size(r) == 1, "medium").otherwise("low").alias("confidence"), F.when(F.size(r) == 0, NO_EVIDENCE).alias("caveat")))

    distinct = F.slice(F.array_distinct(F.filter(F.transform(claims, lambda c: F.trim(c)), lambda c: c != "")), 1, most)
    return F.transform(distinct, linked)


REVIEW_CAVEAT = "Review patterns are useful signals, but they do not prove the product will work the same for everyone."
MARKETING_CAVEAT = "Marketing claims should be treated as directional unless supported by independent evidence."


def briefs(products: DataFrame, maps: DataFrame) -> DataFrame:
    """``doc_id, search_intent, claims, caveats``: what a draft may say of each product and on which evidence."""
    none = F.array().cast("array<string>")
    rows = products.join(maps, "doc_id", "left").withColumn("map", F.coalesce("map", F.array().cast(maps.schema["map"].dataType)))
    made_of = F.transform(F.coalesce("ingredients", none), lambda x: F.concat(x, F.lit(" is part of the product evidence")))
    claims = linked_claims(F.concat(F.coalesce("benefits", none), F.coalesce("effects", none), made_of, F.array(F.coalesce("description", F.lit("")))), F.col("map"))
    kind = F.coalesce("category", F.lit("product"))
    first = F.coalesce(F.get("benefits", 0), F.get("effects", 0), F.col("category"), F.lit("the stated use case"))
    asked = F.array(F.concat(F.lit("is "), "name", F.lit(" worth it")), F.concat(F.lit("best "), kind, F.lit(" for "), first), F.concat("name", F.lit(" reviews and caveats")))
    rows = rows.withColumn("claims", claims)
    own = F.transform(F.filter("claims", lambda c: c["confidence"] == "low"), lambda c: c["caveat"])
    told = F.when(F.size("review_keywords") > 0, F.array(F.lit(REVIEW_CAVEAT))).otherwise(none)
    return rows.select("doc_id", asked.alias("search_intent"), "claims", F.array_distinct(F.concat(own, told, F.array(F.lit(MARKETING_CAVEAT)))).alias("caveats"))


def unsupported_claims(text: Column, claims: Column) -> Column:
    """Names of unsafe wording in a text, and claims of low confidence without a caveat."""
    weak = F.transform(F.filter(claims, lambda c: (c["confidence"] == "low") & (F.coalesce(c["caveat"], F.lit("")) == "")), lambda c: c["claim"])
    return F.concat(S.unsafe_claims(text), weak)


def reasoning(products: DataFrame, chunks: DataFrame, angle: str) -> DataFrame:
    """``doc_id, terms, principles, types``: the first twelve distinct query terms, the principles of an angle, and the types of the chunks by rank."""
    none = F.array().cast("array<string>")
    values = F.concat(F.array("name", "category"), F.coalesce("benefits", none), F.coalesce("review_keywords", none))
    terms = F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), 1, 12)
    types = chunks.groupBy("doc_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_type"))), lambda x: x["source_type"])).alias("types"))
    principles = F.array(*map(F.lit, ("mandatory citation contract", "claim-to-evidence linking", "reddit community-fit tone", f"{angle} content angle")))
    return products.select("doc_id", terms.alias("terms"), principles.alias("principles")).join(types, "doc_id", "left").withColumn("types", F.coalesce("types", none))


# public text

# Caveats that are said once, references and diagnostics that never go out, ingredient lists that are named instead.
CAVEATS = "review patterns|marketing claims|do not prove|directional|not definitive|not a guarantee|careful|caveat|limitation|unsupported"
PRIVATE = (
    (r"(?i)\s*Evidence refs?:\s*[^.\n]+\.?", ""),
    (rf"(?i){T.BORDER}(?:product|extractor|review|paper|news|image|existing-geo|custom|rag)[A-Za-z0-9_.-]*:[A-Za-z0-9_:.-]+{T.BORDER}", ""),
    (rf"(?i){T.BORDER}The selected evidence set includes [^.]+\.?\s*", "I would treat the available evidence as directional rather than definitive. "),
)
AUDIENCES = (r"(?iu)상품을\s*비교하고\s*근거를\s*확인하려는\s*Reddit\s*사용자", "(?i)Reddit users comparing products and evidence", "(?i)people comparing product claims and real-world evidence")
NAMED_INSTEAD = (
    (rf"(?i){T.BORDER}Caveat:\s*", ""),
    (rf"(?i){T.BORDER}INGREDIENTS?:[^\n]*", "the full ingredient list"),
    (rf"(?i){T.BORDER}FORMULATED WITHOUT:[^\n]+", ""),
    (rf"(?i){T.BORDER}(?:WATER\s*/\s*AQUA\s*/\s*EAU|BUTYLENE GLYCOL|PHENOXYETHANOL|SODIUM HYALURONATE CROSSPOLYMER)[^\n]*", "the full ingredient list"),
)


def _said_once(parts: Column, key, least: int) -> Column:
    """Parts without those caveats whose key came before."""
    keys = F.transform(parts, key)
    repeats = lambda k, i: (F.length(k) >= least) & k.rlike(CAVEATS) & (F.array_position(keys, k) <= i)
    return F.filter(parts, lambda x, i: ~repeats(F.element_at(keys, i + 1), i))


def without_repeated_lines(text: Column) -> Column:
    """Caveat lines of 28 characters or more once each."""
    key = lambda x: F.trim(F.lower(F.regexp_replace(x, r"^[-#\s]+", "")))
    return F.array_join(T.let(F.split(text, "\n"), lambda lines: _said_once(lines, key, 28)), "\n")


def without_repeated_sentences(text: Column) -> Column:
    """Caveat sentences of 36 characters or more once each, over all lines."""
    lines = F.split(text, "\n")
    whole = F.flatten(F.transform(lines, lambda line, i: F.transform(T.matched(line, r"[^.!?]+[.!?]+|[^.!?]+$", fold=False), lambda s: F.struct(i.alias("i"), s.alias("s")))))
    key = lambda x: F.lower(F.regexp_replace(T.clean_text(x["s"]), r"^[-#\s]+", ""))
    kept = T.let(whole, lambda w: _said_once(w, key, 36))
    joined = lambda k, i: F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(k, lambda x: x["i"] == i), lambda x: x["s"]), " "), r"\s+([,.!?])", "$1"))
    return T.let(kept, lambda k: F.array_join(F.transform(lines, lambda line, i: F.when(line.rlike("[^.!?]"), joined(k, i)).otherwise(line)), "\n"))


def public_text(text: Column, audience: Column) -> Column:
    """A draft without references, diagnostics, internal audiences, ingredient lists and caveats said twice."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    for pattern, value in PRIVATE:
        out = F.regexp_replace(out, pattern, value)
    for pattern in AUDIENCES:
        out = F.regexp_replace(out, F.lit(pattern), audience)
    for pattern, value in NAMED_INSTEAD:
        out = F.regexp_replace(out, pattern, value)
    out = without_repeated_lines(without_repeated_sentences(out))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
