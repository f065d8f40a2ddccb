"""Extraction-side retrieval and chunk rows: routing and scores of policy chunks, index joins, rows of a product's evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import text as T
from lodestone.operators.retrieval import lexical_similarity, sparse_embedding

#: Kinds of extraction documents by name, first match counts. Fixed values.
EXTRACTION_KINDS = (("orchestration", "orchestrat|manifest|rag-index|rag-map"), ("analysis-prompt", "analysis-prompt"), ("product-normalization", "product-normalization|normalization"), ("ocr-classification", "ocr|classification|keyword"), ("review-extraction", "review"), ("faq-extraction", "faq"))
#: Routing of extraction chunks: kind, pattern, intents, field targets; all that apply count, in order. Fixed values.
EXTRACTION_ROUTES = (
    ("orchestration", "orchestration|routing|rag index|rag-index|coverage|conflict|overlap|missing|누락|충돌|중복", ("orchestration", "diagnostics"), ("diagnostics", "rag.chunks")),
    ("analysis-prompt", "analysis prompt|base instruction|evidence-only|근거|정책", ("evidence", "diagnostics"), ("geoProduct", "diagnostics")),
    ("product-normalization", "normalize|normalization|geoProduct|contentAnalysis|section|field|schema-ready|정규화|분류", ("normalization", "schema-ready"), ("geoProduct", "contentAnalysis.sections", "rag.chunks")),
    ("ocr-classification", "ocr|sentence|keyword|classification|benefit|effect|ingredient|usage|효능|효과|성분|사용법", ("classification", "evidence"), ("ocr.sentenceInsights", "benefits", "effects", "ingredients", "usage")),
    (None, "exclude|cart|coupon|delivery|refund|legal|chrome|purchase|혜택|배송|교환|반품|환불|법적|장바구니", ("exclusion",), ("diagnostics",)),
    ("review-extraction", "review|rating|customer|texture|absorption|satisfaction|리뷰|평점|사용감|흡수감", ("review", "evidence"), ("reviews",)),
    ("faq-extraction", "faq|question|answer|mainentity|q&a|질문|답변", ("faq", "evidence"), ("faq",)),
    (None, f"metric|clinical|survey|rating|count|{T.BORDER}\\d+(?:\\.\\d+)?\\s?%|임상|수치|만족도", ("evidence",), ("metrics",)),
)
#: Boosts of extraction chunks: by intents or targets, then by text. Fixed values.
INTENT_BOOSTS = ((("classification",), ("ocr.sentenceInsights",), 0.06), (("normalization",), ("geoProduct",), 0.04), (("exclusion",), (), 0.06))
TEXT_BOOSTS = (("ocr|sentence|classification|keyword", 0.08), ("product|normalization|field|schema", 0.05), ("review|faq|question|answer", 0.04), ("exclude|cart|coupon|delivery|refund|legal|chrome|혜택|배송|반품", 0.06))
#: Buckets of the hashed vectors that chunks are compared with.
EXTRACTION_BUCKETS = 96


def extraction_kind(name: Column) -> Column:
    rule = F.when(F.lit(False), "")
    for kind, pattern in EXTRACTION_KINDS:
        rule = rule.when(T.matches(name, pattern), kind)
    return rule.otherwise("custom")


def extraction_routing(kind: Column, source: Column, title: Column, text: Column) -> Column:
    """``struct<intents, targets>`` of a chunk; patterns are held against the lower-case text, so those with capitals never match."""
    none = F.array().cast("array<string>")
    listed = lambda names: F.array(*map(F.lit, names))

    def joined(hits: Column) -> Column:
        pick = lambda at: F.array_distinct(F.concat(*[F.when(hits[n], listed(r[at])).otherwise(none) for n, r in enumerate(EXTRACTION_ROUTES)]))
        return T.let(F.struct(pick(2).alias("i"), pick(3).alias("t")), lambda r: F.struct(F.when(F.size(r["i"]) > 0, r["i"]).otherwise(listed(("general",))).alias("intents"), F.when(F.size(r["t"]) > 0, r["t"]).otherwise(listed(("geoProduct",))).alias("targets")))

    hay = F.lower(F.concat(source, F.lit(" "), F.coalesce(title, F.lit("")), F.lit(" "), text))
    tests = lambda h: F.array(*[(kind == k if k else F.lit(False)) | h.rlike(p) for k, p, _, _ in EXTRACTION_ROUTES])
    return T.let(hay, lambda h: T.let(tests(h), joined))


def extraction_boost(kind: Column, intents: Column, targets: Column, text: Column, priority: Column) -> Column:
    """What a chunk gains by its index entry's priority, its intents and targets, and its text."""
    plus = lambda test, v: F.when(test, v).otherwise(0.0)
    total = F.coalesce(priority, F.lit(0.0)) * 0.08 + plus((kind == "orchestration") | F.array_contains(intents, "orchestration"), 0.07)
    for i, t, v in INTENT_BOOSTS:
        total = total + plus(F.array_contains(intents, i[0]) | (F.array_contains(targets, t[0]) if t else F.lit(False)), v)
    for pattern, v in TEXT_BOOSTS:
        total = total + plus(T.matches(text, pattern), v)
    return total


def extraction_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score`` of each query and policy chunk: half lexical, 0.42 semantic (hashed vectors), and the chunk's boost, within 0 and 1.

    queries: query_id, text; chunks: chunk_id, source, title, text, boost. Policy chunks are a product's few hundred at most and each
    pair has a score, so they are joined to all queries.
    """
    whole = F.concat("source", F.lit(" "), F.coalesce("title", F.lit("")), F.lit(" "), "text")
    vector = lambda df, key: sparse_embedding(df, key, F.col("text"), EXTRACTION_BUCKETS)
    dot = vector(queries, "query_id").withColumnRenamed("weight", "w").join(vector(chunks, "chunk_id"), "bucket").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    q = queries.select("query_id", T.tokens(F.col("text")).alias("q"))
    pairs = q.join(F.broadcast(chunks.select("chunk_id", T.tokens(whole).alias("c"), "boost")))
    semantic = T.clamp((F.coalesce("dot", F.lit(0.0)) + 1) / 2)
    both = pairs.join(dot, ["query_id", "chunk_id"], "left")
    return both.select("query_id", "chunk_id", T.clamp(lexical_similarity(F.col("q"), F.col("c")) * 0.5 + semantic * 0.42 + F.col("boost")).alias("score"))


def index_entries(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks (source) with the first index entry (ord, document, priority) of their document, null without one."""
    first = index.groupBy(F.col("document").alias("source")).agg(F.min_by("priority", "ord").alias("priority"))
    return chunks.join(F.broadcast(first), "source", "left")  # the index lists the documents of a profile


def heading_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9가-힣ぁ-んァ-ン一-龯]+", " "))


def section_entries(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks (source, title) with the first section (ord, document, heading, priority) of their document whose heading holds their title or lies in it.

    A document's sections are an array, so the containment is tested in the row.
    """
    listed = sections.groupBy(F.col("document").alias("source")).agg(F.array_sort(F.collect_list(F.struct("ord", heading_key(F.col("heading")).alias("key"), "heading", "priority"))).alias("_sections"))
    key = heading_key(F.col("title"))
    found = F.get(F.filter("_sections", lambda s: F.contains(key, s["key"]) | F.contains(s["key"], key)), 0)
    joined = chunks.join(F.broadcast(listed), "source", "left").withColumn("_found", F.when(F.coalesce("title", F.lit("")) != "", found))
    return joined.withColumns({"section": F.col("_found.heading"), "section_priority": F.col("_found.priority")}).drop("_sections", "_found")


def rerank(chunks: DataFrame, boost: Column, key: str, score: str, order: str) -> DataFrame:
    """Chunks with their scores boosted, within 0 and 1, the scores before and the boosts to four places, and their new places; ties keep their order."""
    rows = chunks.withColumns({"rerank_boost": T.round_score(boost), "base_score": T.round_score(F.col(score)), score: T.clamp(F.col(score) + boost)})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order)))


# rows of a product's evidence


def trimmed_insight(text: Column, category: Column) -> Column:
    """A sentence cut to 360 characters, to 520 of ingredients and to 2,400 of a whole list."""
    t = T.clean_text(text)
    most = F.when(category == "ingredient", F.when(S.full_ingredient_list(t), 2400).otherwise(520)).otherwise(360)
    return F.when(F.length(t) > most, F.concat(F.trim(F.substr(t, F.lit(1), most)), F.lit("..."))).otherwise(t)


def sentence_insights(sentences: DataFrame, text: str = "text", most: int = 10) -> DataFrame:
    """Sentences that say something of a category, with ``category``, the first ``most`` distinct ``keywords`` and the trimmed ``insight``."""
    words = F.slice(F.array_distinct(F.transform(S.all_keywords(F.col(text)), lambda k: k["keyword"])), 1, most)
    rows = sentences.withColumn("category", S.insight_category(F.col(text)))
    rows = rows.where(F.col("category").isNotNull() & (F.col("category") != "unknown") & S.insight_value(F.col(text), F.col("category")))
    return rows.withColumns({"keywords": words, "insight": trimmed_insight(F.col(text), F.col("category"))})


#: Branches of a product's chunks in their order.
BRANCHES = ("product", "faq", "content-section", "review", "ocr", "policy")


def chunk_rows(products: DataFrame, key: str, faq: DataFrame, sections: DataFrame, reviews: DataFrame, images: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """``key, ord, chunk_id, kind, text``: the product's own text, then its questions, sections, reviews, image texts and policy chunks, empty ones left out.

    products: name, description, and arrays benefits, effects, ingredients, usage, metrics; the others: key, ord and question and
    answer, category, title and text, body, text.
    """
    lists = [F.array_join(F.coalesce(c, F.array()), "\n") for c in ("benefits", "effects", "ingredients", "usage", "metrics")]
    parts = F.filter(F.array("name", "description", *lists), lambda x: x.isNotNull() & (x != ""))
    branches = [products.select(key, F.lit(1).cast("long").alias("ord"), F.lit("product").alias("kind"), F.array_join(parts, "\n").alias("text"))]
    branches += [faq.select(key, "ord", F.lit("faq").alias("kind"), F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("text"))]
    branches += [sections.select(key, "ord", F.lit("source").alias("kind"), F.concat(F.lit("["), "category", F.lit("] "), "title", F.lit("\n"), "text").alias("text"))]
    branches += [reviews.select(key, "ord", F.lit("review").alias("kind"), F.col("body").alias("text")), images.select(key, "ord", F.lit("ocr").alias("kind"), "text")]
    branches += [policy.select(key, "ord", F.lit("source").alias("kind"), "text")] if policy is not None else []
    rows = reduce(DataFrame.unionByName, [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)])
    number = F.row_number().over(Window.partitionBy(key, "branch").orderBy("ord"))
    names = F.element_at(F.array(*map(F.lit, BRANCHES)), F.col("branch") + 1)
    rows = rows.withColumn("chunk_id", F.concat(names, F.lit("-"), number.cast("string"))).where(F.length("text") > 0)
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("branch", "ord")).cast("long").alias("ord"), "chunk_id", "kind", "text")


def text_candidates(texts: DataFrame, key: str, address: str, most: int = 6, size: int = 920, least: int = 24) -> DataFrame:
    """``key, url, text``: distinct texts (key, ord, text) of a payload in up to six chunks each, those of 24 characters or more, under addresses that number them."""
    from lodestone.operators.chunking import sentence_chunks

    once = texts.where(F.trim("text") != "").groupBy(key, address, F.trim("text").alias("text")).agg(F.min("ord").alias("ord"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    rows = once.withColumn("n", number).select(key, address, "n", F.posexplode(F.slice(sentence_chunks(F.col("text"), size), 1, most)).alias("k", "chunk"))
    url = F.concat(address, F.lit("#api-text-"), F.col("n").cast("string"), F.lit("-"), (F.col("k") + 1).cast("string"))
    return rows.where(F.length("chunk") >= least).select(key, url.alias("url"), F.col("chunk").alias("text"))


CLAIM_FIELDS = ("label", "subject", "value", "metric", "sentence", "source_text")


def unique_metric_claims(claims: DataFrame, key: str, order: str) -> DataFrame:
    """Metric claims without those whose six telling fields read like an earlier one's, and without those that have none."""
    from lodestone.operators.dedupe import first_wins

    name = T.fingerprint(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in CLAIM_FIELDS]))
    return first_wins(claims.where(name != ""), name, order, within=[key])


def sets_intersect(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


#: Families of profile documents that come first, and how each document's name ranks. Fixed values.
SPINE = ("geo", "eeat", "cep")


def select_documents(documents: DataFrame, key: str, order: str, priority: str, family: str, budget: int) -> DataFrame:
    """Documents within a budget: the best of each of the spine's families, then the best of every other family, then the rest by priority; ``place`` from 1."""
    best = F.row_number().over(Window.partitionBy(key, family).orderBy(F.desc(priority), order))
    spine = F.when(F.lit(False), 0)
    for i, f in enumerate(SPINE):
        spine = spine.when((F.col(family) == f) & (F.col("_best") == 1), i)
    tier = spine.otherwise(F.when(F.col("_best") == 1, len(SPINE)).otherwise(len(SPINE) + 1))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_tier", F.desc(priority), order))
    return documents.withColumn("_best", best).withColumn("_tier", tier).withColumn("place", place).where(F.col("place") <= budget).drop("_best", "_tier")


def underived(candidates: DataFrame, links: DataFrame, direct: DataFrame, key: str) -> DataFrame:
    """Candidates (key, value) without those that only repeat a link's text (key, value), unless a direct signal (key, value) says the same."""
    same = lambda df, name: df.select(key, T.comparison_text(F.col("value")).alias(name)).distinct()
    rows = candidates.withColumn("_name", T.comparison_text(F.col("value")))
    derived = same(links, "_name").join(same(direct, "_name"), [key, "_name"], "left_anti")
    return rows.join(derived.where("_name != ''"), [key, "_name"], "left_anti").drop("_name")


def brand_scope(products: DataFrame, brands: DataFrame) -> DataFrame:
    """Products (key columns, hint, brand, name) with the ``slug`` of the first brand (ord, slug, pattern) that hint, brand and name speak of; null without one."""
    signal = F.regexp_replace(F.lower(F.concat_ws(" ", "hint", "brand", "name")), r"\s+", "")
    listed = brands.agg(F.array_sort(F.collect_list(F.struct("ord", "slug", "pattern"))).alias("_brands"))  # the brands of a profile
    found = F.get(F.filter("_brands", lambda b: F.regexp_like(signal, b["pattern"])), 0)
    return products.join(F.broadcast(listed)).withColumn("slug", found["slug"]).drop("_brands")
