"""Aggregates over product evidence: groups in order of first occurrence, capped where the result is a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import signals as S
from lodestone.functions import text as T


def ordered_unique(order: Column, value: Column, most: int | None = None) -> Column:
    """The distinct values of a group by first occurrence, as an aggregate."""
    each = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))
    return F.slice(each, 1, most) if most else each


def keyword_groups(keywords: DataFrame, key: str, most: int = 12) -> DataFrame:
    """``key`` and an array of the first ``most`` valid keywords for each category (keywords: key, ord, category, keyword)."""
    valid = keywords.where(S.semantic_value(F.col("keyword"), F.col("category")) | F.col("category").isin("product", "price", "faq", "trend"))
    rows = valid.groupBy(key, "category").agg(ordered_unique(F.col("ord"), F.col("keyword"), most).alias("words"))
    return rows.groupBy(key).pivot("category", [*S.KEYWORDS, "trend"]).agg(F.first("words"))


def sentence_diagnostics(sentences: DataFrame, key: str) -> DataFrame:
    """Equal sentences (key, ord, text, image_url, intents) in one row: first spelling, images, intents and the fields those feed."""
    grouped = sentences.groupBy(key, F.lower("text").alias("same")).agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"), ordered_unique(F.col("ord"), F.col("image_url")).alias("images"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "intents"))), lambda x: x["intents"]))).alias("intents"))
    return grouped.drop("same").withColumn("fields", E.schema_fields(F.col("intents")))


def merge_reviews(summaries: DataFrame, key: str, most_items: int = 12, most_keywords: int = 28) -> DataFrame:
    """First defined rating and count, merged distinct items and keywords of summaries (key, ord, rating, review_count, items, keywords)."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    merged = lambda c, n: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]))), 1, n)
    return summaries.groupBy(key).agg(first("rating").alias("rating"), first("review_count").alias("review_count"), merged("items", most_items).alias("items"), merged("keywords", most_keywords).alias("keywords"))


def rating_line(rating: Column, count: Column) -> Column:
    """``Rating 4.5 · 120 reviews``, what is there of it; null without either."""
    parts = F.array_compact(F.array(F.when(rating.isNotNull(), F.concat(F.lit("Rating "), rating.cast("string"))), F.when(count.isNotNull(), F.concat(count.cast("long").cast("string"), F.lit(" reviews")))))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · "))


def ocr_summary(targets: DataFrame, key: str) -> DataFrame:
    """Counters of OCR targets (key, status, category, drop_reason): totals, shares by category, drop reasons."""
    totals = targets.groupBy(key).agg(F.count("*").alias("targets"), F.count_if(F.col("status") == "used").alias("used"), F.count_if(F.col("status") == "dropped").alias("dropped"))
    reasons = targets.where("drop_reason is not null").groupBy(key, "drop_reason").count().groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("drop_reason", "count")))).alias("reasons"))
    kinds = targets.where("status = 'used' and category is not null").groupBy(key, "category").count().groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("by_category"))
    return totals.join(reasons, key, "left").join(kinds, key, "left").withColumn("utilization", F.col("used") / F.col("targets"))


def merge_facts(facts: DataFrame, key: str, fields: tuple[str, ...], most: int = 12) -> DataFrame:
    """Array fields of facts (key, ord, ...) joined in order, distinct, capped."""
    return facts.groupBy(key).agg(*[F.slice(F.array_distinct(F.flatten(_field(f))), 1, most).alias(f) for f in fields])


def _field(name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", name))), lambda x: x[name])


def principle_sources(scored: DataFrame, key: str, most: int = 6, reserved: tuple[str, ...] = ("geo-research", "eeat", "cep")) -> DataFrame:
    """The best sources of a principle (key, source, kind, fit, score): those that fit, then the best of each reserved kind, ``most`` in all.

    Reserved kinds that are not among the best take the last places.
    """
    best = scored.groupBy(key, "source").agg(F.max_by("kind", F.struct("fit", "score")).alias("kind"), F.max("fit").alias("fit"), F.max("score").alias("score"))
    w = Window.partitionBy(key)
    first = F.row_number().over(Window.partitionBy(key, "kind").orderBy(F.desc("score"), "source"))
    rows = best.withColumn("held", F.col("kind").isin(*reserved) & (first == 1)).where("fit > 0 or held")
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("fit"), F.desc("score"), "source")))
    rows = rows.withColumn("missing", F.sum((F.col("held") & (F.col("rank") > most)).cast("int")).over(w))
    kept = (F.col("rank") <= most - F.col("missing")) | F.col("held")
    return rows.where(kept).withColumn("place", F.row_number().over(w.orderBy("rank"))).where(F.col("place") <= most).select(key, "source", "place")


def grouped_numbers(atoms: DataFrame, key: str) -> DataFrame:
    """Number tokens of metric atoms (key, text) that share an ``evidenceGroup``, groups of two or more."""
    group = F.trim(F.regexp_extract("text", r"(?:^|;\s*)evidenceGroup=([^;]+)", 1))
    rows = atoms.withColumn("evidence_group", group).where("evidence_group != ''")
    return rows.groupBy(key, "evidence_group").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list(T.numeric_claims(F.col("text"))))).alias("tokens")).where("n >= 2")


def query_plan(products: DataFrame, targets: list[str], most: int = 6) -> DataFrame:
    """``key, query_id, target, query`` of each product (key, name, brand, category, locale): a general query, then one for each target."""
    base = F.concat_ws(" ", "name", "brand", "category", "locale")
    plans = F.array(F.struct(F.lit("general").alias("target"), base.alias("query")), *[F.struct(F.lit(t).alias("target"), F.concat(base, F.lit(f" {t}")).alias("query")) for t in dict.fromkeys(targets)])
    rows = products.select(products.columns[0], F.posexplode(F.slice(plans, 1, most)).alias("pos", "p"))
    return rows.select(products.columns[0], F.concat(F.col("pos").cast("string"), F.lit("-"), "p.target").alias("query_id"), "p.target", "p.query")
