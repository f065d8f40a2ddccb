"""Product payloads of any shape to one product row: candidate paths over variants, then walkers for what paths do not reach."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import pages as P

#: Wrappers around a product, and candidate paths of each signal, in order of preference. Fixed values.
WRAPPERS = ("$.geoProduct", "$.result.geoProduct", "$.product", "$.data.product")
PATHS = {
    "name": ("name", "title", "productName", "product_name", "onlineProdName"),
    "brand": ("brand.name", "brand", "vendor", "brandName"),
    "description": ("description", "body_html", "summary", "linePromoDesc"),
    "category": ("category", "product_type", "productType"),
    "price": ("price", "offers.price", "variants[0].price", "priceInfo.price"),
    "currency": ("currency", "offers.priceCurrency", "priceCurrency"),
    "url": ("url", "link", "canonicalUrl"),
    "rating": ("aggregateRating.ratingValue", "rating", "reviewInfo.rating"),
    "review_count": ("aggregateRating.reviewCount", "reviewCount", "reviewInfo.count"),
}
LISTS = {"images": ("images", "image", "media"), "options": ("options", "variants"), "benefits": ("benefits", "advantages"), "effects": ("effects", "results"), "ingredients": ("ingredients", "keyIngredients"), "usage": ("usage", "howToUse", "directions")}


def json_value(text: Column) -> Column:
    """A variant of an object or array; null for anything else or bad JSON."""
    return F.when(F.ltrim(text).rlike(r"^[{\[]"), F.try_parse_json(text))


def unwrap(value: Column) -> Column:
    """The product inside known wrappers, else the value."""
    return F.coalesce(*[F.try_variant_get(value, p, "variant") for p in WRAPPERS], value)


def at(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, "$." + path, kind)


def first_of(value: Column, paths: tuple[str, ...]) -> Column:
    """The first path that holds a text or number; empty counts as absent."""
    return F.coalesce(*[F.nullif(T.clean_text(at(value, p)), F.lit("")) for p in paths])


def normalize(df: DataFrame, key: str, payload: str, mapping: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``key``, a column for each signal, and lists of texts. Paths of ``mapping`` go before the default ones. Bad JSON gives nulls."""
    mapping = mapping or {}
    rows = df.select(key, unwrap(json_value(F.col(payload))).alias("v"))

    @F.pandas_udf("array<string>")
    def flat(values: pd.Series) -> pd.Series:
        return values.map(lambda t: list(dict.fromkeys(P.flat_values(json.loads(t)))) if t else [])

    v = F.col("v")
    plain = [first_of(v, (*mapping.get(n, ()), *paths)).alias(n) for n, paths in PATHS.items()]
    lists = [flat(F.coalesce(*[F.to_json(at(v, p, "variant")) for p in (*mapping.get(n, ()), *paths)])).alias(n) for n, paths in LISTS.items()]
    made = rows.select(key, *plain, *lists)
    made = made.withColumns({"amount": T.price_amount(F.col("price")), "rating": T.price_amount(F.col("rating")), "review_count": T.price_amount(F.col("review_count"))})
    return made.withColumn("locale", T.infer_locale(F.concat_ws(" ", "name", "description"))).withColumn("market", T.market_of(F.col("locale")))


def from_pages(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """A product row of each page: JSON-LD, then client state, then meta tags and title; first defined value counts."""
    rows = df.select(key, url, P.json_ld_column(F.col(html)).alias("nodes"), P.client_state_column(F.col(html)).alias("states"), P.meta_column(F.col(html)).alias("meta"), P.faq_column(F.col(html)).alias("faq"), P.review_column(F.col(html)).alias("reviews"), F.col(html).alias("_html"))
    typed = F.filter("nodes", lambda n: F.lower(F.try_variant_get(F.try_parse_json(n), "$['@type']", "string")) == "product")
    node = F.try_parse_json(F.get(typed, 0))
    state = unwrap(F.try_parse_json(F.get("states", 0)))
    from lodestone.functions.web import html_title, product_handle

    names = F.coalesce(first_of(node, PATHS["name"]), first_of(state, PATHS["name"]), F.col("meta")["og:title"], F.nullif(html_title(F.col("_html")), F.lit("")))
    return rows.select(
        key, F.col(url).alias("url"), product_handle(F.col(url)).alias("handle"), names.alias("name"), F.coalesce(first_of(node, PATHS["brand"]), first_of(state, PATHS["brand"]), F.col("meta")["product:brand"]).alias("brand"),
        F.coalesce(first_of(node, PATHS["description"]), F.col("meta")["description"], F.col("meta")["og:description"], first_of(state, PATHS["description"])).alias("description"), first_of(node, PATHS["price"]).alias("price"), first_of(node, PATHS["currency"]).alias("currency"),
        T.price_amount(first_of(node, PATHS["rating"])).alias("rating"), T.price_amount(first_of(node, PATHS["review_count"])).alias("review_count"), P.image_url_column(F.col("_html"), F.col(url)).alias("images"), "faq", "reviews",
    )


def evidence_ledger(products: DataFrame, key: str) -> DataFrame:
    """Evidence atoms ``key, evidence_id, role, text, source_path, locale, confidence`` of product rows, the first of equal (role, text) kept."""
    from pyspark.sql import Window

    roles = (("identity", "name", 0.95), ("identity", "brand", 0.95), ("description", "description", 0.85))
    lists = (("benefit", "benefits", 0.85), ("effect", "effects", 0.85), ("ingredient", "ingredients", 0.9), ("usage", "usage", 0.85))
    atom = lambda role, path, text, conf: F.struct(F.lit(role).alias("role"), path.alias("source_path"), text.alias("text"), F.lit(conf).alias("confidence"))

    def listed(role: str, name: str, confidence: float) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x, i: atom(role, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), x, confidence))

    every = F.concat(F.array(*[atom(r, F.lit(c), F.col(c), k) for r, c, k in roles]), *[listed(*x) for x in lists])
    rows = products.select(key, "locale", F.posexplode(every).alias("ord", "a")).select(key, "locale", "ord", "a.*").where(F.coalesce(F.trim("text"), F.lit("")) != "")
    first = Window.partitionBy(key, "role", F.lower("text")).orderBy("ord")
    rows = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    name = F.concat(F.col("role"), F.lit("-"), T.base36(T.fnv1a(F.concat_ws("|", "role", F.lower("text")))))
    return rows.select(key, name.alias("evidence_id"), "role", T.clean_text(F.col("text")).alias("text"), "source_path", "locale", "confidence", "ord")


def artifact(products: DataFrame, key: str) -> DataFrame:
    """``key, artifact``: the product row as one JSON document; null fields are left out."""
    return products.select(key, F.to_json(F.struct(*[c for c in products.columns if c != key])).alias("artifact"))


def patch_artifacts(df: DataFrame, key: str, document: str, patch: str) -> DataFrame:
    """``key, document, changes``: a JSON merge patch, or lines such as ``set name to X`` and ``remove price``, with the paths that changed."""

    @F.pandas_udf("struct<document:string,changes:array<string>>")
    def run(documents: pd.Series, patches: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(("document", "changes"), apply_patch(d, p), strict=True)) for d, p in zip(documents, patches, strict=True)], columns=["document", "changes"])

    return df.select(key, run(F.col(document), F.col(patch)).alias("r")).select(key, "r.document", "r.changes")


def apply_patch(document: str | None, patch: str | None) -> tuple[str | None, list[str]]:
    import re

    value = P.parse_json(document)
    if not isinstance(value, dict):
        return document, []
    changes: list[str] = []
    wanted = P.parse_json(patch)
    if wanted is None:
        wanted = {}
        for line in re.split(r"[\n;]+", patch or ""):
            if m := re.match(r"\s*(?:set|change)\s+(\w+)\s+to\s+(.+?)\s*$", line, re.I):
                wanted[m[1]] = m[2]
            elif m := re.match(r"\s*(?:remove|delete)\s+(\w+)\s*$", line, re.I):
                wanted[m[1]] = None

    def merge(target: dict, source: dict, path: str) -> None:
        for k, v in source.items():
            at_path = f"{path}.{k}" if path else k
            if v is None:
                if k in target:
                    del target[k]
                    changes.append(at_path)
            elif isinstance(v, dict) and isinstance(target.get(k), dict):
                merge(target[k], v, at_path)
            elif target.get(k) != v:
                target[k] = v
                changes.append(at_path)

    if isinstance(wanted, dict):
        merge(value, wanted, "")
    return json.dumps(value, ensure_ascii=False), changes
