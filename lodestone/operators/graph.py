"""JSON-LD graphs: node rules, references, renderings and validation findings.

A document is a JSON string; rules are small functions from a node to its repaired form and findings, run in Arrow batches.
Nothing is applied unless asked: ``findings`` reports, ``repair`` returns the repaired document too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.pages import flatten_json_ld, parse_json

Finding = dict[str, str | None]


def text_of(value) -> str | None:
    return " ".join(value.split()) or None if isinstance(value, str) else None


def items_of(value) -> list[dict]:
    return [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]


def faq_pairs(node: dict) -> list[tuple[str, str]]:
    found = []
    for item in items_of(node.get("mainEntity")):
        answer = item.get("acceptedAnswer")
        q, a = text_of(item.get("name")), text_of(answer.get("text")) if isinstance(answer, dict) else None
        if q and a:
            found.append((q, a))
    return found


def steps_of(node: dict) -> list[dict]:
    return [s for s in items_of(node.get("step")) if text_of(s.get("text"))]


def valid_how_to(node: dict) -> bool:
    """Named, with a step at least, positions from 1 without gaps."""
    steps = steps_of(node)
    return bool(text_of(node.get("name")) and steps) and all(str(s.get("position")) == str(i) for i, s in enumerate(steps, 1))


def render_faq(graph: list[dict]) -> str:
    return "\n\n".join(f"Q. {q}\nA. {a}" for n in graph if n.get("@type") == "FAQPage" for q, a in faq_pairs(n))


def render_how_to(graph: list[dict]) -> str:
    steps = [text_of(s["text"]) for n in graph if n.get("@type") == "HowTo" for s in steps_of(n)]
    return "\n".join(f"{i}. {t}" for i, t in enumerate(steps, 1))


def normalize_offer(node) -> dict | None:
    """An offer with a three-letter currency and a price above 0."""
    if not isinstance(node, dict):
        return None
    price = re.sub(r"[^0-9.]", "", str(node.get("price", "")))
    currency = str(node.get("priceCurrency") or "").strip().upper()
    try:
        amount = float(price)
    except ValueError:
        return None
    return {**node, "@type": "Offer", "price": amount, "priceCurrency": currency} if re.fullmatch("[A-Z]{3}", currency) and amount > 0 else None


def normalize_rating(node) -> dict | None:
    """A rating above 0 up to 5 with a count above 0."""
    try:
        value, count = float(node.get("ratingValue")), float(node.get("reviewCount") or node.get("ratingCount"))
    except (AttributeError, TypeError, ValueError):
        return None
    return {**node, "@type": "AggregateRating", "ratingValue": value, "reviewCount": int(count)} if 0 < value <= 5 and count > 0 else None


def meaningful_review(body: str | None) -> bool:
    t = text_of(body) or ""
    return 20 <= len(t) <= 600 and not re.fullmatch(r"(rating|평점|별점)?[\s:]*[\d.]+\s*(/|out of)?\s*5?.{0,12}", t, re.I) and (len(t.split()) >= 4 or bool(re.search(r"[぀-ヿ㐀-鿿가-힯]", t)))


def secure_image(url: str | None) -> str | None:
    t = (url or "").strip().split("#")[0]
    if not t or t.startswith("data:") or re.search(r"\.svg(\?|$)", t, re.I):
        return None
    t = re.sub("^http://", "https://", re.sub("^//", "https://", t), flags=re.I)
    return t if t.startswith("https://") else None


def _finding(field: str, issue: str, action: str, before=None, after=None) -> Finding:
    dump = lambda v: None if v is None else json.dumps(v, ensure_ascii=False)
    return {"field": field, "issue": issue, "action": action, "before": dump(before), "after": dump(after)}


def _product(node: dict) -> Iterator[tuple[dict, Finding | None]]:
    node = dict(node)
    images = node.get("image")
    if images is not None:
        once: dict[str, str] = {}
        for u in images if isinstance(images, list) else [images]:
            if safe := secure_image(u.get("url") if isinstance(u, dict) else u if isinstance(u, str) else None):
                once.setdefault(re.sub(r"_(?:\d+x\d*|x\d+)(?=\.[a-z]{3,5}$)", "", safe.split("?")[0].lower()), safe)
        kept = list(once.values())[:8]
        if kept != images:
            yield node, _finding("Product.image", "Images were insecure, repeated or not images.", "Kept secure distinct images.", images, kept)
        node["image"] = kept
        if not kept:
            del node["image"]
    for key, rule in (("offers", normalize_offer), ("aggregateRating", normalize_rating)):
        if key in node:
            value = node[key][0] if isinstance(node[key], list) and node[key] else node[key]
            good = rule(value)
            if good != node[key]:
                yield node, _finding(f"Product.{key}", f"{key} was incomplete or not normalised.", "Normalised it." if good else "Removed it.", node[key], good)
            if good:
                node[key] = good
            else:
                del node[key]
    if "review" in node:
        reviews = items_of(node["review"])
        good_reviews = [r for r in reviews if meaningful_review(r.get("reviewBody"))]
        if len(good_reviews) != len(reviews):
            yield node, _finding("Product.review", "Reviews without a meaningful body.", "Removed them.", reviews, good_reviews)
        node["review"] = good_reviews
        if not good_reviews:
            del node["review"]
    yield node, None


def _breadcrumbs(node: dict) -> Iterator[tuple[dict, Finding | None]]:
    items = items_of(node.get("itemListElement"))
    named = [i for i in items if text_of(i.get("name") or (i.get("item") or {}).get("name") if isinstance(i.get("item"), dict) else i.get("name"))]
    numbered = [{**i, "position": k} for k, i in enumerate(named, 1)]
    if numbered != items:
        yield node, _finding("BreadcrumbList.itemListElement", "Items were unnamed or not numbered from 1.", "Dropped unnamed items and renumbered.", items, numbered)
    node = {**node, "itemListElement": numbered}
    if len(numbered) < 2:
        yield node, _finding("BreadcrumbList", "Fewer than two items.", "Reported only.")
    yield node, None


#: Types whose language must be the document's. Fixed values.
LOCALIZED = ("WebPage", "FAQPage", "HowTo", "Article")


def repair_graph(document: str | None, locale: str) -> tuple[str | None, list[Finding]]:
    """The repaired document and what was found: context and graph, required nodes, node rules, languages, empty collections, dangling references."""
    value = parse_json(document)
    if value is None:
        return None, [_finding("@graph", "The document is no JSON object.", "Nothing could be repaired.")]
    found: list[Finding] = []
    nodes = [n for n in flatten_json_ld(value) if "@graph" not in n or n.get("@type")]
    nodes = [{k: v for k, v in n.items() if k not in ("@graph", "@context")} for n in nodes]
    if not (isinstance(value, dict) and value.get("@context") and isinstance(value.get("@graph"), list)):
        found.append(_finding("@context", "Context or graph was missing.", "Wrapped the nodes in a graph."))
    products = [n for n in nodes if n.get("@type") == "Product"]
    if not products:
        found.append(_finding("Product", "No Product node.", "Reported only."))
    for n in products:
        for key in ("name", "description"):
            if not text_of(n.get(key)):
                found.append(_finding(f"Product.{key}", f"{key} is missing.", "Reported only."))
    out, removed = [], set()
    for n in nodes:
        kind = n.get("@type")
        empty = kind == "FAQPage" and not faq_pairs(n) or kind == "HowTo" and not valid_how_to(n)
        if empty:
            removed.add(n.get("@id"))
            found.append(_finding(kind, f"{kind} has no valid items.", "Removed the node.", n))
            continue
        for n, f in {"Product": _product, "BreadcrumbList": _breadcrumbs}.get(kind, lambda x: iter([(x, None)]))(n):
            if f:
                found.append(f)
        if kind in LOCALIZED and n.get("inLanguage") != locale:
            found.append(_finding(f"{kind}.inLanguage", "Language differs from the document's.", "Set it.", n.get("inLanguage"), locale))
            n = {**n, "inLanguage": locale}
        out.append(n)
    ids = {n.get("@id") for n in out}
    for n in out:
        if n.get("@type") == "WebPage" and n.get("hasPart") is not None:
            parts = n["hasPart"] if isinstance(n["hasPart"], list) else [n["hasPart"]]
            own = str(n.get("@id") or "").split("#")[0]

            def lost(p, own: str = own) -> bool:
                ref = p.get("@id") if isinstance(p, dict) else None
                return bool(ref) and ref not in ids and (ref in removed or ref.startswith("#") or bool(own) and ref.split("#")[0] == own)

            kept = [p for p in parts if not lost(p)]
            if len(kept) != len(parts):
                found.append(_finding("WebPage.hasPart", "References to nodes that are not there.", "Dropped them.", parts, kept))
                if kept:
                    n["hasPart"] = kept if isinstance(n["hasPart"], list) else kept[0]
                else:
                    del n["hasPart"]
    return json.dumps({"@context": "https://schema.org", "@graph": out}, ensure_ascii=False), found


FINDING = "struct<field:string,issue:string,action:string,before:string,after:string>"


def repair(document: Column, locale: Column) -> Column:
    """``struct<document, findings>``."""

    @F.pandas_udf(f"struct<document:string,findings:array<{FINDING}>>")
    def run(documents: pd.Series, locales: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(("document", "findings"), repair_graph(d, loc), strict=True)) for d, loc in zip(documents, locales, strict=True)], columns=["document", "findings"])

    return run(document, locale)


def findings(document: Column, locale: Column) -> Column:
    """What a repair would change; the document stays as it is."""
    return repair(document, locale)["findings"]


def visible_matches_graph(document: Column, faq_text: Column, usage_text: Column) -> Column:
    """Whether visible FAQ and usage texts equal the graph's rendering."""

    @F.pandas_udf("boolean")
    def run(documents: pd.Series, faqs: pd.Series, usages: pd.Series) -> pd.Series:
        out = []
        for d, f, u in zip(documents, faqs, usages, strict=True):
            graph = list(flatten_json_ld(parse_json(d) or []))
            out.append(render_faq(graph) == (f or "").strip() and render_how_to(graph) == (u or "").strip())
        return pd.Series(out, dtype=bool)

    return run(document, faq_text, usage_text)


def script_matches(script: Column, document: Column) -> Column:
    """Whether a script element holds the same JSON as the document."""

    @F.pandas_udf("boolean")
    def run(scripts: pd.Series, documents: pd.Series) -> pd.Series:
        inner = lambda s: re.sub(r"(?is)^\s*<script[^>]*>|</script>\s*$", "", s or "")
        return pd.Series([(a := parse_json(inner(s))) is not None and a == parse_json(d) for s, d in zip(scripts, documents, strict=True)], dtype=bool)

    return run(script, document)
