"""Product pages: a small element tree per page, and what is read from it, as Arrow-batched UDFs that return arrays.

Walking a tree is sequential and recursive, so this is Python; everything behind it (filters, ranks, dedupe) is native.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))
BLOCK = frozenset("p div section article li ul ol tr td th h1 h2 h3 h4 h5 h6 details summary dl dt dd br header footer main table".split())


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self, hidden: bool = False) -> str:
        """The text below, blocks apart, white space collapsed."""
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif hidden or x.tag not in HIDDEN:
                if x.tag in BLOCK:
                    parts.append(" ")
                    stack.append(" ")
                stack.extend(reversed(x.children))
        return " ".join("".join(parts).split())

    def raw(self) -> str:
        return "".join(c if isinstance(c, str) else c.raw() for c in self.children)

    def says(self, *names: str) -> str:
        return " ".join(self.attributes[n] for n in names if self.attributes.get(n))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("root")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, [], self.now))

    def handle_endtag(self, tag):
        node = self.now
        while node.parent is not None:
            if node.tag == tag:
                self.now = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# JSON in pages


def parse_json(text: str | None):
    """An object or array, or None; other JSON values do not count."""
    t = (text or "").strip()
    if t[:1] not in ("{", "["):
        return None
    try:
        return json.loads(t)
    except ValueError:
        return None


def flatten_json_ld(value) -> Iterator[dict]:
    """Records of arrays and ``@graph``, a parent before its graph."""
    if isinstance(value, list):
        for v in value:
            yield from flatten_json_ld(v)
    elif isinstance(value, dict):
        yield value
        yield from flatten_json_ld(value.get("@graph", []))


def json_ld_nodes(html: str | None) -> list[dict]:
    found: list[dict] = []
    for node in parse(html).all("script"):
        if node.attributes.get("type", "").lower() == "application/ld+json":
            found.extend(flatten_json_ld(parse_json(node.raw())))
    return found


def has_type(node: dict, name: str) -> bool:
    kinds = node.get("@type", node.get("type"))
    return any(isinstance(k, str) and k.lower() == name.lower() for k in (kinds if isinstance(kinds, list) else [kinds]))


def balanced_object(text: str, start: int) -> str | None:
    """The object literal that begins there, braces in strings aside."""
    if text[start : start + 1] != "{":
        return None
    depth, at = 0, start
    for m in re.compile(r"""[{}]|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`""", re.S).finditer(text, start):
        at = m.end()
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start:at]
    return None


def expand_state(value, depth: int = 0) -> Iterator:
    """The value, all containers below and JSON inside strings, five levels deep."""
    if depth > 5:
        return
    yield value
    if isinstance(value, str):
        if (inner := parse_json(value)) is not None:
            yield from expand_state(inner, depth + 1)
        return
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if isinstance(child, str):
            if (inner := parse_json(child)) is not None:
                yield from expand_state(inner, depth + 1)
        elif isinstance(child, (dict, list)):
            yield from expand_state(child, depth + 1)


#: Names that page scripts assign state to. Fixed values.
ASSIGNED = re.compile(r"(?:window\.)?(?:__INITIAL_STATE__|__PRELOADED_STATE__|__PRODUCT__|initialState|product(?:Detail|Info|Data|State)?)\s*=\s*(?=\{)", re.I)
MOST_STATES = 24


def object_literal(text: str | None):
    """JSON, or an object literal with bare keys and trailing commas."""
    if (value := parse_json(text)) is None and text:
        value = parse_json(re.sub(r",\s*([}\]])", r"\1", re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)\s*:", r'\1"\2":', text)))
    return value


def client_states(html: str | None) -> list:
    """State in script elements and assignments, the first of those with equal keys, 24 at most."""
    found: list = []
    scripts = parse(html).all("script")
    for s in scripts:
        kind = s.attributes.get("type", "").lower()
        if (kind == "application/json" or s.attributes.get("id") == "__NEXT_DATA__") and (value := parse_json(s.raw())) is not None:
            found.extend(expand_state(value))
    for s in scripts:
        if s.attributes.get("type", "").lower() in ("", "text/javascript", "application/javascript"):
            raw = s.raw()
            for m in ASSIGNED.finditer(raw):
                if (value := object_literal(balanced_object(raw, m.end()))) is not None:
                    found.extend(expand_state(value))
    once: dict[str, object] = {}
    for v in found:
        once.setdefault("|".join(list(v)[:12]) if isinstance(v, dict) else f"{len(v)}|" if isinstance(v, list) else str(v)[:120], v)
    return list(once.values())[:MOST_STATES]


#: Keys that never lead to the product. Fixed values.
SKIPPED_KEYS = frozenset("auth account cart order coupon favorite delivery ship seller payment popup dialog loading form header footer navigation menu category event banner recommend recent cache".split())
PRODUCT_KEYS = re.compile("online prod name|product name|prod name|line promo desc|price info|online images|images|ingredients|disclosures|detail desc|review info", re.I)
PRODUCT_NOUN, PRODUCT_FIELD = re.compile("product|prod|goods|item|sku|상품|제품", re.I), re.compile("name|title|price|image|review|ingredient|description|desc|summary", re.I)


def key_words(key: str) -> str:
    return re.sub(r"[_\-\s]+", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", key)).lower().strip()


def product_records(value, depth: int = 0) -> Iterator[dict]:
    """Records whose keys read like a product's, seven levels deep, an outer one first."""
    if depth > 7:
        return
    if isinstance(value, dict):
        keys = " ".join(map(key_words, value))
        if PRODUCT_KEYS.search(keys) or (PRODUCT_NOUN.search(keys) and PRODUCT_FIELD.search(keys)):
            yield value
        for k, v in value.items():
            if k.lower() not in SKIPPED_KEYS:
                yield from product_records(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from product_records(v, depth + 1)


#: Section categories by key, first match counts. Fixed values.
KEY_CATEGORIES = (("ingredient", "ingredient|성분|원료"), ("usage", "how to use|usage|direction|ritual|routine|사용"), ("benefit", "benefit|advantage|good for|장점|효능"), ("effect", "effect|result|efficacy|clinical|효과|결과"), ("faq", "faq|question|질문"), ("review", "review|리뷰|후기"), ("product", "description|detail|summary|desc|설명"))


def key_category(key: str) -> str | None:
    words = key_words(key)
    return next((c for c, p in KEY_CATEGORIES if re.search(p, words)), None)


def keyed_sections(value, most: int = 32) -> list[tuple[str, str, str]]:
    """``(category, key, text)`` of texts of 12 characters or more under telling keys, five levels deep."""
    found: list[tuple[str, str, str]] = []

    def visit(v, key: str | None, category: str | None, depth: int) -> None:
        if len(found) >= most or depth > 5:
            return
        if isinstance(v, str):
            text = parse(v).text() if "<" in v else " ".join(v.split())
            if category and len(text) >= 12:
                found.append((category, key or "", text))
        elif isinstance(v, list):
            for x in v:
                visit(x, key, category, depth + 1)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k.lower() not in SKIPPED_KEYS:
                    own = key_category(k)
                    visit(x, k if own else key, own or category, depth + 1)

    visit(value, None, None, 0)
    return found


def all_strings(value, depth: int = 0) -> Iterator[str]:
    """Every string and number below, eight levels deep, in order."""
    if depth > 8 or value is None or isinstance(value, bool):
        return
    if isinstance(value, (str, int, float)):
        if text := " ".join(str(value).split()):
            yield text
    else:
        for v in value.values() if isinstance(value, dict) else value:
            yield from all_strings(v, depth + 1)


PREFERRED = ("src", "url", "imgUrl", "name", "value", "text")


def flat_values(value) -> list[str]:
    """Texts of a value; a record gives its preferred field."""
    if isinstance(value, list):
        return [t for v in value for t in flat_values(v)]
    if isinstance(value, dict):
        for k in PREFERRED:
            if (found := flat_values(value.get(k))) if value.get(k) is not None else None:
                return found
        return []
    return list(all_strings(value))


def keyed_texts(value, pattern: str, path: str = "$", depth: int = 0) -> Iterator[tuple[str, str, str]]:
    """``(path, key, text)`` under keys that match, review subtrees left out."""
    if depth > 8:
        return
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        if isinstance(k, str) and re.search("review|리뷰|후기", k, re.I):
            continue
        at = f"{path}.{k}" if isinstance(k, str) else f"{path}[{k}]"
        if isinstance(k, str) and re.search(pattern, k, re.I):
            for t in flat_values(v):
                yield at, k, t
        else:
            yield from keyed_texts(v, pattern, at, depth + 1)


# elements


QUESTION = re.compile(r"[?？]\s*$|^(what|how|why|when|who|can|does|do|is|are|should|which)\b|(인가요|나요|까요|무엇|어떻게)", re.I)


def dom_faq(html: str | None) -> list[tuple[str, str]]:
    """Questions and answers of details elements and of buttons that control a panel."""
    root = parse(html)
    by_id = {n.attributes["id"]: n for n in root.walk() if n.attributes.get("id")}
    pairs: list[tuple[str, str]] = []
    for d in root.all("details"):
        if heads := d.all("summary"):
            q = heads[0].text()
            pairs.append((q, d.text()[len(q) :].strip() if d.text().startswith(q) else d.text()))
    for b in root.walk():
        panel = by_id.get(b.attributes.get("aria-controls", ""))
        if panel is not None and (b.tag == "button" or b.attributes.get("role") == "button"):
            pairs.append((b.text(), panel.text()))
    once: dict[str, tuple[str, str]] = {}
    for q, a in pairs:
        if QUESTION.search(q) and len(a) >= 2:
            once.setdefault(" ".join(re.findall(r"\w+", f"{q}:{a}".lower())), (q, a))
    return list(once.values())


RATING = re.compile(r"([1-5](?:\.\d+)?)\s*(?:out of|/)\s*5|([1-5](?:\.\d+)?)\s*(?:stars?|점|별점)|(?:rating|평점|별점)\D{0,20}([1-5](?:\.\d+)?)", re.I)


def rating_of(text: str | None) -> float | None:
    m = RATING.search(text or "")
    return float(m[1] or m[2] or m[3]) if m else None


def dom_reviews(html: str | None, most: int = 12) -> list[tuple[str, str | None, float | None, str | None]]:
    """``(body, author, rating, date)`` of review cards: elements marked as a review, or with a review class."""
    found: dict[str, tuple] = {}
    for n in parse(html).walk():
        marks = n.says("class", "itemprop", "itemtype", "data-testid").lower()
        if not re.search(r"(^|[\s_/-])review(-?item|-?card|s__item)?($|[\s])", marks):
            continue

        def part(pattern: str, n: Node = n) -> Node | None:
            return next((c for c in n.walk() if c is not n and re.search(pattern, c.says("class", "itemprop", "data-testid"), re.I)), None)

        body, author, when, stars = part("reviewbody|review-?(body|text|content)|body"), part("author|name|user"), part("date|published"), part("rating|star")
        text = body.text() if body else n.text()
        rating = next((r for r in (rating_of(x) for x in ((stars.says("content", "aria-label", "data-rating") + " stars", stars.text()) if stars else ()) if x) if r), None) if stars else rating_of(n.says("aria-label"))
        if len(text) >= 12:
            found.setdefault(" ".join(re.findall(r"\w+", text.lower())), (text, author.text() if author else None, rating, (when.says("content", "datetime") or when.text()) if when else None))
    return list(found.values())[:most]


SECTIONS = frozenset(("section", "article", "details"))
TELLING = re.compile("benefit|ingredient|ritual|result|faq|accordion|pdp|how-?to-?use", re.I)


def text_blocks(html: str | None) -> list[tuple[int, str, str]]:
    """``(place, heading, text)`` of sections and of elements whose class or id tells of product text; the native part filters and ranks."""
    root = parse(html)
    top = next(iter(root.all("main") or root.all("body")), root)
    out = []
    for n in top.walk():
        if n.tag in SECTIONS or TELLING.search(n.says("class", "id")):
            heads = n.all("h1", "h2", "h3", "h4", "summary")
            if text := n.text():
                out.append((len(out) + 1, heads[0].text() if heads else f"Page section {len(out) + 1}", text))
    return out


def page_text(html: str | None) -> str:
    """Headings, paragraphs and list items, with full stops between."""
    return ". ".join(t for n in parse(html).all("h1", "h2", "h3", "h4", "p", "li") if (t := n.text()))


def meta_tags(html: str | None) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in parse(html).all("meta"):
        name = n.attributes.get("name") or n.attributes.get("property")
        if name and n.attributes.get("content"):
            out.setdefault(name, " ".join(n.attributes["content"].split()))
    return out


IMAGE_URL = re.compile(r"https?:(?:\\?/){2}[^\s\"'<>()\\]+?\.(?:jpe?g|png|webp|gif)(?:\?[^\s\"'<>()\\]*)?", re.I)


def raw_image_urls(html: str | None, around: int = 900) -> list[tuple[str, int, str]]:
    """Image addresses anywhere in the page with their position and surroundings."""
    t = html or ""
    return [(m[0].replace("\\/", "/"), m.start(), t[max(0, m.start() - around) : m.end() + around]) for m in IMAGE_URL.finditer(t)]


def srcset_urls(value: str | None) -> list[str]:
    return [p.split()[0] for p in (value or "").split(",") if p.split()]


def image_urls(html: str | None, base: str | None) -> list[str]:
    """Addresses of img and source elements, resolved, the first of equal ones."""
    out: dict[str, None] = {}
    for n in parse(html).all("img", "source"):
        for u in (n.attributes.get("src"), n.attributes.get("data-src"), *srcset_urls(n.attributes.get("srcset"))):
            if u and not u.startswith("data:"):
                out.setdefault(urljoin(base or "", u))
    return list(out)


# as columns


def _column(f: Callable, kind: str) -> Callable[..., Column]:
    """The function as a column function; the UDF is made when it is used, a session being there."""

    def made(*columns: Column) -> Column:
        if len(columns) == 1:

            def run(first: pd.Series) -> pd.Series:
                return first.map(f)
        else:

            def run(first: pd.Series, second: pd.Series) -> pd.Series:
                return pd.Series([f(x, y) for x, y in zip(first, second, strict=True)], dtype=object)

        return F.pandas_udf(run, kind)(*columns)

    return made


dump = lambda values: [json.dumps(v, ensure_ascii=False) for v in values]
json_ld_column = _column(lambda h: dump(json_ld_nodes(h)), "array<string>")
client_state_column = _column(lambda h: dump(client_states(h)), "array<string>")
product_record_column = _column(lambda t: dump(product_records(parse_json(t))), "array<string>")
keyed_section_column = _column(lambda t: [{"category": c, "key": k, "text": x} for c, k, x in keyed_sections(parse_json(t))], "array<struct<category:string,key:string,text:string>>")
string_column = _column(lambda t: list(all_strings(parse_json(t))), "array<string>")
faq_column = _column(lambda h: [{"question": q, "answer": a} for q, a in dom_faq(h)], "array<struct<question:string,answer:string>>")
review_column = _column(lambda h: [{"body": b, "author": a, "rating": r, "date": d} for b, a, r, d in dom_reviews(h)], "array<struct<body:string,author:string,rating:double,date:string>>")
block_column = _column(lambda h: [{"place": p, "title": t, "text": x} for p, t, x in text_blocks(h)], "array<struct<place:int,title:string,text:string>>")
page_text_column = _column(page_text, "string")
meta_column = _column(meta_tags, "map<string,string>")
image_url_column = _column(image_urls, "array<string>")
absolute_url = _column(lambda u, base: None if u is None else urljoin(base or "", u), "string")


def _nfkc(text: str | None) -> str | None:
    import unicodedata

    return None if text is None else unicodedata.normalize("NFKC", text)


nfkc = _column(_nfkc, "string")
