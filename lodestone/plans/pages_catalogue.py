"""Registered queries of page, payload, graph, policy and usage operators.

Pages and payloads are made of every row of ``benchmark`` by a template, so that SQL can say what must be read from them; where an
operator's rule has no counterpart in SQL, what must come out of a small fixture was worked out by hand.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import text as T
from lodestone.functions import web as H
from lodestone.operators import aggregates, chunking, dedupe, extraction, gates, graph, pages, policy, scope, selection, source_texts
from lodestone.plans.catalogue import query, read
from lodestone.plans.fixtures import expected
from lodestone.sources import documents, products

PAGE = """<html><head><title>Dew Cream № &amp; Co</title><meta name="description" content="A cream for dry skin, number №.">
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Dew Cream №", "brand": {"name": "Moss"}, "offers": {"price": "№.50", "priceCurrency": "EUR"}, "aggregateRating": {"ratingValue": "4.6", "reviewCount": "№"}}]}</script>
<script type="application/ld+json">{broken</script>
<script>window.__INITIAL_STATE__ = {productName: "Dew Cream №", note: "a } in a string", price_info: {"price": 24.5,},};</script>
<script id="__NEXT_DATA__" type="application/json">{"props": "{\\"prodName\\": \\"Next №\\", \\"images\\": [\\"/a.jpg\\"]}"}</script></head>
<body><div class="modal">Subscribe</div><main><h1>Dew Cream №</h1><img src="/img/№_400x.jpg" srcset="/img/b№.jpg 1x, /img/c.jpg 2x">
<section class="ingredient"><h2>Ingredients</h2><p>Water, glycerin and ceramide №.</p></section>
<details><summary>How do I use number №?</summary><p>Apply morning and night.</p></details>
<button aria-controls="p1">Is it safe for dry skin?</button><div id="p1">Yes, № is.</div>
<div class="review"><span class="author">Ann №</span><meta itemprop="ratingValue" content="5"><p class="body">Smooth and light on my skin, № times.</p></div></main></body></html>"""


def made_pages(spark, sf_dir):
    number = F.col("item_id").cast("string")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"), F.concat(F.lit("https://x.example/products/dew-cream-"), number, F.lit("?x=1")).alias("url"), F.replace(F.lit(PAGE), F.lit("№"), number).alias("html"))


def fixture(spark, kinds: str, rows):
    return spark.createDataFrame(rows, kinds)


# pages


@query(
    """select item_id as page_id, 'dew-cream-' || item_id as handle, 'Dew Cream ' || item_id as name, 'Moss' as brand, item_id || '.50' as price, 'EUR' as currency, 4.6::double as rating, item_id::double as review_count,
    'A cream for dry skin, number ' || item_id || '.' as description, 'https://x.example/img/' || item_id || '_400x.jpg|https://x.example/img/b' || item_id || '.jpg|https://x.example/img/c.jpg' as images from benchmark"""
)
def page_products(spark, sf_dir):
    """A product row of each page: structured data, client state, meta tags, images with their sources."""
    made = products.from_pages(made_pages(spark, sf_dir), "page_id", "url", "html")
    return made.select("page_id", "handle", "name", "brand", "price", "currency", "rating", "review_count", "description", F.array_join("images", "|").alias("images"))


@query("select item_id as page_id, 'How do I use number ' || item_id || '?' as question, 'Apply morning and night.' as answer from benchmark union all select item_id, 'Is it safe for dry skin?', 'Yes, ' || item_id || ' is.' from benchmark")
def page_questions(spark, sf_dir):
    """Questions and answers of disclosure elements and controlled panels."""
    p = made_pages(spark, sf_dir)
    return p.select("page_id", F.inline(pages.faq_column(F.col("html"))))


@query("select item_id as page_id, 'Smooth and light on my skin, ' || item_id || ' times.' as body, 'Ann ' || item_id as author, 5.0::double as rating from benchmark")
def page_reviews(spark, sf_dir):
    """Review cards."""
    p = made_pages(spark, sf_dir)
    return p.select("page_id", F.inline(pages.review_column(F.col("html")))).select("page_id", "body", "author", "rating")


@query("select item_id as page_id, name, kind from benchmark, lateral (values ('Dew Cream ' || item_id, 'state'), ('Next ' || item_id, 'state'), ('Dew Cream ' || item_id, 'node')) v(name, kind)")
def page_states(spark, sf_dir):
    """Product names in client state (assigned literals, JSON in strings) and in structured data; broken scripts are passed over."""
    p = made_pages(spark, sf_dir)
    states = p.select("page_id", F.explode(pages.client_state_column(F.col("html"))).alias("s"))
    named = states.select("page_id", F.coalesce(F.get_json_object("s", "$.productName"), F.get_json_object("s", "$.prodName")).alias("name"), F.lit("state").alias("kind")).where("name is not null").distinct()
    nodes = p.select("page_id", F.explode(pages.json_ld_column(F.col("html"))).alias("s")).where(F.get_json_object("s", "$['@type']") == "Product")
    return named.unionByName(nodes.select("page_id", F.get_json_object("s", "$.name").alias("name"), F.lit("node").alias("kind")))


@query("select item_id as page_id, v.title, v.text from benchmark, lateral (values ('Ingredients', 'Water, glycerin and ceramide ' || item_id || '.'), ('How do I use number ' || item_id || '?', 'Apply morning and night.')) v(title, text)")
def page_blocks(spark, sf_dir):
    """Sections and elements that tell of product text."""
    blocks = made_pages(spark, sf_dir).select("page_id", F.inline(pages.block_column(F.col("html"))))
    # a block's text begins with its title
    return blocks.select("page_id", "title", T.strip_section_title(F.col("title"), F.col("text")).alias("text"))


# payloads

PAYLOAD = '{"product": {"title": "Dew @", "vendor": "Moss", "code": {"own": "C-@"}, "benefits": ["Soft skin @", "soft SKIN @", "Firm"], "ingredients": {"name": "Water @"}, "howToUse": "Apply a thin layer @.", "cart": {"productName": "x", "price": 1}, "related": [{"productName": "Other @", "price": 2}], "n": [1, {"b": " c  d "}]}}'


def payloads(spark, sf_dir):
    number = F.col("item_id").cast("string")
    return read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 9 == 8, "not json").otherwise(F.replace(F.lit(PAYLOAD), F.lit("@"), number)).alias("payload"))


@query(
    """select item_id, case when ok then 'Dew ' || item_id end as name, case when ok then 'Moss' end as brand, case when ok then 'Soft skin ' || item_id || '|soft SKIN ' || item_id || '|Firm' else '' end as benefits, case when ok then 'Water ' || item_id else '' end as ingredients, 'US' as market
    from (select item_id, item_id % 9 <> 8 as ok from benchmark)"""
)
def payload_products(spark, sf_dir):
    """A product row of each payload, bad JSON without any."""
    made = products.normalize(payloads(spark, sf_dir), "item_id", "payload")
    return made.select("item_id", "name", "brand", F.array_join("benefits", "|").alias("benefits"), F.array_join("ingredients", "|").alias("ingredients"), "market")


@query("select item_id, case when item_id % 9 <> 8 then 'C-' || item_id end as name from benchmark")
def mapped_payloads(spark, sf_dir):
    """A caller's paths go before the usual ones."""
    return products.normalize(payloads(spark, sf_dir), "item_id", "payload", {"name": ("code.own",)}).select("item_id", "name")


@query("select item_id, v.role, v.text, v.source_path from benchmark, lateral (values ('identity', 'Dew ' || item_id, 'name'), ('identity', 'Moss', 'brand'), ('benefit', 'Soft skin ' || item_id, 'benefits[0]'), ('benefit', 'Firm', 'benefits[2]'), ('ingredient', 'Water ' || item_id, 'ingredients[0]'), ('usage', 'Apply a thin layer ' || item_id || '.', 'usage[0]')) v(role, text, source_path) where item_id % 9 <> 8")
def evidence_atoms(spark, sf_dir):
    """The ledger of a product's evidence, without repeats of role and text."""
    made = products.evidence_ledger(products.normalize(payloads(spark, sf_dir), "item_id", "payload"), "item_id")
    return made.select("item_id", "role", "text", "source_path")


@query("select item_id, 'usage' as category, 'howToUse' as key, 'Apply a thin layer ' || item_id || '.' as text from benchmark where item_id % 9 <> 8 and length('Apply') > 0")
def keyed_sections(spark, sf_dir):
    """Texts under keys that tell their category."""
    p = payloads(spark, sf_dir).select("item_id", F.inline(pages.keyed_section_column(F.col("payload"))))
    return p.where("category = 'usage'")


@query("select item_id, len(l) as strings, l[1] as first, l[len(l)] as last from (select item_id, ['Dew ' || item_id, 'c d'] as l0, case when item_id % 9 <> 8 then ['Dew ' || item_id, 'Moss', 'C-' || item_id, 'Soft skin ' || item_id, 'soft SKIN ' || item_id, 'Firm', 'Water ' || item_id, 'Apply a thin layer ' || item_id || '.', 'x', '1', 'Other ' || item_id, '2', '1', 'c d'] else [] end as l from benchmark)")
def payload_strings(spark, sf_dir):
    """Every text and number of a payload, in order."""
    p = payloads(spark, sf_dir).select("item_id", pages.string_column(F.col("payload")).alias("l"))
    return p.select("item_id", F.size("l").cast("long").alias("strings"), F.get("l", 0).alias("first"), F.get("l", F.size("l") - 1).alias("last"))


@query("select item_id, '{\"name\": \"N' || item_id || '\", \"b\": {\"c\": 3}}' as document, 'a,b.c' || case when item_id % 2 = 0 then ',name' else '' end as changes from benchmark where item_id % 2 = 1 union all select item_id, '{\"name\": \"New ' || item_id || '\", \"a\": 1, \"b\": {\"c\": 2}}', 'name' from benchmark where item_id % 2 = 0")
def patched_artifacts(spark, sf_dir):
    """Artifacts after a merge patch, or after an instruction in words."""
    number = F.col("item_id").cast("string")
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit('{"name": "N'), number, F.lit('", "a": 1, "b": {"c": 2}}')).alias("d"), F.when(F.col("item_id") % 2 == 1, '{"a": null, "b": {"c": 3}}').otherwise(F.concat(F.lit("set name to New "), number, F.lit("; remove nothing"))).alias("p"))
    made = products.patch_artifacts(rows, "item_id", "d", "p")
    return made.select("item_id", "document", F.array_join("changes", ",").alias("changes"))


# graphs

GRAPH = {"@context": "https://schema.org", "@graph": [
    {"@type": "WebPage", "@id": "https://x.example/p#page", "inLanguage": "de", "hasPart": [{"@id": "https://x.example/p#faq"}, {"@id": "https://other.example/#f"}, {"@id": "#how"}]},
    {"@type": "FAQPage", "@id": "https://x.example/p#faq", "mainEntity": []},
    {"@type": "HowTo", "@id": "#how", "inLanguage": "en-US", "name": "Use", "step": [{"position": 1, "text": "Apply @."}]},
    {"@type": "Product", "name": "Dew", "description": "D", "offers": {"price": "0", "priceCurrency": "EUR"}, "image": ["http://x.example/a_40x40.jpg", "https://x.example/a.jpg", "data:x"]},
    {"@type": "BreadcrumbList", "itemListElement": [{"name": "A", "position": 3}, {"position": 4}]}]}


def graphs(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.replace(F.lit(json.dumps(GRAPH)), F.lit("@."), F.concat(F.col("item_id").cast("string"), F.lit("."))).alias("d"))


@query("select item_id, field, 'https://other.example/#f,#how' as parts from benchmark, lateral (values ('FAQPage'), ('WebPage.inLanguage'), ('WebPage.hasPart'), ('Product.offers'), ('Product.image'), ('BreadcrumbList.itemListElement'), ('BreadcrumbList')) v(field)")
def graph_repairs(spark, sf_dir):
    """What a graph's repair finds, and the references that are left."""
    rows = graphs(spark, sf_dir).select("item_id", graph.repair(F.col("d"), F.lit("en-US")).alias("r"))
    parts = F.array_join(F.from_json(F.get_json_object("r.document", "$['@graph'][0].hasPart[*]['@id']"), "array<string>"), ",")
    return rows.select("item_id", F.explode(F.array_distinct(F.transform("r.findings", lambda x: x["field"]))).alias("field"), parts.alias("parts"))


@query("select item_id, 1::bigint as again, item_id % 2 = 0 as visible, true as script from benchmark")
def graph_checks(spark, sf_dir):
    """A repaired graph keeps one finding (its breadcrumbs have a single item, which no repair can add to); visible text and script element are held against it."""
    number = F.col("item_id").cast("string")
    rows = graphs(spark, sf_dir).withColumn("fixed", graph.repair(F.col("d"), F.lit("en-US"))["document"])
    script = F.concat(F.lit('<script type="application/ld+json">'), "d", F.lit("</script>"))
    usage = F.concat(F.lit("1. Apply "), number, F.when(F.col("item_id") % 2 == 0, ".").otherwise("!"))
    return rows.select("item_id", F.size(graph.findings(F.col("fixed"), F.lit("en-US"))).cast("long").alias("again"), graph.visible_matches_graph(F.col("d"), F.lit(""), usage).alias("visible"), graph.script_matches(script, F.col("d")).alias("script"))


# policy documents, usage, keywords

RULES = """# Titles
- Must name the product in the title, always.
* Keep **every** claim close to its [source](https://x.example/s).
1. Use short sentences that read
   well aloud, too.
```
- Never a rule inside a fence of code.
```
- Must name the product in the title always
- Too short.
| table | row |
## More
- Never promise a cure or a treatment of any kind.
"""


@query(
    expected(
        "document, heading, text, severity",
        [
            ("rules.md", "Titles", "Must name the product in the title, always.", "critical"), ("rules.md", "Titles", "Keep every claim close to its source.", "guidance"), ("rules.md", "Titles", "Use short sentences that read well aloud, too.", "guidance"),
            ("rules.md", "More", "Never promise a cure or a treatment of any kind.", "critical"),
        ],
    )
)
def policy_rules(spark, sf_dir):
    """Rules of a policy document: bullets and numbered items with their continuations, no code, no tables, no repeats."""
    docs = fixture(spark, "ord int, name string, content string", [(0, "rules.md", RULES), (1, "copy.md", "# Other\n- Must name the product in the title, ALWAYS!\n"), (2, "data.json", '{"a": "- Must not be read as a rule here"}')])
    return policy.policy_rules(docs).select("document", "heading", "text", "severity")


@query(expected("name, kept", [("Dew Cream", "Apply the cream at night.|Massage the cream in."), ("Foam Cleanser", "Lather the cleanser. Rinse well.")]))
def usage_scope(spark, sf_dir):
    """Usage instructions that belong to the product."""
    texts = ["Apply the cream at night. Then use the toner.", "Rinse well.", "Massage the cream in."]
    rows = fixture(spark, "name string, usage array<string>", [("Dew Cream", texts), ("Foam Cleanser", ["Apply the cream at night.", "Lather the cleanser. Rinse well."])])
    made = scope.filter_usage(rows.withColumn("id", F.col("name")), "id", "name", "usage")
    return made.select(F.col("id").alias("name"), F.array_join("usage", "|").alias("kept"))


@query(expected("original, normalized", [("smoth", "smooth")]))
def keyword_corrections(spark, sf_dir):
    """Safe and confident corrections of known keywords."""
    sources = fixture(spark, "keyword string", [("smoth",), ("dry",), ("glow",)])
    rows = fixture(spark, "original string, normalized string, confidence double, ord int", [("Smoth", "smooth", 0.9, 0), ("dry", "wet", 0.2, 1), ("other", "thing", 0.9, 2), ("glow", "반짝임", 0.9, 3), ("smoth", "smith", 0.9, 4)])
    return gates.safe_corrections(sources, rows, "en-US").select("original", "normalized")


@query("select ord, keyword from (values (0::bigint, 'smooth'), (2::bigint, 'dry')) t(ord, keyword)")
def corrected_keywords(spark, sf_dir):
    """Keywords after their corrections, the first of equal ones."""
    keywords = fixture(spark, "ord long, keyword string", [(0, "smoth"), (1, "Smooth"), (2, "dry")])
    return gates.apply_corrections(keywords, fixture(spark, "original string, normalized string", [("smoth", "smooth")])).select("ord", "keyword")


@query(expected("id, benefit, product", [(1, "hydration,radiance", "cream")]))
def keyword_groups(spark, sf_dir):
    """Valid keywords of each category."""
    rows = [(1, 0, "benefit", "hydration"), (1, 1, "benefit", "radiance"), (1, 2, "benefit", "hydration"), (1, 3, "benefit", "coupon"), (1, 4, "product", "cream")]
    made = aggregates.keyword_groups(fixture(spark, "id long, ord int, category string, keyword string", rows), "id")
    return made.select("id", F.array_join("benefit", ",").alias("benefit"), F.array_join("product", ",").alias("product"))


@query(expected("text, images, intents, last", [("Soft skin", "a.jpg,b.jpg", "benefit,usage", "content.sections.howToUse")]))
def sentence_diagnostics(spark, sf_dir):
    """Equal sentences in one row, with the fields that their intents feed."""
    rows = fixture(spark, "id int, ord int, text string, image_url string, intents array<string>", [(1, 0, "Soft skin", "a.jpg", ["benefit"]), (1, 1, "soft skin", "b.jpg", ["usage"])])
    made = aggregates.sentence_diagnostics(rows, "id")
    return made.select("text", F.array_join("images", ",").alias("images"), F.array_join("intents", ",").alias("intents"), F.element_at("fields", -1).alias("last"))


@query(expected("source, place", [("s0", 1), ("s1", 2), ("s2", 3), ("s3", 4), ("paper", 5), ("cep", 6)]))
def principle_sources(spark, sf_dir):
    """The best sources of a principle, with places for the reserved kinds."""
    rows = [(1, f"s{i}", "custom", 9.0 - i, 0.5) for i in range(7)] + [(1, "paper", "geo-research", 0.0, 0.9), (1, "cep", "cep", 0.0, 0.1)]
    made = aggregates.principle_sources(fixture(spark, "p int, source string, kind string, fit double, score double", rows), "p")
    return made.select("source", F.col("place").cast("long").alias("place"))


@query("select item_id, k || '-' || target as query_id, case when k = 0 then 'Dew ' || item_id || ' Moss en-US' else 'Dew ' || item_id || ' Moss en-US ' || target end as query from benchmark, lateral (values (0, 'general'), (1, 'faq'), (2, 'howTo')) v(k, target)")
def query_plans(spark, sf_dir):
    """A general query for each product, and one for each target."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Dew "), F.col("item_id").cast("string")).alias("name"), F.lit("Moss").alias("brand"), F.lit(None).cast("string").alias("category"), F.lit("en-US").alias("locale"))
    return aggregates.query_plan(rows, ["faq", "faq", "howTo"], 6).select("item_id", "query_id", "query")


@query("select p_partkey, k as slice_no, case when h > 2048 and h > 3 * w then 1190 * k else 0 end as top, case when h > 2048 and h > 3 * w then least(1400, h - 1190 * k) else h end as slice_height from (select p_partkey, p_size * 120 as h, (p_partkey % 9 + 1) * 100 as w from part), range(20) r(k) where k < case when h > 2048 and h > 3 * w then least(20, ceil((h - 1400) / 1190) + 1) else 1 end")
def image_slices(spark, sf_dir):
    """Slices of tall images."""
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 120).alias("h"), ((F.col("p_partkey") % 9 + 1) * 100).alias("w"))
    return chunking.slice_plan(rows, "h", "w").select("p_partkey", F.col("slice_no").cast("long").alias("slice_no"), F.col("top").cast("long").alias("top"), F.col("slice_height").cast("long").alias("slice_height"))


@query(
    """with r as (select p_brand, p_partkey, 'https://x.example/i' || (p_partkey % 40) || '_' || w || 'x.jpg' as url, w, p_retailprice as score, p_partkey % 40 as img from (select *, [100, 400, 800][p_partkey % 3 + 1] as w from part)),
    b as (select *, row_number() over (partition by p_brand, img order by w desc, score desc, p_partkey) as rn from r), c as (select *, row_number() over (partition by p_brand order by score desc, p_partkey) as top from b where rn = 1)
    select p_partkey, row_number() over (partition by p_brand order by p_partkey) as place from c where top <= 6"""
)
def image_targets(spark, sf_dir):
    """The widest variant of each image, the best six of a brand, in page order."""
    width = F.element_at(F.array(F.lit("100"), F.lit("400"), F.lit("800")), (F.col("p_partkey") % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://x.example/i"), (F.col("p_partkey") % 40).cast("string"), F.lit("_"), width, F.lit("x.jpg"))
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", url.alias("url"), F.col("p_retailprice").alias("score"))
    return selection.ocr_targets(rows, "p_brand", "url", "score", "p_partkey", 6).select("p_partkey", F.col("place").cast("long").alias("place"))


@query(expected("ord, question, place", [(0, "What does it do?", 0), (3, "Who is it for, in short?", 1)]))
def merged_intents(spark, sf_dir):
    """Questions that share an intent with an earlier one: the preferred takes its place."""
    rows = [(1, 0, "What does it do?", ["a"], 9), (1, 1, "what does it DO", ["b"], 5), (1, 2, "Who is it for?", ["c"], 1), (1, 3, "Who is it for, in short?", ["c"], 2)]
    made = dedupe.dedupe_by_intent(fixture(spark, "id long, ord long, question string, intents array<string>, preference int", rows), "id", "ord", "question", "intents", "preference")
    return made.select("ord", "question", "place")


@query(expected("id, text", [(1, "Clinical results"), (1, "After four weeks of daily use the skin looks smoother."), (1, "Ingredients: water, glycerin")]))
def image_text_units(spark, sf_dir):
    """Wrapped lines of image text as sentences."""
    rows = fixture(spark, "id long, text string", [(1, "Clinical results\nAfter four weeks of daily use the\nskin looks smoother.\nIngredients: water,\nglycerin")])

    @F.pandas_udf("array<string>")
    def units(texts):
        return texts.map(scope.ocr_units)

    return rows.select("id", F.explode(units(F.col("text"))).alias("text"))


@query(expected("name, title, heading_path", [("a.md", "One", "One"), ("a.md", "Two", "One > Two"), ("b.json", "JSON terminology map", "JSON terminology map")]))
def markdown_sections(spark, sf_dir):
    """Sections of a document at its headings."""
    rows = fixture(spark, "name string, content string", [("a.md", "# One\nText of one.\n## Two\nText of two."), ("b.json", '{"a": 1}')])
    return chunking.split_markdown(rows, "name", "content").select("name", "title", "heading_path")


HTML = "<main><p>" + "A benchmark of visibility and citation. " * 6 + "</p></main>"


@query(expected("url, source_kind, begins", [("https://arxiv.org/abs/1", "official-paper", "A benchmark of vis")]))
def referenced_pages(spark, sf_dir):
    """Pages that documents name, their relevant sections; private addresses are no sources."""
    docs = fixture(spark, "ord int, name string, content string", [(0, "a.md", "See https://arxiv.org/abs/1, and http://10.0.0.1/x.")])
    made = documents.referenced_documents(docs, fixture(spark, "url string, title string, html string", [("https://arxiv.org/abs/1", "T", HTML), ("http://10.0.0.1/x", "T", HTML)]))
    return made.select("url", "source_kind", F.substring("content", 1, 18).alias("begins"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'fulfilled' else 'rejected' end as status from part")
def run_states(spark, sf_dir):
    """Requested keys with and without a result."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    return documents.run_status(p, p.where("p_partkey % 3 = 0"), "p_partkey")


CHUNKS = ((1, "product-1", "product", "Dew\nD\nSoft\nWater"), (2, "faq-1", "faq", "Q: Is it?\nA: Yes."), (3, "content-section-1", "source", "[usage] How\nApply."), (4, "review-1", "review", "Nice"), (5, "review-3", "review", "Good"), (6, "ocr-1", "ocr", "On the box"))


@query(expected("ord, chunk_id, kind, text", CHUNKS))
def product_chunks(spark, sf_dir):
    """A product's chunks in their fixed order; empty ones are left out and keep their number."""
    p = fixture(spark, "id int, name string, description string, benefits array<string>, effects array<string>, ingredients array<string>, usage array<string>, metrics array<string>", [(1, "Dew", "D", ["Soft"], [], ["Water"], [], [])])
    faq, sections = fixture(spark, "id int, ord int, question string, answer string", [(1, 0, "Is it?", "Yes.")]), fixture(spark, "id int, ord int, category string, title string, text string", [(1, 0, "usage", "How", "Apply.")])
    reviews, images = fixture(spark, "id int, ord int, body string", [(1, 0, "Nice"), (1, 1, ""), (1, 2, "Good")]), fixture(spark, "id int, ord int, text string", [(1, 0, "On the box")])
    return extraction.chunk_rows(p, "id", faq, sections, reviews, images).select("ord", "chunk_id", "kind", "text")


@query("select item_id, 'src' || item_id || '#api-text-' || n || '-1' as url, text from (select item_id, 1 as n, 'A text of this passage with number ' || item_id || '.' as text from benchmark union all select item_id, 2, 'Another text, long enough to stay.' from benchmark)")
def payload_chunks(spark, sf_dir):
    """Distinct texts of a payload as numbered chunks; short ones are left out."""
    number = F.col("item_id").cast("string")
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), number).alias("source"), F.posexplode(F.array(F.concat(F.lit("A text of this passage with number "), number, F.lit(".")), F.lit("Another text, long enough to stay."), F.lit("Another text, long enough to stay."), F.lit("Short."), F.lit(""))).alias("ord", "text"))
    return extraction.text_candidates(rows, "item_id", "source").select("item_id", "url", "text")


INSIGHTS = (
    ("After 4 weeks, 92% of women agreed that skin hydration improved.", "metric", "After 4 weeks, 92% of women agreed that skin hydration improved."),
    ("Apply two pumps to clean skin every morning.", "usage", "Apply two pumps to clean skin every morning."),
    ("Add to cart and get free shipping on refunds", None, None),
    ("Soft", None, None),
)


@query(expected("id, category, insight", [(i, c, x) for i, (_, c, x) in enumerate(INSIGHTS) if c]))
def insights(spark, sf_dir):
    """Sentences that say something of a category."""
    rows = fixture(spark, "id long, text string", [(i, x[0]) for i, x in enumerate(INSIGHTS)])
    return extraction.sentence_insights(rows).select("id", "category", "insight")


ROUTED = (
    ("ocr-keywords.md", "Sentences", "Ingredient and usage keywords", "ocr-classification", "classification,evidence", "ocr.sentenceInsights,benefits,effects,ingredients,usage", 0.14),
    ("faq.md", "Questions", "An answer", "faq-extraction", "faq,evidence", "faq", 0.04),
    ("notes.md", None, "Plain words", "custom", "general", "geoProduct", 0.04),
    ("rag-map.md", None, "Exclude cart text", "orchestration", "orchestration,diagnostics,exclusion", "diagnostics,rag.chunks", 0.19),
)


@query(expected("source, kind, intents, targets, boost", [(r[0], *r[3:]) for r in ROUTED]))
def extraction_routes(spark, sf_dir):
    """Kind, intents, targets and boost of extraction chunks."""
    rows = fixture(spark, "source string, title string, text string", [r[:3] for r in ROUTED]).withColumn("kind", extraction.extraction_kind(F.col("source")))
    rows = rows.withColumn("r", extraction.extraction_routing(F.col("kind"), F.col("source"), F.col("title"), F.col("text")))
    whole = F.concat_ws(" ", "source", "title", "text")
    return rows.select("source", "kind", F.array_join("r.intents", ",").alias("intents"), F.array_join("r.targets", ",").alias("targets"), F.round(extraction.extraction_boost(F.col("kind"), F.col("r.intents"), F.col("r.targets"), whole, F.lit(0.0)), 6).alias("boost"))


ADDRESSES = (
    # address, blocked, image key, width, low quality
    ("https://x.example/a_400x.jpg", False, "https://x.example/a.jpg"),
    ("http://192.168.0.9/x_10x20.png", True, "http://192.168.0.9/x.png"),
    ("http://localhost/x.gif?v=1", True, "http://localhost/x.gif"),
)


@query(expected("url, public, image_key", [(u, not b, k) for u, b, k in ADDRESSES]))
def addresses(spark, sf_dir):
    """Public addresses and the key that an image's variants share."""
    rows = fixture(spark, "url string", [(x[0],) for x in ADDRESSES])
    return rows.select("url", (F.size(H.extract_urls(F.col("url"))) > 0).alias("public"), H.image_key(F.col("url")).alias("image_key"))


NAMES = (("Dew Cream | Moss", "Dew Cream"), ("Dew Cream - Official Store - EU", "Dew Cream"), ("Dew  Cream – Moss Shop", "Dew Cream"), ("", None), (None, None))


@query(expected("id, name", [(i, n) for i, (_, n) in enumerate(NAMES)]))
def product_names(spark, sf_dir):
    """Names in page titles, without the site's."""
    rows = fixture(spark, "id long, title string", [(i, t) for i, (t, _) in enumerate(NAMES)])
    return rows.select("id", T.product_name(F.col("title"), ("Moss Shop",)).alias("name"))


PROMOTED = (("Good cream.\nBuy now at x!\nStill good.", "Good cream.\nStill good."), ("지금 구매 하세요\n좋아요", "좋아요"))


@query(expected("id, body", [(i, b) for i, (_, b) in enumerate(PROMOTED)]))
def sober_bodies(spark, sf_dir):
    """Bodies without lines that sell."""
    rows = fixture(spark, "id long, body string", [(i, a) for i, (a, _) in enumerate(PROMOTED)])
    return rows.select("id", E.strip_promotion(F.col("body")).alias("body"))


CLAUSES = (
    ("사용 7일 후 87.3% 회복되었고, 사용 7일 후 87.3% 회복되었습니다.", "사용 7일 후 87.3% 회복되었습니다."),
    ("수분이 20% 개선되었고, 탄력이 30% 개선되었습니다.", "수분이 20% 개선되었고, 탄력이 30% 개선되었습니다."),
    ("수분이 좋아졌고, 좋아졌습니다.", "수분이 좋아졌고, 좋아졌습니다."),
)


@query(expected("id, sentence", [(i, b) for i, (_, b) in enumerate(CLAUSES)]))
def clauses_once(spark, sf_dir):
    """Measured Korean sentences without clauses that only repeat."""
    rows = fixture(spark, "id long, sentence string", [(i, a) for i, (a, _) in enumerate(CLAUSES)])
    return rows.select("id", source_texts.without_repeated_clauses(F.col("sentence")).alias("sentence"))


UNITS = (
    ("Soft skin. Firm skin • Calm", "benefit", "Soft skin.|Firm skin|Calm"),
    ("Apply it. Rinse it.", "usage", "Apply it. Rinse it."),
    ("Calm skin. Ingredients: Water, Glycerin, Niacinamide", "ingredient", "Calm skin.|Ingredients: Water, Glycerin, Niacinamide"),
    ("First.Second one", "effect", "First.|Second one"),
    ("", "benefit", ""),
)


@query(expected("id, units", [(i, u) for i, (_, _, u) in enumerate(UNITS)]))
def mixed_units(spark, sf_dir):
    """Mixed texts as units."""
    rows = fixture(spark, "id long, text string, field string", [(i, a, b) for i, (a, b, _) in enumerate(UNITS)])
    return rows.select("id", F.array_join(source_texts.mixed_units(F.col("text"), F.col("field")), "|").alias("units"))


@query(expected("place, text", [(0, "92% agreed in a clinical study after 4 weeks"), (1, "Ginseng and retinol formula"), (2, "Apply at night")]))
def telling_texts(spark, sf_dir):
    """The three most telling texts."""
    texts = ["Pretty jar", "Apply at night", "92% agreed in a clinical study after 4 weeks", "Ginseng and retinol formula", "Apply  at night", "x"]
    rows = fixture(spark, "id int, texts array<string>", [(1, texts)])
    return rows.select(F.posexplode(source_texts.most_telling(F.col("texts"), 3)).alias("place", "text")).select(F.col("place").cast("long").alias("place"), "text")


IMAGE_TEXTS = (("Niacinamide for firmer skin", "ingredient,effect"), ("Ingredients: Water, Glycerin, Niacinamide, Panthenol", "ingredient"), ("Step 1 toner, step 2 serum: complete your ritual", ""), ("My skin feels calm: customers say so", "review"))


@query(expected("id, categories", [(i, c) for i, (_, c) in enumerate(IMAGE_TEXTS)]))
def image_sentence_categories(spark, sf_dir):
    """Categories of sentences on images."""
    rows = fixture(spark, "id long, text string", [(i, a) for i, (a, _) in enumerate(IMAGE_TEXTS)])
    return rows.select("id", F.array_join(source_texts.image_categories(F.col("text")), ",").alias("categories"))
