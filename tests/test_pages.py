"""Page, product and graph operators on own fixtures."""

import json

from pyspark.sql import functions as F

from lodestone.operators import graph, pages, scope
from lodestone.sources import documents, products

PAGE = """<html><head><title>Dew Cream &amp; Co</title><meta name="description" content="A cream for dry skin.">
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Dew Cream", "brand": {"name": "Moss"}, "offers": {"price": "24.50", "priceCurrency": "EUR"}, "aggregateRating": {"ratingValue": "4.6", "reviewCount": "120"}}]}</script>
<script type="application/ld+json">{broken</script>
<script>window.__INITIAL_STATE__ = {productName: "Dew Cream", note: "a } in a string", price_info: {"price": 24.5,},};</script>
<script id="__NEXT_DATA__" type="application/json">{"props": "{\\"prodName\\": \\"Dew Cream\\", \\"images\\": [\\"/a.jpg\\"]}"}</script></head>
<body><div class="modal">Subscribe</div><main><h1>Dew Cream</h1><img src="/img/a_400x.jpg" srcset="/img/b.jpg 1x, /img/c.jpg 2x">
<section class="ingredient"><h2>Ingredients</h2><p>Water, glycerin and ceramide.</p></section>
<details><summary>How do I use it?</summary><p>Apply morning and night.</p></details>
<button aria-controls="p1">Is it safe for dry skin?</button><div id="p1">Yes, it is.</div>
<div class="review"><span class="author">Ann</span><meta itemprop="ratingValue" content="5"><p class="body">Smooth and light on my skin.</p></div></main></body></html>"""


def test_json_in_pages():
    nodes = pages.json_ld_nodes(PAGE)
    assert [n.get("@type") for n in nodes] == [None, "Product"] and pages.has_type(nodes[1], "product")
    states = pages.client_states(PAGE)
    assert any(isinstance(s, dict) and s.get("productName") == "Dew Cream" for s in states)
    assert any(isinstance(s, dict) and s.get("prodName") == "Dew Cream" for s in states)
    assert pages.balanced_object('x {"a": "}"} y', 2) == '{"a": "}"}' and pages.balanced_object("{", 0) is None
    assert pages.parse_json("3") is None and pages.parse_json(None) is None and pages.client_states(None) == []
    assert len(list(pages.product_records({"cart": {"productName": 1}, "a": [{"productName": 1, "price": 2}]}))) == 1


def test_elements():
    assert pages.dom_faq(PAGE) == [("How do I use it?", "Apply morning and night."), ("Is it safe for dry skin?", "Yes, it is.")]
    assert pages.dom_reviews(PAGE) == [("Smooth and light on my skin.", "Ann", 5.0, None)]
    assert [t for _, t, _ in pages.text_blocks(PAGE)] == ["Ingredients", "How do I use it?"]
    assert pages.image_urls(PAGE, "https://x.example/p") == ["https://x.example/img/a_400x.jpg", "https://x.example/img/b.jpg", "https://x.example/img/c.jpg"]
    assert pages.keyed_sections({"howToUse": "Apply a thin layer.", "x": {"mainIngredients": ["Water and glycerin"]}}) == [("usage", "howToUse", "Apply a thin layer."), ("ingredient", "mainIngredients", "Water and glycerin")]
    assert list(pages.all_strings({"a": [1, {"b": " c  d "}], "e": None})) == ["1", "c d"]
    assert list(pages.keyed_texts({"desc": "x", "reviews": {"desc": "y"}}, "desc")) == [("$.desc", "desc", "x")]


def test_products(spark):
    df = spark.createDataFrame([(1, "https://x.example/products/dew-cream?x=1", PAGE), (2, None, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in products.from_pages(df, "page_id", "url", "html").collect()}
    r = rows[1]
    assert (r.handle, r.name, r.brand, r.price, r.currency, r.rating, r.review_count) == ("dew-cream", "Dew Cream", "Moss", "24.50", "EUR", 4.6, 120.0)
    assert r.description == "A cream for dry skin." and len(r.faq) == 2 and rows[2].name is None
    raw = [(1, json.dumps({"product": {"title": "Dew", "vendor": "Moss", "benefits": ["Soft skin", "soft skin"], "ingredients": {"name": "Water"}}}), None), (2, "not json", None), (3, None, None)]
    made = products.normalize(spark.createDataFrame(raw, "id long, payload string, extra string"), "id", "payload")
    rows = {x.id: x for x in made.collect()}
    assert (rows[1].name, rows[1].brand, rows[1].benefits, rows[1].ingredients) == ("Dew", "Moss", ["Soft skin", "soft skin"], ["Water"]) and rows[2].name is None and rows[3].name is None
    ledger = [(x.role, x.text) for x in products.evidence_ledger(made, "id").where("id = 1").orderBy("ord").collect()]
    assert ledger == [("identity", "Dew"), ("identity", "Moss"), ("benefit", "Soft skin"), ("ingredient", "Water")]
    assert products.apply_patch('{"a": 1, "b": {"c": 2}}', '{"a": null, "b": {"c": 3}}') == ('{"b": {"c": 3}}', ["a", "b.c"])
    assert products.apply_patch('{"name": "x"}', "set name to New one; remove nothing") == ('{"name": "New one"}', ["name"])


def test_graph(spark):
    doc = json.dumps({"@context": "https://schema.org", "@graph": [
        {"@type": "WebPage", "@id": "https://x.example/p#page", "inLanguage": "de", "hasPart": [{"@id": "https://x.example/p#faq"}, {"@id": "https://other.example/#f"}, {"@id": "#how"}]},
        {"@type": "FAQPage", "@id": "https://x.example/p#faq", "mainEntity": []},
        {"@type": "HowTo", "@id": "#how", "inLanguage": "en-US", "name": "Use", "step": [{"position": 1, "text": "Apply."}]},
        {"@type": "Product", "name": "Dew", "description": "D", "offers": {"price": "0", "priceCurrency": "EUR"}, "image": ["http://x.example/a_40x40.jpg", "https://x.example/a.jpg", "data:x"]},
        {"@type": "BreadcrumbList", "itemListElement": [{"name": "A", "position": 3}, {"position": 4}]}]})
    fixed, found = graph.repair_graph(doc, "en-US")
    nodes = {n["@type"]: n for n in json.loads(fixed)["@graph"]}
    assert [p["@id"] for p in nodes["WebPage"]["hasPart"]] == ["https://other.example/#f", "#how"] and "FAQPage" not in nodes and "offers" not in nodes["Product"]
    assert nodes["Product"]["image"] == ["https://x.example/a_40x40.jpg"] and nodes["BreadcrumbList"]["itemListElement"] == [{"name": "A", "position": 1}]
    assert {f["field"] for f in found} == {"FAQPage", "WebPage.inLanguage", "WebPage.hasPart", "Product.offers", "Product.image", "BreadcrumbList.itemListElement", "BreadcrumbList"}
    assert graph.repair_graph(fixed, "en-US")[0] == fixed and graph.repair_graph("x", "en-US")[0] is None
    df = spark.createDataFrame([(doc, "1. Apply.")], "d string, u string")
    assert df.select(graph.visible_matches_graph(F.col("d"), F.lit(""), F.col("u"))).first()[0]
    assert df.select(F.size(graph.findings(F.col("d"), F.lit("en-US")))).first()[0] == len(found)
    assert df.select(graph.script_matches(F.concat(F.lit('<script type="x">'), "d", F.lit("</script>")), F.col("d"))).first()[0]


def test_scope_and_ocr():
    texts = ["Apply the cream at night. Then use the toner.", "Rinse well.", "Massage the cream in."]
    assert scope.keep_current(texts, "Dew Cream") == ["Apply the cream at night.", "Massage the cream in."]
    assert scope.ocr_units("Clinical results\nAfter four weeks of daily use the\nskin looks smoother.\nIngredients: water,\nglycerin") == ["Clinical results", "After four weeks of daily use the skin looks smoother.", "Ingredients: water, glycerin"]


def test_documents(spark, tmp_path):
    (tmp_path / "schema_v1.md").write_text("# A\n- Must name the product clearly.\nSee https://arxiv.org/abs/1, and http://10.0.0.1/x.\n")
    docs = documents.read_profile(spark, str(tmp_path)).withColumn("ord", F.lit(0))
    assert [(r.name, r.kind) for r in docs.collect()] == [("schema_v1.md", "schema")]
    html = "<main><p>" + "A benchmark of visibility and citation. " * 6 + "</p></main>"
    found = documents.referenced_documents(docs, spark.createDataFrame([("https://arxiv.org/abs/1", "T", html)], "url string, title string, html string")).collect()
    assert [(r.url, r.source_kind) for r in found] == [("https://arxiv.org/abs/1", "official-paper")] and found[0].content.startswith("A benchmark")
