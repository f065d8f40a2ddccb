"""Operators whose order or rules SQL on the driver's tables cannot show."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import text as T
from lodestone.functions import web as H
from lodestone.operators import chunking, citation, dedupe, gates, linking, policy, retrieval, selection
from lodestone.plans import hooks
from lodestone.streaming import stages


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()) or "x long")
    return df.select(column).first()[0]


def test_text(spark):
    t = F.col("t")
    assert one(spark, T.strip_section_title(F.lit("Benefits"), t), t="benefits Benefits soft skin") == "soft skin"
    assert one(spark, T.metric_phrases(t), t="95% agreed after 4 weeks, 30 ml") == ["95%", "4 weeks", "30 ml", "after 4 weeks"]
    assert one(spark, T.find_price(t), t="now $24.50, was 30 EUR") == "$24.50" and one(spark, T.find_price(t), t="none") is None
    assert one(spark, T.rating_value(t), t="4.5 out of 5") == 4.5 and one(spark, T.rating_value(t), t="rating: 3.9") == 3.9 and one(spark, T.rating_value(t), t="x") is None
    assert one(spark, T.review_count(t), t="1,234 reviews") == 1234 and one(spark, T.review_count(t), t="17") == 17
    assert one(spark, T.dedupe_comma_list(t), t="a, b, A, c") == "a, b, c"
    assert one(spark, T.primary_script(t), t="피부 장벽 ab") == "hangul" and one(spark, T.primary_script(t), t="12") is None
    assert one(spark, T.round_score(F.lit(-2.5), 0)) == -2 and one(spark, T.fnv1a(t), t="a") == 0xE40C292C
    assert one(spark, T.char_ngrams(t), t="ab") == ["ab"] and one(spark, T.char_ngrams(t), t="") == []


def test_web(spark):
    u = F.col("u")
    for url, public in (("https://a.example/x", True), ("http://localhost/x", False), ("http://172.20.1.1", False), ("http://300.1.1.1", False), ("ftp://a.example", False), ("http://8.8.8.8/", True)):
        assert one(spark, H.is_public_url(u), u=url) is public
    assert one(spark, H.canonical_image(u), u="//a.example/b.jpg?width=20&id=3#x") == "https://a.example/b.jpg?id=3"
    assert one(spark, H.canonical_image(u), u="data:image/png;base64,x") is None
    assert one(spark, H.image_width(u), u="https://a.example/b_300x.jpg") == 300 and one(spark, H.is_low_quality_image(u), u="https://a.example/b_64x64.jpg")
    assert one(spark, H.decode_entities(u), u="a&#65;&#x1F600;&lt;") == "aA😀<"


def test_signals(spark):
    t = F.col("t")
    assert one(spark, S.section_category(F.lit("Ingredients"), t), t="Water") == "ingredient"
    assert one(spark, S.section_category(F.lit("x"), t), t="Add to cart now") == "unknown"
    assert one(spark, S.insight_category(t), t="After 4 weeks hydration improved by 20%") == "metric"
    assert one(spark, S.insight_category(t), t="Apply a pump at night") == "usage"
    assert one(spark, S.full_ingredient_list(t), t="Ingredients: Water, Glycerin, Niacinamide")
    assert one(spark, S.unsafe_claims(t), t="It cures; guaranteed!") == ["cure", "guaranteed"]
    assert one(spark, S.freshness(t, F.lit(None).cast("string"), "2025-01-01"), t="2023-01-01") == "dated"
    assert one(spark, S.document_kind(t), t="best_practice.md") == "best-practice"


def test_chunking(spark):
    assert [c for *_, c in chunking.markdown_sections("# A\nx\n## B\ny\n### C\nz")] == ["# A\nx", "## B\ny", "### C\nz"]
    assert [p for _, p, _ in chunking.markdown_sections("# A\nx\n## B\ny")] == ["A", "A > B"]
    assert chunking.markdown_sections(" ") == [] and len(chunking.markdown_sections('{"a": 1}')) == 1
    parts = chunking.markdown_sections("word " * 1000)
    assert all(len(c) <= 1100 for *_, c in parts) and "".join(c for *_, c in parts).replace(" ", "") == "word" * 1000
    plan = chunking.slice_plan(spark.createDataFrame([("a", 5000, 200), ("b", 1200, 800)], "u string, h int, w int"), "h", "w").orderBy("u", "slice_no").collect()
    assert [(r.top, r.slice_height) for r in plan] == [(0, 1400), (1190, 1400), (2380, 1400), (3570, 1400), (4760, 240), (0, 1200)]
    rows = [(1, i, k) for i, k in enumerate("uuusssu")]
    made = chunking.kind_batches(spark.createDataFrame(rows, "k int, i int, kind string"), "k", "i", "kind", {"u": 2, "s": 4}).orderBy("i").collect()
    assert [r.batch for r in made] == [0, 0, 1, 2, 2, 2, 3]
    md = chunking.split_markdown(spark.createDataFrame([(1, "# T\na"), (2, None)], "id int, text string"), "id", "text").collect()
    assert [(r.id, r.title, r.text) for r in md] == [(1, "T", "# T\na")]


def test_dedupe(spark):
    assert dedupe.absorb(["the quick brown fox", "quick brown", "other words here"]) == ["the quick brown fox", "other words here"]
    a, b = "line one is here\nshared line of more than twenty letters", "shared line of more than twenty letters\nline three"
    assert dedupe.absorb([a, b]) == ["line one is here\nshared line of more than twenty letters\nline three"]
    df = spark.createDataFrame([(1, 0, "a b"), (1, 1, "A  b c"), (2, 0, None)], "id int, n int, text string")
    assert sorted((r.id, r.text) for r in dedupe.absorb_texts(df, "id", "n", "text").collect()) == [(1, "A  b c"), (2, "")]
    q = spark.createDataFrame([(1, 0, "How?", ["use"], 1.0), (1, 1, "Usage?", ["use"], 3.0), (1, 2, "Safe?", ["risk"], 1.0)], "id int, n int, q string, i array<string>, p double")
    assert [r.q for r in dedupe.dedupe_by_intent(q, "id", "n", "q", "i", "p").orderBy("place").collect()] == ["Usage?", "Safe?"]


def test_selection(spark):
    rows = [{"score": s, "source": o, "kind": k, "targets": ["t"], "intents": ["i"]} for s, o, k in ((0.9, "a", "x"), (0.88, "a", "x"), (0.8, "b", "y"))]
    assert selection.diverse(rows, 3) == [0, 2, 1]
    df = spark.createDataFrame([(1, i, 1.0 - i / 10, k, i == 4) for i, k in enumerate("xxyyz")], "q int, i int, score double, kind string, keep boolean")
    made = selection.final_selection(df, "q", "i", 3, ["z", "y", "x"], F.col("keep")).collect()
    assert sorted(r.i for r in made) == [0, 1, 2, 4]
    urls = spark.createDataFrame([(1, 0, "https://a.example/p_100x.jpg", 5.0), (1, 1, "https://a.example/p_300x.jpg", 1.0), (1, 2, "https://a.example/q.jpg", 3.0)], "p int, i int, u string, s double")
    assert [r.i for r in selection.ocr_targets(urls, "p", "u", "s", "i").orderBy("place").collect()] == [1, 2]


def test_diverse_select_goes_through_all_candidates(spark):
    """400 rows of one hot source stand before the others; the last rows differ in their targets, so they fill blocks."""
    rows = [(1, i, 0.9 - i / 10_000, "hot", "x", ["t"], ["i"]) for i in range(400)]
    rows += [(1, 400 + i, 0.7 - i / 1000, f"s{i % 7}", "y", [f"u{i % 20}"], None) for i in range(60)]
    kinds = "q int, i int, score double, source string, kind string, targets array<string>, intents array<string>"
    listed = [dict(zip(("score", "source", "kind", "targets", "intents"), (r[2], r[3], r[4], r[5], r[6] or []), strict=True)) for r in rows]
    want = selection.diverse(listed, 8)
    df = spark.createDataFrame(rows, kinds)
    for block in (4096, 10):
        got = selection.diverse_select(df, "q", "i", 8, block=block).orderBy("place").collect()
        assert [r.i for r in got] == want and [r.place for r in got] == list(range(1, 9))
    assert max(want) >= 400


def test_final_selection_fills_by_diversity(spark):
    """The best row of kind x is protected, so the next one is picked; the fill passes over rows of the sources chosen."""
    rows = [(1, 0, 0.9, "a", "x", True), (1, 1, 0.85, "a", "x", False), (1, 2, 0.84, "a", "y", False), (1, 3, 0.8, "b", "y", False)]
    df = spark.createDataFrame([(*r, ["t"], ["i"]) for r in rows], "q int, i int, score double, source string, kind string, keep boolean, targets array<string>, intents array<string>")
    made = {r.i: (r.tier, r.place) for r in selection.final_selection(df, "q", "i", 2, ["x"], F.col("keep")).collect()}
    assert made == {0: (0, 1), 1: (1, 1), 3: (2, 2)}


def test_boost_lifts_chunks_that_share_nothing(spark):
    """Against the same ranking with every pair made: each chunk's scores by the brute rule."""
    chunks = [(f"c{i}", i, f"common{i % 3} word{i}", 0.5 if i in (17, 18, 25) else 0.2 if i % 5 == 0 else 0.0) for i in range(30)]
    c = spark.createDataFrame(chunks, "chunk_id string, idx long, text string, b double")
    q = spark.createDataFrame([(1, "common1 word4"), (2, "zz none")], "query_id int, text string")
    every = {(r.query_id, r.chunk_id): r for r in retrieval.hybrid_topk(q, c, 30).collect()}
    assert len(every) == 60
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in retrieval.hybrid_topk(q, c, 4, boost=F.col("b")).collect()}
    for query in (1, 2):
        best = sorted((-round(min(1.0, every[query, n].score + b), 9), i, n) for n, i, _, b in chunks)[:4]
        assert [got[query, k + 1] for k in range(4)] == [(n, -s) for s, _, n in best]


def test_linking(spark):
    d = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z")], "name string, ord int, content string")
    assert sorted(tuple(r) for r in linking.merge_documents(d, "name", "ord", "content").select("name", "ord", "content").collect()) == [("a", 0, "z"), ("b", 1, "y")]
    docs = spark.createDataFrame([("d1", None, None), ("d2", None, None), ("b1", "moss", "d1"), ("c1", "fern", "d2")], "name string, scope string, replaces string")
    assert sorted(r.name for r in linking.scope_documents(docs, "moss").collect()) == ["b1", "d2"]
    s = linking.source_backed(spark.createDataFrame([(1, "soft skin"), (2, "skin soft"), (3, "the glow of soft skin and more words")], "item_id int, text string"), spark.createDataFrame([(9, "Soft, skin and the glow of words")], "doc_id int, text string"))
    assert {r.item_id: r.backed for r in s.collect()} == {1: True, 2: False, 3: True}
    links = linking.claim_links(spark.createDataFrame([(1, "soft skin glow"), (2, "none")], "claim_id int, text string"), spark.createDataFrame([(7, "skin glow"), (8, "skin")], "evidence_id int, text string"))
    assert [tuple(r) for r in links.orderBy("rank").collect()] == [(1, 7, 2, 1), (1, 8, 1, 2)]
    assert {r.claim_id: r.confidence for r in linking.claim_confidence(spark.createDataFrame([(1,), (2,)], "claim_id int"), links).collect()} == {1: "high", 2: "low"}


def test_gates(spark):
    c, e = F.col("c"), F.col("e")
    assert one(spark, gates.safe_correction(c, e, F.lit("en-US")), c="moisturzing", e="moisturizing") and not one(spark, gates.safe_correction(c, e, F.lit("en-US")), c="dry", e="https://x")
    made = gates.safe_corrections(spark.createDataFrame([("smoth",), ("dry",)], "keyword string"), spark.createDataFrame([("Smoth", "smooth", 0.9, 0), ("dry", "wet", 0.2, 1), ("other", "thing", 0.9, 2)], "original string, normalized string, confidence double, ord int"), "en-US")
    assert [tuple(r) for r in made.collect()] == [("smoth", "smooth", 0.9)]
    rows = spark.createDataFrame([(1, "It has a light feel"), (2, "It has 20 ml")], "id int, text string")
    props = spark.createDataFrame([(1, "It has a light feel.", 0.9), (2, "It has 30 ml", 0.9)], "id int, proposal string, confidence double")
    got = {r.id: (r.accepted, r.reason) for r in hooks.accept_edits(rows, props, "id", "text").collect()}
    assert got == {1: (True, None), 2: (False, "number")}


POLICY = """# Titles
- **Must** name the product and its *brand*.
  A second line goes on.
- Keep it short and clear enough.
```
- not a rule in a fence
```
| - | not a rule |
## Claims
1. Never invent a number or a source.
- Short
"""


def test_policy(spark):
    docs = spark.createDataFrame([(0, "schema_v2.md", POLICY), (1, "cep.md", "- keep it short, and CLEAR enough\n- Describe who it is for."), (2, "x.json", "- no rule here at all")], "ord int, name string, content string")
    index = spark.createDataFrame([("cep.md", "cep", "narrative", 0.9)], "document string, kind string, extraction string, priority double")
    rules, injected, cover = policy.compile_policy(docs, index, budget=3)
    got = [(r.id, r.heading, r.text, r.severity) for r in rules.orderBy("id").collect()]
    assert got == [("CEP-001", "General", "Describe who it is for.", "guidance"), ("SCHEMA-001", "Titles", "Must name the product and its brand. A second line goes on.", "critical"), ("SCHEMA-002", "Titles", "Keep it short and clear enough.", "guidance"), ("SCHEMA-003", "Claims", "Never invent a number or a source.", "critical")]
    assert sorted(r.id for r in injected.collect()) == ["CEP-001", "SCHEMA-001", "SCHEMA-003"]
    total = [r for r in cover.collect() if r.document is None][0]
    assert (total.total_rules, total.injected_rules, total.critical_ratio, total.narrative_rules) == (4, 3, 1.0, 1)
    lines = policy.checklist(rules.withColumn("targets", F.array(F.lit("PDP.content")))).first()
    assert lines.field == "PDP.content" and lines.lines[0].startswith("[SCHEMA-001][critical]")


def test_citation(spark):
    checks = citation.artifact_checks(F.lit("Is Dew Cream worth it?"), F.lit("TL;DR\n- evidence from a review\n- one caveat\nCompared to others, a recent review says 20% more. Thoughts?"), F.lit("Dew Cream"), F.lit("cream"), F.array(F.lit("review")), F.lit(True), F.lit(""), F.array(F.lit("?")))
    score, passed = citation.readiness(checks, F.lit(1.0))
    failed = [c.name for c in checks if not one(spark, F.coalesce(c.test, F.lit(False)))]
    assert failed == ["comparison-context"] and one(spark, passed) and one(spark, score) == 0.93
    kinds = "doc_id int, ord int, title string, text string, type string, url string, rating double, published_at string, observed_at string"
    e = citation.normalize_evidence({"review": spark.createDataFrame([(1, 0, None, "A light cream that sinks in within a minute or so.", "review", None, 4.0, None, "2024-01-01"), (1, 1, None, " ", "review", None, None, None, None)], kinds), "paper": spark.createDataFrame([(1, 0, "T", "Hydration rose by 20% in the treated group.", "research", None, None, "2020-01-01", None)], kinds)}, "2024-06-01")
    assert sorted((r.evidence_id, r.source_type, r.freshness) for r in e.collect()) == [("paper-1", "paper", "dated"), ("review-1", "review", "recent")]
    assert [r.source_type for r in citation.quotes(e).orderBy("place").collect()] == ["review", "paper"]
    s = citation.statistics(e).first()
    assert (s.n, s.average, s.lines) == (1, 4.0, ["Hydration rose by 20% in the treated group."])


def test_hybrid_equals_brute_force(spark):
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    chunks = [(f"c{i}", i, " ".join(r.choices(words, k=4))) for i in range(40)]
    queries = [(i, " ".join(r.choices(words, k=2))) for i in range(6)] + [(6, "zz none")]
    c, q = spark.createDataFrame(chunks, "chunk_id string, idx long, text string"), spark.createDataFrame(queries, "query_id int, text string")
    got = {(x.query_id, x.rank): (x.chunk_id, round(x.score, 9)) for x in retrieval.hybrid_topk(q, c, 5).collect()}

    def fnv(w):
        h = 2166136261
        for ch in w:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % 384

    def vector(t):
        v = {}
        for w in t.split():
            v[fnv(w)] = v.get(fnv(w), 0) + len(w) ** -0.5
        n = sum(x * x for x in v.values()) ** 0.5
        return {k: x / n for k, x in v.items()}

    for qid, qt in queries:
        rows = []
        for _, i, t in chunks:
            a, b = qt.split(), set(t.split())
            lex = len(set(a) & b) / (len(a) * len(b)) ** 0.5
            va, vb = vector(qt), vector(t)
            rows.append([i, lex, min(1, max(0, (sum(x * vb.get(k, 0) for k, x in va.items()) + 1) / 2))])
        df = pd.DataFrame(rows, columns=["i", "l", "s"])
        df["rl"], df["rs"] = df.assign(k=-df.l.round(9)).sort_values(["k", "i"]).reset_index().reset_index().set_index("index")["level_0"].sort_index() + 1, df.assign(k=-df.s.round(9)).sort_values(["k", "i"]).reset_index().reset_index().set_index("index")["level_0"].sort_index() + 1
        df["t"] = 0.38 * df.l + 0.34 * df.s + 0.16 * (30 * (1 / (60 + df.rl) + 1 / (60 + df.rs))).clip(upper=1)
        best = df.assign(k=-df.t.round(9)).sort_values(["k", "i"]).head(5)
        assert [got[qid, n + 1] for n in range(5)] == [(f"c{i}", round(t, 9)) for i, t in zip(best.i, best.t, strict=True)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, s, f"2024-01-0{d} 10:00:00") for r in (1, 2) for s in ("a", "b") for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "run_id int, stage string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stages.windowed_timeline(stream).writeStream.format("memory").queryName("timeline").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("timeline").groupBy("run_id", "stage").agg(F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.sum("steps").alias("steps"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages.stage_timeline(df).collect()))
    stages.write_progress(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == len(rows)
    status = spark.createDataFrame([(1, "a", "running", 1), (1, "a", "done", 1), (1, "b", "pending", 2)], "run_id int, stage string, status string, at int")
    assert {r.stage: r.status for r in stages.latest_status(status).collect()} == {"a": "done", "b": "pending"}


def test_evidence(spark):
    from lodestone.functions import evidence as E

    t = F.col("t")
    for text, primary in (("How do I use it?", "faq"), ("Apply a pump at night", "usage"), ("Hydration rose 20% in 4 weeks", "metric"), ("Ginseng gives hydration and radiance", "ingredient"), ("Avoid contact with eyes", "safety"), ("", "source"), ("I love it on my skin", "review")):
        assert one(spark, E.evidence_roles(t)["primary"], t=text) == primary, text
    assert one(spark, E.modality(t), t="It may not help, a study found") == ["not", "may", "help", "study"]
    assert [one(spark, E.evidence_token(t), t=w) for w in ("hydrating", "studies", "피부에서는")] == ["hydr", "study", "피부"]
    assert one(spark, E.support_term(t), t="serums") == "serum" and one(spark, E.support_term(t), t="brand's") == "brand"
    assert one(spark, E.schema_fields(F.array(F.lit("usage"), F.lit("benefit"))), t="") == ["Product.description", "WebPage.description", "content.sections.benefits", "FAQPage.mainEntity", "HowTo.step", "content.sections.howToUse"]
    r = one(spark, E.chunk_routing(F.lit("custom"), F.lit("https://schema.org/FAQPage"), F.lit(None).cast("string"), t), t="x")
    assert (r.intents, r.targets) == (["schema", "faq"], ["FAQPage.mainEntity"])
    assert one(spark, E.chunk_routing(F.lit("eeat"), F.lit("a.md"), F.lit(None).cast("string"), t), t="zzz").intents == ["evidence", "claims"]
    assert one(spark, E.negative_review(t), t="too sticky") and not one(spark, E.negative_review(t), t="끈적임 없이 좋아요")
    assert one(spark, E.cross_sell(t), t="Complete your ritual: step 1 toner, step 2 cream") and one(spark, E.routing_context(t), t="plain words") == "general"
    assert one(spark, E.faq_preference(t, F.lit("20% in 4 weeks")), t="Which ingredients help most?") >= 49
    assert one(spark, E.handle_score(t, F.lit("dew-cream")), t="Dew Cream") == 180 and one(spark, E.specificity(F.lit("sourceTexts[0]"), t), t="x") == 1
    assert one(spark, E.meaningful_review(t), t="Smooth and light on my skin.") and not one(spark, E.meaningful_review(t), t="4.5 / 5")
    assert one(spark, E.strip_promotion(t), t="good\nbuy now\nend") == "good\nend"
    assert one(spark, E.roles_support_topics(t, F.array(F.lit("review"))), t="The ingredients are good") is False
