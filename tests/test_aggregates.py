"""Aggregates and image headers on own fixtures."""

import struct

import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import images


def test_groups(spark):
    k = spark.createDataFrame([(1, 0, "benefit", "hydration"), (1, 1, "benefit", "radiance"), (1, 2, "benefit", "hydration"), (1, 3, "benefit", "coupon"), (1, 4, "product", "cream")], "id int, ord int, category string, keyword string")
    r = A.keyword_groups(k, "id").first()
    assert r.benefit == ["hydration", "radiance"] and r["product"] == ["cream"] and r.usage is None
    s = spark.createDataFrame([(1, 0, "Soft skin", "a.jpg", ["benefit"]), (1, 1, "soft skin", "b.jpg", ["usage"])], "id int, ord int, text string, image_url string, intents array<string>")
    d = A.sentence_diagnostics(s, "id").first()
    assert (d.text, d.images, d.intents) == ("Soft skin", ["a.jpg", "b.jpg"], ["benefit", "usage"]) and d.fields[-1] == "content.sections.howToUse"
    m = spark.createDataFrame([(1, 0, None, 3.0, ["x"], ["a"]), (1, 1, 4.5, 9.0, ["y", "x"], ["b"])], "id int, ord int, rating double, review_count double, items array<string>, keywords array<string>")
    r = A.merge_reviews(m, "id").first()
    assert (r.rating, r.review_count, r["items"], r.keywords) == (4.5, 3.0, ["x", "y"], ["a", "b"])
    assert m.select(A.rating_line(F.col("rating"), F.col("review_count"))).collect()[0][0] == "3 reviews"
    f = A.merge_facts(m, "id", ("items", "keywords"), 2).first()
    assert f["items"] == ["x", "y"]
    o = spark.createDataFrame([(1, "used", "benefit", None), (1, "dropped", None, "small"), (1, "dropped", None, "small")], "id int, status string, category string, drop_reason string")
    r = A.ocr_summary(o, "id").first()
    assert (r.targets, r.used, r.dropped, r.reasons, r.by_category) == (3, 1, 2, {"small": 2}, {"benefit": 1}) and r.utilization == pytest.approx(1 / 3)


def test_sources_and_plans(spark):
    rows = [(1, f"s{i}", "custom", 9.0 - i, 0.5) for i in range(7)] + [(1, "paper", "geo-research", 0.0, 0.9), (1, "cep", "cep", 0.0, 0.1)]
    got = [r.source for r in A.principle_sources(spark.createDataFrame(rows, "p int, source string, kind string, fit double, score double"), "p").orderBy("place").collect()]
    assert got == ["s0", "s1", "s2", "s3", "paper", "cep"]
    n = spark.createDataFrame([(1, "20% in 4 weeks; evidenceGroup=a"), (1, "30%; evidenceGroup=a"), (1, "5%; evidenceGroup=b")], "id int, text string")
    r = A.grouped_numbers(n, "id").collect()
    assert [(x.evidence_group, sorted(x.tokens)) for x in r] == [("a", ["20%", "30%", "4week"])]
    p = spark.createDataFrame([(1, "Dew", "Moss", None, "en-US")], "id int, name string, brand string, category string, locale string")
    assert [(x.query_id, x.query) for x in A.query_plan(p, ["faq", "faq", "howTo"], 2).orderBy("query_id").collect()] == [("0-general", "Dew Moss en-US"), ("1-faq", "Dew Moss en-US faq")]


def test_image_sizes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 320, 200) + b"\x08"
    gif = b"GIF89a" + struct.pack("<HH", 10, 20)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 480, 640) + b"\x00" * 10
    webp = b"RIFF" + b"\0" * 4 + b"WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [images.image_size(x) for x in (png, gif, jpg, webp, b"", None, b"xx")] == [(320, 200), (10, 20), (640, 480), (100, 50), None, None, None]
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.bin").write_bytes(b"zz")
    assert sorted((r.width, r.height) for r in images.read_images(spark, str(tmp_path)).where("width is not null").collect()) == [(320, 200)]
