"""Small tables of product evidence that the driver's tables do not hold: claims, edits, pages, graphs. Our own wording and products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRODUCT = (["Dewy Root Serum"], ["ginseng", "niacinamide"], ["hydration", "firmness"])
PRODUCT_KIND = "struct<names:array<string>,ingredients:array<string>,benefits:array<string>>"

#: claim, cited atoms (role, text), whether a model audited it, the gate it fails, whether its numbers are supported.
CLAIMS = (
    ("Ginseng is included.", [("ingredient", "Ginseng root extract is included.")], False, None, True),
    ("It improves hydration of dry skin.", [("effect", "It does not improve hydration of dry skin.")], False, "polarity", True),
    ("It improves firmness.", [("benefit", "It may improve firmness.")], False, "polarity", True),
    ("This treats eczema on dry skin.", [("benefit", "A cream for dry skin.")], False, "risk", True),
    ("Suits dry skin in winter.", [("audience", "For dry skin.")], False, "context", True),
    ("For dry skin in winter.", [("audience", "For dry skin in winter months.")], False, None, True),
    ("It absorbs fast.", [("review", "It absorbs fast.")], False, "review-not-attributed", True),
    ("Customers say it absorbs fast.", [("review", "It absorbs fast.")], False, "wording", True),
    ("The price is fair.", [("benefit", "The price is fair.")], False, "topic-without-role", True),
    ("A serum.", [("identity", "Dewy Root Serum")], False, "no-evidence", True),
    ("Niacinamide improves firmness.", [("ingredient", "Niacinamide is inside."), ("benefit", "It improves firmness.")], False, "cause", True),
    ("Niacinamide improves firmness.", [("benefit", "Niacinamide improves firmness.")], False, None, True),
    ("건조한 피부를 위한 세럼", [("benefit", "A serum for dry skin.")], True, None, True),
    ("건조한 피부를 위한 세럼", [("benefit", "A serum for dry skin.")], False, "other-script", True),
    ("Glass jar with gold lid.", [("description", "Glass jar.")], False, "wording", True),
    ("Calms redness and feels light on skin", [("benefit", "Feels light on skin every morning")], True, "concept", True),
    ("Skin is generally softer.", [("effect", "Skin is softer.")], False, "context", True),
    ("Hydration rose 20% in 4 weeks.", [("metric", "In a test hydration rose 20% in 4 weeks.")], False, None, True),
    ("20% in 2 weeks", [("metric", "20% of users; others in 2 weeks")], False, None, False),
    ("20% after 4 weeks", [("metric", "evidenceGroup=a; hydration 20%"), ("metric", "evidenceGroup=a; after 4 weeks")], False, None, True),
    ("20% after 4 weeks", [("metric", "evidenceGroup=a; hydration 20%"), ("metric", "evidenceGroup=b; after 4 weeks")], False, None, False),
    ("95% agreed", [("metric", "95% agreed in a clinical study")], False, None, False),
    ("95% agreed in a clinical study", [("metric", "95% agreed in a clinical study")], False, None, True),
    ("1,000 users", [("metric", "1000 users")], False, None, True),
    ("30% firmer", [("metric", "20% firmer")], False, "wording", False),
)

#: before, after, locale, kind, whether it has evidence, strings that stay, whether marks alone may change, the gate it fails.
EDITS = (
    ("It has 20 ml", "It has 30 ml", "en-US", "text", True, [], False, "number"),
    ("It has a light feel", "It has a light feel.", "en-US", "text", True, [], False, None),
    ("It may help skin.", "It helps skin.", "en-US", "text", True, [], False, "modality"),
    ("Skin is soft", "", "en-US", "text", True, [], False, "empty"),
    ("Soft skin", "Soft​skin", "en-US", "text", True, [], False, "unsafe-characters"),
    ("Soft skin", "Soft skin.", "en-US", "text", False, [], False, "no-evidence"),
    ("피부가 부드럽습니다.", "Skin is soft.", "ko-KR", "text", True, [], False, "locale"),
    ("Soft.", "Soft and gentle and kind.", "en-US", "text", True, [], False, "longer"),
    ("A long sentence about soft skin care.", "A long.", "en-US", "text", True, [], False, "shorter"),
    ("Use Dewy Root daily", "Use Dewy root daily", "en-US", "text", True, ["Dewy Root"], False, "fixed-token"),
    ("Apply it, then rinse", "Apply it then rinse off", "en-US", "howto-step", True, [], True, "not-marks-only"),
    ("One review mentions soft skin.", "Reviews mention soft skin.", "en-US", "text", True, [], False, "review-scope"),
    ("Ginseng is inside. It helps skin.", "It is inside. Ginseng helps skin.", "en-US", "text", True, [], False, "cause"),
    ("Is it soft?", "It is soft.", "en-US", "faq-question", True, [], False, "speech-act"),
    ("Soft (very) skin", "Soft very skin", "en-US", "text", True, [], False, "marks"),
    ("Soft skin daily", "Smooth skin daily", "en-US", "text", True, [], False, "substance"),
    ("Skin is soft. Calm skin.", "Skin is soft calm. Skin.", "en-US", "text", True, [], False, "sentences"),
    ("Skin is soft", "Skin are soft", "en-US", "text", True, [], False, "wording"),
    ("very soft soft skin", "very soft skin", "en-US", "text", True, [], False, None),
    ("Skin is soft. Skin is soft.", "Skin is soft.", "en-US", "text", True, [], False, None),
    ("It's a well-known, soft cream", "It's a well-known soft cream", "en-US", "text", True, [], False, "marks"),
)


def claims(spark: SparkSession) -> DataFrame:
    rows = [(i, c, [(f"e{k}", role, text) for k, (role, text) in enumerate(cited)], PRODUCT, audited) for i, (c, cited, audited, _, _) in enumerate(CLAIMS)]
    return spark.createDataFrame(rows, f"claim_id long, claim string, cited array<struct<id:string,role:string,text:string>>, product {PRODUCT_KIND}, audited boolean")


def edits(spark: SparkSession) -> DataFrame:
    rows = [(i, a, b, locale, kind, ["e1"] if backed else [], fixed, marks) for i, (a, b, locale, kind, backed, fixed, marks, _) in enumerate(EDITS)]
    return spark.createDataFrame(rows, "edit_id long, before string, after string, locale string, kind string, evidence_ids array<string>, fixed array<string>, marks_only boolean")


def literal(x) -> str:
    """A value in SQL."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"{x!r}::{'bigint' if isinstance(x, int) else 'double'}"


def expected(columns: str, rows) -> str:
    """SQL of rows that were worked out by hand."""
    names = ", ".join(f'"{c.strip()}"' for c in columns.split(","))
    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"
