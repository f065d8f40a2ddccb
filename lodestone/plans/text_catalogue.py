"""Registered queries of text functions, predicates, classifiers and scores: all passages of ``benchmark`` and the product sentences below.

The SQL states each rule again from its definition, on the same fixed vocabularies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import signals as S
from lodestone.functions import text as T
from lodestone.plans.catalogue import _hit, _rule, clean, finger, query, read
from lodestone.plans.fixtures import literal

#: title, text
SENTENCES = (
    ("How to use", "Apply two pumps to clean skin every morning and night, then massage until absorbed."),
    ("Clinical results", "After 4 weeks of use, 92% of women agreed that skin hydration improved."),
    ("Ingredients", "Ingredients: Water, Glycerin, Niacinamide, Panthenol, Butylene Glycol, Sodium Hyaluronate, Ceramide NP, Citrus Extract, Fragrance"),
    ("전성분", "전성분: 정제수, 글리세린, 다이프로필렌글라이콜, 나이아신아마이드, 판테놀, 세라마이드엔피, 카보머, 토코페롤, 잔탄검"),
    ("사용법", "세안 후 적당량을 덜어 얼굴에 펴 발라 흡수시켜 주세요."),
    ("효능", "피부 장벽을 강화하고 보습과 탄력에 도움을 줍니다."),
    ("결과", "4주 사용 후 피부 수분이 32.5% 개선되었습니다."),
    ("Reviews", "4.8 out of 5 from 1,204 reviews: customers say it absorbs fast and feels smooth."),
    ("FAQ", "Can I use this serum every day on sensitive skin?"),
    ("자주 묻는 질문", "민감 피부도 사용할 수 있나요?"),
    ("Price", "$ 48.00 for 30 ml, sale price 39,000원, free shipping and returns"),
    ("Shipping", "Free shipping on all orders. Returns are accepted within 30 days at checkout."),
    ("", "장바구니 담기 구매하기 배송비 2,500원"),
    ("Option", "세럼 50ml 본품 + 리필 세트"),
    ("Shade", "Set of 2, 30 ml"),
    ("Review", "Write a review, sort by newest"),
    ("Good for", "Good for dry skin and combination skin; helps with dullness, fine lines and wrinkles."),
    ("Key ingredients", "Panax ginseng extract, retinol and a peptide blend for firmer, more elastic skin."),
    ("", "[Detail 3] Immediately after use, moisture rose by 2.5 times in a clinical study."),
    ("Notes", "• Keeps its shape in the jar • Opens with a soft click • Closes tight every time"),
    ("", "rating: 3.9 of a possible five, 77"),
    ("", "4 stars"),
    ("", "うるおいを与えるセラム 朝 夜"),
    ("List", "Dry, Oily, dry, Sensitive, oily"),
    ("", "A2 milk, SPF50 and PA-4 sit beside UV-B and vitamin B3"),
    ("", "https://shop.example/list,of/things"),
    ("", "1,234"),
    ("", ""),
    ("Care", "What is in it? An answer follows. It has ginseng!  Use it at night."),
    ("제품 설명", "건성 피부와 민감 피부를 위한 고밀도 크림 / 대용량 | 한정"),
)


def sentences(spark, sf_dir) -> DataFrame:
    fixed = spark.createDataFrame([(-1 - i, a, b) for i, (a, b) in enumerate(SENTENCES)], "id long, title string, text string")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("").alias("title"), "text").unionByName(fixed)


ROWS = "(select item_id as id, '' as title, text from benchmark union all select * from (values " + ", ".join(f"({-1 - i}, {literal(a)}, {literal(b)})" for i, (a, b) in enumerate(SENTENCES)) + ") f(id, title, text))"
V = f"(select *, {clean('text')} as v from {ROWS})"
SPACE = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*"


def hit(x: str, pattern: str) -> str:
    return _hit(x, _rule(pattern).replace("'", "''"))


def every(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, '(?i){_rule(pattern)}')"


def plain_list(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"


def commerce(x: str) -> str:
    v = clean(x)
    return f"({hit(v, S.HARD_COMMERCE)} or (length({v}) > 120 and {hit(v, S.POLICY)} and len({every(v, S.STRONG_CARE)}) < 2))"


def full_list(x: str) -> str:
    v = clean(rf"regexp_replace({x}, '^\[[^\]]+\]{SPACE}', '')")
    words = f"list_distinct(list_transform(list_concat({every(v, f'{T.BEGIN}(?:{S.INGREDIENT_LATIN}){T.END}')}, {every(v, S.INGREDIENT_KOREAN)}), lambda w: lower(w)))"
    label = r"^(?:ingredients?|전성분|全成分)\s*:"
    rest = rf"length(regexp_replace({v}, '(?i){label}?\s*', '')) >= 12"
    return f"(({hit(v, label)} and {rest}) or (len(regexp_extract_all({v}, ',')) >= 8 and len({words}) >= 5))"


def timeline(x: str) -> str:
    v = clean(x)
    return f"({hit(v, S.TIMELINE_WHEN)} and {hit(v, S.TIMELINE_WHAT)} and not {hit(v, S.TIMELINE_NOT)})"


def usage(x: str) -> str:
    return f"({hit(clean(x), S.USAGE)} and not {timeline(x)})"


METRIC = rf"{T.BEGIN}\d+(?:\.\d+)?\s?%|{T.BEGIN}\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?\s?(?:weeks?|days?|hours?|drops?|pumps?|times?){T.END}|주|일|시간|회"
OPTION = r"\d+(?:\.\d+)?\s?(?:ml|g|kg|oz|호|매|개입|입|세트)|단품|세트|리필|본품|기획|색상|컬러|호수|shade|size|set|refill|크림|세럼|에센스|앰플|토너|로션"
BARE_OPTION = r"^(총 상품가|혜택 적용가|장바구니|구매하기|상품을 선택해주세요|선택|옵션|[-+]?|\d+|[0-9,]+원)$"
SIGNAL = rf"\d+(?:\.\d+)?\s*(?:%|배)|{T.BEGIN}\d+(?:\.\d+)?\s*(?:weeks?|days?|hours?|명|주|일|시간){T.END}"


@query(
    f"""select id, candidate_text <> '' and not {commerce('candidate_text')} and ({hit('candidate_text', S.CARE)} or {hit('candidate_text', S.REVIEW)} or ({hit('candidate_text', METRIC)} and {hit('candidate_text', S.CARE)})) as candidate,
    {hit('text', METRIC)} and {hit('text', S.CARE)} as metric, {timeline('text')} as timeline, {usage('text')} as usage, {hit('text', SIGNAL)} as signal, {full_list('text')} as full_list,
    v <> '' and length(v) <= 80 and not {commerce('v')} and not {hit('v', BARE_OPTION)} and {hit('v', OPTION)} as option, {hit('v', S.QUESTIONS)} as question, {hit('text', S.REVIEW_CHROME)} and length(text) < 120 as chrome
    from (select *, {clean("title || ' ' || text")} as candidate_text from {V})"""
)
def product_predicates(spark, sf_dir):
    """Which of nine predicates hold for a sentence."""
    t = F.col("text")
    made = {"candidate": S.evidence_candidate(F.col("title"), t), "metric": S.metric_evidence(t), "timeline": S.measurement_timeline(t), "usage": S.usage_instruction(t), "signal": S.metric_signal(t), "full_list": S.full_ingredient_list(t)}
    made |= {"option": S.product_option(t), "question": S.faq_question(t), "chrome": S.review_chrome(t)}
    return sentences(spark, sf_dir).select("id", *[v.alias(k) for k, v in made.items()])


def counts(x: str) -> str:
    return ", ".join(f"len(list_distinct({every(x, p)})) as n{i}" for i, p in enumerate(S.KEYWORDS.values()))


def top(prefix: str = "") -> str:
    n = [f"{prefix}n{i}" for i in range(len(S.KEYWORDS))]
    best = f"greatest({', '.join(n)})"
    return "case when " + f"{best} = 0 then null " + " ".join(f"when {c} = {best} then '{k}'" for c, k in zip(n, S.KEYWORDS, strict=True)) + " end"


def rules(pairs) -> str:
    return " ".join(f"when {hit(x, p)} then '{n}'" for x, n, p in pairs)


@query(
    f"""select id, case when {commerce('joined')} or {commerce('text')} then 'unknown' when {full_list('text')} then 'ingredient' {rules(('label', n, p) for n, p in S.SECTION_TITLES)} {rules(('joined', n, p) for n, p in S.SECTION_TEXTS)}
      when dominant in ('benefit', 'effect', 'ingredient', 'usage', 'faq', 'review', 'metric') then dominant else 'unknown' end as section,
    case when {commerce('text')} then 'unknown' when {timeline('text')} then case when regexp_matches(text, '[0-9%]') then 'metric' else 'effect' end when {usage('text')} then 'usage' {rules(('text', n, p) for n, p in S.INSIGHTS)} else dominant end as insight, dominant
    from (select *, label || ' ' || lower(substr(text, 1, 220)) as joined, {top()} as dominant from (select *, lower({clean('title')}) as label, {counts('text')} from {ROWS}))"""
)
def text_categories(spark, sf_dir):
    """Section, insight and dominant keyword category of a sentence."""
    t = F.col("text")
    return sentences(spark, sf_dir).select("id", S.section_category(F.col("title"), t).alias("section"), S.insight_category(t).alias("insight"), S.dominant_category(t).alias("dominant"))


@query(
    "select id, category, keyword from (select *, row_number() over (partition by id, category, lower(keyword) order by i) as rn from ("
    + " union all ".join(f"select id, '{c}' as category, unnest({every('text', p)}) as keyword, generate_subscripts({every('text', p)}, 1) as i from {ROWS}" for c, p in S.KEYWORDS.items())
    + ")) where rn = 1"
)
def keywords_by_category(spark, sf_dir):
    """All keywords of each of the nine categories, each spelling once."""
    return sentences(spark, sf_dir).select("id", F.explode(S.all_keywords(F.col("text"))).alias("k")).select("id", "k.category", "k.keyword")


GROUPS = (
    "benefit|ingredient|how to use|how-to-use|directions|ritual|faq|result|clinical|review|summary|formulated without|key ingredients?", "skin|serum|cream|ginseng|retinol|niacinamide|peptide|wrinkle|firm|elastic|moistur|texture|radiance|anti-aging|apply|water|aqua|glycol|extract",
    "피부|보습|수분|진정|탄력|장벽|주름|효능|효과|성분|사용|리뷰|자생력|고밀도|영양|인삼|펩타이드|스킨케어",
)
NAME = "Panax Ginseng Serum"


@query(
    f"""select id, (3 * len(list_filter(['panax', 'ginseng', 'serum'], lambda w: contains(lower(text), w))) + 4 * ({' + '.join(f"{hit('text', g)}::int" for g in GROUPS)}) + least(length(text) // 120, 6) - case when {commerce('text')} then 12 else 0 end)::bigint as score,
    case when path = 'semanticFacts.metricClaims' then 5 when path = 'semanticFacts.x' then 4 when path = 'reviews.keywords' then 3 when path = 'sourceTexts' then case when length(text) <= 320 then 1 else 0 end else 2 end as specificity
    from (select *, ['semanticFacts.metricClaims', 'semanticFacts.x', 'reviews.keywords', 'sourceTexts', 'name'][abs(id) % 5 + 1] as path from {ROWS})"""
)
def text_scores(spark, sf_dir):
    """Fit of a sentence to a product name, and how specific its source path is."""
    path = F.element_at(F.array(*map(F.lit, ("semanticFacts.metricClaims", "semanticFacts.x", "reviews.keywords", "sourceTexts", "name"))), (F.abs("id") % 5 + 1).cast("int"))
    return sentences(spark, sf_dir).select("id", S.product_text_score(F.col("text"), F.lit(NAME)).cast("long").alias("score"), E.specificity(path, F.col("text")).alias("specificity"))


PRICE = rf"(?i)(?:[$€£¥]{SPACE})\d[\d,.]*|₩{SPACE}\d[\d,.]*|\d[\d,.]*{SPACE}(?:원|KRW|USD|EUR|JPY)"
RATED = (rf"(?i)([1-5](?:\.\d+)?){SPACE}(?:out of|/){SPACE}5|([1-5](?:\.\d+)?){SPACE}(?:stars?|점|별점)", r"(?i)(?:rating|평점|별점)[^\d]{0,20}([1-5](?:\.\d+)?)")
COUNTED = rf"(?i)([\d,]+){SPACE}(?:reviews?|ratings?|개의 리뷰|리뷰|후기|평점)"


@query(
    f"""select id, nullif(regexp_replace(regexp_extract(text, '{PRICE}'), '[.,]+$', ''), '') as price, try_cast(regexp_replace(text, '[^0-9.]', '', 'g') as double) as amount,
    coalesce(try_cast(nullif(regexp_extract(v, '{RATED[0]}', 1), '') as double), try_cast(nullif(regexp_extract(v, '{RATED[0]}', 2), '') as double), try_cast(nullif(regexp_extract(v, '{RATED[1]}', 1), '') as double)) as rating,
    try_cast(nullif(case when regexp_extract(v, '{COUNTED}', 1) <> '' then replace(regexp_extract(v, '{COUNTED}', 1), ',', '') when regexp_matches(v, '^\\d+$') then v end, '') as double) as reviews from {V}"""
)
def text_amounts(spark, sf_dir):
    """Price, amount, rating and count of reviews in a sentence."""
    t = F.col("text")
    return sentences(spark, sf_dir).select("id", T.find_price(t).alias("price"), T.price_amount(t).alias("amount"), T.rating_value(t).alias("rating"), T.review_count(t).alias("reviews"))


IDENTIFIERS = r"\b(?:[A-Z]{2,}[A-Z0-9-]*|[A-Za-z]+\d+[A-Za-z0-9-]*|\d+[A-Za-z]+[A-Za-z0-9-]*)\b"
PHRASES = (rf"(?i)\b\d+(?:\.\d+)?\s?%|\b\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?\s?(?:{T.UNITS})\b", r"(?i)\b(?:after|in)\s+\d+(?:\.\d+)?\s?(?:weeks?|days?|hours?)\b", r"\b\d+(?:\.\d+)?\s?(?:점|개|명|회|주|일|시간|퍼센트)")


@query(
    rf"""select id, {plain_list(f"list_distinct(regexp_extract_all(text, '{IDENTIFIERS}'))")} as identifiers,
    {plain_list(rf"list_distinct(list_concat(regexp_extract_all(v, '(?i)(?:dry|sensitive|oily|combination)\s+skin'), regexp_extract_all(v, '(?:건조|건성|민감|지성|복합성)\s*피부')))")} as skins,
    regexp_replace(lower(v), '[^\p{{L}}\p{{N}}]+', '', 'g') as compared, {clean(rf"regexp_replace(text, '^\[[^\]]+\]{SPACE}', '')")} as unlabelled,
    case when regexp_matches(trim(text), '(?i)^https?://') then trim(text) else array_to_string(list_filter(list_transform(string_split_regex(trim(text), '\n|,| \| | / '), lambda x: {clean('x')}), lambda x: x <> ''), '|') end as items,
    case when regexp_matches(text, '[\x{{3040}}-\x{{30FF}}]') then 'JP' when regexp_matches(text, '[\x{{AC00}}-\x{{D7AF}}]') then 'KR' else 'US' end as market from {V}"""
)
def text_forms(spark, sf_dir):
    """Codes, skin types, comparison form, text without its label, list items and market of a sentence."""
    t = F.col("text")
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return sentences(spark, sf_dir).select(
        "id", joined(T.identifier_tokens(t)).alias("identifiers"), joined(T.skin_type_signals(t)).alias("skins"), T.comparison_text(t).alias("compared"), T.strip_source_label(t).alias("unlabelled"), F.array_join(T.split_list(t), "|").alias("items"), T.market_of(T.infer_locale(t)).alias("market"),
    )


@query(
    f"""select id, {plain_list(f"list_distinct(list_concat(list_concat(regexp_extract_all(text, '{PHRASES[0]}'), regexp_extract_all(text, '{PHRASES[1]}')), []::varchar[]))")} as phrases from {ROWS} where not regexp_matches(text, '[가-힣]')"""
)
def measured_phrases(spark, sf_dir):
    """Shares, amounts and durations in a sentence without Korean text (whose counters SQL's word borders cannot tell)."""
    rows = sentences(spark, sf_dir).where(~F.col("text").rlike("[가-힣]"))
    return rows.select("id", F.array_join(F.array_sort(T.metric_phrases(F.col("text"))), "|").alias("phrases"))


PAIRS = f"(select a.id as a, b.id as b, a.text as x, b.title as y, b.text as z from {ROWS} a join {ROWS} b on a.id < 0 and b.id < 0)"


@query(
    f"""select a, b, (y <> '' and contains(lower(x), lower(y))) or (y = '') or (length(cy) >= 2 and contains(cx, cy)) as includes, length(fx) >= 12 and length(fz) >= 12 and (contains(fz, substr(fx, 1, 120)) or contains(fx, substr(fz, 1, 120))) as belongs
    from (select *, regexp_replace(lower({clean('x')}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as cx, regexp_replace(lower({clean('y')}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as cy, {finger('x')} as fx, {finger('z')} as fz from {PAIRS})"""
)
def sentence_pairs(spark, sf_dir):
    """Whether a sentence names another one's title, and whether it belongs to that one; over all pairs of the product sentences."""
    own = sentences(spark, sf_dir).where("id < 0")
    pairs = own.select(F.col("id").alias("a"), F.col("text").alias("x")).join(F.broadcast(own.select(F.col("id").alias("b"), F.col("title").alias("y"), F.col("text").alias("z"))))
    return pairs.select("a", "b", S.includes_keyword(F.col("x"), F.col("y")).alias("includes"), S.sentence_belongs(F.col("x"), F.col("z")).alias("belongs"))


# roles and routes

ASKED = E.QUESTION.replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)")
FLAGS = {
    "commerce": f"({hit('t', E.OFFER)} or {commerce('t')})", "safety": hit("t", E.SAFETY), "review": hit("t", E.EXPERIENCE), "instruction": usage("t"), "num": hit("t", SIGNAL),
    **{k: hit("t", S.KEYWORDS[k]) for k in ("ingredient", "benefit", "effect")}, "audience": hit("t", E.AUDIENCE), "asked": hit("t", ASKED),
}
OPEN = "not safety and not review and not uses and not commerce"
ROLES = {"commerce": "commerce", "safety": "safety", "review": "review", "usage": "uses", "metric": "metric", "ingredient": "made", "benefit": f"({OPEN} and not metric and benefit)", "effect": f"({OPEN} and effect)", "audience": "audience"}


@query(
    f"""with f as (select id, t, {', '.join(f'{v} as {k}' for k, v in FLAGS.items())} from (select id, v as t from {V})),
    g as (select *, not safety and not review and not commerce and instruction as uses, not commerce and num as metric, not commerce and not review and ingredient as made from f),
    h as (select *, list_filter([{', '.join(f"case when {v} then '{k}' end" for k, v in ROLES.items())}], lambda x: x is not null) as found, not asked and t <> '' and made and ({ROLES['benefit']} or {ROLES['effect']}) and not metric and not review and not safety as links from g),
    r as (select *, case when t = '' then ['source'] when asked then ['faq'] when len(found) = 0 then ['source'] else found end as roles from h)
    select id, array_to_string(roles, ',') as roles, links, case {' '.join(("when links and list_contains(roles, 'ingredient') then 'ingredient' " if p == 'audience' else '') + f"when list_contains(roles, '{p}') then '{p}'" for p in E.PRECEDENCE)} else 'source' end as first from r"""
)
def sentence_roles(spark, sf_dir):
    """Roles of a sentence, the one that counts, and whether it links an ingredient to an outcome."""
    made = sentences(spark, sf_dir).select("id", E.evidence_roles(F.col("text")).alias("r"))
    return made.select("id", F.array_join("r.roles", ",").alias("roles"), "r.links", F.col("r.primary").alias("first"))


def _routes(at: int) -> str:
    lists = [f"case when regexp_matches(h, '{_rule(r[1])}') then {'[' + ', '.join(map(literal, r[at])) + ']' if r[at] else '[]::varchar[]'} else []::varchar[] end" for r in E.ROUTES]
    return "list_distinct(flatten([" + ", ".join(lists) + "]))"


@query(
    f"""select id, array_to_string(list_sort(case when len(i) > 0 then i else ['general'] end), ',') as intents, array_to_string(list_sort(case when len(t) > 0 then t else ['PDP.content'] end), ',') as targets
    from (select id, {_routes(2)} as i, {_routes(3)} as t from (select id, lower('src ' || title || ' ' || text) as h from {ROWS}))"""
)
def sentence_routes(spark, sf_dir):
    """Intents and field targets of a sentence as a chunk of a policy document of no special kind."""
    made = sentences(spark, sf_dir).select("id", E.chunk_routing(F.lit("custom"), F.lit("src"), F.col("title"), F.col("text")).alias("r"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return made.select("id", joined("r.intents").alias("intents"), joined("r.targets").alias("targets"))
