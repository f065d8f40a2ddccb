"""Predicates and classifiers over product text, as Column expressions on named vocabularies.

The vocabularies are fixed values: results depend on their words and, where rules are tried in turn, on their order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import BEGIN, END, UNITS, clean_text, comparison_text, fingerprint, let, matched, matches, names_any, strip_source_label

# Vocabularies of signals.
HARD_COMMERCE = "레이어\\s*(?:열기|닫기)|장바구니|구매하기|바로구매|제품 수량|상품 수량|수량 감소|수량 증가|총 상품가|혜택 적용가|네이버페이|뷰티포인트|적립 제외|사용 제외|재입고|알림 신청|판매자 정보|상품정보제공 고시|배송/교환/반품|배송지역|배송기간|배송비|교환/반품|반품/교환|청약철회|고객센터|택배기사|회수 상품|반송 주소|구매안전서비스|에스크로|KG이니시스|무료배송|첫 구매 혜택|혜택보기|cart|checkout|shipping|returns?|refund|subscribe|newsletter"
POLICY = "배송|교환|반품|환불|주문취소|청약철회|고객변심|택배|반송|회수|미성년자|법정대리인|이용약관|도서지역|사서함|배송비|판매자|고시"
CARE = "피부|보습|수분|탄력|장벽|광채|영양|진정|주름|잔주름|피부결|고밀도|자생력|인삼|레티놀|나이아신아마이드|펩타이드|히알루론산|세라마이드|콜라겐|비타민|성분|효능|효과|사용법|도포|세럼|크림|에센스|앰플|토너|로션|serum|cream|essence|ampoule|skin|hydration|moisture|firming|firmness|firmer|elastic|radiance|resilience|plumpness|wrinkle|ingredient|retinol|niacinamide|peptide|hyaluronic|apply"
STRONG_CARE = "피부|보습|수분|탄력|장벽|광채|주름|피부결|인삼|레티놀|나이아신아마이드|펩타이드|효능|효과|사용법|도포|hydration|firming|wrinkle|ingredient|retinol|niacinamide|apply"
REVIEW = "리뷰|후기|평점|별점|재구매|만족|흡수|촉촉|review|rating|stars?|repurchase|satisfied|smooth|customer"
FAQ = "\\?|FAQ|Q&A|자주|질문|답변"
OBSTRUCTIVE = "(^|[-_\\s])(modal|popup|overlay|backdrop|newsletter|klaviyo|cookie|drawer|cart|account|search)([-_\\s]|$)"
TIMELINE_WHEN = "사용\\s*(?:전|직후|후)|사용\\s+\\d|before use|after use|immediately after use|after\\s+\\d+(?:\\.\\d+)?\\s?(?:weeks?|days?|hours?)"
TIMELINE_WHAT = "결과|개선|효과|측정|수분|보습|장벽|피부결|탄력|주름|%|\\d|clinical|result|improv|hydration|moisture|barrier|texture|firmness|wrinkle"
TIMELINE_NOT = "사용법|사용 방법|사용방법|도포|바르|펴 발라|적당량|펌프|펌핑|흡수시켜|apply|dispense|massage|rinse|routine"
USAGE = "how to use|directions?|apply|dispense|massage|rinse|morning|night|routine|pump|drops?|사용법|사용 방법|사용방법|도포|바르|펴 발라|적당량|펌프|펌핑|아침|저녁|루틴|흡수시켜|朝|夜"
INGREDIENT_LATIN = "water|aqua|eau|glycerin|glycol|sodium|potassium|cocoyl|cocoate|betaine|acrylates?|peg-\\d+|chloride|edta|extract|fragrance|parfum|limonene|benzoate|hydroxide|caprylyl|capryl|citrus|niacinamide|retinol|panthenol|ceramide|hyaluronic|butylene"
INGREDIENT_KOREAN = "정제수|글리세린|글라이콜|다이올|오일|추출물|애씨드|알코올|세라마이드|판테놀|콜레스테롤|카보머|토코페롤|레시틴|왁스|폴리머|크로스폴리머|글루코|스쿠알란|실리카|이디티에이|트로메타민|잔탄검|하이드로|메티콘|스테아레이트|카프릴|팔미|라우릭|미리스틱|올레익|만니톨|소듐|포스페이트|락톤"
#: Keyword patterns of each category, in the order in which categories are tried.
KEYWORDS = {
    "product": "serum|cream|essence|ampoule|toner|lotion|cleanser|mask|선크림|세럼|크림|에센스|앰플|토너|로션|마스크",
    "price": "(?:\\$|₩)\\s*[\\d,.]+|[\\d,]+\\s*원|price|sale|discount|가격|할인",
    "ingredient": "ginseng|retinol|niacinamide|peptide|hyaluronic|ceramide|collagen|panax|vitamin|성분|원료|진세노믹스|인삼|레티놀|나이아신아마이드|펩타이드|히알루론산|세라마이드|콜라겐|비타민",
    "benefit": "보습|수분|진정|탄력|장벽|광채|영양|고밀도|자생력|hydration|moisture|moisturizing|soothing|brightening|firming|anti-aging|radiance|elasticity|resilience|plumpness",
    "effect": "효과|개선|완화|케어|주름|잔주름|피부결|리프팅|effect|improve|improved|improvement|care|reduce|diminish|diminished|fine lines|wrinkles|texture|even|elastic|firmer|lift|lifting|firmness",
    "usage": "use|apply|morning|night|ritual|pump|face|neck|사용|도포|아침|저녁|루틴|펌프|얼굴|목",
    "faq": "\\?|faq|question|answer|what are|how does|can i|자주|질문|답변",
    "review": "촉촉|흡수|만족|재구매|가벼운|산뜻|review|rating|customer|smooth|satisfied|repurchase|stars",
    "metric": f"{BEGIN}\\d+(?:\\.\\d+)?\\s?%|{BEGIN}\\d+(?:\\.\\d+)?(?:-\\d+(?:\\.\\d+)?)?\\s?(?:{UNITS}|점|개|명|회|주|일|시간|퍼센트){END}",
}
KEYWORD_CONFIDENCE = 0.66
#: Section categories by title, then by title and the text's beginning, in order.
SECTION_TITLES = (
    ("ingredient", "^(ingredients?|key ingredients?|formula|formulated without|성분|주요 성분|전성분|원료)$"),
    ("usage", "^(how to use|how-to-use|directions|application|ritual|routine|사용법|사용 ?방법|사용|도포)$"),
    ("benefit", "^(benefits?|why you'?ll love it|good for|장점|효능|피부\\s?고민)$"),
    ("effect", "^(clinical results?|results?|efficacy|효과|결과|개선)$"),
)
#: Two of the titles' rules come again here: the first pass asks for a whole title, this one for a word in title or text.
SECTION_TEXTS = (
    ("rating", "rating|stars?|평점|별점"),
    ("review", "review|customer|리뷰|후기"),
    ("faq", "faq|question|answer|q&a|자주|질문|답변"),
    ("ingredient", "ingredient|formula|formulated without|성분|원료|전성분"),
    ("usage", "how to use|how-to-use|directions|application|ritual|routine|사용법|사용 ?방법|사용|도포"),
    ("benefit", "benefit|why you|good for|helps|장점|효능|피부\\s?고민|보습|수분|탄력|장벽|광채|자생력|고밀도"),
    ("effect", "clinical|result|efficacy|improvement|improved|diminish|diminished|firmer|elastic|wrinkles?|fine lines|효과|결과|개선"),
)
INSIGHTS = (
    ("effect", "clinical|result|after\\s+\\d|showed|agreed|improvement|improved|enhances?|diminish|diminished|visible signs|wrinkles?|fine lines|firmness|firmer|elasticity|resilience|texture|even|효과|결과|개선|주름|피부결|탄력"),
    ("ingredient", "ingredient|formula|blend|peptide|ginseng|retinol|niacinamide|hyaluronic|ceramide|panax|extract|성분|원료|인삼|펩타이드|레티놀"),
    ("benefit", "benefit|hydration|moisture|moisturizing|soothing|brightening|barrier|radiance|plumpness|보습|수분|진정|장벽|광채|자생력|고밀도"),
    ("metric", f"{BEGIN}\\d+(?:\\.\\d+)?\\s?(?:%|(?:weeks?|days?|hours?|ml|oz|drops?|pumps?|점|개|명|회|주|일|시간|퍼센트){END})"),
    ("review", "review|customer|rating|stars?|리뷰|후기|평점"),
    ("faq", "\\?|faq|question|answer|자주|질문|답변"),
)


def _flags(t: Column) -> Column:
    """What the vocabularies find in a text, each looked for once and only where it can count."""
    def of(low: Column) -> Column:
        strong = F.when(names_any(low, STRONG_CARE), F.size(matched(low, STRONG_CARE)) >= 2).otherwise(F.lit(False))
        commerce = lambda s: names_any(low, HARD_COMMERCE) | ((F.length(low) > 120) & names_any(low, POLICY) & ~s)
        return let(strong, lambda s: F.struct(s.alias("strong"), commerce(s).alias("commerce"), names_any(low, CARE).alias("care"), names_any(low, REVIEW).alias("review"), names_any(low, FAQ).alias("faq")))

    return let(F.lower(clean_text(F.coalesce(t, F.lit("")))), of)


def document_signals(t: Column) -> Column:
    """``struct<care, strong_care, commerce, review, faq>``: the signals below, with every vocabulary looked up once."""
    return let(_flags(t), lambda f: F.struct(f["care"].alias("care"), f["strong"].alias("strong_care"), f["commerce"].alias("commerce"), (f["review"] & ~f["commerce"]).alias("review"), (f["faq"] & f["care"]).alias("faq")))


def care_signal(t: Column) -> Column:
    return names_any(F.lower(F.coalesce(t, F.lit(""))), CARE)


def strong_care_signal(t: Column) -> Column:
    return let(F.lower(F.coalesce(t, F.lit(""))), lambda low: F.when(names_any(low, STRONG_CARE), F.size(matched(low, STRONG_CARE)) >= 2).otherwise(F.lit(False)))


def commerce_text(t: Column) -> Column:
    """Shop chrome and policies rather than product text."""
    return _flags(t)["commerce"]


def review_evidence(t: Column) -> Column:
    return let(_flags(t), lambda f: f["review"] & ~f["commerce"])


def faq_evidence(t: Column) -> Column:
    return let(_flags(t), lambda f: f["faq"] & f["care"])


def metric_evidence(t: Column) -> Column:
    """A number with a unit, or a bare Korean counter (it needs no number), in care text."""
    return matches(t, f"{BEGIN}\\d+(?:\\.\\d+)?\\s?%|{BEGIN}\\d+(?:\\.\\d+)?(?:-\\d+(?:\\.\\d+)?)?\\s?(?:weeks?|days?|hours?|drops?|pumps?|times?){END}|주|일|시간|회") & care_signal(t)


def evidence_candidate(title: Column, text: Column) -> Column:
    v = clean_text(F.concat(title, F.lit(" "), text))
    return (v != "") & ~commerce_text(v) & (care_signal(v) | review_evidence(v) | faq_evidence(v) | metric_evidence(v))


def obstructive_node(attributes: Column, text: Column) -> Column:
    short = F.length(text) < 40
    return matches(attributes, OBSTRUCTIVE) & (short | matches(text, "subscribe|newsletter|cookie|sign up|log ?in|your cart|장바구니|로그인|구독"))


def metric_signal(t: Column) -> Column:
    return matches(t, f"\\d+(?:\\.\\d+)?\\s*(?:%|배)|{BEGIN}\\d+(?:\\.\\d+)?\\s*(?:weeks?|days?|hours?|명|주|일|시간){END}")


def full_ingredient_list(t: Column) -> Column:
    v = clean_text(strip_source_label(t))
    labelled = matches(v, r"^(?:ingredients?|전성분|全成分)\s*:") & (F.length(F.regexp_replace(v, r"(?iu)^(?:ingredients?|전성분|全成分)\s*:?\s*", "")) >= 12)
    found = F.array_distinct(F.transform(F.concat(matched(v, f"{BEGIN}(?:{INGREDIENT_LATIN}){END}"), matched(v, INGREDIENT_KOREAN)), lambda x: F.lower(x)))
    return labelled | ((F.regexp_count(v, F.lit(",")) >= 8) & (F.size(found) >= 5))


def measurement_timeline(t: Column) -> Column:
    v = clean_text(t)
    return matches(v, TIMELINE_WHEN) & matches(v, TIMELINE_WHAT) & ~matches(v, TIMELINE_NOT)


def usage_instruction(t: Column) -> Column:
    v = clean_text(t)
    return matches(v, USAGE) & ~measurement_timeline(v)


#: How a question begins or what it holds; chrome of review widgets. Fixed values.
QUESTIONS = f"\\?|^(?:how|what|when|where|why|can|should|is|are|does|do|which){END}|자주|질문|답변"
REVIEW_CHROME = "write a review|sort by|filter|load more|see more reviews|리뷰 작성|정렬|필터"


def faq_question(t: Column) -> Column:
    return matches(clean_text(t), QUESTIONS)


def faq_item(question: Column, answer: Column) -> Column:
    """An answered question that is no shop chrome."""
    return (F.length(question) > 0) & (F.length(answer) > 0) & faq_question(question) & ~commerce_text(F.concat_ws(" ", question, answer))


def review_chrome(t: Column) -> Column:
    """Text of a review widget rather than of a review."""
    return matches(t, REVIEW_CHROME) & (F.length(t) < 120)


def includes_keyword(text: Column, keyword: Column) -> Column:
    """Containment in any case, or after separators are dropped."""
    key = comparison_text(keyword)
    return F.contains(F.lower(text), F.lower(keyword)) | ((F.length(key) >= 2) & F.contains(comparison_text(text), key))


def sentence_belongs(sentence: Column, candidate: Column) -> Column:
    a, b = fingerprint(sentence), fingerprint(candidate)
    return (F.length(a) >= 12) & (F.length(b) >= 12) & (F.contains(b, F.substring(a, 1, 120)) | F.contains(a, F.substring(b, 1, 120)))


def product_option(t: Column) -> Column:
    v = clean_text(t)
    bare = "^(총 상품가|혜택 적용가|장바구니|구매하기|상품을 선택해주세요|선택|옵션|[-+]?|\\d+|[0-9,]+원)$"
    return (v != "") & (F.length(v) <= 80) & ~commerce_text(v) & ~matches(v, bare) & matches(v, "\\d+(?:\\.\\d+)?\\s?(?:ml|g|kg|oz|호|매|개입|입|세트)|단품|세트|리필|본품|기획|색상|컬러|호수|shade|size|set|refill|크림|세럼|에센스|앰플|토너|로션")


def semantic_value(t: Column, category: Column) -> Column:
    """Whether a text can stand for a field of that category."""
    v = clean_text(t)
    usage = ~matches(v, "^(use|사용|주의|face|neck|얼굴|목)$") & matches(v, "도포|사용법|아침|저녁|루틴|펌프|펌핑|스킨케어|apply|morning|night|routine|pump|drops?")
    benefit = ~matches(v, "^(혜택|benefit|장점)$") & ~matches(v, "할인|쿠폰|구매|배송|반품|교환|적립|혜택 적용가|benefit price|reward|point") & matches(v, "보습|수분|진정|탄력|장벽|광채|영양|고밀도|자생력|피부|hydration|moisture|soothing|brightening|firming|firmness|radiance|elasticity|resilience|plumpness")
    effect = ~matches(v, "^(효과|개선|케어|care|effect|improvement)$") & matches(v, "주름|잔주름|피부결|리프팅|탄력|개선|완화|효과|firmness|firmer|elastic|texture|even|wrinkles?|fine lines|lift|improve|improved|reduce|diminish|diminished")
    ingredient = full_ingredient_list(v) | matches(v, "인삼|레티놀|나이아신아마이드|펩타이드|히알루론산|세라마이드|콜라겐|비타민|성분|ginseng|panax|retinol|niacinamide|peptide|hyaluronic|ceramide|collagen|vitamin|water|aqua|glycerin|extract")
    metric = matches(v, KEYWORDS["metric"]) & ~matches(v, "할인|쿠폰|배송비|상품가|혜택 적용가|discount|sale|shipping")
    rule = F.when(category == "usage", usage).when(category == "benefit", benefit).when(category == "effect", effect).when(category == "ingredient", ingredient)
    rule = rule.when(category == "metric", metric).when(category == "review", review_evidence(v)).otherwise(True)
    return (v != "") & ~commerce_text(v) & rule


def insight_value(t: Column, category: Column) -> Column:
    v = clean_text(t)
    limit = F.when((category == "ingredient") & full_ingredient_list(v), 3000).otherwise(900)
    rule = F.when(category.isin("product", "price", "trend"), False).when(category == "metric", semantic_value(v, F.lit("metric")) | matches(v, "clinical|result|agreed|showed|after\\s+\\d"))
    return (F.length(v) >= 12) & (F.length(v) <= limit) & ~commerce_text(v) & rule.when(category.isin("faq", "review"), True).otherwise(semantic_value(v, category))


def category_keywords(t: Column, category: str) -> Column:
    """Distinct matches of a category's pattern, in order."""
    return F.array_distinct(matched(t, KEYWORDS[category]))


def all_keywords(t: Column) -> Column:
    """``array<struct<category, keyword>>`` over all categories in order; a keyword that differs in case only comes once in a category."""
    def of(category: str) -> Column:
        words = matched(t, KEYWORDS[category])
        keys = F.transform(words, lambda x: F.lower(x))
        once = F.filter(words, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)
        return F.transform(once, lambda x: F.struct(F.lit(category).alias("category"), x.alias("keyword")))

    return F.concat(*map(of, KEYWORDS))


def dominant_category(t: Column) -> Column:
    """The category with most keywords (each counts the same); the first in order of several."""
    sizes = F.array(*[F.struct(F.size(category_keywords(t, c)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(KEYWORDS)])
    top = F.array_max(sizes)
    return F.when(top["n"] > 0, top["c"])


def section_category(title: Column, text: Column) -> Column:
    """Ordered rules on the title, then on title and beginning, else the dominant keyword category."""
    label = F.lower(clean_text(title))
    joined = F.concat(label, F.lit(" "), F.lower(F.substring(text, 1, 220)))
    rule = F.when(commerce_text(joined) | commerce_text(text), "unknown").when(full_ingredient_list(text), "ingredient")
    for name, pattern in (*((n, matches(label, p)) for n, p in SECTION_TITLES), *((n, matches(joined, p)) for n, p in SECTION_TEXTS)):
        rule = rule.when(pattern, name)
    top = dominant_category(text)
    return rule.otherwise(F.when(top.isin("benefit", "effect", "ingredient", "usage", "faq", "review", "metric"), top).otherwise("unknown"))


def insight_category(t: Column) -> Column:
    """A sentence's category by ordered rules, else the dominant keyword category (null if there is none)."""
    rule = F.when(commerce_text(t), "unknown").when(measurement_timeline(t), F.when(t.rlike("[0-9%]"), "metric").otherwise("effect")).when(usage_instruction(t), "usage")
    for name, pattern in INSIGHTS:
        rule = rule.when(matches(t, pattern), name)
    return rule.otherwise(dominant_category(t))


def product_text_score(text: Column, name: Column) -> Column:
    """3 for each word of the name, 4 for each group of signals, up to 6 for length, -12 for shop chrome."""
    words = F.filter(F.split(F.lower(name), "[^A-Za-z0-9_]+"), lambda w: F.length(w) >= 4)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) * 3
    groups = ("benefit|ingredient|how to use|how-to-use|directions|ritual|faq|result|clinical|review|summary|formulated without|key ingredients?", "skin|serum|cream|ginseng|retinol|niacinamide|peptide|wrinkle|firm|elastic|moistur|texture|radiance|anti-aging|apply|water|aqua|glycol|extract", "피부|보습|수분|진정|탄력|장벽|주름|효능|효과|성분|사용|리뷰|자생력|고밀도|영양|인삼|펩타이드|스킨케어")
    signals = sum((matches(text, g).cast("int") for g in groups), F.lit(0)) * 4
    return hits + signals + F.least(F.floor(F.length(text) / 120), F.lit(6)) - F.when(commerce_text(text), 12).otherwise(0)


def image_target_score(value: Column, has_evidence: Column, has_negative: Column, name_signal: Column, name_conflict: Column) -> Column:
    """Additive signals of an image address and its surroundings; -100 for review images."""
    t = F.lower(value)
    strong = ("clinical|result|before|after|infographic|ingredient|benefit|efficacy|survey|study", "wrinkle|firm|elastic|texture|radiance|ginseng|retinol|peptide|niacinamide", "use|how-to-use|how\\s*to\\s*use|routine|ritual|apply|direction", "효능|효과|성분|전성분|원료|보습|수분|장벽|피지|유분|사용법|임상|결과")
    image = ("/upload/product/", "dspimg|detail|pdp|prd|product|goods|contents|visual|main|description|technology|tech|ingredient|formula|spec", "상세|기술|기술서|성분|효능|효과|제품\\s*정보|상품\\s*정보", "serum|cream|크림|세럼|앰플|토너")
    weak = F.when(matches(value, "product|detail|pdp|brand\\.com|serum|cream|description|technology|ingredient|spec|상품|상세|기술|성분|효능|효과"), 3).otherwise(0)
    total = sum((t.rlike(p).cast("int") * 8 for p in strong), F.lit(0)) + sum((t.rlike(p).cast("int") * 12 for p in image), F.lit(0)) + weak
    total = total + F.when(has_evidence, 18).otherwise(0) + F.when(name_signal, 10).otherwise(0) + F.when(has_negative & ~has_evidence, -40).otherwise(0) + F.when(name_conflict, -60).otherwise(0)
    return F.when(matches(value, "review|리뷰|후기"), -100).otherwise(total)


#: Document kinds by name, first match counts. Fixed values.
DOCUMENT_KINDS = (("orchestration", "orchestrat|rag-map|manifest|analysis-prompt"), ("schema", "schema"), ("eeat", "eeat|e-e-a-t"), ("cep", "cep"), ("best-practice", "best"), ("geo-research", "geo-research|geo-paper|generative"), ("official-docs", "official|openai|google|gemini|perplexity|platform|docs|search-api|embedding|file-search|vector-store"), ("terminology", "terminology"), ("locale", "locale"))


def document_kind(name: Column) -> Column:
    rule = F.when(F.lit(False), "")
    for kind, pattern in DOCUMENT_KINDS:
        rule = rule.when(matches(name, pattern), kind)
    return rule.otherwise("custom")


#: Kinds of resolved addresses, first match counts; their share of sections and characters. Fixed values.
SOURCE_KINDS = (("official-paper", "generative-engines\\.com|arxiv\\.org|doi\\.org|paper|research|proceedings"), ("schema-reference", "schema\\.org"), ("provider-doc", "developers\\.openai\\.com|platform\\.openai\\.com|ai\\.google\\.dev|docs\\.perplexity\\.ai"), ("official-doc", "developers\\.google\\.com|search central|official"))
SOURCE_LIMITS = {"official-paper": (8, 9000), "schema-reference": (6, 7000), "provider-doc": (5, 6000), "official-doc": (5, 6000), "other": (3, 3500)}
SOURCE_BONUS = {"official-paper": "experiment|benchmark|dataset|method|visibility|citation|domain-specific|generative engine", "schema-reference": "property|expected type|used on these types|values expected|examples|faqpage|howto|product|webpage|breadcrumblist", "provider-doc": "retrieval|embedding|grounding|search result|file search|vector|citation|source", "official-doc": "structured data|product|review|rating|offer|eligibility|required|recommended"}
RELEVANT = ("generative engine", "generative engines", "answer engine", "citation", "cite", "visibility", "source", "grounding", "retrieval", "structured data", "schema.org", "product structured data", "product snippet", "merchant listing", "faqpage", "howto", "breadcrumblist", "webpage", "product", "review", "rating", "offer", "claim", "evidence", "attribute", "property", "entity", "content optimization", "domain-specific")
NOISE = ("install", "npm", "pip install", "curl", "api key", "authentication", "rate limit", "billing", "pricing", "sdk", "sdks", "quickstart", "navigation", "get started overview", "sdk and cli", "node reference", "prompt guide", "early adopters program", "package tracking", "structured data carousels", "profile page q&a recipe", "software app", "vacation rental", "title links", "cookie", "terms and conditions", "login", "dashboard")
BOILERPLATE = ("get started overview quickstart models pricing", "openai sdk agents sdk openai cli", "early adopters program package tracking", "profile page q&a recipe review snippet software app", "speakable subscription and paywalled content vacation rental", "debug drops in search traffic", "terms and conditions schema.org", "skip to main content")


def source_kind(url: Column, title: Column) -> Column:
    key = F.concat_ws(" ", url, F.coalesce(title, F.lit("")))
    rule = F.when(F.lit(False), "")
    for kind, pattern in SOURCE_KINDS:
        rule = rule.when(matches(key, pattern), kind)
    return rule.otherwise("other")


def phrase_score(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases the text contains."""
    return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def relevance_score(section: Column, kind: Column) -> Column:
    t = F.lower(section)
    bonus = F.when(F.lit(False), 0)
    for k, pattern in SOURCE_BONUS.items():
        bonus = bonus.when((kind == k) & t.rlike(pattern), 4)
    return phrase_score(t, RELEVANT) - phrase_score(t, NOISE) + bonus.otherwise(0) - F.when(F.length(t) < 120, 2).otherwise(0)


def is_boilerplate(section: Column) -> Column:
    return phrase_score(F.regexp_replace(F.lower(section), r"\s+", " "), BOILERPLATE) > 0


#: Names of evidence sources and the type each stands for; the retrieval boost of each type. Fixed values.
SOURCE_TYPES = {"product": "product", "review": "review", "image": "image", "news": "news", "paper": "paper", "existing-geo": "existing-geo", "custom": "custom", "research": "paper", "research-paper": "paper", "article": "news", "newsArticle": "news", "geo": "existing-geo", "pdp-geo": "existing-geo"}
SOURCE_BOOSTS = {"paper": 0.16, "news": 0.12, "review": 0.1, "existing-geo": 0.09, "image": 0.08, "product": 0.07, "custom": 0.04}


def lookup(key: Column, table: dict, default) -> Column:
    rule = F.when(F.lit(False), default)
    for k, v in table.items():
        rule = rule.when(key == k, v)
    return rule.otherwise(default)


def source_type(name: Column, fallback: str = "custom") -> Column:
    """The type that a source's name stands for."""
    return lookup(name, SOURCE_TYPES, fallback)


def source_boost(kind: Column) -> Column:
    return lookup(kind, SOURCE_BOOSTS, 0.04)


def freshness(published: Column, observed: Column, as_of: str) -> Column:
    """recent, dated (more than 365 days before ``as_of``) or unknown."""
    when = F.try_to_timestamp(published)
    return F.when(F.coalesce(observed, F.lit("")) != "", "recent").when(when.isNull(), "unknown").when(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(when) <= 365 * 86400, "recent").otherwise("dated")


#: Patterns of claims that evidence cannot carry; the bracket classes hold a bar on purpose. Fixed values.
UNSAFE_CLAIMS = {"cure": f"{BEGIN}cure[s|d]?{END}", "treat": f"{BEGIN}treat[s|ed|ment]?{END}", "guaranteed": f"{BEGIN}guaranteed{END}", "miracle": f"{BEGIN}miracle{END}", "clinically proven": f"{BEGIN}clinically proven{END}", "absolute": "완치|치료|보장|기적|무조건|100%"}


def unsafe_claims(t: Column) -> Column:
    """Names of the patterns that a text matches."""
    return F.filter(F.array(*[F.when(matches(t, p), F.lit(n)) for n, p in UNSAFE_CLAIMS.items()]), lambda x: x.isNotNull())


#: Angles of a seeded variant and the evidence that each prefers. Fixed values.
ANGLES = {"claim-check": ("product", "paper", "news", "review"), "comparison": ("product", "review", "existing-geo", "custom"), "use-case-fit": ("review", "product", "image"), "review-pattern": ("review", "image", "product"), "skeptical-research": ("paper", "news", "review", "product"), "buyer-question": ("review", "product", "existing-geo")}


def evidence_focus(angle: Column, available: Column) -> Column:
    """Preferred types that are there, in order of preference, else the first four that are."""
    wanted = F.array().cast("array<string>")
    for name, types in ANGLES.items():
        wanted = F.when(angle == name, F.array(*[F.lit(t) for t in types])).otherwise(wanted)
    found = F.array_intersect(wanted, available)
    return F.when(F.size(found) > 0, found).otherwise(F.slice(available, 1, 4))
