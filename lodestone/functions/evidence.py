"""Roles, routing, modality and scores of evidence texts, as Column expressions. Vocabularies are fixed values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions.text import BEGIN, END, alternatives, clean_text, fingerprint, is_plain, let, matched, matches, terms


def _set(*pairs: tuple[Column, str]) -> Column:
    """The names whose tests hold, in order, each once."""
    return F.array_distinct(F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]), lambda x: x.isNotNull()))


# tokens


#: Endings that are stripped, by a test of the word: English in steps, then Korean forms and particles. Fixed values.
ENDINGS = (
    ("^[a-z]+$", (("(?:izations?|isations?)$", ""), ("(?:ations?|ating|ated|ingly|ing|edly|ed)$", ""), ("ies$", "y"), ("s$", ""))),
    ("[가-힣]..|.[가-힣].|..[가-힣]", (
        ("(?:인가요|한가요|일까요|나요|까요|습니까|입니까)$", ""), ("(?:입니다|됩니다|합니다|드립니다|있습니다|없습니다|했습니다|되었습니다|줍니다)$", ""),
        ("(?:으로|에서|에게|까지|부터|처럼|보다|에는|에서는|은|는|이|가|을|를|의|에|도|와|과)$", ""),
    )),
)


def evidence_token(token: Column) -> Column:
    """English endings stripped in four steps, Korean endings and particles (of three characters or more) in three."""
    t = F.lower(token)
    rule = F.when(F.lit(False), t)
    for test, endings in ENDINGS:
        bare = t
        for pattern, value in endings:
            bare = F.regexp_replace(bare, pattern, value)
        rule = rule.when(t.rlike(test), bare)
    return rule.otherwise(t)


def support_term(token: Column) -> Column:
    """A Korean particle, a possessive or a plural s stripped."""
    t = F.lower(clean_text(token))
    return F.when(t.rlike("^[가-힣]{3,}$"), F.regexp_replace(t, "(?:으로|에서|에게|에는|에도|은|는|이|가|을|를|와|과|의|로|에|도|만)$", "")).when(t.endswith("'s"), F.substr(t, F.lit(1), F.length(t) - 2)).when((F.length(t) > 4) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def tokens_match(a: Column, b: Column) -> Column:
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 3) & (F.contains(a, b) | F.contains(b, a)))


#: Labels of claim modality with their patterns, in order.
MODALITY = (
    ("not", f"{BEGIN}not{END}|않"), ("no", f"{BEGIN}no{END}|없|아니|미포함|불가"), ("never", f"{BEGIN}never{END}"), ("without", f"{BEGIN}without{END}"), ("may", f"{BEGIN}may{END}"), ("might", f"{BEGIN}might{END}"),
    ("can", f"{BEGIN}can{END}|도울\\s*수"), ("could", f"{BEGIN}could{END}"), ("help", f"{BEGIN}helps?{END}|도움|돕"), ("support", f"{BEGIN}supports?{END}|기여"), ("suggest", f"{BEGIN}suggests?{END}"), ("reported", f"{BEGIN}reported?{END}|보고"),
    ("measured", f"{BEGIN}measur(?:e|ed|ement)s?{END}|측정"), ("tested", f"{BEGIN}tests?|tested{END}|시험|테스트"), ("study", f"{BEGIN}stud(?:y|ies){END}|연구"), ("result", f"{BEGIN}results?{END}|결과"), ("observed", f"{BEGIN}observ(?:e|ed|ation)s?{END}|관찰"),
    ("review", f"{BEGIN}reviews?{END}|리뷰|후기"), ("presented", f"{BEGIN}presented?{END}|제시"), ("because", f"{BEGIN}because{END}|때문"), ("therefore", f"{BEGIN}therefore{END}"), ("cause", f"{BEGIN}causes?{END}"), ("due-to", f"{BEGIN}due\\s+to{END}"),
    ("through", f"{BEGIN}through{END}|통해"), ("effective", f"{BEGIN}effective{END}|효과적"), ("improve", f"{BEGIN}improves?{END}|개선"), ("reduce", f"{BEGIN}reduces?{END}|감소"), ("increase", f"{BEGIN}increases?{END}|증가"), ("proven", f"{BEGIN}proven{END}|입증"),
)


def _occurs(low: Column, pattern: str) -> Column:
    """Whether a pattern of MODALITY is found in a lower-case text; borders are only looked at where the word's first letters are there."""
    found = F.lit(False)
    for part in alternatives(pattern):
        if is_plain(part):
            found = found | F.contains(low, F.lit(part))
            continue
        bare = part.replace(BEGIN, "")
        stem = re.match(r"[a-z]*", bare)[0]
        stem = stem[:-1] if bare[len(stem) : len(stem) + 1] == "?" else stem  # its last letter may be missing
        found = found | (F.contains(low, F.lit(stem)) & low.rlike(part))
    return found


def modality(text: Column) -> Column:
    """The labels that occur, in the fixed order."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: _set(*((_occurs(low, p), n) for n, p in MODALITY)))


def same_modality(a: Column, b: Column) -> Column:
    return modality(a) == modality(b)


#: Whose experience is told: any review, a single one, many, or praise only. Fixed values.
REVIEW_SCOPES = (
    f"{BEGIN}(?:review|reviews|customer feedback){END}|(?:고객\\s*)?(?:리뷰|후기)",
    f"{BEGIN}(?:one|a single)\\s+(?:customer\\s+)?review{END}|(?:한|1명의?)\\s*(?:고객\\s*)?(?:리뷰|후기)",
    f"{BEGIN}(?:customers|reviewers|reviews\\s+(?:show|mention|indicate)){END}|고객들|여러\\s*(?:고객|리뷰)|공통\\s*(?:경향|반응)|고객\\s*리뷰에서는",
    f"{BEGIN}positive\\s+reviews?{END}|긍정(?:적인)?\\s*(?:리뷰|후기)",
)


def same_review_scope(a: Column, b: Column) -> Column:
    """Four flags of whose experience is told agree."""
    same = F.lit(True)
    for p in REVIEW_SCOPES:
        same = same & (matches(a, p) == matches(b, p))
    return same


# roles and routing

SAFETY = "avoid|caution|warning|patch test|consult|discontinue|keep out|주의|금지|상담|중단"
AUDIENCE = "for (?:dry|oily|sensitive|combination|all) skin|(?:dry|oily|sensitive|combination) skin types?|건성|지성|민감|복합성|모든 피부"
OFFER = "\\$\\s*\\d|₩\\s*\\d|\\d[\\d,]*\\s*원|free shipping|discount|coupon|할인|쿠폰|무료배송"
EXPERIENCE = "i (?:love|like|use|feel)|my skin|reviewer|customers? (?:say|love|mention)|리뷰|후기|재구매"
QUESTION = "[?？]\\s*$|^(?:what|how|why|when|who|can|does|do|is|are|should|which)(?![A-Za-z])|(?:인가요|나요|까요)$"
#: The first of these is the primary role; ingredient goes before audience when it links to an outcome.
PRECEDENCE = ("faq", "review", "safety", "usage", "commerce", "metric", "audience", "benefit", "effect", "ingredient")


def evidence_roles(text: Column) -> Column:
    """``struct<roles, primary, links>``: all roles of a text, the one that counts, and whether an ingredient is linked to an outcome."""
    def flags(t: Column) -> Column:
        tests = {"empty": t == "", "question": matches(t, QUESTION), "commerce": matches(t, OFFER) | S.commerce_text(t), "safety": matches(t, SAFETY), "review": matches(t, EXPERIENCE), "instruction": S.usage_instruction(t), "number": S.metric_signal(t)}
        tests |= {k: matches(t, S.KEYWORDS[k]) for k in ("ingredient", "benefit", "effect")} | {"audience": matches(t, AUDIENCE)}
        return F.struct(*[v.alias(k) for k, v in tests.items()])

    def judged(f: Column) -> Column:
        commerce, safety, review = f["commerce"], f["safety"], f["review"]
        usage = ~safety & ~review & ~commerce & f["instruction"]
        metric = ~commerce & f["number"]
        ingredient = ~commerce & ~review & f["ingredient"]
        open_claim = ~safety & ~review & ~usage & ~commerce
        benefit, effect = open_claim & ~metric & f["benefit"], open_claim & f["effect"]
        found = _set((commerce, "commerce"), (safety, "safety"), (review, "review"), (usage, "usage"), (metric, "metric"), (ingredient, "ingredient"), (benefit, "benefit"), (effect, "effect"), (f["audience"], "audience"))
        links = ~f["question"] & ~f["empty"] & ingredient & (benefit | effect) & ~metric & ~review & ~safety
        roles = F.when(f["empty"], F.array(F.lit("source"))).when(f["question"], F.array(F.lit("faq"))).when(F.size(found) == 0, F.array(F.lit("source"))).otherwise(found)
        return F.struct(roles.alias("roles"), links.alias("links"))

    def primary(r: Column) -> Column:
        rule = F.when(F.lit(False), "")
        for name in PRECEDENCE:
            if name == "audience":  # a linked ingredient stands before it
                rule = rule.when(r["links"] & F.array_contains(r["roles"], "ingredient"), "ingredient")
            rule = rule.when(F.array_contains(r["roles"], name), name)
        return F.struct(r["roles"].alias("roles"), rule.otherwise("source").alias("primary"), r["links"].alias("links"))

    return let(clean_text(text), lambda t: let(flags(t), lambda f: let(judged(f), primary)))


#: Schema fields of each intent, in order.
INTENT_FIELDS = {
    "ingredient": ("Product.additionalProperty[Key ingredients]", "Product.description", "content.sections.ingredients"),
    "effect": ("Product.description", "WebPage.description", "content.sections.benefits", "FAQPage.mainEntity"),
    "benefit": ("Product.description", "WebPage.description", "content.sections.benefits", "FAQPage.mainEntity"),
    "usage": ("HowTo.step", "content.sections.howToUse"),
    "review": ("Review.reviewBody", "Product.positiveNotes", "FAQPage.mainEntity"),
    "metric": ("Product.additionalProperty[Reported details]", "Product.description", "FAQPage.mainEntity"),
}


def schema_fields(intents: Column) -> Column:
    """Fields of a set of intents, the first of equal ones kept."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(F.array_contains(intents, k), F.array(*map(F.lit, v))).otherwise(none) for k, v in INTENT_FIELDS.items()]))


def cross_sell(text: Column) -> Column:
    """A routine of two steps or more with two kinds of product or more."""
    t = clean_text(text)
    kinds = F.array_distinct(F.transform(matched(t, f"{BEGIN}(?:serum|cream|toner|water|cleanser|foam|oil|essence|ampoule|mask|lotion){END}|스킨|토너|세럼|크림|클렌저|오일|에센스|앰플|마스크"), lambda x: F.lower(x)))
    return matches(t, f"{BEGIN}(?:complete\\s+your\\s+ritual|routine|regimen|ritual|step\\s*\\d)|단계|루틴") & (F.size(matched(t, f"{BEGIN}step\\s*\\d+{END}|단계\\s*\\d+|\\d+\\s*단계")) >= 2) & (F.size(kinds) >= 2)


def routing_context(text: Column) -> Column:
    return F.when(S.full_ingredient_list(text), "ingredient-list").when(cross_sell(text), "cross-sell-routine").when(S.metric_signal(text) & ~S.usage_instruction(text), "metric-evidence").otherwise("general")


#: Routing rules of a chunk's kind, source, title and text: kinds, pattern, intents, field targets; all that apply count, in order.
ROUTES = (
    (("terminology", "locale"), f"{BEGIN}locale{END}|terminology|market wording|locali[sz]e|금칙|표현|wording", ("locale",), ("PDP.content",)),
    (("orchestration",), "orchestration|routing|rag index|rag-index|overlap|conflict|missing|coverage|content unit|문서 단위|내용 단위|누락|충돌|중복", ("retrieval", "general"), ("retrieval", "diagnostics")),
    (("official-docs",), "retrieval|embedding|vector|search api|grounding|provider|openai|gemini|perplexity", ("retrieval",), ("retrieval", "diagnostics")),
    ((), "faq|question|answer|mainentity|customer question|q&a", ("faq",), ("FAQPage.mainEntity",)),
    ((), f"howto|how to use|stepwise|{BEGIN}step{END}|usage|routine|direction|apply|application|사용법|사용\\s*순서", ("howTo",), ("HowTo.step",)),
    ((), "claim|evidence|source-supported|reported result|clinical|metric|award|certification|trust|trustworthiness|expertise|authoritativeness|positive notes|positivenotes|additionalproperty|propertyvalue|효능|효과|근거", ("claims", "evidence"), ("Product.description", "Product.additionalProperty", "Product.positiveNotes")),
    ((), "customer|target customer|audience|entry point|cep|concern|skin type|use occasion|routine timing|buying|discovery|review-backed preference", ("customer",), ("WebPage.description", "Product.description")),
    ((), "review|rating|experience|texture|absorption|comfort|satisfaction|customer language|사용감|흡수감|리뷰", ("review",), ("FAQPage.mainEntity", "Product.description", "Product.positiveNotes")),
    ((), "schema|json-ld|webpage|product\\.description|webpage\\.description|product entity|breadcrumb|offer|brand|manufacturer|graph|structured data", ("schema",), ("Product.description", "WebPage.description")),
    ((), "breadcrumb", (), ("BreadcrumbList",)),
    ((), "ocr|sentence diagnostics|classified sentence|diagnostic", ("evidence",), ("diagnostics",)),
)
#: Routes that an address or title fixes, before all others; the first that applies counts.
FIXED_ROUTES = (
    ("schema\\.org/faqpage", "^faqpage(?![a-z0-9_])", ("schema", "faq"), ("FAQPage.mainEntity",)), ("schema\\.org/howto", "^howto(?![a-z0-9_])", ("schema", "howTo"), ("HowTo.step",)),
    ("schema\\.org/product", "^product(?![a-z0-9_])", ("schema", "claims", "customer"), ("Product.description", "Product.additionalProperty", "Product.positiveNotes")),
    ("schema\\.org/webpage", "^webpage(?![a-z0-9_])", ("schema", "customer"), ("WebPage.description",)), ("schema\\.org/breadcrumblist", "^breadcrumblist(?![a-z0-9_])", ("schema",), ("BreadcrumbList",)),
    ("schema\\.org/", None, ("schema",), ("PDP.content",)),
)


def chunk_routing(kind: Column, source: Column, title: Column, text: Column) -> Column:
    """``struct<intents, targets>`` of a chunk."""
    title = F.coalesce(title, F.lit(""))
    none = F.array().cast("array<string>")
    listed = lambda names: F.array(*map(F.lit, names)) if names else none
    fallback = F.when(kind == "eeat", listed(("evidence", "claims"))).when(kind == "cep", listed(("customer",))).otherwise(listed(("general",)))

    def hits(hay: Column) -> Column:
        return F.array(*[(kind.isin(*kinds) if kinds else F.lit(False)) | hay.rlike(pattern) for kinds, pattern, _, _ in ROUTES])

    def joined(tests: Column) -> Column:
        pick = lambda at: F.array_distinct(F.concat(*[F.when(tests[n], listed(r[at])).otherwise(none) for n, r in enumerate(ROUTES)]))
        return F.struct(pick(2).alias("intents"), pick(3).alias("targets"))

    def filled(r: Column) -> Column:
        return F.struct(F.when(F.size(r["intents"]) > 0, r["intents"]).otherwise(fallback).alias("intents"), F.when(F.size(r["targets"]) > 0, r["targets"]).otherwise(listed(("PDP.content",))).alias("targets"))

    route = let(F.lower(F.concat_ws(" ", source, title, text)), lambda hay: let(hits(hay), lambda tests: let(joined(tests), filled)))
    s, t = F.lower(source), F.lower(title)
    both = lambda i, f: F.struct(listed(i).alias("intents"), listed(f).alias("targets"))
    provider = (kind == "official-docs") | s.rlike("developers\\.openai\\.com|platform\\.openai\\.com|developers\\.google\\.com|ai\\.google\\.dev|docs\\.perplexity\\.ai")
    found = F.when(F.lit(False), route)
    for address, heading, i, f in FIXED_ROUTES:
        found = found.when(s.rlike(address) | (t.rlike(heading) if heading else F.lit(False)), both(i, f))
    found = found.when(provider & (s.rlike("structured-data|product") | t.rlike("structured data|product")), both(("retrieval", "schema", "claims"), ("retrieval", "diagnostics", "Product.description", "Product.additionalProperty")))
    found = found.when(provider & (s.rlike("grounding|search") | t.rlike("grounding|search")), both(("retrieval", "evidence"), ("retrieval", "diagnostics"))).when(provider, both(("retrieval",), ("retrieval", "diagnostics")))
    return found.otherwise(route)


# reviews and questions


def rating_summary_text(t: Column) -> Column:
    return matches(t, r"^(?:rating|평점|별점)?[\s:]*[\d.]+\s*(?:/|out of)?\s*5?[^A-Za-z가-힣]{0,12}$")


def meaningful_review(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) >= 20) & ~rating_summary_text(t) & ((F.size(F.split(t, r"\s+")) >= 4) | t.rlike("[가-힣ぁ-んァ-ン]"))


def review_keyword(text: Column) -> Column:
    t = F.trim(text)
    named = matches(t, "^(review|reviews|rating|ratings|star|stars|customer|keyword|keywords|ingredient|ingredients)$")
    return F.length(t).between(3, 32) & ~named & ~t.rlike(r"^[A-Z0-9\s-]{8,}$") & matches(t, "보습|흡수|탄력|피부결|순한|만족|촉촉|매끄|광채|texture|smooth|hydration|moist|moisture|firm|elastic|lightweight|rich|absorbs|glow|plump|うるおい|保湿|ハリ|なじみ|満足")


def review_keywords(text: Column, most: int = 12) -> Column:
    parts = F.transform(F.split(text, r"[,.;:!?/|\n]+"), clean_text)
    return F.slice(F.array_distinct(F.filter(parts, review_keyword)), 1, most)


def negative_review(text: Column) -> Column:
    """Complaints; praise of absence ("not sticky", in Korean) is none."""
    return matches(clean_text(text), "약품\\s*냄새|냄새|향(?:이|은)?[^.。！？]{0,24}(?:아쉬|별로|강하|불편)|아쉬|별로|불편|따가|화끈|자극(?!\\s*(?:없|없이|적))|트러블(?!\\s*(?:없|안|올라오지))|건조하|당김이\\s*심|끈적(?!임?(?:이)?\\s*(?:없|없이|적))|답답|무거|뻑뻑|실망|문제|(?:효과|개선)(?:를|가|은)?\\s*(?:느끼|보|확인)지\\s*못|(?:효과|도움)(?:이|가)?\\s*(?:없|미미|되지\\s*않)|bad|worse|worst|smell|odor|scent|fragrance|irritat|breakout|sticky|greasy|heavy|drying|disappoint|complain|(?:did\\s+not|didn't|does\\s+not|doesn't)\\s+(?:notice|see|feel|help)|no\\s+(?:visible\\s+)?(?:effect|improvement)|not\\s+effective")


FAQ_KEYS = (("ingredient-benefit-overview", "(?:ingredient|성분).*(?:benefit|help|do for|효능|효과)"), ("benefit-overview", "^(?:what are the (?:main )?benefits|what does .* do)|어떤 효능|주요 효능"), ("ingredient-overview", "(?:what|which).*ingredients|(?:주요|어떤) 성분"), ("suitability-overview", "who (?:is|should)|suitable|skin types?|어떤 피부|누구에게"))


def faq_keys(question: Column) -> Column:
    return _set(*((matches(question, p), n) for n, p in FAQ_KEYS))


def faq_preference(question: Column, answer: Column) -> Column:
    both = F.concat_ws(" ", question, answer)
    plus = lambda test, n: F.when(test, n).otherwise(0)
    keys = faq_keys(question)
    return plus(F.array_contains(keys, "ingredient-benefit-overview"), 40) + plus(F.array_contains(keys, "benefit-overview"), 20) + plus(matches(both, "성분|기술|ingredient|formula|technology"), 5) + plus(matches(both, "효능|효과|보습|장벽|수분|탄력|주름|benefit|effect|hydration|barrier|firm|wrinkle"), 5) + plus(matches(answer, r"\d+(?:\.\d+)?\s*%|\d+\s*(?:시간|일|주|명|회|hours?|days?|weeks?|participants?)"), 4)


# scores

#: Topics that a claim names and the roles of evidence that can carry each. Fixed values.
TOPIC_ROLES = (
    (f"{BEGIN}(?:ingredients?|actives?|formula){END}|성분|원료|포뮬러|成分|原料|処方", ("ingredient", "description", "source", "faq")),
    (f"{BEGIN}(?:benefits?|effects?|results?){END}|효능|효과|혜택|개선|効果|ベネフィット|改善", ("benefit", "effect", "description", "metric", "source", "faq")),
    (f"{BEGIN}(?:reviews?|customers?\\s+(?:say|mention)){END}|리뷰|후기|고객이\\s*언급|レビュー|口コミ", ("review", "faq", "source")),
    (f"{BEGIN}(?:price|cost|size|option|variant){END}|가격|용량|옵션|버전|価格|容量|オプション|種類", ("commerce", "faq", "source")),
)


def roles_support_topics(text: Column, roles: Column) -> Column:
    """Each topic that a text names is carried by one of its roles."""
    ok = F.lit(True)
    for pattern, wanted in TOPIC_ROLES:
        ok = ok & (~matches(text, pattern) | F.arrays_overlap(roles, F.array(*map(F.lit, wanted))))
    return ok


def specificity(path: Column, text: Column) -> Column:
    """How specific an evidence atom's source path is, from 0 to 5."""
    return F.when(path.rlike("semanticFacts\\.(?:metricClaims|ingredientBenefitLinks|citations)"), 5).when(path.rlike("semanticFacts\\."), 4).when(path.rlike("reviews\\.keywords"), 3).when(path.rlike("reviews\\.items"), 2).when(path.rlike("sourceTexts"), F.when(F.length(text) <= 320, 1).otherwise(0)).otherwise(2)


def principle_score(intents: Column, targets: Column, kind: Column, label: Column, primary: list[str], supporting: list[str], wanted: list[str], kinds: list[str]) -> Column:
    """A chunk's fit to a principle: intents, targets, kind, and a discount for reference outputs."""
    has = lambda column, names: F.arrays_overlap(column, F.array(*map(F.lit, names))) if names else F.lit(False)
    plus = lambda test, n: F.when(test, n).otherwise(0.0)
    base = plus(has(intents, primary), 5.0) + plus(has(targets, wanted), 3.0) + plus(has(intents, supporting), 1.5)
    bare = (F.size(intents) == 0) & (F.size(targets) == 0)
    return base + plus(kind.isin(*kinds) & (bare | (base > 0)), 0.75) + plus(kind.isin("geo-research", "eeat", "cep") & F.array_contains(intents, "general"), 1.0) - plus(matches(label, "reference output|verbatim|benchmark"), 2.0)


def decision_confidence(sources: Column, evidence: Column) -> Column:
    """0 without sources or evidence, else 0.55 and up to 0.95 with their numbers."""
    return F.when((sources == 0) | (evidence == 0), 0.0).otherwise(F.least(F.lit(0.95), 0.55 + F.least(sources, F.lit(3)) * 0.08 + F.least(evidence, F.lit(5)) * 0.04))


def handle_score(name: Column, handle: Column) -> Column:
    """How well a product name agrees with the words of its address."""
    words = F.filter(F.split(F.lower(handle), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    n, plain = F.size(words), fingerprint(name)
    hits = F.size(F.filter(words, lambda w: F.contains(plain, w)))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0).when(plain == F.array_join(words, " "), 180).when(hits == n, 160 + hits * 4).when(hits >= F.ceil(n * 0.6), 86 + hits * 6).otherwise(hits * 6)


def promotional_tone(promo_hits: Column, mentions: Column) -> Column:
    return F.least(F.lit(1.0), promo_hits * 0.35 + F.when(mentions > 8, 0.2).otherwise(0.0))


def strip_promotion(body: Column) -> Column:
    """Lines with a sales call dropped, what is left of its phrases replaced."""
    kept = F.array_join(F.filter(F.split(body, "\n"), lambda x: ~matches(x, "buy now|shop now|limited offer|link in bio|affiliate link|지금\\s*구매|바로\\s*구매|링크를\\s*확인")), "\n")
    return F.regexp_replace(kept, "(?iu)지금\\s*구매|바로\\s*구매", "근거를 비교")
