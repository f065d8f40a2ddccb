"""Claim gates: whether a text says no more than the evidence it cites.

A claim is a text column, its evidence an array of ``struct<id, role, text>``, so every gate is a row's own affair and needs no
join. ``support_reason`` runs them in turn and names the first that fails.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.evidence import ENDINGS, evidence_token, roles_support_topics, tokens_match


def _either(english: str, korean: str, japanese: str) -> str:
    """Whole English words, or Korean or Japanese text anywhere."""
    return f"{T.BEGIN}(?:{english}){T.END}|{korean}|{japanese}"


# Words that carry no meaning in a claim.
CLAIM_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "did", "do", "does", "for", "from", "has", "have", "helps", "in", "is", "it", "its", "may", "might", "of", "on", "or", "should", "that", "the", "this", "to", "will", "with", "what", "which", "when", "who", "would", "how",
    "product", "page", "pdp", "serum", "cream", "toner", "formula", "item", "information", "details", "include", "includes", "contain", "contains", "composed", "shows", "explains", "check", "find", "main", "key", "benefit", "feature", "features", "ingredient", "ingredients",
    "제품", "상품", "페이지", "정보", "확인", "확인할", "있습니다", "합니다", "어떤", "무엇", "어떻게", "위한", "통해", "대한", "그리고", "또는", "핵심", "장점", "주요", "소개", "소개됩니다", "특징", "성분", "포함", "함유", "구성", "공식", "관련", "해당", "함께", "각각", "내용", "설명", "설명됩니다", "제시", "제시됩니다", "표기", "표기됩니다", "완료",
    "商品", "製品", "ページ", "情報", "確認", "できます", "です", "ます", "どの", "どんな", "について", "主な", "利点", "特徴", "成分", "含む", "配合", "構成",
)
#: The same for Japanese text before it is cut into trigrams. Fixed values.
JAPANESE_FILLERS = "商品|製品|ページ|情報|確認|できます|です|ます|どの|どんな|について"

# Concepts that a text names, in English, Korean and Japanese.
CONCEPTS = (
    ("dry", "dry|dryness|dehydrated", "건조|메마른", "乾燥|かさつ"),
    ("oily", "oily|oiliness|sebum", "지성|유분|피지", "脂性|皮脂|べたつ"),
    ("sensitive", "sensitive|sensitivity", "민감|예민", "敏感|デリケート"),
    ("hydration", "hydrate|hydrates|hydrating|hydration|moisture|moisturize|moisturizing", "수분|보습", "保湿|うるおい|潤い"),
    ("barrier", "(?:skin\\s+)?barrier", "(?:피부\\s*)?장벽", "(?:肌の)?バリア"),
    ("brightening", "brighten|brightening|dullness|radiance", "브라이트닝|미백|칙칙|광채", "明る|くすみ|透明感"),
    ("firmness", "firmness|firming|elasticity", "탄력|리프팅", "ハリ|弾力"),
    ("wrinkle", "wrinkles?|fine\\s+lines?", "주름|잔주름", "しわ|シワ"),
    ("soothing", "soothe|soothing|calm|calming|redness", "진정|붉은기", "鎮静|赤み"),
    ("acne", "acne|blemishes?|breakouts?", "여드름|트러블", "ニキビ|吹き出物"),
    ("lightweight", "lightweight|light|non[-\\s]?sticky", "산뜻|가벼운|끈적임\\s*없", "軽い|さっぱり|べたつかない"),
    ("rich", "rich|nourishing", "리치|영양감|고보습", "濃厚|しっとり"),
    ("gentle", "gentle|mild", "순한|저자극", "やさしい|低刺激"),
    ("cleanser", "cleanser|cleansing|cleanse", "클렌저|클렌징|세안", "クレンジング|洗顔"),
    ("sunscreen", "sunscreen|sun\\s+protection|spf|uv", "선크림|자외선|차단", "日焼け止め|紫外線|UV"),
    ("serum", "serum", "세럼", "セラム|美容液"),
    ("cream", "cream", "크림", "クリーム"),
    ("toner", "toner", "토너", "化粧水|トナー"),
    ("lotion", "lotion", "로션", "ローション|乳液"),
    ("mask", "mask", "마스크|팩", "マスク|パック"),
    ("ceramide", "ceramides?", "세라마이드", "セラミド"),
    ("hyaluronic-acid", "hyaluronic(?:\\s+acid)?", "히알루론산", "ヒアルロン酸"),
    ("niacinamide", "niacinamide", "나이아신아마이드", "ナイアシンアミド"),
    ("retinol", "retinol", "레티놀", "レチノール"),
    ("ginseng", "ginseng", "인삼", "高麗人参|ジンセン"),
    ("peptide", "peptides?", "펩타이드", "ペプチド"),
    ("panthenol", "panthenol", "판테놀", "パンテノール"),
    ("fragrance", "fragrance|perfume|scent", "향료|무향", "香料|無香料"),
    ("daily", "daily|every\\s+day", "매일|데일리", "毎日|デイリー"),
    ("apply", "apply|spread|smooth", "바르|도포|펴\\s*바르", "塗|広げ|のばし"),
    ("massage", "massage|rub|press|pat", "마사지|문지르|누르|두드", "マッサージ|こす|押さえ|パッティング"),
    ("rinse", "rinse|wash\\s+off|remove", "헹구|씻어|닦아?내|제거", "すす|洗い流|拭き取|落と"),
)

# Seasons, times, occasions and audiences that only evidence may bring in.
CONTEXTS = (
    ("season:spring", "spring|springtime|spring\\s+months?", "봄철?|춘계", "春|春季"),
    ("season:summer", "summer|summertime|summer\\s+months?|hot\\s+(?:weather|months?|season|air)", "여름철?|하절기|더운\\s*(?:날씨|시기|계절|바람)", "夏|夏季|暑い\\s*(?:時期|季節|風)"),
    ("season:autumn", "autumn|autumnal|fall\\s+season|autumn\\s+months?", "가을철?|추계", "秋|秋季"),
    ("season:winter-cold", "winter|wintertime|winter\\s+months?|cold\\s+(?:weather|months?|season|air|wind)|chilly\\s+(?:weather|air|wind)|indoor\\s+heating", "겨울철?|동절기|추운\\s*(?:날씨|시기|계절)|찬\\s*바람|차가운\\s*바람|추위|난방", "冬|冬季|寒い\\s*(?:時期|季節)|冷たい\\s*風|寒さ|暖房"),
    ("season:transition", "seasonal\\s+transition|change\\s+of\\s+seasons?|dry\\s+season|rainy\\s+season", "환절기|건기|우기|장마철", "季節の変わり目|乾季|雨季|梅雨"),
    ("routine:morning", "morning|a\\.m\\.", "아침|오전", "朝|午前"),
    ("routine:night", "night|nighttime|evening|bedtime|overnight|p\\.m\\.", "밤|야간|저녁|취침\\s*전|밤사이", "夜|夜間|夕方|就寝前|一晩"),
    ("routine:after-cleansing", "after\\s+cleansing|post[-\\s]?cleanse|after\\s+washing", "세안\\s*후|클렌징\\s*후", "洗顔後|クレンジング後"),
    ("routine:before-makeup", "before\\s+makeup|pre[-\\s]?makeup|under\\s+makeup", "메이크업\\s*전|화장\\s*전", "メイク前|化粧前"),
    ("occasion:gifting", "gift|gifting|holiday|celebration", "선물|기프트|명절|기념일", "ギフト|贈り物|祝日|記念日"),
    ("occasion:travel", "travel|travelling|traveling|on[-\\s]?the[-\\s]?go", "여행|휴대용|외출", "旅行|持ち運び|外出"),
    ("occasion:activity", "exercise|workout|sport|outdoor", "운동|스포츠|야외\\s*활동", "運動|スポーツ|屋外"),
    ("occasion:post-procedure", "after\\s+(?:a\\s+)?procedure|post[-\\s]?procedure|post[-\\s]?treatment", "시술\\s*후|치료\\s*후", "施術後|治療後"),
    ("audience:life-stage", "pregnan(?:t|cy)|postpartum|baby|infant|child|teen", "임신|산후|아기|영유아|어린이|청소년", "妊娠|産後|赤ちゃん|乳幼児|子ども|十代"),
)
#: The same for copy that is held against a product's own source: seasons by their names and weather only. Fixed values.
SOURCE_SEASONS = (
    ("season:spring", "spring|springtime", "봄철?|춘계", "春|春季"),
    ("season:summer", "summer|summertime|hot\\s+weather", "여름철?|하절기|더운\\s*날씨", "夏|夏季|暑い\\s*時期"),
    ("season:autumn", "autumn|autumnal", "가을철?|추계", "秋|秋季"),
    ("season:winter", "winter|wintertime|cold\\s+weather", "겨울철?|동절기|추운\\s*날씨", "冬|冬季|寒い\\s*時期"),
)
GENERALISED = _either("generally|typically|usually|commonly|as\\s+a\\s+rule|in\\s+general", "일반적으로|대체로|통상적으로|보통은", "一般的に|通常は|概して")
BECAUSE = _either("because|because\\s+of|due\\s+to|caused\\s+by|as\\s+a\\s+result\\s+of", "때문에|로\\s*인해|에서\\s*비롯|결과로", "ために|によって|が原因で")

# Risks that a claim may only name where the evidence does.
RISKS = (
    _either("cures?|treats?|heals?", "치료|치유", "治療|治す"),
    _either("medical|medicine|therapeutic", "의약|의학적", "医薬|治療用"),
    _either("eczema|cancer|disease", "습진|아토피|암|질환", "湿疹|がん|疾患"),
    _either("clinically\\s+proven", "임상적으로\\s*입증", "臨床的に証明"),
    _either("clinical(?:ly)?\\s+tested", "임상\\s*(?:시험|테스트)", "臨床試験済み"),
    _either("dermatologist(?:ically)?\\s+approved", "피부과\\s*(?:승인|인정)", "皮膚科医承認"),
    _either("certified", "인증(?:받|된)", "認証済み"),
    _either("patented|granted\\s+patent", "특허(?:받|등록|된)", "特許取得"),
    _either("patent\\s+pending", "특허\\s*(?:출원|신청)", "特許出願"),
    _either("permanent(?:ly)?|guaranteed", "영구적|보장", "永久|保証"),
    _either("safe\\s+for\\s+everyone|works?\\s+for\\s+all", "모두에게\\s*안전|모든\\s*피부", "すべての人に安全|すべての肌"),
    _either("best|number\\s*one|no\\.?\\s*1|award[-\\s]?winning|better\\s+than", "최고|1위|수상|보다\\s*우수", "最高|第?1位|受賞|より優れ"),
)
# Negation, weak wording, and wording that asserts an effect.
NEGATIVE = _either("no|not|never|neither|without|cannot|can't|doesn't|does\\s+not|do\\s+not|isn't|is\\s+not|aren't|are\\s+not", "않|없|아니|못하|무첨가", "ない|ません|ではない|無し|なし")
WEAK = _either("may|might|could|can|potentially|appears?|suggests?|helps?|supports?|designed\\s+to|aims?\\s+to", "수\\s*있|가능성|도움을?\\s*줄|도와|돕|지원|설계", "可能性|ことがある|場合がある|助け|支え|目指|設計")
ASSERTIVE = _either("improves?|boosts?|strengthens?|provides?|increases?|decreases?|cures?|treats?", "(?:개선|강화|제공|증가|감소|완화|치료|치유)(?:하|합|됩|시켜|된다고)", "(?:改善|強化|提供|増加|減少|治療)(?:する|します|できる)")
REVIEWED = _either("reviews?|reviewers?|customers?|users?|respondents?", "리뷰|후기|고객|사용자|응답자", "レビュー|口コミ|利用者|回答者")
# Study scopes that a number keeps.
SCOPES = (
    "self[-\\s]?assessment|consumer\\s+(?:survey|test)|survey|자가\\s*평가|소비자\\s*(?:설문|평가)|アンケート|自己評価",
    "clinical|instrumental|in[-\\s]?vivo|임상|기기\\s*(?:평가|측정)|臨床|機器測定",
    "results?\\s+(?:may\\s+)?vary|individual\\s+results|개인차|결과는\\s*다를|個人差|結果には差",
)
# Wording that ties an ingredient to a benefit, and wording that only sets both side by side.
REST = "[^.!?。！？;；\\n]{0,100}"
RELATION = (
    f"{T.BEGIN}(?:helps?|supports?|improves?|boosts?|strengthens?|provides?|delivers?|contributes?\\s+to|based\\s+on|powered\\s+by|through|via){T.END}|{T.BEGIN}with{T.END}{REST}{T.BEGIN}for{T.END}|{T.BEGIN}for{T.END}{REST}{T.BEGIN}with{T.END}"
    "|도와|돕|지원|개선|강화|높여|제공|기여|기반|통해|(?:으)?로\\s+[^.!?。！？;；\\n]{0,80}(?:보습|수분|장벽|탄력|진정|개선|효과|효능)|助け|支え|改善|高め|与え|寄与|による|を通じ|配合で"
)
THE_PRODUCT = f"{T.BEGIN}(?:the|this)\\s+product{T.END}|(?:이|해당)\\s*제품(?:은|는|이|가)|本品(?:は|が)"
BRIDGE = f"{T.BEGIN}(?:through|via|based\\s+on|powered\\s+by|because\\s+of){T.END}|통해|기반(?:으로)?|바탕으로|덕분에|때문에|로\\s*인해|を通じ|に基づ|によって"
SIDE_BY_SIDE = (
    "(?:포함|함유|배합)(?:하고|하며|해\\s*있고|되어\\s*있고|하고\\s*있으며)[^.!?。！？;；\\n]{0,140}(?:도와|돕|지원)"
    f"|{T.BEGIN}(?:includes?|contains?|features?){T.END}[^.!?]{{0,140}}{T.BEGIN}and{T.END}[^.!?]{{0,100}}{T.BEGIN}(?:helps?|supports?|provides?){T.END}|(?:配合|含有|含み)[^。！？]{{0,140}}(?:かつ|し、|して)[^。！？]{{0,100}}(?:助け|支え)"
)


# words and concepts


def match_key(text: Column) -> Column:
    """Lower-case letters and digits with single spaces between, uncut."""
    return F.trim(F.regexp_replace(F.lower(T.clean_text(text)), r"[^\p{L}\p{N}]+", " "))


def _stripped(word: str) -> str:
    for test, endings in ENDINGS:
        if re.search(test, word):
            for pattern, value in endings:
                word = re.sub(pattern, value, word)
    return word


STOPS = tuple(dict.fromkeys(x for w in CLAIM_STOPWORDS for x in (w, _stripped(w))))


def claim_tokens(text: Column) -> Column:
    """Distinct stripped words of two characters or more that carry meaning, and trigrams of Japanese text."""
    words = F.filter(F.transform(F.split(match_key(text), " "), evidence_token), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPS))
    bare = F.regexp_replace(F.regexp_replace(text, JAPANESE_FILLERS, ""), r"[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]", "")
    none = F.array().cast("array<string>")
    grams = T.let(bare, lambda b: F.when(F.length(b) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - 2, F.lit(1))), lambda i: F.substr(b, i, F.lit(3)))).when(F.length(b) == 2, F.array(b)).otherwise(none))
    return F.array_distinct(F.concat(words, grams))


def _named(text: Column, table) -> Column:
    return F.filter(F.array(*[F.when(T.matches(text, _either(*patterns)), F.lit(name)) for name, *patterns in table]), lambda x: x.isNotNull())


def concepts(text: Column) -> Column:
    """Names of the concepts in a text, in their fixed order."""
    return _named(text, CONCEPTS)


def contexts(text: Column) -> Column:
    return _named(text, CONTEXTS)


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def shared(words: Column, others: Column) -> Column:
    """How many of the words match one of the others."""
    return F.size(F.filter(words, lambda w: F.exists(others, lambda o: tokens_match(w, o))))


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?。！？;；\n]+"), T.clean_text), lambda c: c != "")


def different_script(a: Column, b: Column) -> Column:
    """Whether both texts have a main script (three characters at least), and not the same."""
    return F.coalesce(main_script(a) != main_script(b), F.lit(False))


def main_script(text: Column) -> Column:
    """latin, hangul or japanese, whichever has most characters, the first of equals; null below three."""
    n = [(F.regexp_count(text, F.lit(p)), name) for p, name in (("[A-Za-z]", "latin"), (r"[\x{AC00}-\x{D7A3}]", "hangul"), (r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]", "japanese"))]
    top = F.greatest(*(c for c, _ in n))
    rule = F.when(top < 3, F.lit(None).cast("string"))
    for c, name in n:
        rule = rule.when(c == top, name)
    return rule


def texts_of(cited: Column, glue: str) -> Column:
    return F.array_join(F.transform(cited, lambda x: x["text"]), glue)


# numbers


def metric_groups(cited: Column) -> Column:
    """Numbers of metric atoms that name the same evidence group, for groups of two atoms or more."""
    group = lambda x: F.trim(F.regexp_extract(x["text"], r"(?:^|;\s*)evidenceGroup=([^;]+)", 1))
    own = F.filter(cited, lambda x: (x["role"] == "metric") & (group(x) != ""))
    names = F.array_distinct(F.transform(own, group))
    members = F.transform(names, lambda n: F.filter(own, lambda x: group(x) == n))
    return F.transform(F.filter(members, lambda m: F.size(m) >= 2), lambda m: F.array_distinct(F.flatten(F.transform(m, lambda x: T.numeric_claims(x["text"])))))


def relationships_supported(claim: Column, cited: Column) -> Column:
    """Each clause with two numbers or more lies inside one clause, or one metric group, of the evidence."""
    own = F.filter(T.numeric_claim_groups(claim), lambda g: F.size(g) >= 2)
    return T.let(F.concat(T.numeric_claim_groups(texts_of(cited, ". ")), metric_groups(cited)), lambda given: F.forall(own, lambda g: F.exists(given, lambda c: _subset(g, c))))


def scopes_kept(claim: Column, evidence: Column) -> Column:
    test = F.lit(True)
    for p in SCOPES:
        test = test & (~T.matches(evidence, p) | T.matches(claim, p))
    return test


def numbers_supported(claim: Column, cited: Column) -> Column:
    given = texts_of(cited, ". ")
    return (F.size(T.numeric_claims(claim)) == 0) | (_subset(T.numeric_claims(claim), T.numeric_claims(given)) & relationships_supported(claim, cited) & scopes_kept(claim, given))


CLAIM_TOKENS = (
    (r"[+\-−]?\d+(?:\.\d+)?\s?(?:%|배)", True),
    (f"{T.BEGIN}\\d+(?:\\.\\d+)?\\s?(?:weeks?|days?|hours?|users?|participants?|women|men|subjects?|reviews?){T.END}", True),
    (f"{T.BEGIN}(?:after|in)\\s+\\d+(?:\\.\\d+)?\\s?(?:weeks?|days?|hours?){T.END}", True),
)


def unsupported_claim_tokens(text: Column, corpus: Column) -> Column:
    """Whether a measured token of the text is not in the corpus."""
    plain = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("−"), F.lit("-")), r"\s+", " "))
    found = F.concat(*[T.matched(text, p, fold) for p, fold in CLAIM_TOKENS])
    return T.let(plain(corpus), lambda c: F.exists(found, lambda t: ~F.contains(c, plain(t))))


# context, risk, polarity, causes


def contexts_supported(claim: Column, evidence: Column) -> Column:
    """No season, time, occasion or audience, no generalisation and no cause that the evidence does not name."""
    kept = lambda p: ~T.matches(claim, p) | T.matches(evidence, p)
    return (F.coalesce(claim, F.lit("")) == "") | (_subset(contexts(claim), contexts(evidence)) & kept(GENERALISED) & kept(BECAUSE))


def adds_context(text: Column, corpus: Column) -> Column:
    """Whether copy brings in a season, time, occasion, audience, generalisation or cause that the product's source does not name."""
    table = (*SOURCE_SEASONS, *CONTEXTS[4:])
    new = lambda p: T.matches(text, p) & ~T.matches(corpus, p)
    return ~_subset(_named(text, table), _named(corpus, table)) | new(GENERALISED) | new(BECAUSE)


def risks_supported(claim: Column, evidence: Column) -> Column:
    """A risk that the claim names, the evidence names."""
    test = F.lit(True)
    for p in RISKS:
        test = test & (~T.matches(claim, p) | T.matches(evidence, p))
    return test


def polarity_kept(claim: Column, evidence: Column) -> Column:
    """A negation in a related clause of the evidence stays, and a weak one is not made firm."""
    firm = T.matches(claim, ASSERTIVE) & ~T.matches(claim, WEAK)
    own = F.struct(claim_tokens(claim).alias("words"), concepts(claim).alias("concepts"), T.matches(claim, NEGATIVE).alias("negative"), firm.alias("firm"))

    def broken(c: Column, o: Column) -> Column:
        words = claim_tokens(c)
        near = T.let(words, lambda w: shared(w, o["words"]) >= F.least(F.lit(2), F.greatest(F.lit(1), F.size(w))))
        related = F.when(different_script(claim, c), F.arrays_overlap(concepts(c), o["concepts"])).otherwise(near)
        return ((T.matches(c, NEGATIVE) & ~o["negative"]) | (T.matches(c, WEAK) & o["firm"])) & related

    return T.let(own, lambda o: ~F.exists(clauses(evidence), lambda c: broken(c, o)))


def side_by_side(clause: Column, names: Column) -> Column:
    """A clause whose subject is the product, that holds a component and helps with a benefit, without a bridge between them."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    subject = F.exists(names, lambda n: (T.clean_text(n) != "") & F.contains(plain(clause), plain(n))) | T.matches(clause, THE_PRODUCT)
    return subject & ~T.matches(clause, BRIDGE) & T.matches(clause, SIDE_BY_SIDE)


def causes_supported(claim: Column, cited: Column, product: Column) -> Column:
    """A clause that ties an ingredient to a benefit needs a clause of the evidence that ties the same.

    ``product``: ``struct<names array, ingredients array, benefits array>``.
    """
    words = lambda name: claim_tokens(F.array_join(product[name], " "))
    own = F.struct(words("ingredients").alias("ingredients"), words("benefits").alias("benefits"))
    given = F.flatten(F.transform(cited, lambda x: clauses(x["text"])))
    met = lambda terms, found: F.filter(terms, lambda t: F.exists(found, lambda c: tokens_match(t, c)))

    def unsupported(clause: Column, o: Column) -> Column:
        def judged(w: Column) -> Column:
            parts = F.struct(met(o["ingredients"], w).alias("i"), met(o["benefits"], w).alias("b"))

            def missing(p: Column) -> Column:
                tie = lambda c: T.let(claim_tokens(c), lambda s: (shared(p["i"], s) > 0) & (shared(p["b"], s) > 0)) & T.matches(c, RELATION)
                return (F.size(p["i"]) > 0) & (F.size(p["b"]) > 0) & ~F.exists(given, tie)

            return T.let(parts, missing)

        return T.matches(clause, RELATION) & ~side_by_side(clause, product["names"]) & T.let(claim_tokens(clause), judged)

    return T.let(own, lambda o: ~F.exists(clauses(claim), lambda c: unsupported(c, o)))


# the gates in turn


def support_reason(claim: Column, cited: Column, product: Column, audited: Column, least: float = 0.55) -> Column:
    """The first gate that a claim fails on its cited evidence, null if it passes all.

    ``audited`` tells whether a model has judged the wording; without it every word of the claim has to be in the evidence.
    """
    solid = F.filter(cited, lambda x: x["role"] != "identity")

    def judged(s: Column) -> Column:
        text = texts_of(s, " ")
        names = claim_tokens(F.array_join(product["names"], " "))
        words = T.let(names, lambda n: F.filter(claim_tokens(claim), lambda w: ~F.exists(n, lambda x: tokens_match(w, x))))
        state = F.struct(text.alias("text"), words.alias("words"), claim_tokens(text).alias("given"), concepts(claim).alias("own"), concepts(text).alias("there"))

        def reason(x: Column) -> Column:
            n = F.size(x["words"])
            hits = shared(x["words"], x["given"])
            japanese = T.matches(claim, r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]") & ~T.matches(claim, r"[\x{AC00}-\x{D7A3}]")
            named = _subset(x["own"], x["there"])
            far = different_script(claim, x["text"])
            enough = (hits >= F.least(F.lit(3), n)) & (hits / n >= F.when(japanese, 0.55).otherwise(F.lit(least)))
            return F.coalesce(
                F.when(F.size(s) == 0, "no-evidence"),
                F.when(F.forall(s, lambda e: e["role"] == "review") & ~T.matches(claim, REVIEWED), "review-not-attributed"),
                F.when(~roles_support_topics(claim, F.transform(cited, lambda e: e["role"])), "topic-without-role"),
                F.when(~contexts_supported(claim, x["text"]), "context"),
                F.when(~risks_supported(claim, x["text"]), "risk"),
                F.when(~polarity_kept(claim, x["text"]), "polarity"),
                F.when(~causes_supported(claim, cited, product), "cause"),
                F.when(far, F.when(~(audited & named & (F.size(x["own"]) > 0)), "other-script")).otherwise(
                    F.when(n == 0, F.lit(None)).when(audited, F.when(~japanese & ~named, "concept").when(~enough, "wording")).when(hits < n, "wording")
                ),
            )

        return T.let(state, reason)

    return T.let(solid, judged)


def supported(claim: Column, cited: Column, product: Column, audited: Column) -> Column:
    """Whether a claim passes the gates and its numbers are supported."""
    return support_reason(claim, cited, product, audited).isNull() & numbers_supported(claim, cited)


# texts against texts


def too_similar(a: Column, b: Column) -> Column:
    """Containment either way, or 0.8 of the smaller's tokens (three at least) matched in the other; an empty text is like none."""
    keys = F.struct(match_key(a).alias("x"), match_key(b).alias("y"), claim_tokens(a).alias("s"), claim_tokens(b).alias("t"))

    def judged(k: Column) -> Column:
        least = F.least(F.size(k["s"]), F.size(k["t"]))
        inside = F.contains(k["x"], k["y"]) | F.contains(k["y"], k["x"])
        return (k["x"] != "") & (k["y"] != "") & (inside | ((least >= 3) & (shared(k["s"], k["t"]) >= least * 0.8)))

    return T.let(keys, judged)


def faq_equivalent(a: Column, b: Column) -> Column:
    """Equal questions, the same intent and entry point, or 0.8 of the questions' words in common; of ``struct<question, intent, cep>``."""
    words = lambda q: F.array_distinct(F.filter(F.split(match_key(q["question"]), " "), lambda t: F.length(t) > 1))
    same = lambda k: (match_key(a[k]) != "") & (match_key(a[k]) == match_key(b[k]))
    union = F.size(F.array_union(words(a), words(b)))
    overlap = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)
    return (match_key(a["question"]) == match_key(b["question"])) | (same("intent") & same("cep")) | (overlap >= 0.8)


def matching_evidence(texts: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """``texts`` rows with ``evidence_ids``, in order: the atoms of the same ``key`` that equal, hold or lie in the text.

    texts: key, text; evidence: key, ord, evidence_id, text. Atoms of a key are few; the join is on the key.
    """
    left = texts.withColumn("_k", match_key(F.col("text")))
    right = evidence.select(key, F.col("ord").alias("_ord"), F.col("evidence_id").alias("_id"), match_key(F.col("text")).alias("_e"))
    right = right.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_ord", "_id", "_e"))).alias("_atoms"))
    hits = F.filter(F.coalesce("_atoms", F.array().cast("array<struct<_ord:bigint,_id:string,_e:string>>")), lambda x: F.contains(x["_e"], F.col("_k")) | F.contains(F.col("_k"), x["_e"]))
    return left.join(right, key, "left").withColumn("evidence_ids", F.transform(hits, lambda x: x["_id"])).drop("_k", "_atoms")
