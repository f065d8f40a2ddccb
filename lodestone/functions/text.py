"""Scalar text functions as Column expressions; all stay in the JVM.

White space, word borders and case folding are spelled out, so that results do not depend on an engine's regex defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space including no-break and other Unicode spaces.
WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_LETTER = r"[^\p{L}\p{N}]"
#: A word border that looks at ASCII letters, digits and underscores only: behind a Korean counter there is none before a space.
BORDER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
BEGIN = END = BORDER
#: Words that carry no meaning in evidence keywords. Fixed values.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "제품", "상품", "그리고", "입니다")


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found, in any case; null counts as empty."""
    return F.coalesce(text, F.lit("")).rlike(f"(?iu){pattern}")


def matched(text: Column, pattern: str, fold: bool = True) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iu)({pattern})" if fold else f"({pattern})"), F.lit(0))


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside of brackets."""
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def is_plain(pattern: str) -> bool:
    return not any(c in "\\^$.|?*+()[]{}" for c in pattern)


def names_any(lowered: Column, pattern: str) -> Column:
    """Whether a text in lower case holds one of a pattern's alternatives; plain words are looked for one by one, which is faster than their pattern."""
    parts = alternatives(pattern)
    plain, rest = [p.lower() for p in parts if is_plain(p)], [p for p in parts if not is_plain(p)]
    found = F.lit(False)
    for word in plain:
        if not any(w != word and w in word for w in plain):  # a longer one is found by its part
            found = found | F.contains(lowered, F.lit(word))
    return found | lowered.rlike("(?iu)" + "|".join(rest)) if rest else found


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def clean_text(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def fingerprint(text: Column, length: int = 260) -> Column:
    """Lower-case letters and digits with single spaces between, cut to a length."""
    return F.substring(F.regexp_replace(F.lower(clean_text(text)), f"{NOT_LETTER}+", " "), 1, length)


def comparison_text(text: Column) -> Column:
    """Lower-case letters and digits only, uncut: spacing variants compare equal."""
    return F.regexp_replace(F.lower(clean_text(text)), f"{NOT_LETTER}+", "")


def clean_lines(text: Column) -> Column:
    """Each line cleaned, empty ones dropped."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, clean_text), lambda x: x != ""), "\n")


def strip_section_title(title: Column, text: Column) -> Column:
    """The text without its title at the start, however often it stands there, in any case."""
    t = clean_text(title)
    body = clean_text(text)
    quoted = F.concat(F.lit(r"(?iu)^(?:\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E ?)+"))
    return F.when(t == "", body).otherwise(F.trim(F.regexp_replace(body, quoted, F.lit(""))))


def strip_source_label(text: Column) -> Column:
    """A leading label in square brackets dropped."""
    return clean_text(F.regexp_replace(text, rf"^\[[^\]]+\]{WS}*", ""))


def tokens(text: Column) -> Column:
    """Retrieval terms: lower-case words of two characters or more, hyphens kept, repeats kept."""
    bare = F.regexp_replace(F.lower(text), rf"(?:(?!{WS})[^\p{{L}}\p{{N}}-])+", " ")
    return F.filter(F.split(bare, f"{WS}+"), lambda x: F.length(x) >= 2)


def terms(text: Column) -> Column:
    """Evidence terms: lower-case words of two characters or more, no hyphens."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), f"{NOT_LETTER}+", " "), " "), lambda x: F.length(x) >= 2)


def keywords(text: Column, most: int = 16) -> Column:
    """The first distinct terms that are no stopwords."""
    return F.slice(F.array_distinct(F.filter(terms(text), lambda x: ~x.isin(*STOPWORDS))), 1, most)


def sentences(text: Column) -> Column:
    """Pieces that end in a sentence mark followed by white space, cleaned, empty ones dropped."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?。！？]){WS}+"), clean_text), lambda x: x != "")


def sentence_units(text: Column) -> Column:
    """Sentences where the next begins with a capital, a digit or an East Asian character."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?。！？]){WS}+(?=[A-Z0-9\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}])"), clean_text), lambda x: x != "")


def distinct_sentences(text: Column) -> Column:
    """Sentences without those whose fingerprint came before."""
    parts = sentences(text)
    keys = F.transform(parts, lambda x: fingerprint(x))
    return F.filter(parts, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def bullets(text: Column) -> Column:
    """Up to six list items, or sentences where there is no list, of 12 characters or more, each cut to 220."""
    body = clean_text(text)
    items = F.filter(F.split(body, rf"{WS}*(?:[•·]| - |\|){WS}*"), lambda x: F.length(x) >= 12)
    parts = F.when(F.size(items) > 1, items).otherwise(F.filter(sentences(body), lambda x: F.length(x) >= 12))
    return F.slice(F.array_distinct(F.transform(parts, lambda x: F.substring(clean_text(x), 1, 220))), 1, 6)


def split_list(text: Column) -> Column:
    """Items of a line, comma, `` | `` or `` / `` list; an address stays whole."""
    body = F.trim(text)
    return F.when(matches(body, "^https?://"), F.array(body)).otherwise(F.filter(F.transform(F.split(text, r"\n|,| \| | / "), clean_text), lambda x: x != ""))


def infer_locale(text: Column) -> Column:
    """Kana: ja-JP, hangul: ko-KR, else en-US."""
    return F.when(text.rlike(r"[\x{3040}-\x{30FF}]"), "ja-JP").when(text.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko-KR").otherwise("en-US")


def market_of(locale: Column) -> Column:
    language = F.lower(F.substring(locale, 1, 2))
    return F.when(language == "ko", "KR").when(language == "ja", "JP").when(language == "en", "US").otherwise("GLOBAL")


SCRIPTS = {"hangul": r"[\x{AC00}-\x{D7AF}]", "kana": r"[\x{3040}-\x{30FF}]", "latin": r"[A-Za-z]"}


def script_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(v)) for k, v in SCRIPTS.items()}


def primary_script(text: Column, least: int = 3) -> Column:
    """The script with most characters, if it has three at least; ties go to hangul, kana, latin in this order."""
    n = script_counts(text)
    top = F.greatest(*n.values())
    found = F.lit(None).cast("string")
    for k in reversed(n):
        found = F.when(n[k] == top, k).otherwise(found)
    return F.when(top >= least, found)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The set of n-character strings; a shorter text is its only member."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def dedupe_comma_list(text: Column) -> Column:
    """A list of three or more short parts without repeats; other texts unchanged."""
    parts = F.filter(F.transform(F.split(text, ","), clean_text), lambda x: x != "")
    keys = F.transform(parts, lambda x: F.lower(x))
    once = F.filter(parts, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)
    short = F.forall(parts, lambda x: F.length(x) <= 40)
    return F.when((F.size(parts) >= 3) & short, F.array_join(once, ", ")).otherwise(text)


def product_name(text: Column, sites: tuple[str, ...] = ()) -> Column:
    """A page title without what follows a bar, and without a closing site name behind a dash; null where nothing is left."""
    body = F.regexp_replace(clean_text(F.coalesce(text, F.lit(""))), r"\s+\|\s+.*$", "")
    for site in (*sites, "Official Store", "Official Site"):
        body = F.regexp_replace(body, rf"(?iu)\s+[–—-]\s+\Q{site}\E.*$", "")
    return F.nullif(clean_text(body), F.lit(""))


# numbers and amounts


def price_amount(text: Column) -> Column:
    """Digits and dots as a number, null if they are none."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def find_price(text: Column) -> Column:
    """The first amount with a currency, null if there is none."""
    found = F.regexp_extract(text, rf"(?iu)(?:[$€£¥]{WS}*)\d[\d,.]*|₩{WS}*\d[\d,.]*|\d[\d,.]*{WS}*(?:원|KRW|USD|EUR|JPY)", 0)
    return F.when(found != "", F.regexp_replace(found, "[.,]+$", ""))


def rating_value(text: Column) -> Column:
    """A rating from 1 to 5 in words such as ``4.5 out of 5``, ``4 stars`` or ``rating: 3.9``."""
    body = clean_text(text)
    found = [
        F.regexp_extract(body, rf"(?iu)([1-5](?:\.\d+)?){WS}*(?:out of|/){WS}*5|([1-5](?:\.\d+)?){WS}*(?:stars?|점|별점)", g) for g in (1, 2)
    ] + [F.regexp_extract(body, r"(?iu)(?:rating|평점|별점)[^\d]{0,20}([1-5](?:\.\d+)?)", 1)]
    return F.coalesce(*[F.nullif(x, F.lit("")).cast("double") for x in found])


def review_count(text: Column) -> Column:
    """The count in ``1,234 reviews``, or a bare whole number."""
    body = clean_text(text)
    named = F.regexp_extract(body, rf"(?iu)([\d,]+){WS}*(?:reviews?|ratings?|개의 리뷰|리뷰|후기|평점)", 1)
    number = F.when(named != "", F.replace(named, F.lit(","), F.lit(""))).when(body.rlike(r"^\d+$"), body)
    return F.nullif(number, F.lit("")).cast("double")


UNITS = "ml|mL|oz|fl\\.?\\s?oz|weeks?|days?|hours?|stars?|drops?|pumps?|times?"


def metric_phrases(text: Column, most: int = 8) -> Column:
    """Distinct measured phrases: shares, amounts and durations, then ``after 4 weeks``, then Korean counters."""
    found = F.concat(
        matched(text, rf"{BEGIN}\d+(?:\.\d+)?\s?%|{BEGIN}\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?\s?(?:{UNITS}){END}"),
        matched(text, rf"{BEGIN}(?:after|in)\s+\d+(?:\.\d+)?\s?(?:weeks?|days?|hours?){END}"),
        matched(text, rf"{BEGIN}\d+(?:\.\d+)?\s?(?:점|개|명|회|주|일|시간|퍼센트){END}", fold=False),
    )
    return F.slice(F.array_distinct(found), 1, most)


def skin_type_signals(text: Column) -> Column:
    body = clean_text(text)
    return F.array_distinct(F.concat(matched(body, r"(?:dry|sensitive|oily|combination)\s+skin"), matched(body, r"(?:건조|건성|민감|지성|복합성)\s*피부", fold=False)))


def numeric_tokens(text: Column) -> Column:
    """Numbers with sign, currency and unit, in order, repeats kept."""
    return F.transform(matched(text, r"[+-]?[$€£¥₩]?\d+(?:[.,]\d+)*\s?(?:%|ml|mg|g|kg|oz|weeks?|days?|hours?|명|회|주|일|시간)?"), lambda x: F.regexp_replace(F.lower(F.trim(x)), " ", ""))


def identifier_tokens(text: Column) -> Column:
    """Acronyms and codes of letters and digits."""
    return F.array_distinct(matched(text, rf"{BEGIN}(?:[A-Z]{{2,}}[A-Z0-9-]*|[A-Za-z]+\d+[A-Za-z0-9-]*|\d+[A-Za-z]+[A-Za-z0-9-]*){END}", fold=False))


#: Units of a claimed number, longer spellings first where one begins like another; what is dropped or renamed at its end. Fixed values.
CLAIM_UNITS = "%|％|ppm|ml|mg|kg|g|oz|hours?|hrs?|days?|weeks?|months?|minutes?|seconds?|participants?|subjects?|users?|people|times?|layers?|krw|usd|eur|gbp|jpy|시간|일|주|개월|분|초|명|회|배|개|층|원|달러|유로|엔|人|時間|日|週間|か月|分|秒"
CLAIM_ENDINGS = (
    ("(?:krw|usd|eur|gbp|jpy|원|달러|유로|엔)$", ""), (r"^(\d+)\.0+$", "$1"), ("hrs?$", "hour"), ("hours$", "hour"), ("days$", "day"), ("weeks$", "week"), ("months$", "month"), ("minutes$", "minute"), ("seconds$", "second"),
    ("participants$", "participant"), ("subjects$", "subject"), ("users$", "user"), ("layers?$", "층"), ("times$", "time"),
)


def numeric_claims(text: Column) -> Column:
    """Numbers that stand alone, each with its unit in one spelling, in order, repeats kept."""
    found = matched(text, rf"(?<![\p{{L}}\p{{N}}])\d+(?:[.,]\d+)?\s*(?:{CLAIM_UNITS})?(?![.,]\d|[\p{{L}}\p{{N}}])")

    def one(x: Column) -> Column:
        token = F.lower(F.regexp_replace(x, r"[,\s]+", ""))
        for pattern, value in CLAIM_ENDINGS:
            token = F.regexp_replace(token, pattern, value)
        return token

    return F.transform(found, one)


#: Where a clause with numbers ends. Fixed values.
CLAIM_BREAKS = rf"(?iu)[;。！？!?]|\.(?=\s|$)|,(?=\s*[^\d\s])|{BEGIN}(?:and|also|while|whereas){END}|그리고|또한|반면|이며|および|また|一方"


def numeric_claim_groups(text: Column) -> Column:
    """The tokens of each clause that has any."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CLAIM_BREAKS), numeric_claims), lambda x: F.size(x) > 0)


# rounding and bounds


def round_score(x: Column, places: int = 4) -> Column:
    """Halves are rounded up."""
    return F.floor(x * 10**places + 0.5) / 10**places


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


# hashes


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(text: Column) -> Column:
    """Unsigned 32-bit FNV-1a over the text's characters."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    return F.aggregate(_codes(text), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(mask))


def stable_hash(text: Column) -> Column:
    """The same, as the absolute value of the signed number."""
    h = fnv1a(text)
    return F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def poly31(text: Column) -> Column:
    """Polynomial hash of base 31, modulo 2^32."""
    return F.aggregate(_codes(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
