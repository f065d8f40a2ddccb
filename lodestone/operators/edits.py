"""Proofreading gates: whether a proposed edit changes wording only, never what is said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.evidence import same_modality, same_review_scope
from lodestone.functions.text import BEGIN, END
from lodestone.operators.retrieval import dice

# Characters that an edit must not bring in, numbers with their units, words without content.
UNSAFE = r"```|[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]|[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0334}-\x{0338}\x{20D2}-\x{20FF}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
EDIT_NUMBERS = r"(?:[$€£₩]\s*)?[+\-−]?\d+(?:[.,]\d+)?\s*(?:%|％|배|x|회|명|인|주|일|시간|분|초|weeks?|days?|hours?|minutes?|seconds?|users?|participants?|subjects?|women|men|ml|mL|l|g|mg|µg|μg|kg|oz|ppm|mm|cm|°c|krw|usd|eur|gbp)?"
PROOF_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "nor", "so", "yet", "of", "for", "to", "in", "on", "at", "by", "with", "from", "as", "into", "onto",
    "this", "that", "these", "those", "it", "its", "they", "their", "them", "which", "who", "whom",
    "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do", "does", "did",
)
KOREAN_STOPWORDS = ("그리고", "또는", "하지만", "또한", "위")
KOREAN_SUFFIXES = (
    "이었습니다", "였습니다", "하였습니다", "되었습니다", "했습니다", "있습니다", "없습니다", "됩니다", "합니다", "입니다", "한다", "된다", "있다", "없다", "이다",
    "으로부터", "에게서는", "에서는", "으로", "에게", "께서", "까지", "부터", "처럼", "보다", "이라고", "라고", "하며", "하여", "하고", "되는", "하는", "된", "한",
    "에서", "에게", "으로", "은", "는", "이", "가", "을", "를", "와", "과", "의", "에", "로", "도", "만",
)
#: Endings of English words with the length a word must exceed; the first that applies is replaced.
ENGLISH_SUFFIXES = (("ies", 5, "y"), ("ing", 5, ""), ("ed", 4, ""), ("es", 4, ""), ("s", 3, ""))
PAGE_ROLE = f"{BEGIN}(?:official\\s+)?product\\s+page{END}|{BEGIN}page\\s+(?:covers|provides|presents|includes){END}|(?:공식\\s*)?상품\\s*페이지|페이지(?:에서는|는|가)"
TIES = f"{BEGIN}(?:because|therefore|causes?|due\\s+to|helps?|supports?|improves?|reduces?|increases?){END}|때문|통해|돕|도움|기여|개선|감소|증가|효과"
SCRIPTS = {"ko-KR": ("[가-힣]", 0.35, 0.3), "ja-JP": ("[ぁ-んァ-ン一-龯]", 0.35, 0.3), "en-US": ("[A-Za-z]", 0.5, 0.5), "en-GB": ("[A-Za-z]", 0.5, 0.5)}


def proposed(text: Column) -> Column:
    """A proposal without code fences, without spaces before marks, its blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?i)```(?:json)?", ""), r"\s+([,.!?;:。！？])", "$1")
    return F.trim(F.regexp_replace(bare, r"[ \t]+", " "))


def edit_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def _adjacent_once(parts: Column) -> Column:
    """Without members that equal the one before."""
    return F.filter(parts, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(parts, i - 1)))


def edit_numbers(text: Column) -> Column:
    """Numbers with sign, currency and unit in lower case, each once, in order."""
    tidy = lambda x: F.trim(F.regexp_replace(F.translate(x, "−％", "-%"), r"\s+", " "))
    return F.array_distinct(F.transform(T.matched(text, EDIT_NUMBERS), lambda x: F.lower(tidy(x))))


def substantive_token(token: Column) -> Column:
    """A word without its endings, Korean ones as long as any is left to strip; null for words without content."""
    bare = F.regexp_replace(F.lower(token), "^-+|-+$", "")
    suffix = f"^(..+?)(?:{'|'.join(KOREAN_SUFFIXES)})$"

    def korean(t: Column) -> Column:
        # a step strips a character at least, so as many steps as characters settle it
        done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), t, lambda x, _: F.regexp_replace(x, suffix, "$1"))
        return F.when((F.length(done) >= 2) & ~done.isin(*KOREAN_STOPWORDS), done)

    def english(t: Column) -> Column:
        rule = F.when(F.lit(False), t)
        for ending, most, value in ENGLISH_SUFFIXES:
            rule = rule.when((F.length(t) > most) & t.endswith(ending), F.concat(F.substr(t, F.lit(1), F.length(t) - len(ending)), F.lit(value)))
        return T.let(rule.otherwise(t), lambda x: F.when(F.length(x) >= 2, x))

    return T.let(bare, lambda t: F.when(t.rlike("[가-힣]"), korean(t)).when((t != "") & ~t.isin(*PROOF_STOPWORDS), english(t)))


def substantive_tokens(text: Column) -> Column:
    """Distinct words of content, in order."""
    return F.array_distinct(F.filter(F.transform(T.matched(text, r"\p{L}[\p{L}\p{N}-]*", fold=False), substantive_token), lambda t: t.isNotNull()))


def same_substance(a: Column, b: Column) -> Column:
    return substantive_tokens(a) == substantive_tokens(b)


def _units(text: Column) -> Column:
    """Of each sentence its words of content and its numbers."""
    return F.transform(edit_sentences(text), lambda s: F.struct(substantive_tokens(s).alias("words"), edit_numbers(s).alias("numbers")))


def removes_distinct_sentence(before: Column, after: Column) -> Column:
    """Fewer sentences than before, and one of those before that none after says."""
    return T.let(F.struct(_units(before).alias("a"), _units(after).alias("b")), lambda u: (F.size(u["b"]) < F.size(u["a"])) & (F.size(F.array_except(u["a"], u["b"])) > 0))


def keeps_sentences(before: Column, after: Column) -> Column:
    """The same sentences in the same order, or fewer where none is lost."""
    return T.let(F.struct(_units(before).alias("a"), _units(after).alias("b")), lambda u: F.when(F.size(u["a"]) == F.size(u["b"]), u["a"] == u["b"]).otherwise((F.size(u["b"]) < F.size(u["a"])) & (F.size(F.array_except(u["a"], u["b"])) == 0)))


def adds_ingredient_cause(before: Column, after: Column, ingredients: Column) -> Column:
    """Whether a sentence now ties an ingredient to an outcome that no sentence tied before."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    tied = lambda text, name: F.exists(edit_sentences(text), lambda s: F.contains(plain(s), plain(name)) & T.matches(s, TIES))
    return F.exists(F.filter(ingredients, lambda n: F.trim(n) != ""), lambda n: ~tied(before, n) & tied(after, n))


def keeps_locale(before: Column, after: Column, locale: Column) -> Column:
    """A text mostly in its locale's script stays so."""
    share = lambda t, p: F.when(F.regexp_count(t, F.lit(r"\p{L}")) > 0, F.regexp_count(t, F.lit(p)) / F.regexp_count(t, F.lit(r"\p{L}"))).otherwise(0.0)
    rule = F.when(F.lit(False), True)
    for name, (script, was, least) in SCRIPTS.items():
        rule = rule.when((locale == name) & (share(before, script) >= was), share(after, script) >= least)
    return rule.otherwise(True)


def _surface(text: Column) -> Column:
    """Of each sentence its words and how it ends, repeats of the sentence before dropped."""
    act = lambda s: F.when(s.rlike(r"""[?？]\s*["'”’)]*\s*$"""), "question").when(s.rlike(r"""[!！]\s*["'”’)]*\s*$"""), "exclamation").otherwise("statement")
    words = lambda s: T.matched(s, r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*", fold=False)
    return T.let(F.transform(edit_sentences(text), lambda s: F.struct(words(s).alias("words"), act(s).alias("act"))), _adjacent_once)


def same_speech_acts(a: Column, b: Column) -> Column:
    acts = lambda t: F.transform(_surface(t), lambda u: u["act"])
    return acts(a) == acts(b)


def surface_only(a: Column, b: Column) -> Column:
    """The same words but for repeats of the one before, in sentences that end alike, and no more of them than before."""
    once = lambda t: F.transform(_surface(t), lambda u: F.struct(_adjacent_once(u["words"]).alias("words"), u["act"].alias("act")))
    words = lambda t: F.size(T.matched(t, r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*", fold=False))
    return (once(a) == once(b)) & (words(b) <= words(a)) & (F.size(edit_sentences(b)) <= F.size(edit_sentences(a)))


def mark_signature(text: Column) -> Column:
    """Marks other than those that end sentences, each after the number of words before it."""
    whole = F.array_join(T.let(edit_sentences(text), _adjacent_once), " ")
    inner = F.regexp_replace(whole, r"""[.!?。！？](?=(?:[.!?。！？]+["'”’\])}]*)?(?:\s|$))""", "")
    parts = T.matched(inner, r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*|[^\p{L}\p{N}\s]", fold=False)
    signs = F.transform(parts, lambda x: F.when(x.rlike(r"^[\p{L}\p{N}]"), F.concat(F.lit("w"), F.regexp_replace(x, r"[\p{L}\p{N}]", ""))).otherwise(x))
    return F.regexp_replace(F.array_join(signs, ""), "w+$", "")


def edit_similarity(a: Column, b: Column) -> Column:
    """Dice similarity of character trigrams of lower-case letters, digits and percent signs; of two empty texts 1 or 0, as they are equal or not."""
    plain = lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}%]+", " "))
    return T.let(F.struct(plain(a).alias("x"), plain(b).alias("y")), lambda k: dice(T.char_ngrams(k["x"]), T.char_ngrams(k["y"])))


def rejection_reason(before: Column, after: Column, locale: Column, kind: Column, evidence_ids: Column, ingredients: Column, fixed: Column | None = None, marks_only: Column | None = None) -> Column:
    """The first gate that an edit fails, null if it passes all.

    ``kind``: what is edited (``faq-question``, ``webpage-description``, ``product-description`` or another). ``fixed`` are strings that
    must stay; ``marks_only`` allows marks and spacing alone. Wording may change by repeats, marks and spacing; a proposal that
    changes grammar is rejected as ``wording``.
    """
    new = proposed(after)
    fixed = F.array().cast("array<string>") if fixed is None else fixed
    marks_only = F.lit(False) if marks_only is None else marks_only
    bare = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}%]+", "")
    question = kind == "faq-question"
    page = lambda t: T.matches(t, PAGE_ROLE)
    ladder = (
        ("unsafe-characters", after.rlike(UNSAFE)),
        ("empty", new == ""),
        ("no-evidence", F.size(evidence_ids) <= 0),
        ("locale", ~keeps_locale(before, new, locale)),
        ("longer", F.length(new) > F.length(before) * 1.15 + 12),
        ("shorter", F.length(new) < F.length(before) * F.when(question, 0.55).otherwise(0.35)),
        ("not-marks-only", marks_only & (bare(new) != bare(before))),
        ("fixed-token", F.exists(fixed, lambda x: ~F.contains(new, x))),
        ("number", edit_numbers(before) != edit_numbers(new)),
        ("modality", ~same_modality(before, new)),
        ("review-scope", ~same_review_scope(before, new)),
        ("cause", adds_ingredient_cause(before, new, ingredients)),
        ("speech-act", ~same_speech_acts(before, new)),
        ("marks", mark_signature(before) != mark_signature(new)),
        ("substance", ~same_substance(before, new)),
        ("sentences", ~keeps_sentences(before, new)),
        ("wording", ~surface_only(before, new)),
        ("page-role-lost", (kind == "webpage-description") & page(before) & ~page(new)),
        ("page-role-gained", (kind == "product-description") & ~page(before) & page(new)),
        ("no-question", question & before.rlike(r"[?？]\s*$") & ~new.rlike(r"[?？]\s*$")),
        ("more-sentences", F.size(edit_sentences(new)) > F.size(edit_sentences(before))),
        ("sentence-lost", removes_distinct_sentence(before, new)),
        ("too-different", edit_similarity(before, new) < F.when(question, 0.52).otherwise(0.42)),
    )
    return F.coalesce(*[F.when(test, name) for name, test in ladder])


# descriptions

# Wording that opens a page description, and wording that tells nothing when descriptions are compared.
PAGE_OPENING = f"상품\\s*페이지|제품\\s*페이지|상세\\s*페이지|product\\s+(?:detail\\s+)?page|{BEGIN}PDP{END}|商品ページ|製品ページ"
ROLE_WORDS = (
    f"{BEGIN}(?:this|the){END}", f"{BEGIN}(?:product\\s+detail\\s+page|product\\s+page|pdp|page){END}", f"{BEGIN}(?:introduces?|summari[sz]es?|covers?|presents?|describes?|includes?|explains?|helps?|lets?){END}",
    "상품\\s*페이지|제품\\s*페이지|상세\\s*페이지|페이지에서는|페이지에는|페이지는|페이지|소개합니다|추천합니다|다룹니다|안내합니다|설명합니다|제공합니다|확인할\\s*수\\s*있습니다", "商品ページ|製品ページ|ページでは|ページは|ページ",
)


def role_key(text: Column) -> Column:
    key = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    for p in ROLE_WORDS:
        key = F.regexp_replace(key, p, " ")
    return F.trim(F.regexp_replace(key, r"\s+", " "))


def descriptions_too_similar(page: Column, product: Column, long: int = 72) -> Column:
    """Equal descriptions, one (of 72 characters or more) inside the other, or two such sentences in common without a page's own opening."""
    parts = lambda t: F.filter(F.transform(F.split(t, r"(?<=[.!?。！？])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    first = lambda t: F.coalesce(F.get(parts(t), 0), F.lit(""))
    keys = lambda t: F.filter(F.transform(parts(t), role_key), lambda x: F.length(x) >= long)
    state = F.struct(role_key(page).alias("a"), role_key(product).alias("b"), keys(page).alias("p"), keys(product).alias("q"))

    def judged(k: Column) -> Column:
        own = T.matches(first(page), PAGE_OPENING) & (role_key(first(page)) != role_key(first(product)))
        inside = ((F.length(k["b"]) >= long) & F.contains(k["a"], k["b"])) | ((F.length(k["a"]) >= long) & F.contains(k["b"], k["a"]))
        repeats = F.size(F.filter(k["q"], lambda x: F.exists(k["p"], lambda y: F.contains(x, y) | F.contains(y, x))))
        return (k["a"] != "") & (k["b"] != "") & ((k["a"] == k["b"]) | inside | (~own & (repeats >= 2)))

    return T.let(state, judged)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one letter put in, left out or changed makes the texts equal."""
    return F.levenshtein(a, b, 1) >= 0
