"""Source texts of a product: the most telling ones first, mixed ones cut into units, repeated clauses dropped, categories of image sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import signals as S
from lodestone.functions import text as T

#: What a text gains by what it tells. Fixed values.
TELLING = (
    ("[0-9０-９]", 6),
    (f"%|배|{T.BORDER}(?:weeks?|days?|hours?|participants?|women|men|subjects?|reviews?){T.BORDER}|명|인|주|일|시간", 7),
    ("임상|인체\\s*적용|자가\\s*평가|시험|테스트|결과|개선|지속|만족|clinical|study|self[-\\s]?assessment|instrumental|result|improvement|agreed", 6),
    ("성분|기술|포뮬러|진세노믹스|펩타이드|비타민|콜라겐|레티놀|ingredient|technology|formula|peptide|vitamin|collagen|retinol|ginseng", 5),
    ("보습|수분|탄력|주름|피부결|장벽|진정|리프팅|밀도|hydration|firming|wrinkle|texture|barrier|soothing|lifting|density", 5),
    ("사용|아침|저녁|루틴|단계|apply|use|routine|morning|night", 2),
)


def telling_score(text: Column) -> Column:
    return sum((F.when(T.matches(text, p), n).otherwise(0) for p, n in TELLING), F.lit(0))


def most_telling(texts: Column, most: int, chars: int = 520) -> Column:
    """The ``most`` most telling distinct texts of four characters or more, ties in order, each cut to a length."""
    own = F.filter(F.transform(texts, T.clean_text), lambda t: F.length(t) >= 4)
    ranked = F.array_sort(F.transform(own, lambda t, i: F.struct((-telling_score(t)).alias("s"), i.alias("i"), t.alias("t"))))
    return F.transform(F.slice(F.array_distinct(F.transform(ranked, lambda r: r["t"])), 1, most), lambda t: F.substring(t, 1, chars))


def tidy(text: Column) -> Column:
    """Collapsed text with a space behind full stops that run into the next sentence, and none before marks."""
    t = T.clean_text(text)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(t, "([.!?。！？])(?=[가-힣A-Z])", "$1 "), r"\s+([,.!?。！？])", "$1"))
    address = T.matches(F.trim(text), r"^(?:https?://|data:image/|/)|\.(?:jpe?g|png|webp|gif|avif|svg)(?:\?|$)")
    return F.when(address, t).otherwise(spaced)


def mixed_units(text: Column, field: Column) -> Column:
    """A text's sentences and bullets; usage texts and whole ingredient lists stay as they are, an embedded list comes apart."""
    def parts(t: Column) -> Column:
        found = F.filter(F.transform(F.split(t, r"\r?\n|\s*[•●▪■]\s*|(?<=[.!?。！？])\s+(?=[\p{L}\p{N}])"), tidy), lambda x: x != "")
        return F.when(F.size(found) > 0, found).otherwise(F.array(t))

    def units(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(r"(?iu)(?:^|\s)(?:ingredients?|전성분|全成分)\s*[:：]"))
        head, tail = F.trim(F.substr(t, F.lit(1), F.greatest(at - 1, F.lit(0)))), F.trim(F.substr(t, F.greatest(at, F.lit(1))))
        split = F.filter(F.concat(F.when(S.full_ingredient_list(head), F.array(head)).otherwise(parts(tidy(head))), F.array(tail)), lambda x: x != "")
        listed = F.when(at > 1, split).when(S.full_ingredient_list(t), F.array(t)).otherwise(parts(t))
        return F.when(t == "", F.array().cast("array<string>")).when(field == "usage", F.array(t)).when(field == "ingredient", listed).otherwise(parts(t))

    return T.let(tidy(text), units)


#: Korean connectives between clauses with the ending that closes a sentence, and endings that tokens lose. Fixed values.
CONNECTIVES = {"되었고": "되었습니다", "되었으며": "되었습니다", "하였고": "하였습니다", "했고": "했습니다", "이고": "입니다"}
CLAUSE_ENDINGS = "(?:되었습니다|되었고|되었으며|하였습니다|했습니다|합니다|됩니다|입니다)$"


def without_repeated_clauses(sentence: Column) -> Column:
    """A Korean sentence with measured values without clauses whose tokens an earlier clause has all; the last one left gets a closing ending."""
    names = "|".join(CONNECTIVES)

    def tokens(text: Column) -> Column:
        found = T.matched(text, r"\d+(?:\.\d+)?\s*(?:%|％|배)|\d+[가-힣]+|[가-힣]{2,}|[A-Za-z]{3,}", fold=False)
        return F.filter(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), CLAUSE_ENDINGS, ""))), lambda x: x != "")

    def judged(body: Column) -> Column:
        marked = F.regexp_replace(body, rf"({names}),\s*", "$1\u0001")
        clauses = F.transform(F.split(marked, "\u0001"), lambda c: F.struct(F.regexp_extract(c, f"(?:{names})$", 0).alias("joint"), c.alias("whole"), tokens(F.regexp_replace(c, f"(?:{names})$", "")).alias("words")))
        return T.let(clauses, kept)

    def kept(clauses: Column) -> Column:
        # the last clause has no joint of its own, even where it ends like one
        last = F.size(clauses) - 1
        covered = lambda c, i: (F.size(c["words"]) > 0) & F.exists(F.slice(clauses, F.lit(1), i), lambda p: F.size(F.array_except(c["words"], p["words"])) == 0)
        flagged = F.transform(clauses, lambda c, i: F.struct(c["whole"].alias("whole"), F.when(i < last, c["joint"]).otherwise("").alias("joint"), covered(c, i).alias("again")))
        return T.let(flagged, lambda f: F.when(F.exists(f, lambda x: x["again"]), joined(F.filter(f, lambda x: ~x["again"]))))

    def joined(left: Column) -> Column:
        end = F.size(left) - 1
        closing = F.lit("")
        for joint, ending in CONNECTIVES.items():
            closing = F.when(F.element_at(left, -1)["joint"] == joint, ending).otherwise(closing)
        final = F.element_at(left, -1)
        stem = F.substr(final["whole"], F.lit(1), F.length(final["whole"]) - F.length(final["joint"]))
        return F.concat(F.array_join(F.transform(F.slice(left, F.lit(1), end), lambda x: F.concat(x["whole"], F.lit(", "))), ""), stem, closing)

    mark = F.regexp_extract(sentence, "[.。]$", 0)
    body = F.substr(sentence, F.lit(1), F.length(sentence) - F.length(mark))
    measured = sentence.rlike(r"\d+(?:\.\d+)?\s*(?:%|％|배)") & sentence.rlike(rf"(?:{names}),\s*")
    shorter = F.concat(judged(body), F.when(mark == "", ".").otherwise(mark))
    return F.when(measured, F.coalesce(shorter, sentence)).otherwise(sentence)


IMAGE_ROLES = ("ingredient", "benefit", "effect", "usage", "review", "metric")


def image_categories(text: Column) -> Column:
    """Categories of a sentence on an image: none of a routine of several products, ingredient of a whole list, else its roles."""
    roles = F.filter(F.array(*map(F.lit, IMAGE_ROLES)), lambda r: F.array_contains(E.evidence_roles(text)["roles"], r))
    route = E.routing_context(text)
    return F.when(route == "cross-sell-routine", F.array().cast("array<string>")).when(route == "ingredient-list", F.array(F.lit("ingredient"))).otherwise(roles)
