"""Evidence for citation: normalised items, readiness scores, claim checks, quotes and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import text as T


@dataclass(frozen=True)
class Check:
    name: str
    test: Column
    weight: float


def weighted(checks: list[Check]) -> Column:
    """Weight of the checks that hold over all weight; 1 without any."""
    total = sum(c.weight for c in checks)
    held = sum((F.when(c.test, c.weight).otherwise(0.0) for c in checks), F.lit(0.0))
    return held / total if total else F.lit(1.0)


def readiness(checks: list[Check], coverage: Column, least: float = 0.78) -> tuple[Column, Column]:
    """Score (0.78 checks, 0.22 keyword coverage, two places) and whether it passes: high enough, no heavy check failed."""
    score = T.round_score(weighted(checks) * 0.78 + coverage * 0.22, 2)
    heavy = F.lit(True)
    for c in checks:
        if c.weight >= 1:
            heavy = heavy & F.coalesce(c.test, F.lit(False))
    return score, (score >= least) & heavy


# The patterns of the readiness checks.
PROMO = "(buy now|shop now|limited offer|link in bio|affiliate link)|지금\\s*구매|바로\\s*구매|링크를\\s*확인"
CAVEAT = "(caveat|careful|skeptical|limitation|uncertain|directional|not definitive|not a guarantee|not guaranteed?|do not prove|does not prove|not proof|before trusting)|주의|한계|조심|불확실|단정|검증"
EVIDENCE = "(evidence|supported|verify|source|claim|review|paper|news|study|signal)|근거|검증|리뷰|논문|뉴스|출처"
COMPARISON = "(compare|comparison|alternative|against|versus|vs|worth comparing)|비교|대안|대체"
REVIEWS = "(review|user signals?|reviewers?)|리뷰|후기"
STRONGER = "(paper|news|study|stronger sources?|external reference)|논문|뉴스|연구|외부\\s*근거"
FRESH = "(as of|available as of|recent|fresh|observed|published|202\\d|20\\d{2}-\\d{2}-\\d{2})|최근|기준|게시|확인"


def _word(pattern: str) -> str:
    latin, _, rest = pattern.partition(")|")
    return f"{T.BEGIN}{latin}){T.END}|{rest}" if rest else pattern


def artifact_checks(title: Column, body: Column, name: Column, category: Column, types: Column, quotable: Column, freshness: Column, comments: Column) -> list[Check]:
    """The eleven checks of a title and body; ``types`` are the evidence types that are there, ``quotable`` whether quotes or numbers are."""
    text = F.concat(title, F.lit("\n"), body)
    entity = F.exists(F.split(T.fingerprint(name), " "), lambda w: (F.length(w) >= 4) & F.contains(T.fingerprint(title), w)) | F.coalesce(F.contains(T.fingerprint(title), T.fingerprint(category)) & (category != ""), F.lit(False))
    marker = F.regexp_instr(body, F.lit("(?iu)short version|tl;dr|요약"))
    bullets = F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*[-*]\s+\S")))
    reviews, strong = F.array_contains(types, "review"), F.array_contains(types, "paper") | F.array_contains(types, "news")
    separated = F.when(reviews & strong, T.matches(text, _word(REVIEWS)) & T.matches(text, _word(STRONGER))).when(reviews, T.matches(text, _word(REVIEWS))).when(strong, T.matches(text, _word(STRONGER))).otherwise(T.matches(text, _word(EVIDENCE)))
    quoted = body.rlike(r'(?m)^\s*>\s*["“].+["”]') | T.matches(body, r"\d+(?:\.\d+)?\s*(?:%|percent|점|명|주|week|day|hour|rating)")
    return [
        Check("answer-ready-title", (title.rlike("[?？]") | T.matches(title, f"{T.BEGIN}(looked|noticed|compared|who would|is .+ worth){T.END}")) & entity, 1.0),
        Check("short-version-chunks", (marker > 0) & (bullets >= 2), 1.0),
        Check("tldr-position", (marker > 0) & (marker - 1 <= F.greatest(F.lit(500), F.floor(F.length(body) / 3))), 0.6),
        Check("claim-evidence-language", T.matches(text, _word(EVIDENCE)), 1.0),
        Check("quotation-or-statistic", ~quotable | quoted, 0.7),
        Check("source-type-separation", separated, 0.9),
        Check("caveat-limitation", T.matches(text, _word(CAVEAT)), 1.0),
        Check("comparison-context", T.matches(text, _word(COMPARISON)), 0.85),
        Check("community-question", F.trim(body).endswith("?") | F.exists(comments, lambda c: F.trim(c).rlike("[?？]$")), 0.75),
        Check("anti-promo", ~T.matches(text, _word(PROMO)), 1.0),
        Check("freshness-signal", T.matches(text, _word(FRESH)) | T.matches(freshness, _word(FRESH)), 0.75),
    ]


def keyword_coverage(required: Column, text: Column) -> Column:
    """``struct<present, missing, ratio>`` of required keywords in a text."""
    body = T.fingerprint(text, 1 << 20)
    hit = lambda k: F.contains(body, T.fingerprint(k))
    present = F.filter(required, hit)
    ratio = F.when(F.size(required) == 0, 1.0).otherwise(T.round_score(F.size(present) / F.size(required), 2))
    return F.struct(present.alias("present"), F.array_except(required, present).alias("missing"), ratio.alias("ratio"))


def normalize_evidence(buckets: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Buckets of evidence (name to a DataFrame with doc_id, ord, title, text, type, url, rating, published_at, observed_at) in one relation with ids and freshness."""
    from functools import reduce

    rows = [df.select("doc_id", F.lit(i).alias("bucket"), F.lit(name).alias("name"), "ord", "title", "text", S.source_type(F.col("type"), name if name in S.SOURCE_BOOSTS else "custom").alias("source_type"), "url", "rating", "published_at", "observed_at") for i, (name, df) in enumerate(buckets.items())]
    every = reduce(DataFrame.unionByName, rows).where(F.trim("text") != "")
    number = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("ord"))
    return every.withColumns({"evidence_id": F.concat("name", F.lit("-"), number.cast("string")), "freshness": S.freshness(F.col("published_at"), F.col("observed_at"), as_of)})


def quotes(evidence: DataFrame, most: int = 2, low: int = 30, high: int = 140) -> DataFrame:
    """Per document the first fitting sentence of each item, reviews before papers before news before the rest, up to two."""
    fit = F.filter(T.sentences(F.col("text")), lambda s: F.length(s).between(low, high))
    rank = F.when(F.col("source_type") == "review", 0).when(F.col("source_type") == "paper", 1).when(F.col("source_type") == "news", 2).otherwise(3)
    rows = evidence.withColumn("quote", F.get(fit, 0)).where(F.col("quote").isNotNull() & ~T.matches(F.col("quote"), _word(PROMO)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "evidence_id"))).where(F.col("place") <= most).select("doc_id", "evidence_id", "source_type", "quote", "place")


def statistics(evidence: DataFrame) -> DataFrame:
    """Per document the average rating of rated reviews in words, and up to two numeric sentences of papers and news."""
    number = F.filter(T.sentences(F.col("text")), lambda s: T.matches(s, r"\d+(?:\.\d+)?\s*(?:%|percent|점|명|주|week|day|hour)") & (F.length(s) <= 180))
    rated = evidence.where((F.col("source_type") == "review") & F.col("rating").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), T.round_score(F.avg("rating"), 1).alias("average"))
    told = evidence.where(F.col("source_type").isin("paper", "news")).withColumn("line", F.get(number, 0)).where("line is not null")
    told = told.withColumn("_rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("evidence_id"))).where("_rn <= 2").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "line"))), lambda x: x["line"]).alias("lines"))
    return rated.join(told, "doc_id", "full_outer")


def freshness_statement(dates: Column) -> Column:
    latest = F.array_max(F.filter(dates, lambda d: F.trim(d) != ""))
    shown = F.when(F.contains(latest, F.lit("T")), F.substring(latest, 1, 10)).otherwise(latest)
    return F.when(latest.isNotNull(), F.concat(F.lit("Based on product and evidence signals available as of "), shown, F.lit("."))).otherwise("Based on the supplied product information and evidence signals; no freshness date was provided.")


def visibility(responses: DataFrame) -> DataFrame:
    """Mention rate, citation rate and share of voice by prompt set (columns prompt_set, mentioned, cited, ours, competitors)."""
    return responses.groupBy("prompt_set").agg(F.avg(F.col("mentioned").cast("int")).alias("mention_rate"), F.avg(F.col("cited").cast("int")).alias("citation_rate"), (F.sum("ours") / F.sum(F.col("ours") + F.col("competitors"))).alias("share_of_voice"))
