"""Gates of locale and overlap, and keyword corrections. Proposals are data; acceptance is a deterministic column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def metric_tokens_supported(claim: Column, evidence: Column) -> Column:
    return F.size(F.array_except(T.numeric_claims(claim), T.numeric_claims(evidence))) == 0


def semantic_overlap(claim: Column, evidence: Column) -> Column:
    """Two shared terms in Korean text, else three."""
    shared = F.size(F.array_intersect(F.array_distinct(T.terms(claim)), T.terms(evidence)))
    return shared >= F.when(T.matches(claim, "[가-힣]"), 2).otherwise(3)


def target_locale(text: Column, locale: Column) -> Column:
    """Whether a text's scripts fit a locale."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    hangul, kana, han, latin = n(r"[\x{AC00}-\x{D7A3}]"), n(r"[\x{3040}-\x{30FF}]"), n(r"[\x{3400}-\x{9FFF}]"), n("[A-Za-z]")
    japanese = kana + han
    korean_ok = (hangul > 0) & (japanese < F.greatest(F.lit(3.0), hangul * 0.2)) & (latin <= F.greatest(F.lit(16.0), hangul * 1.5))
    japanese_ok = (kana > 0) & (hangul == 0) & (latin <= F.greatest(F.lit(14.0), japanese * 1.5))
    other_ok = (latin > 0) & (hangul + japanese <= F.greatest(F.lit(2), F.floor(latin * 0.08)))
    return F.when(locale == "ko-KR", korean_ok).when(locale == "ja-JP", japanese_ok).otherwise(other_ok)


# keyword corrections


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def distance_limit(a: Column, b: Column, locale: Column) -> Column:
    """Edit distance that a correction may have, by length and script."""
    n = F.greatest(F.length(_plain(a)), F.length(_plain(b)))
    korean = (locale == "ko-KR") | T.matches(F.concat(a, b), "[가-힣]")
    return F.when(korean, F.when(n <= 4, 2).otherwise(F.greatest(F.lit(2), F.floor(n * 0.35)))).otherwise(F.when(n <= 8, 2).otherwise(F.greatest(F.lit(2), F.floor(n * 0.25)))).cast("int")


def safe_correction(original: Column, normalized: Column, locale: Column) -> Column:
    """Short, plain, of one script with the original, and within the distance limit."""
    target = T.clean_text(normalized)
    ok = F.length(target).between(2, 32) & ~target.rlike(r"[,/|;:()\[\]{}<>]") & ~T.matches(target, "https?://") & (F.size(F.split(target, " ")) <= 4)
    script = lambda x, p: T.matches(x, p)
    mixed = (~script(original, "[A-Za-z]") & script(target, "[A-Za-z]")) | (~script(original, "[가-힣]") & script(target, "[가-힣]"))
    return ok & ~mixed & (F.levenshtein(_plain(original), _plain(target)) <= distance_limit(original, normalized, locale))


def safe_corrections(sources: DataFrame, corrections: DataFrame, locale: str, least: float = 0.78) -> DataFrame:
    """``original, normalized, confidence`` of the first safe, confident change of each known keyword (sources: keyword; corrections: original, normalized, confidence, ord)."""
    key = lambda c: F.lower(T.clean_text(c))
    known = sources.select(F.col("keyword").alias("known"), key(F.col("keyword")).alias("key")).dropDuplicates(["key"])
    rows = corrections.withColumn("key", key(F.col("original"))).join(known, "key").where(F.col("confidence") >= least)
    rows = rows.where((F.col("key") != key(F.col("normalized"))) & safe_correction(F.col("known"), F.col("normalized"), F.lit(locale)))
    first = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    return rows.withColumn("_rn", first).where("_rn = 1").select(F.col("known").alias("original"), T.clean_text(F.col("normalized")).alias("normalized"), "confidence")


def apply_corrections(keywords: DataFrame, corrections: DataFrame) -> DataFrame:
    """Keywords (ord, keyword) with their corrections, the first of equal ones kept."""
    changed = keywords.join(corrections.select(F.col("original").alias("keyword"), "normalized"), "keyword", "left").select("ord", F.coalesce("normalized", "keyword").alias("keyword"))
    return changed.groupBy(F.lower("keyword").alias("key")).agg(F.min("ord").alias("ord"), F.min_by("keyword", "ord").alias("keyword")).drop("key")
