"""Policy documents and resolved pages as sources, and the sinks of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import web as H

SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,120}\.(md|markdown|txt|json)$"


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """``name, content`` of the text documents of a folder, by Spark's own reader."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("content"))
    return files.withColumn("kind", S.document_kind(F.col("name")))


def write_profile(documents: DataFrame, path: str) -> None:
    """Documents with safe names, as a table; the others are an error, not dropped."""
    bad = documents.where(~F.col("name").rlike(SAFE_NAME)).select("name").first()
    if bad:
        raise ValueError(f"unsafe document name: {bad[0]}")
    documents.select("name", "content").write.mode("overwrite").parquet(path)


def reset_profile(defaults: DataFrame, path: str) -> None:
    """The default documents in place of a folder's."""
    write_profile(defaults, path)


def union_ranked(*sources: DataFrame) -> DataFrame:
    """Sources in order of preference, with their rank; ``first_wins`` by rank settles what they share."""
    return reduce(DataFrame.unionByName, [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)])


def referenced_documents(documents: DataFrame, pages: DataFrame, most: int = 16) -> DataFrame:
    """Pages (url, title, html) that documents (ord, name, content) name, the first ``most`` distinct addresses in order: relevant sections only.

    Nothing is fetched: pages come from a table of resolved ones.
    """
    urls = documents.select("ord", F.posexplode(H.extract_urls(F.col("content"))).alias("pos", "url"))
    first = urls.groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("at")).orderBy("at").limit(most)  # the limit is the feature
    return first.join(pages, "url").select("url", relevant_content(F.col("url"), F.col("title"), H.readable_text(F.col("html"))).alias("r")).select("url", "r.*")


def relevant_content(url: Column, title: Column, text: Column) -> Column:
    """``struct<source_kind, content>``: the best sections for the address's kind in their order, cut to its length; the first two paragraphs if none is relevant."""
    kind = S.source_kind(url, title)
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    scored = F.transform(F.filter(parts, lambda x: (F.length(x) > 80) & ~S.is_boilerplate(x)), lambda x, i: F.struct((-S.relevance_score(x, kind)).alias("s"), i.alias("i"), x.alias("x")))
    good = F.filter(scored, lambda r: r["s"] < 0)
    most, chars = F.lit(3), F.lit(3500)
    for k, (n, c) in S.SOURCE_LIMITS.items():
        most, chars = F.when(kind == k, n).otherwise(most), F.when(kind == k, c).otherwise(chars)
    best = F.slice(F.array_sort(good), F.lit(1), most)
    ordered = F.transform(F.array_sort(F.transform(best, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r["x"])
    chosen = F.array_join(F.when(F.size(good) > 0, ordered).otherwise(F.slice(parts, 1, 2)), "\n\n")
    return F.struct(kind.alias("source_kind"), F.substr(chosen, F.lit(1), chars).alias("content"))


def run_status(requested: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Each requested key with ``fulfilled`` or ``rejected``, whether a result is there."""
    return requested.select(key).distinct().join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left").select(key, F.when(F.col("_done"), "fulfilled").otherwise("rejected").alias("status"))


def write_events(events: DataFrame, path: str) -> None:
    """Progress and results as JSON lines."""
    events.write.mode("append").json(path)


def latest_versions(documents: DataFrame) -> DataFrame:
    """One row per name, of the largest version."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version")))
    return documents.withColumn("_rn", rank).where("_rn = 1").drop("_rn")
