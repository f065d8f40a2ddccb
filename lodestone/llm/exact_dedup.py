"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. A digest of each normalised text (one pass over the texts; the small digest table is written to the shared folder).
2. Misra-Gries counters, Spark's ``freqItems``, name every digest with more than ``support`` of the rows, and perhaps others.
3. The candidates are counted exactly; those that do hold that share are the winners, at most 1 / ``support`` of them.
4. Winners are broadcast: their rows get their verdict map-side, without a shuffle. All other digests are counted by digest, with
   partial sums before the shuffle, and their rows joined to the counts; none of those groups holds more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import numbered, partitions, save

#: Share of the rows above which a digest counts as frequent: the first, or a quarter of a partition's where partitions are smaller,
#: but not under the second. 1 / share counters bound what is broadcast (100,000 rows of about 100 bytes).
SUPPORT, LEAST_SUPPORT = 0.001, 0.00001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8 after lower-casing A-Z; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    ``doc_id`` stays. A null id stays only where its whole group has none. Repeated rows with one id and text are copies of
    the same document: they count in ``group_size`` and carry the same verdict. Other columns are not read, whatever
    their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    support = support or max(LEAST_SUPPORT, min(SUPPORT, 0.25 / partitions(spark)))
    digests = save(docs.select(F.col(doc_id).alias("doc_id"), text_digest(F.col(text)).alias("text_sha256")), "digests")
    total = digests.count()
    named = digests.stat.freqItems(["text_sha256"], support).first()[0] if total else []
    verdict = {"keep_id": F.max("doc_id"), "group_size": F.count("*")}
    winners: list = []
    if named:
        candidates = spark.createDataFrame([(x,) for x in named], "text_sha256 string")
        counted = digests.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*(v.alias(k) for k, v in verdict.items()))
        winners = counted.where(F.col("group_size") > support * total).collect()  # 1 / support rows at most
    frequent = F.broadcast(spark.createDataFrame(winners, f"text_sha256 string, keep_id {dict(digests.dtypes)['doc_id']}, group_size long"))
    hot = digests.join(frequent, "text_sha256")
    others = digests.join(frequent.select("text_sha256"), "text_sha256", "left_anti")
    rest = others.join(others.groupBy("text_sha256").agg(*(v.alias(k) for k, v in verdict.items())), "text_sha256")
    columns = ("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return hot.select(*columns).unionByName(rest.select(*columns))


#: Rows to drop up to which their keys (digest and id, under 200 bytes each) are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; the texts themselves are not shuffled while the dropped
    rows are few.

    Null texts count as empty, a null id stays only where its group has no other. Of repeated rows with one id and text a single
    one stays. An empty table gives an empty one.
    """
    plain, name = numbered(docs)
    groups = save(exact_groups(docs, doc_id, text), "groups")
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_digest")).distinct()
    marked = plain.withColumn("digest", text_digest(F.col(name(text))))
    few = dropped.count() <= BROADCAST_ROWS
    dropped = F.broadcast(dropped) if few else dropped
    left = marked.join(dropped, (F.col("digest") == F.col("dropped_digest")) & F.col(name(doc_id)).eqNullSafe(F.col("dropped_id")), "left_anti")
    again = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if again.limit(1).count():
        left = left.dropDuplicates([name(doc_id), "digest"])
    return left.drop("digest").toDF(*docs.columns)
