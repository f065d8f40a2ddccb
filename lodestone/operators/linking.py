"""Join-shaped operators: claims to evidence, sources to text, references to nodes, questions to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def claim_links(claims: DataFrame, evidence: DataFrame, most: int = 3) -> DataFrame:
    """``claim_id, evidence_id, overlap, rank``: the evidence that shares most distinct terms with each claim, up to ``most``.

    ``claims``: claim_id, text. ``evidence``: evidence_id, text. An equi-join on terms: pairs that share none are never made.
    """
    a = claims.select("claim_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    b = evidence.select("evidence_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    pairs = a.join(b, "term").groupBy("claim_id", "evidence_id").agg(F.count("*").alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("overlap"), "evidence_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def claim_confidence(claims: DataFrame, links: DataFrame) -> DataFrame:
    """``claim_id, refs, confidence``: high with two references or more, medium with one, else low."""
    n = links.groupBy("claim_id").agg(F.count("*").alias("refs"))
    n = claims.select("claim_id").join(n, "claim_id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return n.withColumn("confidence", F.when(F.col("refs") >= 2, "high").when(F.col("refs") == 1, "medium").otherwise("low"))


def source_backed(items: DataFrame, corpus: DataFrame, least: float = 0.66, least_chars: int = 12) -> DataFrame:
    """``item_id, backed, best``: whether a corpus text contains the item, or has that share of its terms (repeats counted).

    ``items``: item_id, text; ``corpus``: doc_id, text. Containment implies that all whole terms are shared, so candidates for both
    tests come from one equi-join on terms; only pairs with enough shared terms are tested for containment.
    """
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    i = items.select("item_id", key(F.col("text")).alias("name"), T.terms(F.col("text")).alias("terms"))
    d = corpus.select("doc_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    weighted = i.select("item_id", F.size("terms").alias("n"), F.explode("terms").alias("term")).groupBy("item_id", "n", "term").agg(F.count("*").alias("times"))
    ratio = weighted.join(d, "term").groupBy("item_id", "doc_id").agg((F.sum("times") / F.first("n")).alias("ratio"))
    best = ratio.groupBy("item_id").agg(F.max("ratio").alias("best"))
    out = i.join(best, "item_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    # an item shorter than the limit has to be contained; one whose terms all occur in a text may be
    short = out.where((F.length("name") < least_chars) & (F.col("best") >= 1)).select("item_id", "name")
    held = short.join(ratio.where("ratio >= 1"), "item_id").join(corpus.select("doc_id", key(F.col("text")).alias("body")), "doc_id").where(F.contains("body", F.col("name"))).select("item_id").distinct().withColumn("held", F.lit(True))
    out = out.join(held, "item_id", "left")
    return out.select("item_id", F.when(F.length("name") >= least_chars, F.col("best") >= least).otherwise(F.coalesce("held", F.lit(False))).alias("backed"), "best")


def semi_or_first(rows: DataFrame, wanted: DataFrame, key: str, group: str, order: str, fallback: int = 4) -> DataFrame:
    """Rows whose key is wanted; in groups without any, the first ``fallback`` rows.

    Groups are told by a distinct of the wanted rows, and first rows are limited before they are shuffled, so no group is gathered.
    """
    hits = rows.join(wanted.select(F.col(key)).distinct(), key, "left_semi")
    rest = rows.join(hits.select(group).distinct(), group, "left_anti")
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return hits.unionByName(rest.withColumn("_rn", place).where(F.col("_rn") <= fallback).drop("_rn"))


def semi_or_all(rows: DataFrame, match: Column, group: str) -> DataFrame:
    """Rows that match; in groups without any, all of them."""
    w = Window.partitionBy(group)
    return rows.withColumn("_m", match.cast("int")).withColumn("_any", F.max("_m").over(w)).where("_m = 1 or coalesce(_any, 0) = 0").drop("_m", "_any")


def missing_kinds(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required combinations that no present row has."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def dangling_references(edges: DataFrame, nodes: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """References (graph_id, page_id, ref) to nodes (graph_id, node_id) that are not there, when they point into the graph's own document:
    to a removed node, to a bare fragment, or to the page's address before its fragment."""
    lost = edges.where(F.col("ref").isNotNull() & (F.col("ref") != "")).join(nodes.select("graph_id", F.col("node_id").alias("ref")), ["graph_id", "ref"], "left_anti")
    own = F.substring_index("ref", "#", 1) == F.substring_index("page_id", "#", 1)
    local = F.col("ref").startswith("#") | F.coalesce(own, F.lit(False))
    if removed is not None:
        gone = removed.select("graph_id", F.col("node_id").alias("ref")).distinct().withColumn("_gone", F.lit(True))
        return lost.join(gone, ["graph_id", "ref"], "left").where(local | F.col("_gone")).drop("_gone")
    return lost.where(local)


def question_answers(rows: DataFrame, group: str, order: str, text: str, is_question: Column, is_answer: Column, reach: int = 3, longest: int = 140) -> DataFrame:
    """Each question of at most ``longest`` characters with the first plausible non-question among the next ``reach`` rows."""
    w = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("_answer", F.when(~is_question & is_answer, F.col(text))).withColumn("_question", is_question)
    nexts = [F.lead("_answer", k).over(w) for k in range(1, reach + 1)]
    found = marked.withColumn("answer", F.coalesce(*nexts))
    return found.where(F.col("_question") & (F.length(text) <= longest) & F.col("answer").isNotNull()).drop("_answer", "_question")


def merge_documents(df: DataFrame, name: str, order: str, content: str) -> DataFrame:
    """One row per name: the last content at the first position."""
    return df.groupBy(name).agg(F.max_by(content, order).alias(content), F.min(order).alias(order))


def scope_documents(documents: DataFrame, brand: str) -> DataFrame:
    """Documents (name, scope null or a brand, replaces) of no brand or this one; a default that a brand document replaces goes."""
    own = documents.where(F.col("scope").isNull() | (F.col("scope") == brand))
    replaced = own.where(F.col("scope") == brand).select(F.col("replaces").alias("name"))
    return own.where("scope = " + repr(brand)).unionByName(own.where("scope is null").join(replaced, "name", "left_anti"))


def hydrate(selected: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` documents of each query's selected chunks (query_id, source, title, rank), with their chunk titles in rank order."""
    joined = selected.join(documents.select(F.col("name").alias("source"), "content"), "source")
    titles = joined.groupBy("query_id", "source").agg(F.min("rank").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"), F.first("content").alias("content"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "source"))
    return titles.withColumn("place", place).where(F.col("place") <= most).drop("first")


def usage_diagnostics(decisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each decision's source (decision_id, pos, source) with the first chunk (ord) that has it as id, document or title."""
    keys = chunks.select("chunk_id", "ord", F.explode(F.array_distinct(F.array("chunk_id", "source", "title"))).alias("key")).where("key is not null")
    joined = decisions.join(keys, decisions["source"] == keys["key"], "left")
    return joined.groupBy("decision_id", "pos", decisions["source"]).agg(F.min_by("chunk_id", "ord").alias("chunk_id"))
