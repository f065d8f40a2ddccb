"""Hybrid retrieval on sparse vectors: token and bucket equi-joins, two rankings, reciprocal rank fusion, boosts, top k.

A chunk's hashed vector is kept as (chunk, bucket, weight) rows, so both scores are equi-joins with partial aggregation; pairs that
share nothing are never made. Their place in the rankings follows from the counts of those that do (``hybrid_topk``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.lineage import cut

BUCKETS = 384
#: Weights of the hybrid score and the constant of rank fusion. Fixed values.
LEXICAL, SEMANTIC, FUSION, RANK_OFFSET, RANK_SCALE = 0.38, 0.34, 0.16, 60, 30


def lexical_similarity(query: Column, candidate: Column) -> Column:
    """Distinct shared terms over the root of (query terms with repeats times distinct candidate terms); 0 if either is empty."""
    shared = F.size(F.array_intersect(query, candidate))
    return F.when((F.size(query) == 0) | (F.size(candidate) == 0), 0.0).otherwise(shared / F.sqrt(F.size(query).cast("double") * F.size(F.array_distinct(candidate))))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Distinct shared members over the root of both sizes."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b)))


def token_overlap_ratio(tokens: Column, candidate: Column) -> Column:
    """Share of the tokens, repeats counted, that the candidate has."""
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(F.filter(tokens, lambda t: F.array_contains(candidate, t))) / F.size(tokens))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared over all character n-grams of two sets."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def cosine(a: Column, b: Column) -> Column:
    """(dot + 1) / 2, within 0 and 1: orthogonal vectors score a half."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return T.clamp((dot + 1) / 2)


def term_counts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, term, times``: the tokens of a text; one shuffle that both kinds of vectors share."""
    return df.select(F.col(key), F.explode(T.tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("times"))


def _bucket_weights(counts: DataFrame, key: str, buckets: int) -> DataFrame:
    sums = counts.groupBy(key, (T.stable_hash(F.col("term")) % buckets).alias("bucket")).agg(F.sum(F.col("times") / F.sqrt(F.length("term"))).alias("sum"))
    norm = F.sqrt(F.sum(F.col("sum") * F.col("sum")).over(Window.partitionBy(key)))
    return sums.select(key, "bucket", (F.col("sum") / norm).alias("weight"))


def sparse_embedding(df: DataFrame, key: str, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """``key, bucket, weight``: each token adds 1 / sqrt(its length) to its hash's bucket; vectors have length 1."""
    return _bucket_weights(term_counts(df, key, text), key, buckets)


def fusion_score(*ranks: Column) -> Column:
    """Reciprocal rank fusion, scaled and bounded."""
    return T.clamp(sum((F.lit(1.0) / (RANK_OFFSET + r) for r in ranks), F.lit(0.0)) * RANK_SCALE)


def hybrid_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, boost: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``query_id, chunk_id, rank, lexical, semantic, fusion, score``: the best k chunks of each query.

    ``queries``: query_id, text. ``chunks``: chunk_id, idx (dense from 0, their order), text, and what ``boost`` uses. Every chunk
    is ranked, though only pairs that share a token or a bucket are made: a chunk that shares nothing scores 0 and a half, ranks
    behind those that do and among its like by idx, so its ranks follow from counts, and only the first k of them can matter.
    """
    q, c = term_counts(queries, "query_id", F.col("text")), term_counts(chunks, "idx", F.col("text"))
    n_terms = q.select("query_id", "term", F.sum("times").over(Window.partitionBy("query_id")).alias("n"))
    m_terms = c.select("idx", "term", F.count("*").over(Window.partitionBy("idx")).alias("m"))
    shared = n_terms.join(m_terms, "term").groupBy("query_id", "idx").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    lexical = shared.select("query_id", "idx", (F.col("shared") / F.sqrt(F.col("n").cast("double") * F.col("m"))).alias("lexical"))
    qv, cv = _bucket_weights(q, "query_id", buckets).withColumnRenamed("weight", "qw"), _bucket_weights(c, "idx", buckets).withColumnRenamed("weight", "cw")
    dots = qv.join(cv, "bucket").groupBy("query_id", "idx").agg(F.sum(F.col("qw") * F.col("cw")).alias("dot"))
    # a shared token is a shared bucket; a query that meets nothing keeps one row without idx
    met = queries.select("query_id").join(dots.join(lexical, ["query_id", "idx"], "left"), "query_id", "left")
    met = met.select("query_id", "idx", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), T.clamp((F.coalesce("dot", F.lit(0.0)) + 1) / 2).alias("semantic"))
    # ties are told apart at nine places: the order of summation does not matter
    by_idx = Window.partitionBy("query_id").orderBy("idx")
    upto, whole = by_idx.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("query_id")
    positive = (F.col("lexical") > 0).cast("long")
    met = met.withColumns({
        "place": F.row_number().over(by_idx), "positive_before": F.coalesce(F.sum(positive).over(upto), F.lit(0)),
        "lexical_place": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("lexical", 9)), "idx")), "semantic_rank": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("semantic", 9)), "idx")),
    })
    # the j-th chunk that shares nothing stands behind all met chunks with j or fewer such chunks before them
    free_before = F.col("idx") - (F.col("place") - 1)
    counts = {f"{n}{j}": F.coalesce(F.sum(((free_before <= j) & test).cast("long")).over(whole), F.lit(0)) for j in range(k) for n, test in (("c", F.lit(True)), ("p", F.col("lexical") > 0))}
    met = met.withColumns({"positive": F.sum(positive).over(whole), "met": F.count("idx").over(whole), **counts})
    lexical_rank = F.when(F.col("lexical") > 0, F.col("lexical_place")).otherwise(F.col("positive") + F.col("idx") + 1 - F.col("positive_before"))
    row = lambda idx, lex, sem, lr, sr: F.struct(idx.cast("long").alias("idx"), lex.alias("lexical"), sem.alias("semantic"), lr.cast("long").alias("lexical_rank"), sr.cast("long").alias("semantic_rank"))
    own = row(F.col("idx"), F.col("lexical"), F.col("semantic"), lexical_rank, F.col("semantic_rank"))
    free = [row(F.lit(j) + F.col(f"c{j}"), F.lit(0.0), F.lit(0.5), F.col("positive") + j + F.col(f"c{j}") + 1 - F.col(f"p{j}"), F.col("met") + j + 1) for j in range(k)]
    both = met.select("query_id", F.inline(F.when(F.col("place") == 1, F.array(own, *free)).otherwise(F.array(own)))).where("idx is not null")
    both = both.withColumn("fusion", fusion_score(F.col("lexical_rank"), F.col("semantic_rank")))
    if boost is not None:
        both = _with_boosts(met, both, chunks.withColumn("boost", boost).select("idx", "boost"), k)
    score = LEXICAL * F.col("lexical") + SEMANTIC * F.col("semantic") + FUSION * F.col("fusion") + (F.col("boost") if boost is not None else 0.0)
    both = both.withColumn("score", T.clamp(score))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "idx"))
    top = both.withColumn("rank", best).where(F.col("rank") <= k)
    return top.join(chunks.select("idx", "chunk_id"), "idx").select("query_id", "chunk_id", "rank", "lexical", "semantic", "fusion", "score")


def _with_boosts(met: DataFrame, both: DataFrame, boosts: DataFrame, k: int) -> DataFrame:
    """The met chunks with their boosts, and those unmet ones that a boost may lift among the best k of a query.

    Unmet chunks of equal boost rank by idx, so of each boost the first k unmet ones can matter; they are among the first k plus
    as many as the query met of that boost. Few boosts make few such rows; where each chunk has its own, all pairs are made.
    """
    level = boosts.withColumn("level_place", F.row_number().over(Window.partitionBy("boost").orderBy("idx")))
    pairs = met.where("idx is not null").select("query_id", "idx")
    in_level = pairs.join(boosts, "idx").groupBy("query_id", "boost").agg(F.count("*").alias("met_here"))
    wanted = met.select("query_id").distinct().crossJoin(boosts.select("boost").distinct())
    wanted = wanted.join(in_level, ["query_id", "boost"], "left")
    near = wanted.join(level.withColumnRenamed("boost", "_boost"), F.col("boost").eqNullSafe(F.col("_boost")) & (F.col("level_place") <= k + F.coalesce("met_here", F.lit(0))))
    near = near.select("query_id", F.col("idx").cast("long").alias("idx")).join(pairs, ["query_id", "idx"], "left_anti")
    # an unmet chunk's ranks follow from the met ones before it
    marked = met.where("idx is not null").select("query_id", F.col("idx").cast("long").alias("idx"), F.lit(1).alias("is_met"), (F.col("lexical") > 0).cast("int").alias("is_positive"))
    marked = marked.unionByName(near.withColumns({"is_met": F.lit(0), "is_positive": F.lit(0)}))
    whole = Window.partitionBy("query_id")
    upto = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{n}_{w}": F.sum(f"is_{n}").over(o) for n in ("met", "positive") for w, o in (("before", upto), ("all", whole))}
    unmet = marked.withColumns(sums).where("is_met = 0").select(
        "query_id", "idx", F.lit(0.0).alias("lexical"), F.lit(0.5).alias("semantic"), (F.col("positive_all") + F.col("idx") + 1 - F.col("positive_before")).alias("lexical_rank"), (F.col("met_all") + F.col("idx") - F.col("met_before") + 1).alias("semantic_rank"),
    )
    unmet = unmet.withColumn("fusion", fusion_score(F.col("lexical_rank"), F.col("semantic_rank")))
    return both.join(pairs, ["query_id", "idx"], "left_semi").unionByName(unmet).join(boosts, "idx")


def dense_index(chunks: DataFrame, *order: str) -> DataFrame:
    """``idx`` from 0 without gaps in the given order: range partitions, their sizes' prefix sums, places inside.

    The ranged table is checkpointed: both its sizes and its rows have to be of the same ranges.
    """
    ranged = cut(chunks.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    ranged = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_part").count()
    bases = sizes.withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    return ranged.join(F.broadcast(bases), "_part").withColumn("idx", F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


# boosts; fixed values

KIND_BOOSTS = {"schema": 0.05, "orchestration": 0.07, "terminology": 0.07, "locale": 0.07, "official-docs": 0.06, "best-practice": 0.08, "geo-research": 0.08, "eeat": 0.04, "cep": 0.04}
BOOSTED_TEXT = "ocr|sentence diagnostics|sentence intent|classified sentence|citation|cite|quotable|answer-ready|faqpage|mainentity|review|customer|webpage\\.description|product\\.description|claim support|evidence hierarchy|public wording"
QUERY_KINDS = {"geo-research": "geo|generative|answer-ready|retrieval|query planning", "cep": "cep|customer|entry point|routine|review|faq", "eeat": "e-e-a-t|eeat|trust|evidence|claim|safety"}


def retrieval_boost(kind: Column, text: Column, priority: Column, locale: Column, market: Column) -> Column:
    kinds = F.when(F.lit(False), 0.0)
    for k, v in KIND_BOOSTS.items():
        kinds = kinds.when(kind == k, v)
    plus = lambda test, v: F.when(F.coalesce(test, F.lit(False)), v).otherwise(0.0)
    return F.coalesce(priority, F.lit(0.0)) * 0.08 + kinds.otherwise(0.0) + plus(T.matches(text, BOOSTED_TEXT), 0.04) + plus(F.contains(text, locale), 0.05) + plus((market != "") & F.contains(text, market), 0.03)


def rerank_boost(query: Column, kind: Column, intents: Column, targets: Column, product_terms: Column, context: Column) -> Column:
    """Named targets, intents and kinds of the query, and its product's terms in the chunk."""
    q = F.lower(query)
    plus = lambda test, v: F.when(test, v).otherwise(0.0)
    total = plus(F.exists(targets, lambda t: F.contains(q, F.lower(t))), 0.05) + plus(F.exists(intents, lambda t: F.contains(q, F.lower(t))), 0.03)
    for k, pattern in QUERY_KINDS.items():
        total = total + plus((kind == k) & T.matches(query, pattern), 0.04)
    return total + F.least(F.lit(0.05), lexical_similarity(product_terms, T.tokens(F.lower(context))) * 0.12)


def subquery_boost(score: Column, targets: Column, intents: Column, wanted_targets: Column, wanted_intents: Column) -> Column:
    return F.least(F.lit(1.0), score + F.when(F.arrays_overlap(targets, wanted_targets), 0.08).otherwise(0.0) + F.when(F.arrays_overlap(intents, wanted_intents), 0.04).otherwise(0.0))


def evidence_score(query_terms: Column, title: Column, text: Column, keywords: Column, boost: Column, dated: Column) -> Column:
    """Share of the query's terms in the chunk, plus source, date and name boosts, at most 1."""
    chunk = T.terms(F.concat_ws(" ", F.coalesce(title, F.lit("")), text, F.array_join(keywords, " ")))
    overlap = F.size(F.filter(query_terms, lambda t: F.array_contains(chunk, t)))
    exact = F.exists(query_terms, lambda t: (F.length(t) > 5) & F.contains(F.lower(text), t))
    return F.least(F.lit(1.0), overlap / F.greatest(F.size(query_terms), F.lit(1)) + boost + F.when(dated, 0.06).otherwise(0.0) + F.when(exact, 0.05).otherwise(0.0))


def merge_best(df: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """One row per key: the best score, the earliest of equal ones."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, key: list[str], score: str, order: str, k: int, threshold: float | None = None) -> DataFrame:
    """The best k rows of each key at or above a threshold, with their rank."""
    rows = df if threshold is None else df.where(F.col(score) >= threshold)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), order))).where(F.col("rank") <= k)
