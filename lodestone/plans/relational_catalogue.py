"""Registered queries of relational operators over whole driver tables, each with SQL from its definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import signals as S
from lodestone.functions import text as T
from lodestone.operators import aggregates, chunking, citation, dedupe, extraction, linking, policy, retrieval, selection
from lodestone.plans.catalogue import clean, finger, query, read, sparse, stable, terms, tokens
from lodestone.plans.fixtures import expected, literal


def listed(values) -> str:
    return "[" + ", ".join(map(literal, values)) + "]"


# retrieval

SHARED = "len(list_distinct(list_intersect(a.t, b.t)))"


@query(
    f"""with p as (select item_id, {tokens('text')} as t, list_distinct({terms('text')}) as d, {terms('text')} as r from benchmark)
    select a.item_id as a, b.item_id as b, round(case when len(a.t) = 0 or len(b.t) = 0 then 0 else {SHARED} / sqrt(len(a.t) * len(list_distinct(b.t))) end, 6)::double as lexical,
    round(case when len(a.d) = 0 or len(b.d) = 0 then 0 else len(list_intersect(a.d, b.d)) / sqrt(len(a.d) * len(b.d)) end, 6)::double as overlap, round(len(list_filter(a.r, lambda w: list_contains(b.r, w))) / len(a.r), 6)::double as share
    from p a join p b on a.item_id < b.item_id"""
)
def passage_similarities(spark, sf_dir):
    """Lexical similarity, overlap and share of terms of all pairs of passages."""
    t = F.col("text")
    p = read(spark, sf_dir, "benchmark").select("item_id", T.tokens(t).alias("t"), F.array_distinct(T.terms(t)).alias("d"), T.terms(t).alias("r"))
    a, b = p.toDF("a", "ta", "da", "ra"), p.toDF("b", "tb", "db", "rb")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    made = {"lexical": retrieval.lexical_similarity(F.col("ta"), F.col("tb")), "overlap": retrieval.overlap_ratio(F.col("da"), F.col("db")), "share": retrieval.token_overlap_ratio(F.col("ra"), F.col("rb"))}
    return pairs.select("a", "b", *[F.round(v, 6).cast("double").alias(k) for k, v in made.items()])


@query(f"select item_id, bucket, round(weight, 6) as weight from ({sparse('item_id', 'benchmark').replace('% 384', '% 96')})")
def sparse_embedding_96(spark, sf_dir):
    """Hashed vectors of 96 buckets."""
    made = retrieval.sparse_embedding(read(spark, sf_dir, "benchmark"), "item_id", F.col("text"), extraction.EXTRACTION_BUCKETS)
    return made.select("item_id", "bucket", F.round("weight", 6).alias("weight"))


@query("select l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rank from lineitem where l_extendedprice >= 5000) where rank <= 3")
def threshold_topk(spark, sf_dir):
    """The three dearest lines of each order at or above a threshold."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return retrieval.top_k(rows, ["l_orderkey"], "l_extendedprice", "l_linenumber", 3, 5000.0).select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


BOOSTED = "least(1, score + b)"


@query(
    f"""with r as (select l_orderkey, l_linenumber, l_discount * 9 as score, l_tax as b from lineitem)
    select l_orderkey, l_linenumber, round({BOOSTED}, 6)::double as score, (floor(score * 10000 + 0.5) / 10000)::double as base_score, (floor(b * 10000 + 0.5) / 10000)::double as rerank_boost, row_number() over (partition by l_orderkey order by {BOOSTED} desc, l_linenumber) as place from r"""
)
def reranked(spark, sf_dir):
    """Rows scored again with a boost."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 9).alias("score"), "l_tax")
    made = extraction.rerank(rows, F.col("l_tax"), "l_orderkey", "score", "l_linenumber")
    return made.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "base_score", "rerank_boost", F.col("place").cast("long").alias("place"))


@query(
    f"""select item_id, round(least(1, len(list_filter(q, lambda w: list_contains(c, w))) / greatest(len(q), 1) + 0.16 + case when item_id % 2 = 0 then 0.06 else 0 end + case when len(list_filter(q, lambda w: length(w) > 5 and contains(lower(text), w))) > 0 then 0.05 else 0 end), 6)::double as score,
    round(least(1, 0.9 * (item_id % 10) / 10 + case when item_id % 3 = 0 then 0.08 else 0 end + case when item_id % 2 = 0 then 0.04 else 0 end), 6)::double as wanted
    from (select item_id, text, {terms("'note ' || text || ' alpha beta'")} as c, list_concat(list_slice({terms('text')}, 1, 3), ['absent', 'beta']) as q from benchmark)"""
)
def chunk_scores(spark, sf_dir):
    """Citation score of a passage for a query of its first terms, and what a subquery adds."""
    t = F.col("text")
    q = F.concat(F.slice(T.terms(t), 1, 3), F.array(F.lit("absent"), F.lit("beta")))
    score = retrieval.evidence_score(q, F.lit("note"), t, F.array(F.lit("alpha"), F.lit("beta")), S.source_boost(F.lit("paper")), F.col("item_id") % 2 == 0)
    none = lambda test, v: F.when(test, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    base = 0.9 * (F.col("item_id") % 10) / 10
    wanted = retrieval.subquery_boost(base, none(F.col("item_id") % 3 == 0, "faq"), none(F.col("item_id") % 2 == 0, "review"), F.array(F.lit("faq")), F.array(F.lit("review")))
    return read(spark, sf_dir, "benchmark").select("item_id", F.round(score, 6).cast("double").alias("score"), F.round(wanted, 6).cast("double").alias("wanted"))


INDEX = (("src0", 0.9), ("src1", 0.5), ("src2", 0.7))


@query(
    f"""with i(source, priority) as (values {', '.join(f"('{a}', {b}::double)" for a, b in INDEX)}), s(source, ord, key, heading, priority) as (values ('src0', 1, 'part one', 'Part One', 0.4::double), ('src0', 2, 'part', 'Part', 0.3::double), ('src1', 1, 'whole part two', 'Whole, part TWO', 0.2::double)),
    d as (select doc_id, source, case doc_id % 3 when 0 then 'Part one' when 1 then 'part TWO!' else null end as title, case doc_id % 3 when 0 then 'part one' when 1 then 'part two' end as k from documents)
    select doc_id, i.priority, (select arg_min(heading, ord) from s where s.source = d.source and (contains(d.k, s.key) or contains(s.key, d.k))) as section from d left join i using (source)"""
)
def index_joins(spark, sf_dir):
    """Documents with their index entry and the first section whose heading fits their title."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "Part one").when(F.col("doc_id") % 3 == 1, "part TWO!").alias("title"))
    index = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(INDEX)] + [(9, "src0", 0.1)], "ord int, document string, priority double")
    sections = spark.createDataFrame([("src0", 1, "Part One", 0.4), ("src0", 2, "Part", 0.3), ("src1", 1, "Whole, part TWO", 0.2)], "document string, ord int, heading string, priority double")
    made = extraction.section_entries(extraction.index_entries(d, index), sections)
    return made.select("doc_id", "priority", "section")


# selection and batches


@query(
    """with r as (select doc_id, source, case when doc_id % 7 = 0 then 'critical' else 'guidance' end as severity, (doc_id % 5)::int as kind_weight, (doc_id % 9) / 10.0 as priority from documents),
    f as (select *, row_number() over (partition by source order by case severity when 'critical' then 0 else 1 end, kind_weight desc, priority desc, doc_id) as rn from r), t as (select *, case when rn = 1 then 0 when severity = 'critical' then 1 else 2 end as tier from f)
    select doc_id, tier from t order by tier, kind_weight desc, priority desc, source, doc_id limit 60"""
)
def injected_rules(spark, sf_dir):
    """Sixty rules: one of each source, then critical ones, then the rest."""
    d = read(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("document"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "critical").otherwise("guidance").alias("severity"), (F.col("doc_id") % 5).cast("int").alias("kind_weight"), ((F.col("doc_id") % 9) / 10.0).alias("priority"))
    return selection.rules_for_injection(rows, 60).select(F.col("id").alias("doc_id"), "tier")


@query(
    """with m as (select source as document, doc_id % 7 = 0 as critical, doc_id % 2 = 0 as inside, doc_id % 11 = 0 as told from documents)
    select document, count(*) as total_rules, count(*) filter (where inside) as injected_rules, count(*) filter (where critical) as critical_rules, count(*) filter (where critical and inside) as injected_critical_rules, count(*) filter (where told) as narrative_rules,
    case when count(*) filter (where critical) = 0 then 1.0 else round(count(*) filter (where critical and inside) / count(*) filter (where critical), 6) end::double as critical_ratio from m group by rollup (document)"""
)
def rule_coverage(spark, sf_dir):
    """Rules by document and in total, and the share of critical ones that are injected."""
    d = read(spark, sf_dir, "documents")
    rules = d.select(F.col("source").alias("document"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "critical").otherwise("guidance").alias("severity"), F.when(F.col("doc_id") % 11 == 0, "narrative").otherwise("rules").alias("extraction"))
    return policy.coverage(rules, d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))).withColumn("critical_ratio", F.round("critical_ratio", 6).cast("double"))


@query(
    """with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as i, lag(event_type) over (partition by user_id order by event_id) as before from events),
    r as (select *, sum(case when before is null or before <> event_type then 1 else 0 end) over (partition by user_id order by event_id) as run from e),
    p as (select *, (row_number() over (partition by user_id, run order by event_id) - 1) // case event_type when 'click' then 2 when 'view' then 3 else 1 end as part from r)
    select user_id, event_id, dense_rank() over (partition by user_id order by run, part) - 1 as batch from p"""
)
def run_batches(spark, sf_dir):
    """Runs of one event type in batches of the type's size."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return chunking.kind_batches(e, "user_id", "event_id", "event_type", {"click": 2, "view": 3}).select("user_id", "event_id", F.col("batch").cast("long").alias("batch"))


@query(
    """with b as (select p_partkey, p_brand, p_size, row_number() over (partition by p_brand, p_size % 5 order by p_retailprice desc, p_partkey) as best from part),
    t as (select p.*, p.p_size % 5 as fam, p.p_retailprice as pr, b.best, case when p.p_size % 5 < 3 and b.best = 1 then p.p_size % 5 when b.best = 1 then 3 else 4 end as tier from part p join b using (p_partkey))
    select p_partkey, place from (select p_partkey, row_number() over (partition by p_brand order by tier, pr desc, p_partkey) as place from t) where place <= 8"""
)
def documents_in_budget(spark, sf_dir):
    """Eight parts of each brand: the best of three sizes first, then of the others, then the rest by price."""
    names = F.array(*map(F.lit, (*extraction.SPINE, "x", "y")))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.element_at(names, F.col("p_size") % 5 + 1).alias("family"))
    return extraction.select_documents(rows, "p_brand", "p_partkey", "p_retailprice", "family", 8).select("p_partkey", F.col("place").cast("long").alias("place"))


@query("select user_id, event_type, event_id, rank from (select *, row_number() over (partition by user_id, event_type order by event_id) as rank from events) where rank <= 3")
def first_of_categories(spark, sf_dir):
    """The first three events of each type of a user."""
    return selection.bucket_first(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id", 3).select("user_id", "event_type", "event_id", F.col("rank").cast("long").alias("rank"))


# joins


@query("with m as (select doc_id, source, doc_id % 97 = 0 as hit, bool_or(doc_id % 97 = 0) over (partition by source) as any_hit from documents) select doc_id, source from m where hit or not any_hit")
def match_or_all(spark, sf_dir):
    """Documents that match; all of a source where none does."""
    return linking.semi_or_all(read(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id") % 97 == 0, "source").select("doc_id", "source")


@query("select source, min(doc_id) as doc_id, arg_max(n_chars, doc_id) as n_chars from documents group by source")
def merged_documents(spark, sf_dir):
    """The last size of each source at its first place."""
    return linking.merge_documents(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars").select("source", "doc_id", "n_chars")


@query(
    """with s as (select conv_id, turn as rank, 'src' || (turn % 5) as source, role as title from conversations), j as (select s.*, 'body ' || s.source as content from s where source <> 'src4'),
    g as (select conv_id, source, min(rank) as first, string_agg(title, ',' order by rank, title) as titles, any_value(content) as content from j group by all)
    select conv_id, source, titles, content, place from (select *, row_number() over (partition by conv_id order by first, source) as place from g) where place <= 3"""
)
def hydrated(spark, sf_dir):
    """The first three documents of each conversation's turns, with what named them."""
    c = read(spark, sf_dir, "conversations")
    chosen = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("src"), (F.col("turn") % 5).cast("string")).alias("source"), F.col("role").alias("title"))
    docs = spark.createDataFrame([(f"src{i}", f"body src{i}") for i in range(4)], "name string, content string")
    return linking.hydrate(chosen, docs).select(F.col("query_id").alias("conv_id"), "source", F.array_join("titles", ",").alias("titles"), "content", F.col("place").cast("long").alias("place"))


@query(
    """with k as (select 'c' || doc_id as chunk_id, doc_id as ord, source, lang as title from documents), keys as (select chunk_id, ord, unnest(list_distinct([chunk_id, source, title])) as key from k), d as (select item_id, ['src1', 'c7', 'de', 'none'][item_id % 4 + 1] as source from benchmark)
    select item_id, d.source, arg_min(chunk_id, ord) as chunk_id from d left join keys on keys.key = d.source group by item_id, d.source"""
)
def used_chunks(spark, sf_dir):
    """The first chunk that a decision's source names by id, document or title."""
    chunks = read(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("ord"), "source", F.col("lang").alias("title"))
    names = F.array(*map(F.lit, ("src1", "c7", "de", "none")))
    decisions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("decision_id"), F.lit(0).alias("pos"), F.element_at(names, (F.col("item_id") % 4 + 1).cast("int")).alias("source"))
    return linking.usage_diagnostics(decisions, chunks).select(F.col("decision_id").alias("item_id"), "source", "chunk_id")


@query(
    f"""with c as (select distinct item_id, unnest({terms('text')}) as w from benchmark), e as (select distinct doc_id, unnest({terms('text')}) as w from documents),
    p as (select item_id, doc_id, row_number() over (partition by item_id order by count(*) desc, doc_id) as rn from c join e using (w) group by item_id, doc_id), n as (select item_id, count(*) filter (where rn <= 3) as refs from p group by 1)
    select b.item_id as claim_id, coalesce(refs, 0) as refs, case when coalesce(refs, 0) >= 2 then 'high' when refs = 1 then 'medium' else 'low' end as confidence from benchmark b left join n using (item_id)"""
)
def claim_confidences(spark, sf_dir):
    """How many documents carry each passage, in three steps."""
    claims = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    links = linking.claim_links(claims, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text"))
    return linking.claim_confidence(claims, links).select("claim_id", F.col("refs").cast("long").alias("refs"), "confidence")


# aggregates


@query("select user_id, array_to_string(list_slice(list_transform(list_sort(list(x)), lambda r: r.t), 1, 3), ',') as types from (select user_id, {'o': min(event_id), 't': event_type} as x from events group by user_id, event_type) group by user_id")
def types_in_order(spark, sf_dir):
    """The first three distinct event types of a user, by first occurrence."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array_join(aggregates.ordered_unique(F.col("event_id"), F.col("event_type"), 3), ",").alias("types"))


@query(
    """with t as (select l_orderkey, case when l_linenumber % 3 = 0 then 'dropped' else 'used' end as status, l_returnflag as category, case when l_linenumber % 3 = 0 then l_linestatus end as reason from lineitem)
    select l_orderkey, count(*) as targets, count(*) filter (where status = 'used') as used, count(*) filter (where status = 'dropped') as dropped, round(count(*) filter (where status = 'used') / count(*), 6)::double as utilization,
    count(*) filter (where status = 'used' and category = 'N') as n_used, count(*) filter (where reason = 'O') as o_dropped from t group by 1"""
)
def target_summary(spark, sf_dir):
    """Counters of targets by status, category and reason."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, "dropped").otherwise("used").alias("status"), F.col("l_returnflag").alias("category"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linestatus")).alias("drop_reason"))
    made = aggregates.ocr_summary(rows, "l_orderkey")
    count = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0).cast("long"))
    return made.select("l_orderkey", "targets", "used", "dropped", F.round("utilization", 6).alias("utilization"), count("by_category", "N").alias("n_used"), count("reasons", "O").alias("o_dropped"))


@query(
    """with s as (select user_id, event_id as ord, case when event_id % 3 = 0 then value end as rating, event_type as k, row_number() over (partition by user_id order by event_id) as i from events), f as (select user_id, k, min(i) as i from s group by all)
    select s.user_id, round(arg_min(rating, ord) filter (where rating is not null), 6) as rating, (select string_agg(k, ',' order by i) from (select * from f where f.user_id = s.user_id order by i limit 28)) as keywords from s group by s.user_id"""
)
def merged_reviews(spark, sf_dir):
    """First rating that is there, and keywords without repeats."""
    e = read(spark, sf_dir, "events")
    rows = e.select("user_id", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("rating"), F.lit(None).cast("long").alias("review_count"), F.array().cast("array<string>").alias("items"), F.array("event_type").alias("keywords"))
    return aggregates.merge_reviews(rows, "user_id").select("user_id", F.round("rating", 6).alias("rating"), F.array_join("keywords", ",").alias("keywords"))


@query(
    """with f as (select user_id, event_type as v, min(event_id) as o from events group by all) select user_id, string_agg(v, ',' order by o) filter (where rn <= 2) as kinds from (select *, row_number() over (partition by user_id order by o) as rn from f) group by user_id"""
)
def merged_facts(spark, sf_dir):
    """The first two distinct members of facts, in order."""
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.array("event_type").alias("kinds"))
    return aggregates.merge_facts(rows, "user_id", ("kinds",), 2).select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("select event_type as prompt_set, round(avg((event_id % 2 = 0)::int), 6)::double as mention_rate, round(avg((event_id % 5 = 0)::int), 6)::double as citation_rate, round(sum(event_id % 4) / sum(event_id % 4 + event_id % 7), 6)::double as share_of_voice from events group by event_type")
def answer_visibility(spark, sf_dir):
    """Mention rate, citation rate and share of voice by prompt set."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    made = citation.visibility(e.select(F.col("event_type").alias("prompt_set"), (i % 2 == 0).alias("mentioned"), (i % 5 == 0).alias("cited"), (i % 4).alias("ours"), (i % 7).alias("competitors")))
    return made.select("prompt_set", *[F.round(c, 6).cast("double").alias(c) for c in ("mention_rate", "citation_rate", "share_of_voice")])


@query(
    rf"""with s as (select doc_id, source, unnest(string_split_regex({clean('text')}, '\x01')) as x from (select doc_id, source, regexp_replace(text, '([.!?。！？])[\t-\r \x{{00A0}}]+', '\1' || chr(1), 'g') as text from documents)),
    p as (select doc_id, source, i, {clean('x')} as x from (select doc_id, source, unnest(l) as x, generate_subscripts(l, 1) as i from (select doc_id, source, string_split(regexp_replace(text, '([.!?。！？])[\t-\r ]+', '\1' || chr(1), 'g'), chr(1)) as l from documents))),
    q as (select doc_id, source, arg_min(x, i) as quote from p where length(x) between 30 and 140 group by all)
    select source, doc_id::varchar as evidence_id, quote, place from (select *, row_number() over (partition by source order by case doc_id % 3 when 0 then 0 when 1 then 1 else 3 end, doc_id::varchar) as place from q) where place <= 2"""
)
def quotable(spark, sf_dir):
    """Two quotes of each source, reviews before papers before the rest."""
    kind = F.when(F.col("doc_id") % 3 == 0, "review").when(F.col("doc_id") % 3 == 1, "paper").otherwise("custom")
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("evidence_id"), kind.alias("source_type"), "text")
    return citation.quotes(rows).select(F.col("doc_id").alias("source"), "evidence_id", "quote", F.col("place").cast("long").alias("place"))


@query(
    f"""select item_id, round(case when len(k) = 0 then 1 else floor(len(list_filter(k, lambda w: contains(f, w))) / len(k) * 100 + 0.5) / 100 end, 6)::double as ratio, len(list_filter(k, lambda w: not contains(f, w))) as missing
    from (select item_id, {finger('text').replace(', 1, 260)', ', 1, 1048576)')} as f, list_distinct(list_concat(list_slice({terms('text')}, 1, 3), ['nowhere', 'at all'])) as k from benchmark)"""
)
def required_keywords(spark, sf_dir):
    """Share of required keywords that a passage has."""
    t = F.col("text")
    required = F.array_distinct(F.concat(F.slice(T.terms(t), 1, 3), F.array(F.lit("nowhere"), F.lit("at all"))))
    made = read(spark, sf_dir, "benchmark").select("item_id", citation.keyword_coverage(required, t).alias("c"))
    return made.select("item_id", F.round("c.ratio", 6).cast("double").alias("ratio"), F.size("c.missing").cast("long").alias("missing"))


# names

DOCUMENTS = ("rag-map.md", "schema-org.md", "eeat-notes.txt", "cep.md", "best-practice.md", "geo-research-2.md", "official-docs.md", "terminology.md", "locale-ko.md", "product-normalization.md", "analysis-prompt.md", "ocr-keywords.md", "review-rules.md", "faq.md", "notes.md")
GENERATOR = ("orchestration", "schema", "eeat", "cep", "best-practice", "geo-research", "official-docs", "terminology", "locale", "custom", "orchestration", "custom", "custom", "custom", "custom")
EXTRACTOR = ("orchestration", "custom", "custom", "custom", "custom", "custom", "custom", "custom", "custom", "product-normalization", "analysis-prompt", "ocr-classification", "review-extraction", "faq-extraction", "custom")


@query(expected("name, kind, extraction", list(zip(DOCUMENTS, GENERATOR, EXTRACTOR, strict=True))))
def document_kinds(spark, sf_dir):
    """Kinds of policy documents by name, for generation and for extraction."""
    n = F.col("name")
    return spark.createDataFrame([(d,) for d in DOCUMENTS], "name string").select("name", S.document_kind(n).alias("kind"), extraction.extraction_kind(n).alias("extraction"))


SOURCES = (("product", "product", 0.07), ("research-paper", "paper", 0.16), ("newsArticle", "news", 0.12), ("pdp-geo", "existing-geo", 0.09), ("my-geo", "custom", 0.04), ("geo", "existing-geo", 0.09), ("review", "review", 0.1), ("", "custom", 0.04))


@query(expected("name, type, boost", SOURCES))
def source_types(spark, sf_dir):
    """The type that a source's name stands for, and its boost."""
    made = spark.createDataFrame([(x[0],) for x in SOURCES], "name string").withColumn("type", S.source_type(F.col("name")))
    return made.withColumn("boost", S.source_boost(F.col("type")))


@query("select p_partkey, ['product', 'paper', 'news', 'review'][p_size % 4 + 1] as focus_first, case when p_size % 2 = 0 then 'recent' when p_size % 3 = 0 then 'dated' else 'unknown' end as freshness from part")
def evidence_freshness(spark, sf_dir):
    """The first type that an angle prefers, and how fresh evidence is."""
    size = F.col("p_size")
    there = F.element_at(F.array(*map(F.lit, ("product", "paper", "news", "review"))), size % 4 + 1)
    focus = F.get(S.evidence_focus(F.lit("claim-check"), F.array(there)), 0)
    fresh = S.freshness(F.when(size % 3 == 0, "2020-01-01").otherwise("not a date"), F.when(size % 2 == 0, "2026-01-01"), "2026-06-01")
    return read(spark, sf_dir, "part").select("p_partkey", focus.alias("focus_first"), fresh.alias("freshness"))


@query(
    """select c_custkey, case when k = 0 then 40 when k = 1 then 20 else 0 end + 5 * (k = 0)::int + 5 * (k < 2)::int + 4 * (k = 2)::int as preference, array_to_string(case k when 0 then ['ingredient-benefit-overview'] when 1 then ['benefit-overview'] else ['suitability-overview'] end, ',') as keys
    from (select c_custkey, c_nationkey % 3 as k from customer)"""
)
def faq_preferences(spark, sf_dir):
    """Intents and preference of questions."""
    texts = ("Which ingredient has a benefit here?", "What are the benefits?", "Who is it for?"), ("It has a formula", "An effect", "Used by 20 participants")
    pick = lambda t: F.element_at(F.array(*map(F.lit, t)), F.col("c_nationkey") % 3 + 1)
    return read(spark, sf_dir, "customer").select("c_custkey", E.faq_preference(pick(texts[0]), pick(texts[1])).alias("preference"), F.array_join(E.faq_keys(pick(texts[0])), ",").alias("keys"))


@query(f"select item_id, {stable('text')} as hash, {clean('text')} = text as tidy from benchmark")
def passage_hashes(spark, sf_dir):
    """Hash of each passage, and whether its white space is collapsed."""
    t = F.col("text")
    return read(spark, sf_dir, "benchmark").select("item_id", T.stable_hash(t).alias("hash"), (T.clean_text(t) == t).alias("tidy"))


CLAIMS = ((1, 1, "hydration", "", "20", "", "", ""), (1, 2, "Hydration!", None, "20", None, "", ""), (1, 3, "firmness", "", "20", "", "", ""), (2, 1, "hydration", "", "20", "", "", ""), (2, 2, "", "", "", "", "", None))


@query(expected("product_id, ord", [(1, 1), (1, 3), (2, 1)]))
def metric_claims(spark, sf_dir):
    """Metric claims without repeats and empty ones."""
    rows = spark.createDataFrame(CLAIMS, "product_id long, ord long, label string, subject string, value string, metric string, sentence string, source_text string")
    return extraction.unique_metric_claims(rows, "product_id", "ord").select("product_id", "ord")


CANDIDATES = (("p", "Ginseng helps skin"), ("p", "ginseng HELPS skin."), ("p", "soft"), ("p", "firm"), ("q", "Ginseng helps skin"))


@query(expected("product, value", [("p", "soft"), ("p", "firm"), ("q", "Ginseng helps skin")]))
def underived_candidates(spark, sf_dir):
    """Candidates that do not just repeat a link, unless a direct signal says the same."""
    kinds = "product string, value string"
    links, direct = spark.createDataFrame([("p", "Ginseng helps skin"), ("p", "Firm")], kinds), spark.createDataFrame([("p", "FIRM!")], kinds)
    return extraction.underived(spark.createDataFrame(CANDIDATES, kinds), links, direct, "product")


BRANDED = ((1, None, "Moss & Fern", "Serum", "moss"), (2, "MOSS", "Other", "x", "moss"), (3, None, "Dune", "이끼 크림", "moss"), (4, None, "Dune", "Tide balm", "tide"), (5, None, None, "Plain", None))


@query(expected("id, slug", [(x[0], x[4]) for x in BRANDED]))
def brand_scopes(spark, sf_dir):
    """The profile brand that a product speaks of."""
    brands = spark.createDataFrame([(1, "moss", "moss|이끼"), (2, "tide", "tide")], "ord int, slug string, pattern string")
    return extraction.brand_scope(spark.createDataFrame([x[:4] for x in BRANDED], "id long, hint string, brand string, name string"), brands).select("id", "slug")


KEYED = {
    "keyword": (lambda c, t: dedupe.keyword_key(c, t), "role || ':' || lower(text)"),
    "faq": (lambda c, t: dedupe.faq_key(c, t), finger("role || ':' || text")),
    "section": (lambda c, t: dedupe.section_key(c, t), f"role || ':' || {finger('text')}"),
    "insight": (lambda c, t: dedupe.insight_key(c, t), f"role || ':' || substr({finger('text')}, 1, 160)"),
    "block": (lambda c, t: dedupe.block_key(c, t), finger("role || ':' || text")),
    "question": (lambda c, t: dedupe.question_key(c, t), "lower(role || chr(10) || text)"),
}


@query("select * from (" + " union all ".join(f"select conv_id, turn, '{k}' as kind from (select *, row_number() over (partition by {sql} order by conv_id, turn) as rn from conversations) where rn = 1" for k, (_, sql) in KEYED.items()) + ")")
def merged_by_keys(spark, sf_dir):
    """The turns that stay under each of the keys by which keywords, questions, sections, insights and blocks are merged."""
    c = read(spark, sf_dir, "conversations").where("text is not null and role is not null")
    parts = [dedupe.first_wins(c, key(F.col("role"), F.col("text")), "conv_id", "turn").select("conv_id", "turn", F.lit(k).alias("kind")) for k, (key, _) in KEYED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
