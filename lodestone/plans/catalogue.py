"""The registered queries of the engine's own operators, each with the SQL that must give the same rows.

Every query runs over whole tables. SQL is written from an operator's definition: brute force where the operator is clever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import signals as S
from lodestone.functions import text as T
from lodestone.functions import web as H
from lodestone.operators import aggregates, chunking, dedupe, gates, linking, retrieval, selection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the SQL's spelling of shared definitions
WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CLEAN = rf"trim(regexp_replace({{0}}, '{WS}+', ' ', 'g'))"


def clean(x: str) -> str:
    return CLEAN.replace("{0}", x)


def finger(x: str) -> str:
    return rf"substr(regexp_replace(lower({clean(x)}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), 1, 260)"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\t-\r \x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}-]+', ' ', 'g'), '{WS}+'), lambda w: length(w) >= 2)"


def terms(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)"


FNV = "list_reduce(list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: ord(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint)"


def stable(x: str) -> str:
    h = FNV.replace("{0}", x)
    return f"abs(case when {h} >= 2147483648 then {h} - 4294967296 else {h} end)"


def _rule(pattern: str) -> str:
    """A pattern in RE2, whose word borders are the ASCII ones that ours spell out."""
    return pattern.replace(T.BEGIN, r"\b").replace(T.END, r"\b").replace("(?<![A-Za-z])", r"\b").replace("(?![A-Za-z])", r"\b")


# text


@query(f"select doc_id, {clean('text')} as clean, {finger('text')} as fingerprint from documents")
def clean_text(spark, sf_dir):
    """Collapsed text and its fingerprint."""
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"), T.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, array_to_string(t, ' ') as tokens from (select doc_id, {tokens('text')} as t from documents)")
def token_terms(spark, sf_dir):
    """Retrieval terms with repeats."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


@query(
    f"""select doc_id, string_agg(w, ' ' order by first) as keywords from (
      select *, row_number() over (partition by doc_id order by first) as rn from (
        select doc_id, w, min(i) as first from (select doc_id, unnest(t) as w, generate_subscripts(t, 1) as i from (select doc_id, {terms('text')} as t from documents))
        where w not in ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was', 'were', '제품', '상품', '그리고', '입니다') group by all)) where rn <= 16 group by doc_id"""
)
def keyword_terms(spark, sf_dir):
    """The first sixteen distinct terms that are no stopwords."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))
    return d.where("keywords != ''")


@query(f"select w as token, n, {stable('w')} % 384 as bucket, {FNV.replace('{0}', 'w')} as hash from (select w, count(*) as n from (select unnest({tokens('text')}) as w from benchmark) group by w)")
def fnv_buckets(spark, sf_dir):
    """Hash and bucket of each token."""
    t = read(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", "n", (T.stable_hash(F.col("token")) % 384).alias("bucket"), T.fnv1a(F.col("token")).alias("hash"))


SPARSE = """select {key}, bucket, s / sqrt(sum(s * s) over (partition by {key})) as weight from (
  select {key}, {hash} % 384 as bucket, sum(1 / sqrt(length(w))) as s from (select {key}, unnest({tokens}) as w from {table}) group by all)"""


def sparse(key: str, table: str) -> str:
    return SPARSE.format(key=key, table=table, hash=stable("w"), tokens=tokens("text"))


@query(f"select item_id, bucket, round(weight, 6) as weight from ({sparse('item_id', 'benchmark')})")
def sparse_embedding(spark, sf_dir):
    """Hashed vectors as (item, bucket, weight) rows."""
    made = retrieval.sparse_embedding(read(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return made.select("item_id", "bucket", F.round("weight", 6).alias("weight"))


@query(
    f"""with t as (select item_id, {tokens('text')} as t from benchmark)
    select a.item_id as a, b.item_id as b, round(case when len(a.t) = 0 or len(b.t) = 0 then 0 else len(list_distinct(list_intersect(a.t, b.t))) / sqrt(len(a.t) * len(list_distinct(b.t))) end, 6) as score
    from t a join t b on a.item_id < b.item_id where len(list_intersect(a.t, b.t)) > 0"""
)
def lexical_score(spark, sf_dir):
    """Lexical similarity of benchmark passages that share a term, by an equi-join on terms."""
    t = read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    words = t.select("item_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("m"), F.explode(F.array_distinct("t")).alias("w"))
    a, b = words.select(F.col("item_id").alias("a"), "n", "w"), words.select(F.col("item_id").alias("b"), "m", "w")
    shared = a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    return shared.select("a", "b", F.round(F.col("k") / F.sqrt(F.col("n").cast("double") * F.col("m")), 6).alias("score"))


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), q as (select * from v where vec_id % 100 = 0)
    select q.vec_id as query_id, v.vec_id, round(least(1, greatest(0, (list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) + 1) / 2)), 6) as score from q join v on q.vec_id <> v.vec_id"""
)
def cosine_pairs(spark, sf_dir):
    """Shifted cosine of every hundredth vector, the stated query set, against all others."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"))
    return v.join(q, v["vec_id"] != q["query_id"]).select("query_id", "vec_id", F.round(retrieval.cosine(F.col("q"), F.col("e")), 6).alias("score"))


@query(
    f"""with q as (select item_id, text from benchmark), c as (select doc_id, row_number() over (order by doc_id) - 1 as idx, text from documents),
    qt as (select item_id, {tokens('text')} as t from q), ct as (select idx, doc_id, {tokens('text')} as t from c),
    qx as (select item_id, len(t) as n, unnest(list_distinct(t)) as w from qt), cx as (select idx, len(list_distinct(t)) as m, unnest(list_distinct(t)) as w from ct),
    lex as (select item_id, idx, count(*) / sqrt(any_value(n) * any_value(m)) as l from qx join cx using (w) group by all),
    qv as ({sparse('item_id', 'q')}), cv as ({sparse('idx', 'c')}),
    dot as (select item_id, idx, sum(qv.weight * cv.weight) as d from qv join cv using (bucket) group by all),
    every as (select q.item_id, c.idx, c.doc_id, coalesce(l, 0) as l, least(1, greatest(0, (coalesce(d, 0) + 1) / 2)) as s from q cross join c left join lex using (item_id, idx) left join dot using (item_id, idx)),
    ranked as (select *, row_number() over (partition by item_id order by round(l, 9) desc, idx) as rl, row_number() over (partition by item_id order by round(s, 9) desc, idx) as rs from every),
    scored as (select *, least(1, 30 * (1 / (60 + rl) + 1 / (60 + rs))) as f from ranked), total as (select *, least(1, 0.38 * l + 0.34 * s + 0.16 * f) as score from scored),
    best as (select *, row_number() over (partition by item_id order by round(score, 9) desc, idx) as rank from total)
    select item_id as query_id, doc_id as chunk_id, rank, round(l, 6) as lexical, round(s, 6) as semantic, round(f, 6) as fusion, round(score, 6) as score from best where rank <= 5"""
)
def rank_fusion_topk(spark, sf_dir):
    """Hybrid retrieval: benchmark passages as queries, documents as the corpus, the best five of each."""
    docs = retrieval.dense_index(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    top = retrieval.hybrid_topk(queries, docs, 5)
    return top.select("query_id", "chunk_id", "rank", *[F.round(c, 6).alias(c) for c in ("lexical", "semantic", "fusion", "score")])


# chunks and batches

PACK = """with recursive pieces as ({pieces}),
 fold as (
   select doc_id, 1 as i, 1 as chunk, p as cur, p as text from pieces where i = 1
   union all
   select f.doc_id, f.i + 1, case when length(f.cur || ' ' || n.p) > {most} then f.chunk + 1 else f.chunk end,
          case when length(f.cur || ' ' || n.p) > {most} then n.p else f.cur || ' ' || n.p end, n.p
   from fold f join pieces n on n.doc_id = f.doc_id and n.i = f.i + 1
 )"""
SENTENCES = r"string_split(regexp_replace({0}, '([.!?。！？])" + WS + r"+', '\1' || chr(1), 'g'), chr(1))"
BODY = clean("text")
EVIDENCE_PIECES = f"select doc_id, i, p from (select doc_id, unnest(case when length(b) <= 700 then [b] else {SENTENCES.replace('{0}', 'b')} end) as p, generate_subscripts(case when length(b) <= 700 then [b] else {SENTENCES.replace('{0}', 'b')} end, 1) as i from (select doc_id, {BODY} as b from documents))"


@query(PACK.format(pieces=EVIDENCE_PIECES, most=700) + " select doc_id, chunk::bigint as chunk_no, doc_id || ':chunk:' || chunk as chunk_id, arg_max(cur, i) as text from fold group by doc_id, chunk")
def sentence_pack_700(spark, sf_dir):
    """Evidence chunks of 700 characters."""
    docs = read(spark, sf_dir, "documents")
    return chunking.explode_chunks(docs, chunking.evidence_chunks(F.col("text")), "doc_id").withColumn("chunk_no", F.col("chunk_no").cast("long"))


LONG_PIECES = f"select doc_id, row_number() over (partition by doc_id order by j) as i, p from (select doc_id, j, {clean('x')} as p from (select doc_id, unnest({SENTENCES.replace('{0}', 'text')}) as x, generate_subscripts({SENTENCES.replace('{0}', 'text')}, 1) as j from documents)) where p <> ''"


@query(
    PACK.format(pieces=LONG_PIECES, most=920)
    + """, chunks as (select doc_id, chunk, arg_max(cur, i) as t, max(chunk) over (partition by doc_id) as last from fold group by doc_id, chunk)
    select doc_id, chunk::bigint as chunk_no, case when chunk = last then substr(t, 1, 920) else t end as text from chunks"""
)
def sentence_pack_920(spark, sf_dir):
    """Page chunks of 920 characters; only the last one is cut."""
    docs = read(spark, sf_dir, "documents")
    return chunking.explode_chunks(docs, chunking.sentence_chunks(F.col("text"), 920), "doc_id").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


@query(
    f"""select doc_id, row_number() over (partition by doc_id order by j) as sentence_no, p as sentence from (
      select *, row_number() over (partition by doc_id, {finger('p')} order by j) as k from ({LONG_PIECES.replace('row_number() over (partition by doc_id order by j) as i', 'j')})) where k = 1"""
)
def sentence_split(spark, sf_dir):
    """Sentences without repeats."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    once = dedupe.first_wins(rows, T.fingerprint(F.col("sentence")), "pos", within=["doc_id"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return once.select("doc_id", number.cast("long").alias("sentence_no"), "sentence")


@query(
    """with recursive d as (select source, doc_id, length(text) as n, row_number() over (partition by source order by doc_id) as i from documents),
    f as (select source, doc_id, i, n as used, 0 as batch from d where i = 1
      union all select d.source, d.doc_id, d.i, case when f.used + d.n > 14000 and f.used > 0 then d.n else f.used + d.n end, f.batch + case when f.used + d.n > 14000 and f.used > 0 then 1 else 0 end from f join d on d.source = f.source and d.i = f.i + 1)
    select source, doc_id, batch::bigint as batch from f"""
)
def budget_batches(spark, sf_dir):
    """Documents of a source in batches of 14,000 characters."""
    return chunking.budget_batches(read(spark, sf_dir, "documents"), "source", "doc_id", F.length("text"))


# pages


@query(
    r"""select page_id, replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') as title, url,
    lower(regexp_extract(url, '^(?i:https?)://([^/?#:]*)', 1)) as host, lower(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '(?i)_(?:\d+x\d*|x\d+)(\.[a-z]{3,5})$', '\1')) as image_key from pages"""
)
def page_title(spark, sf_dir):
    """Title, host and canonical key of each page."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", H.html_title(F.col("html")).alias("title"), "url", H.host_of(F.col("url")).alias("host"), H.image_key(F.col("url")).alias("image_key"))


READABLE = r"""with b as (
  select page_id, html, list_concat(list_concat(regexp_extract_all(html, '(?is)<main\b[^>]*>(.*?)</main>', 1), regexp_extract_all(html, '(?is)<article\b[^>]*>(.*?)</article>', 1)),
    regexp_extract_all(html, '(?is)<div\b[^>]*(?:class|id)=["''][^"'']*(?:content|docs|article|markdown|main)[^"'']*["''][^>]*>(.*?)</div>', 1)) as bodies from pages
), one as (
  select page_id, coalesce((select trim(x) from (select unnest(bodies) as x, generate_subscripts(bodies, 1) as i) where trim(x) <> '' order by length(trim(x)) desc, i limit 1), html) as h from b
), t as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
    '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<noscript.*?</noscript>', ' ', 'g'), '(?i)</(p|div|section|article|li|h[1-6]|tr)>', chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'),
    '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as x from one
)
"""


@query(READABLE + r"select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''') as text from t".replace('\\"', '"'))
def page_readable_text(spark, sf_dir):
    """The text of a page's primary body."""
    return read(spark, sf_dir, "pages").select("page_id", H.readable_text(F.col("html")).alias("text"))


@query(
    r"""select page_id, i::bigint as place, u as link from (
      select page_id, unnest(l) as u, generate_subscripts(l, 1) as i from (select page_id, list_transform(regexp_extract_all(url || ' ' || html, 'https?://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')) as l from pages))
    where not regexp_matches(u, '^https?://(localhost|0\.0\.0\.0|127\.|10\.|192\.168\.)')"""
)
def page_urls_public(spark, sf_dir):
    """Public addresses in a page."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(H.extract_urls(F.concat("url", F.lit(" "), "html"))).alias("pos", "link")).select("page_id", (F.col("pos") + 1).cast("long").alias("place"), "link")


def _contains(x: str, phrases) -> str:
    return " + ".join(f"contains({x}, '{p}')::int" for p in phrases)


@query(f"select page_id, ({_contains('t', S.RELEVANT)}) - ({_contains('t', S.NOISE)}) - case when length(t) < 120 then 2 else 0 end as relevance, regexp_matches(lower(url), 'schema\\.org') as schema_reference from (select page_id, url, lower(html) as t from pages)")
def source_relevance(spark, sf_dir):
    """Relevance of a page by its phrases."""
    p = read(spark, sf_dir, "pages")
    kind = S.source_kind(F.col("url"), F.lit(None).cast("string"))
    return p.select("page_id", S.relevance_score(F.col("html"), F.lit("other")).cast("int").alias("relevance"), (kind == "schema-reference").alias("schema_reference"))


# signals over documents


@query(
    r"""select doc_id, len(regexp_extract_all(text, '[\x{AC00}-\x{D7AF}]'))::int as hangul, len(regexp_extract_all(text, '[\x{3040}-\x{30FF}]'))::int as kana, len(regexp_extract_all(text, '[A-Za-z]'))::int as latin,
    case when regexp_matches(text, '[\x{3040}-\x{30FF}]') then 'ja-JP' when regexp_matches(text, '[\x{AC00}-\x{D7AF}]') then 'ko-KR' else 'en-US' end as locale from documents"""
)
def script_profile(spark, sf_dir):
    """Characters of each script and the locale."""
    d = read(spark, sf_dir, "documents")
    n = T.script_counts(F.col("text"))
    return d.select("doc_id", *[n[k].alias(k) for k in ("hangul", "kana", "latin")], T.infer_locale(F.col("text")).alias("locale"))


@query(
    r"""select doc_id, i::bigint as place, regexp_replace(lower(trim(x)), ' ', '', 'g') as token from (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from (
      select doc_id, regexp_extract_all(text, '(?i)[+-]?[$€£¥₩]?\d+(?:[.,]\d+)*[\t\n\v\f\r ]?(?:%|ml|mg|g|kg|oz|weeks?|days?|hours?|명|회|주|일|시간)?') as l from documents))"""
)
def numeric_tokens(spark, sf_dir):
    """Numbers with their units, in order."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.numeric_tokens(F.col("text"))).alias("pos", "token")).select("doc_id", (F.col("pos") + 1).cast("long").alias("place"), "token")


def _keyword_sql() -> str:
    parts = [f"select doc_id, '{c}' as category, unnest(regexp_extract_all(text, '(?i){_rule(p)}')) as keyword from documents" for c, p in S.KEYWORDS.items()]
    return "select distinct doc_id, category, lower(keyword) as keyword from (" + " union all ".join(parts) + ")"


@query(_keyword_sql())
def category_keywords(spark, sf_dir):
    """Distinct keywords of each category in a document."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(S.all_keywords(F.col("text"))).alias("k")).select("doc_id", "k.category", F.lower("k.keyword").alias("keyword"))


def _hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){pattern}')"


@query(
    f"""select doc_id, {_hit('text', S.CARE)} as care, len(regexp_extract_all(text, '(?i){S.STRONG_CARE}')) >= 2 as strong_care, commerce, {_hit('text', S.REVIEW)} and not commerce as review, {_hit('text', S.FAQ)} and {_hit('text', S.CARE)} as faq
    from (select doc_id, text, {_hit('v', S.HARD_COMMERCE)} or (length(v) > 120 and {_hit('v', S.POLICY)} and not len(regexp_extract_all(v, '(?i){S.STRONG_CARE}')) >= 2) as commerce from (select doc_id, text, {clean('text')} as v from documents))"""
)
def evidence_signals(spark, sf_dir):
    """Which signals a document carries."""
    d = read(spark, sf_dir, "documents").select("doc_id", S.document_signals(F.col("text")).alias("s"))
    return d.select("doc_id", "s.care", "s.strong_care", "s.commerce", "s.review", "s.faq")


# dedupe and joins


@query(f"select doc_id, key from (select doc_id, {finger('text')} as key, row_number() over (partition by {finger('text')} order by doc_id) as rn from documents) where rn = 1")
def first_wins_dedupe(spark, sf_dir):
    """The first document of each fingerprint."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("key"))
    return dedupe.first_wins(d, F.col("key"), "doc_id")


@query(
    f"""with i as (select item_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as name, {terms('text')} as t from benchmark), d as (select doc_id, list_distinct({terms('text')}) as t from documents)
    select item_id, max(r) >= 0.66 as backed, round(max(r), 6) as best from (select item_id, name, i.t as it, len(list_filter(i.t, lambda w: list_contains(d.t, w))) / len(i.t) as r from i cross join d where len(i.t) > 0) group by item_id"""
)
def source_backed(spark, sf_dir):
    """Whether a benchmark passage is backed by some document."""
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    made = linking.source_backed(items, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("item_id", "backed", F.round("best", 6).alias("best"))


@query(
    f"""with c as (select distinct item_id, unnest({terms('text')}) as w from benchmark), e as (select distinct doc_id, unnest({terms('text')}) as w from documents)
    select claim_id, evidence_id, overlap, rank from (select *, row_number() over (partition by claim_id order by overlap desc, evidence_id) as rank from (select item_id as claim_id, doc_id as evidence_id, count(*) as overlap from c join e using (w) group by all)) where rank <= 3"""
)
def claim_links_top3(spark, sf_dir):
    """The three documents that share most terms with each passage."""
    return linking.claim_links(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text"), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text"))


@query(
    """with w as (select distinct doc_id from labels where toxic = 1 and quality = 0), m as (select d.doc_id, source, w.doc_id is not null as hit, bool_or(w.doc_id is not null) over (partition by source) as has_some, row_number() over (partition by source order by d.doc_id) as rn from documents d left join w on w.doc_id = d.doc_id)
    select doc_id, source from m where hit or (not has_some and rn <= 4)"""
)
def evidence_semi_fallback(spark, sf_dir):
    """Selected documents of each source, its first four where none is."""
    wanted = read(spark, sf_dir, "labels").where("toxic = 1 and quality = 0").select("doc_id")
    return linking.semi_or_first(read(spark, sf_dir, "documents").select("doc_id", "source"), wanted, "doc_id", "source", "doc_id")


@query("select s.source, l.lang from (select distinct source from documents) s cross join (select distinct lang from documents) l where not exists (select 1 from documents d where d.source = s.source and d.lang = l.lang and d.n_chars > 20000)")
def coverage_missing_kinds(spark, sf_dir):
    """Languages that a source has no long document in."""
    d = read(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    required = d.select("source").distinct().join(F.broadcast(d.select("lang").distinct()))
    return linking.missing_kinds(required, d.where("n_chars > 20000"), ["source", "lang"])


REFS = """select source as graph_id, 'https://c.example/' || source as page_id, case doc_id % 3 when 0 then '#d' || (doc_id + 40) when 1 then 'https://c.example/' || source || '#d' || (doc_id + 40) else 'https://other.example/#d' || doc_id end as ref from documents"""


@query(f"with e as ({REFS}), n as (select source as graph_id, '#d' || doc_id as node_id from documents union all select source, 'https://c.example/' || source || '#d' || doc_id from documents) select graph_id, page_id, ref from e where not exists (select 1 from n where n.graph_id = e.graph_id and n.node_id = e.ref) and (ref like '#%' or split_part(ref, '#', 1) = page_id)")
def dangling_refs(spark, sf_dir):
    """References between documents of a source whose target the source does not hold; references to other places are left alone."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("graph_id"), F.concat(F.lit("https://c.example/"), "source").alias("page_id"))
    far = (F.col("doc_id") + 40).cast("string")
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#d"), far)).when(F.col("doc_id") % 3 == 1, F.concat("page_id", F.lit("#d"), far)).otherwise(F.concat(F.lit("https://other.example/#d"), F.col("doc_id").cast("string")))
    own = F.concat(F.lit("#d"), F.col("doc_id").cast("string"))
    nodes = d.select("graph_id", F.explode(F.array(own, F.concat("page_id", own))).alias("node_id"))
    return linking.dangling_references(d.select("graph_id", "page_id", ref.alias("ref")), nodes)


PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(
    f"""with p as (select p_partkey, p_name, {PLAIN.replace('{0}', 'p_name')} as a, {PLAIN.replace('{0}', "replace(p_name, ' ', '')")} as b, trim(p_name) as n from part)
    select p_partkey, levenshtein(a, reverse(a)) as distance, case when length(a) <= 8 then 2 else greatest(2, floor(length(a) * 0.25)) end::int as distance_limit from p"""
)
def name_corrections(spark, sf_dir):
    """Edit distance and its limit for a proposed spelling (the name turned around)."""
    p = read(spark, sf_dir, "part")
    name = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "")
    turned = F.reverse(name)
    return p.select("p_partkey", F.levenshtein(name, turned).cast("long").alias("distance"), gates.distance_limit(name, turned, F.lit("en-US")).alias("distance_limit"))


@query(
    """with g as (select item_id, list_distinct(list_transform(generate_series(1, greatest(length(text) - 2, 1)), lambda i: substr(text, i, 3))) as g from benchmark), q as (select * from g where item_id % 10 = 0)
    select q.item_id as a, g.item_id as b, round(2 * len(list_intersect(q.g, g.g)) / (len(q.g) + len(g.g)), 6) as dice, round(len(list_intersect(q.g, g.g)) / len(list_distinct(list_concat(q.g, g.g))), 6) as jaccard from q join g on q.item_id <> g.item_id"""
)
def char_trigram_dice(spark, sf_dir):
    """Dice and Jaccard similarity of character trigrams: every tenth passage, the stated query set, against all others."""
    g = read(spark, sf_dir, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("g"))
    q = g.where("item_id % 10 = 0").select(F.col("item_id").alias("a"), F.col("g").alias("h"))
    rows = q.join(g, F.col("a") != F.col("item_id"))
    return rows.select("a", F.col("item_id").alias("b"), F.round(retrieval.dice(F.col("h"), F.col("g")), 6).alias("dice"), F.round(retrieval.jaccard(F.col("h"), F.col("g")), 6).alias("jaccard"))


@query(
    """with g as (select item_id, list_distinct(list_transform(generate_series(1, greatest(length(text) - 2, 1)), lambda i: substr(text, i, 3))) as g from benchmark)
    select q.item_id as a, g.item_id as b, round(2 * len(list_intersect(q.g, g.g)) / (len(q.g) + len(g.g)), 6) as dice, round(len(list_intersect(q.g, g.g)) / len(list_distinct(list_concat(q.g, g.g))), 6) as jaccard from g q join g on q.item_id < g.item_id"""
)
def char_trigram_dice_pairs(spark, sf_dir):
    """Dice and Jaccard similarity of character trigrams of all pairs of passages."""
    g = read(spark, sf_dir, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("g"))
    rows = g.select(F.col("item_id").alias("a"), F.col("g").alias("h")).join(g, F.col("a") < F.col("item_id"))
    return rows.select("a", F.col("item_id").alias("b"), F.round(retrieval.dice(F.col("h"), F.col("g")), 6).alias("dice"), F.round(retrieval.jaccard(F.col("h"), F.col("g")), 6).alias("jaccard"))


@query(f"select w as token, n, {stable('w')} % 384 as bucket, {FNV.replace('{0}', 'w')} as hash from (select w, count(*) as n from (select unnest({tokens('text')}) as w from documents) group by w)")
def fnv_buckets_documents(spark, sf_dir):
    """Hash and bucket of each token of the documents."""
    t = read(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", "n", (T.stable_hash(F.col("token")) % 384).alias("bucket"), T.fnv1a(F.col("token")).alias("hash"))


@query(f"select doc_id, bucket, round(weight, 6) as weight from ({sparse('doc_id', 'documents')})")
def sparse_embedding_documents(spark, sf_dir):
    """Hashed vectors of the documents as (document, bucket, weight) rows."""
    made = retrieval.sparse_embedding(read(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return made.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query()
def lexical_score_documents(spark, sf_dir):
    """Lexical similarity of each passage to the documents that share a term with it, by an equi-join on terms."""
    q = retrieval.term_counts(read(spark, sf_dir, "benchmark"), "item_id", F.col("text")).select("item_id", "term", F.sum("times").over(Window.partitionBy("item_id")).alias("n"))
    c = retrieval.term_counts(read(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("doc_id", "term", F.count("*").over(Window.partitionBy("doc_id")).alias("m"))
    shared = q.join(c, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    return shared.select("item_id", "doc_id", F.round(F.col("k") / F.sqrt(F.col("n").cast("double") * F.col("m")), 6).alias("score"))


# selection


@query(
    """with r as (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as k from conversations),
    q as (select *, k <= case role when 'system' then 1 when 'user' then 2 else 2 end as inside from r), p as (select *, row_number() over (partition by conv_id order by inside desc, case when inside then k else 0 end, turn) as place from q)
    select conv_id, turn, role, k as role_rank, place from p where place <= 6"""
)
def quota_round_robin(spark, sf_dir):
    """Turns by role quotas, then by order."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    made = selection.quota_round_robin(c, "conv_id", "role", "turn", {"system": 1, "user": 2}, 6, default=2)
    return made.select("conv_id", "turn", "role", F.col("role_rank").cast("long").alias("role_rank"), F.col("place").cast("long").alias("place"))


@query("select user_id, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as rn from events) where rn = 1")
def merge_best_score(spark, sf_dir):
    """The best event of each user and type."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return retrieval.merge_best(e, ["user_id", "event_type"], "value", "event_id").select("user_id", "event_id", F.round("value", 6).alias("value"))


@query()
def diverse_select(spark, sf_dir):
    """Greedy diversity over vectors, labels as kinds."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.select((F.col("vec_id") % 20).alias("query_id"), "vec_id", F.abs(F.element_at("embedding", 1).cast("double")).alias("score"), F.col("label").cast("string").alias("kind"), (F.col("vec_id") % 7).cast("string").alias("source"), F.array(F.col("label").cast("string")).alias("targets"), F.array((F.col("vec_id") % 3).cast("string")).alias("intents"))
    return selection.diverse_select(rows, "query_id", "vec_id", 8).select("query_id", "vec_id", "place")


@query(
    """with r as (select conv_id, turn, role, text, lead(case when role = 'assistant' then text end, 1) over w as a1, lead(case when role = 'assistant' then text end, 2) over w as a2, lead(case when role = 'assistant' then text end, 3) over w as a3 from conversations window w as (partition by conv_id order by turn))
    select conv_id, turn, text as question, coalesce(a1, a2, a3) as answer from r where role <> 'assistant' and length(text) <= 140 and coalesce(a1, a2, a3) is not null"""
)
def question_answer_pairs(spark, sf_dir):
    """Short prompts with the first reply among the next three turns."""
    c = read(spark, sf_dir, "conversations")
    made = linking.question_answers(c, "conv_id", "turn", "text", F.col("role") != "assistant", F.col("role") == "assistant")
    return made.select("conv_id", "turn", F.col("text").alias("question"), "answer")


# aggregates


@query(
    """with m as (select d.source, l.quality, l.toxic from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) l using (doc_id))
    select source, count(*) as total, count(quality) as labelled, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic, case when count(quality) = 0 then 1.0 else round(count(*) filter (where quality = 1) / count(quality), 6) end as ratio from m group by rollup (source)"""
)
def conditional_coverage(spark, sf_dir):
    """Conditional counts by source and in total, with a share that is 1 where nothing counts."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    m = read(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    made = m.rollup("source").agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return made.withColumn("ratio", F.when(F.col("labelled") == 0, 1.0).otherwise(F.round(F.col("good") / F.col("labelled"), 6)))


@query("select user_id, arg_max(event_type, (s, -asc_rank)) as category, round(max(s), 4) as total from (select user_id, event_type, round(sum(value), 4) as s, row_number() over (partition by user_id order by event_type) as asc_rank from events group by user_id, event_type) group by user_id")
def dominant_category(spark, sf_dir):
    """The event type with the largest sum of each user."""
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("s"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), "event_type"))
    return e.withColumn("rn", rank).where("rn = 1").select("user_id", F.col("event_type").alias("category"), F.col("s").alias("total"))


@query(
    """with c as (select doc_id, length(text) >= 200 as long_enough, regexp_matches(text, '[.!?]') as has_sentence, regexp_matches(text, '[0-9]') as has_number, lang = 'en' as english from documents),
    w as (select *, (1.0 * long_enough::int + 1.0 * has_sentence::int + 0.7 * has_number::int + 0.6 * english::int) / 3.3 as checks, (long_enough::int + has_sentence::int) / 2.0 as cover from c)
    select doc_id, floor((0.78 * checks + 0.22 * cover) * 100 + 0.5) / 100 as score, floor((0.78 * checks + 0.22 * cover) * 100 + 0.5) / 100 >= 0.78 and long_enough and has_sentence as passed from w"""
)
def weighted_readiness(spark, sf_dir):
    """Weighted checks and coverage to one score; heavy checks must hold."""
    from lodestone.operators.citation import Check, readiness

    d, t = read(spark, sf_dir, "documents"), F.col("text")
    long_enough, has_sentence = F.length(t) >= 200, t.rlike("[.!?]")
    checks = [Check("long_enough", long_enough, 1.0), Check("has_sentence", has_sentence, 1.0), Check("has_number", t.rlike("[0-9]"), 0.7), Check("english", F.col("lang") == "en", 0.6)]
    score, passed = readiness(checks, (long_enough.cast("int") + has_sentence.cast("int")) / 2.0)
    return d.select("doc_id", score.alias("score"), passed.alias("passed"))


@query("select event_type, count(*) as n, floor(avg(value) * 10 + 0.5) / 10 as average, 'Rating ' || floor(avg(value) * 10 + 0.5) / 10 || ' · ' || count(*) || ' reviews' as summary from events group by event_type")
def rating_summary(spark, sf_dir):
    """Average and count in words."""
    e = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), T.round_score(F.avg("value"), 1).alias("average"))
    return e.withColumn("summary", aggregates.rating_line(F.col("average"), F.col("n")))


@query("select user_id, event_type as stage, min(ts) as started_at, max(ts) as completed_at, count(*) as steps from events group by all")
def stage_timeline(spark, sf_dir):
    """First and last time of each stage."""
    from lodestone.streaming.stages import stage_timeline as timeline

    return timeline(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("ts").alias("at"))).withColumnRenamed("run_id", "user_id")


B36 = "0123456789abcdefghijklmnopqrstuvwxyz"


@query(
    f"""with h as (select p_partkey, {FNV.replace('{0}', 'p_name')} as h, list_reduce(list_transform(list_filter(string_split(p_name, ''), lambda c: c <> ''), lambda c: ord(c)::bigint), lambda a, c: (a * 31 + c) & 4294967295, 0::bigint) as v from part)
    select p_partkey, ltrim(list_reduce(list_transform([6, 5, 4, 3, 2, 1, 0], lambda i: substr('{B36}', ((h // (36 ** i)::bigint) % 36 + 1)::int, 1)), lambda a, b: a || b), '0') as evidence_id,
      v as variant_hash, ['claim-check', 'comparison', 'use-case-fit', 'review-pattern', 'skeptical-research', 'buyer-question'][v % 6 + 1] as angle from h"""
)
def evidence_ids(spark, sf_dir):
    """Hash ids in base 36 and the seeded variant of each part name."""
    p, name = read(spark, sf_dir, "part"), F.col("p_name")
    angles = F.array(*[F.lit(a) for a in S.ANGLES])
    return p.select("p_partkey", T.base36(T.fnv1a(name)).alias("evidence_id"), T.poly31(name).alias("variant_hash"), F.element_at(angles, (T.poly31(name) % 6 + 1).cast("int")).alias("angle"))


# evidence


@query("select doc_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(text, '(?i){_rule(p)}') then '{n}' end" for n, p in E.MODALITY) + "], lambda x: x is not null), ',') as modality from documents")
def modality_signature(spark, sf_dir):
    """Modality labels of each document, in their fixed order."""
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(E.modality(F.col("text")), ",").alias("modality"))


def _topics() -> str:
    return " and ".join(f"(not regexp_matches(text, '(?i){_rule(p)}') or list_has_any([kind], [{', '.join(repr(r) for r in roles)}]))" for p, roles in E.TOPIC_ROLES)


@query(f"select doc_id, {_topics()} as supported from (select doc_id, text, case when doc_id % 2 = 0 then 'review' else 'ingredient' end as kind from documents)")
def topic_roles(spark, sf_dir):
    """Whether a document's topics are carried by a given role."""
    role = F.array(F.when(F.col("doc_id") % 2 == 0, "review").otherwise("ingredient"))
    return read(spark, sf_dir, "documents").select("doc_id", E.roles_support_topics(F.col("text"), role).alias("supported"))


@query(
    """select p_partkey, case when w = '' then 0 when s = h then 180 when hits = n then 160 + hits * 4 when hits >= ceil(n * 0.6) then 86 + hits * 6 else hits * 6 end::int as score from (
      select *, len(list_filter(l, lambda x: contains(s, x))) as hits, len(l) as n, array_to_string(l, ' ') as h, array_to_string(l, ' ') as w from (
        select p_partkey, lower(p_name) as s, list_filter(string_split_regex(lower(p_brand || '-' || split_part(p_name, ' ', 1)), '[^a-z0-9]+'), lambda x: length(x) >= 2) as l from part))"""
)
def handle_agreement(spark, sf_dir):
    """How well part names agree with a handle made of brand and first word."""
    p = read(spark, sf_dir, "part")
    handle = F.concat_ws("-", "p_brand", F.substring_index("p_name", " ", 1))
    return p.select("p_partkey", E.handle_score(F.col("p_name"), handle).cast("int").alias("score"))


@query(
    """with c as (select l_orderkey, count(distinct l_suppkey) as s, count(*) as e from lineitem group by 1)
    select l_orderkey, round(least(0.95, 0.55 + least(s, 3) * 0.08 + least(e, 5) * 0.04), 6)::double as confidence, least(1, 0.35 * (e % 4) + case when e > 8 then 0.2 else 0 end)::double as tone from c"""
)
def decision_scores(spark, sf_dir):
    """Confidence by numbers of sources and of evidence, and promotional tone."""
    c = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("s"), F.count("*").alias("e"))
    return c.select("l_orderkey", F.round(E.decision_confidence(F.col("s"), F.col("e")), 6).alias("confidence"), E.promotional_tone(F.col("e") % 4, F.col("e")).alias("tone"))


@query()
def evidence_roles(spark, sf_dir):
    """Roles, primary role and routing of each document; lookaround patterns have no counterpart in SQL."""
    d = read(spark, sf_dir, "documents").select("doc_id", E.evidence_roles(F.col("text")).alias("r"), E.chunk_routing(F.lit("custom"), F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("c"), E.negative_review(F.col("text")).alias("negative"))
    return d.select("doc_id", "r.roles", "r.primary", "r.links", "c.intents", "c.targets", "negative")
