"""The registered queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat_format, embedding_dedup, exact_dedup, language_id, ngram_join, packing, sentencepiece_backend, token_files, toxicity, warc_revisits
from lodestone.llm.runtime import table

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~toxicity.held_out())
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """``pages`` as a crawl: each page fetched in full at time 2 * page_id, and asked for again, a not-modified revisit, at
    2 * (page_id + 40) + 1 with its own validators. So the latest earlier response of a URL may be another page's."""
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    base = pages.select("page_id", "url", digest.alias("sha"))
    mark = F.pmod(F.col("page_id"), F.lit(3))
    tag = F.when(mark != 2, F.concat(F.lit('"'), F.substring("sha", 1, 16), F.lit('"')))
    full = base.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (2 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(mark == 2, F.col("sha")).alias("digest"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (2 * F.col("page_id")).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    again = base.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (2 * (F.col("page_id") + 40) + 1).alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), tag).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(mark == 2, F.col("sha")).alias("digest"), F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("date"), (2 * (F.col("page_id") + 40) + 1).cast("string"), F.lit("X-Cache"), F.lit("HIT")).alias("headers"),
    )
    return full.unionByName(again)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc_revisits.resolve_revisits(crawl_records(pages))
    payloads = pages.select((2 * F.col("page_id")).alias("record_id"), F.coalesce("html", F.lit("")).alias("payload"))
    full = warc_revisits.attach_payload(found, payloads)
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return full.select("record_id", "canonical_url", "ts", "response_id", "status", headers.alias("headers"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=0)
    return token_files.read_token_files(spark, uri)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_language(table(spark, sf_dir, "documents"), learn=~language_id.held_out())
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


#: A conversation whose texts hold other templates' control strings.
HARD_ID, HARD_TEXT = -7, "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(HARD_ID, 0, "user", HARD_TEXT), (HARD_ID, 1, "assistant", HARD_TEXT)], turns.schema)
    made = chat_format.format_conversations(turns.unionByName(hard), parts=chat_format.text_part(F.col("text")))
    read = made.select("conv_id", "formatted", "mask", chat_format.read_turns(F.col("formatted")).alias("turns"))
    read = read.select("conv_id", "formatted", "turns", chat_format.masked_text(F.col("turns"), F.col("mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["body"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.digest_ids(sentencepiece_backend.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE)))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), end_id=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc_revisits, op3_token_files, op4_embedding_dedup, op5_exact_dedup, op6_language_id, op7_chat_format, op8_sentencepiece, op9_ngram_join, op10_packing, pipeline)}

OP2_SQL = r"""
with parts as (
  select page_id, sha256(coalesce(html, '')) as sha,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages
), cut as (
  select page_id, sha, split_part(bare, '?', 1) as place, case when instr(bare, '?') > 0 then regexp_replace(bare, '^[^?]*\?', '') else '' end as query from parts
), named as (
  select page_id, sha,
         regexp_replace(regexp_replace(regexp_replace(lower(split_part(place, '/', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '')
           || regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', '') as base,
         list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)'))) as kept
  from cut
), urls as (
  select page_id, sha, page_id % 3 = 2 as by_digest, nullif(base || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end, '') as u from named
), found as (
  select v.page_id, v.u, v.sha, v.by_digest, max(r.page_id) as response from urls v left join urls r on r.u = v.u and 2 * r.page_id < 2 * (v.page_id + 40) + 1 group by all
), judged as (
  select f.*, case when response is null then 'missing'
                   when f.by_digest <> r.by_digest then 'unchecked'
                   when f.by_digest and f.sha = r.sha or not f.by_digest and substr(f.sha, 1, 16) = substr(r.sha, 1, 16) then 'resolved' else 'mismatch' end as status, r.sha as stored
  from found f left join urls r on r.page_id = f.response
)
select 2 * page_id + 1 as record_id, u as canonical_url, 2 * (page_id + 40) + 1 as ts, case when status in ('resolved', 'unchecked') then 2 * response end as response_id, status,
       case when status in ('resolved', 'unchecked') then 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (2 * (page_id + 40) + 1) || chr(10) || 'x-cache: HIT' end as headers,
       case when status in ('resolved', 'unchecked') then stored end as payload_sha256
from judged
"""

OP5_SQL = """
with digests as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
groups as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from digests group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from digests join groups using (text_sha256)
"""

OP7_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped as (
  select *, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') as erole, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as etext from turns
), whole as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, etext) as lines,
         coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, etext), '') as loss,
         sum(length('<|turn|>') + length(erole) + length('<|says|>') + length(etext) + length('<|end|>')) as formatted_chars
  from escaped group by conv_id
)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars from whole
"""

ORACLES = {"op2_warc_revisits": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op7_chat_format": OP7_SQL}
