"""WARC: not-modified revisits resolved by an as-of join to the latest earlier full response of the same canonical URL.

The window that finds the response carries ids, validators and headers, never payloads. A URL's records are cut into
blocks of time that hold about as many of all records each: inside a block a sorted window looks back, and what a block has not
seen comes from a small table with one row for each URL and block. So a URL that holds a third of all records is spread over a third
of the blocks, even where it was asked for in a burst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that name a campaign, not a page. Fixed values.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)"
#: Headers of a 304 that do not replace those of the stored response (RFC 9111, 3.2 and 4.3.4). Fixed values.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, user, default port, fragment, tracking parameters and closing slash; host
    in lower case, other parameters sorted. Null and empty stay null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    host = F.lower(F.substring_index(place, "/", 1))
    path = F.regexp_replace(F.regexp_replace(place, r"^[^/]*", ""), r"/+$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(full != "", full)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers with those of the 304 that it may replace; names in lower case, sorted, the last of repeated names."""
    none = F.create_map().cast("map<string,string>")
    lower = lambda m: F.transform(F.map_entries(F.coalesce(m, none)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    allowed = F.filter(lower(fresh), lambda e: ~e["key"].isin(*NOT_MERGED) & e["value"].isNotNull())
    names = F.transform(allowed, lambda e: e["key"])
    both = F.concat(F.filter(lower(stored), lambda e: ~F.array_contains(names, e["key"])), allowed)
    keys = F.array_sort(F.array_distinct(F.transform(both, lambda e: e["key"])))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(both, lambda e: e["key"] == k), -1)["value"].alias("value"))))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


#: Blocks of time at least and at most; between, one for each so many records.
LEAST_BLOCKS, MOST_BLOCKS, BLOCK_RECORDS = 64, 256, 1_000_000


def resolve_revisits(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per revisit: ``record_id, canonical_url, ts, response_id, status, headers``.

    ``records``: ``record_id, url, ts (bigint), kind ('response' or 'revisit'), etag, last_modified, digest, headers
    (map<string,string>)``. A response counts if its kind says so. ``status`` is ``resolved`` if the first validator that both
    sides carry agrees (payload digest, then ETag by weak comparison, then Last-Modified), ``mismatch`` if it doesn't,
    ``unchecked`` if they share none, ``missing`` if the URL has no earlier response or is null. ``response_id`` and merged
    ``headers`` are null unless resolved or unchecked (headers are then the merged ones). Earlier is a smaller ``ts``;
    of responses at one ``ts`` the largest ``record_id`` counts. A response without ``ts`` never counts, a revisit without it is missing.
    Repeated revisit rows are each resolved. Other columns are not read; an empty table gives an empty one.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), ((F.col("kind") == "response") & F.col("ts").isNotNull()).alias("full"), (F.col("kind") == "revisit").alias("again"),
        F.col("etag").alias("etag"), F.col("last_modified").alias("last_modified"), F.col("digest").alias("digest"), F.col("headers").cast("map<string,string>").alias("headers"),
    ).where("full or again")
    if blocks is None:
        blocks = max(LEAST_BLOCKS, min(MOST_BLOCKS, rows.count() // BLOCK_RECORDS))
    # where blocks begin does not change what is found, so approximate quantiles do
    begins = sorted({int(x) for x in rows.approxQuantile("ts", [k / blocks for k in range(1, blocks)], 1 / (4 * blocks))}) if blocks > 1 else []
    block = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in begins]), lambda b: b <= F.col("ts"))) if begins else F.lit(0)
    stored = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    rows = rows.withColumns({"block": F.when(F.col("ts").isNull(), -1).otherwise(block).cast("long"), "stored": F.when(F.col("full"), stored)})
    without, named = rows.where("canonical_url is null and again"), rows.where("canonical_url is not null")
    # inside a block: at one ts revisits go before responses, which are not earlier
    back = Window.partitionBy("canonical_url", "block").orderBy(F.col("ts").asc_nulls_first(), F.col("full").asc(), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = named.withColumn("near", F.last("stored", ignorenulls=True).over(back)).where("again")
    # a row for each URL and block, with the last response before the block
    ends = named.groupBy("canonical_url", "block").agg(F.max(F.when(F.col("full"), F.struct("ts", "record_id"))).alias("end"), F.max(F.col("again").cast("int")).alias("asks"))
    past = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("end", F.last("end", ignorenulls=True).over(past)).where("asks = 1 and end is not null").select("canonical_url", "block", F.col("end.ts").alias("end_ts"), F.col("end.record_id").alias("end_id"))
    full = named.where("full").select("canonical_url", F.col("ts").alias("end_ts"), F.col("record_id").alias("end_id"), F.col("stored").alias("far")).dropDuplicates(["canonical_url", "end_ts", "end_id"])
    carried = carried.join(full, ["canonical_url", "end_ts", "end_id"]).select("canonical_url", "block", "far")
    found = inside.join(carried, ["canonical_url", "block"], "left").withColumn("response", F.coalesce("near", "far"))
    found = found.unionByName(without.withColumns({"near": F.col("stored"), "far": F.col("stored"), "response": F.col("stored")}))
    r = F.col("response")
    agree = F.coalesce(F.col("digest") == r["digest"], _weak(F.col("etag")) == _weak(r["etag"]), F.col("last_modified") == r["last_modified"])
    status = F.when(r.isNull() | F.col("ts").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    use = F.col("status").isin("resolved", "unchecked")
    found = found.withColumn("status", status)
    return found.select("record_id", "canonical_url", "ts", F.when(use, r["record_id"]).alias("response_id"), "status", F.when(use, merged_headers(r["headers"], F.col("headers"))).alias("headers"))


def attach_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """The resolved revisits with the response's ``payload``; ``payloads`` has ``record_id, payload`` of full responses.

    Revisits without a response have a null payload and stay out of the join.
    """
    side = payloads.select(F.col("record_id").alias("response_id"), F.col("payload").alias("payload"))
    found = resolved.where("response_id is not null").join(side, "response_id", "left").select(*resolved.columns, "payload")
    return found.unionByName(resolved.where("response_id is null").withColumn("payload", F.lit(None).cast(payloads.schema["payload"].dataType)))
