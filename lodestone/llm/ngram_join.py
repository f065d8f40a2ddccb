"""N-gram Jaccard join by MinHash banding with exact verification.

1. One pass over the texts: 64-bit hashes of the distinct five-word shingles, a digest of that set, and a band hash for each
   group of MinHash values. The table of digests and bands, not the shingles, is written.
2. Documents with equal sets become one class, by a partial aggregate: thousands of copies are one row from here on.
3. Classes are shuffled on band hashes. A bucket links its members to its smallest one; components of these links, found
   by rounds of joins, are the clusters that can hold similar pairs.
4. Full shingle sets are made again, for classes in clusters only, and compared. A small cluster is compared as a whole; in a large one,
   which chance may have grown from many small buckets, each bucket is, of several with the same members one, and a pair is looked at
   in the first bucket that it shares. What holds more than ``block`` classes is cut into blocks, and a task gets two of them. It
   verifies pairs on the full sets and returns counts of links and a spanning forest, not the pairs. So no task holds an unbounded
   group, and no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.components import components, join_least
from lodestone.llm.runtime import by_bytes, give_back, hold, numbered, save, ship

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: MinHash values at most.
MOST_HASHES = 80
#: Classes in a block of a cluster or bucket, on average; larger clusters are compared bucket by bucket.
BLOCK = 256
#: Classes up to which the ids of cluster members (some 30 bytes each) are broadcast to the texts; beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000

NOT_WORD = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def choose_banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> Banding:
    """The banding with most rows to a band, so with fewest false candidates, that reaches the recall at the threshold within ``most`` values."""
    best = Banding(most, 1)
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if bands * rows <= most and Banding(bands, rows).recall(threshold) >= recall:
            best = Banding(bands, rows)
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Hashes of word n-grams of whole texts, by prefix sums over the bytes of a batch.

    A text is lower-cased and split at everything but letters and digits. A text of fewer words than ``n`` has one shingle, all its
    words; one without words has none.
    """

    def __init__(self, n: int = WORDS):
        self.n = n
        rng = np.random.default_rng(20240229)
        self.of_byte = rng.integers(1, 1 << 63, 256, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _room(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        clean = [" ".join(NOT_WORD.sub(" ", t.lower()).split()).encode("utf-8", "surrogatepass") for t in texts]
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for c in clean:
            if group and size + len(c) > 1 << 20:
                out.extend(self._hash(group))
                group, size = [], 0
            group.append(c)
            size += len(c) + 1
        return out + (self._hash(group) if group else [])

    def _hash(self, group: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        self._room(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.powers[: len(data)], out=prefix[1:])
        border = np.flatnonzero((data == 32) | (data == 10))  # the end of each word; a text without words has one of length 0
        starts = np.concatenate([[0], border[:-1] + 1])
        last = np.flatnonzero(data[border] == 10)  # position of each text's last word
        first = np.concatenate([[0], last[:-1] + 1])
        out = []
        for text, f, e in zip(group, first.tolist(), last.tolist(), strict=True):
            if not text:
                out.append(np.zeros(0, np.uint64))
                continue
            k = max(f, e - self.n + 1)
            begin, end = starts[f : k + 1], border[f + (e - k) : e + 1]
            out.append(np.unique(mix((prefix[end] - prefix[begin]) * self.inverses[begin])))
        return out


class MinHasher:
    """The k-th value of a set is the least of its shingles scrambled with the k-th seed, a function of its own for each k."""

    def __init__(self, banding: Banding):
        self.banding = banding
        self.seeds = np.random.default_rng(20240301).integers(1, 1 << 63, (banding.bands * banding.rows, 1), np.uint64)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """A signed 64-bit hash for each band; a set without shingles has none."""
        if not len(shingles):
            return np.zeros(0, np.int64)
        values = np.full(len(self.seeds), np.iinfo(np.uint64).max, np.uint64)
        for low in range(0, len(shingles), 128):  # all shingles; 128 of them by 72 seeds stay in the processor's cache
            np.minimum(values, mix(shingles[low : low + 128] ^ self.seeds).min(axis=1), out=values)
        rows = mix(values.reshape(self.banding.bands, self.banding.rows))
        out = np.arange(1, self.banding.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for r in range(self.banding.rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
        return out.view(np.int64)


def similar_pairs(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray | None, threshold: float, first: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a band and reach the threshold: of the two sides, or within the whole where ``side`` is None.

    With ``first``, only pairs for which that band is the first shared one; a band of 0 is shared with nothing.
    """
    n = len(sets)
    a = np.arange(n) if side is None else np.flatnonzero(side == 0)
    b = a if side is None else np.flatnonzero(side == 1)
    sizes = np.array([len(s) for s in sets])
    left, right = [], []
    if len(a) and len(b):
        for low in range(0, len(a), 256):
            rows = a[low : low + 256]
            share = np.zeros((len(rows), len(b)), bool)
            for k in range(bands.shape[1] if first < 0 else first):
                share |= (bands[rows, k][:, None] == bands[b, k][None, :]) & (bands[rows, k] != 0)[:, None]
            if first >= 0:
                share = ~share
            # no pair of sizes this far apart can reach the threshold
            small, large = np.minimum.outer(sizes[rows], sizes[b]), np.maximum.outer(sizes[rows], sizes[b])
            i, j = np.nonzero(share & (small >= threshold * large - 1e-9))
            i, j = rows[i], b[j]
            keep = i < j if side is None else np.ones(len(i), bool)
            left.append(i[keep])
            right.append(j[keep])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return i, j
    # shingles as small numbers; a set meets many others, so it is marked once and the others are looked up
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    good = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order])) + 1
    for run in np.split(order, cuts):
        own = codes[ends[i[run[0]]] : ends[i[run[0]] + 1]]
        mark[own] = True
        for part in np.array_split(run, max(1, int(sizes[j[run]].sum()) >> 20)):
            others = j[part]
            spans = np.concatenate([codes[ends[k] : ends[k + 1]] for k in others.tolist()])
            at = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
            common = np.add.reduceat(mark[spans].astype(np.int64), at)
            union = len(own) + sizes[others] - common
            good[part] = common >= threshold * union - 1e-9
        mark[own] = False
    return i[good], j[good]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    from lodestone.llm.embedding_dedup import forest

    return forest(n, i, j)


SIGNATURE = "doc_id long, digest binary, n_shingles long, bands array<long>"
#: A group of classes that are compared: a bucket, by the band's position and hash, or a small cluster (position -1), and its blocks.
UNIT = "struct<at:int,band:bigint,blocks:bigint>"


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, banding: Banding | None = None) -> DataFrame:
    """``doc_id, digest, n_shingles, bands`` of each document; the digest tells sets apart (128 bits of BLAKE2b)."""
    ship(docs.sparkSession)
    banding = banding or choose_banding()

    def run(batches):
        import pyarrow as pa

        hold("ngram_join")
        shingler, hasher = Shingler(words), MinHasher(banding)
        for batch in batches:
            digests, counts, bands = [], [], []
            for texts in by_bytes(x or "" for x in batch.column(1).to_pylist()):
                for s in shingler.sets(texts):
                    digests.append(_digest(s))
                    counts.append(len(s))
                    bands.append(hasher.bands(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_shingles", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNATURE)


def _digests(words: int, text: int):
    """Adds to rows the digest of the set of the text at that place."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for batch in batches:
            found = [_digest(s) for some in by_bytes(x or "" for x in batch.column(text).to_pylist()) for s in shingler.sets(some)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "digest"])

    return run


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, set_id, n_links, class_id, kept``.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at least ``threshold``.
    ``set_id`` is the smallest id with the very same set, ``n_links`` the number of other documents linked directly (copies
    count each), ``class_id`` the smallest id reachable by links, ``kept`` whether that is the document's own. A null text, and
    one without words, links with nothing. Repeated rows of an id are rows of their own: copies of each other where their sets are equal,
    else linked or not like any two. A null id links with nothing. Other columns are not read; an empty table gives an empty one. A pair at the threshold is found with probability
    ``recall``, a closer one with more; what is found is verified on the full sets.
    """
    return _verdicts(docs, doc_id, text, words, threshold, recall, block).drop("digest", "group")


def _verdicts(docs: DataFrame, doc_id: str, text: str, words: int, threshold: float, recall: float, block: int) -> DataFrame:
    """What ``jaccard_join`` returns, with the ``digest`` of a row's set and a number of its ``group`` (null where it cannot link)."""
    banding = choose_banding(threshold, recall)
    give_back()
    signed = save(signatures(docs, doc_id, text, words, banding), "signatures")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    # a class has a number of its own: an id that comes with several texts stands for several classes
    classes = save(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("class", F.posexplode("bands").alias("at", "band"))
    hubs = save(buckets.groupBy("at", "band").agg(F.min("class").alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).where("n > 1"), "hubs")
    most = classes.count() * banding.bands
    stars = join_least(buckets.select("class", F.struct("at", "band").alias("key")), hubs.select(F.struct("at", "band").alias("key"), "hub", "n"), "key", most)
    cluster_of = components(stars.where("class != hub").select("class", "hub"))
    names = cluster_of.select("node", F.col("component").alias("cluster")).unionByName(cluster_of.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct())
    sizes = names.groupBy("cluster").agg(F.count("*").alias("n"))
    members = save(join_least(names, sizes.withColumn("large", F.col("n") > block), "cluster", most).join(classes.withColumnRenamed("class", "node"), "node"), "members")
    # the buckets of large clusters, of those with the very same members the first
    large = members.where("large").select(F.col("node").alias("class"), F.posexplode("bands").alias("at", "band")).select("class", F.struct("at", "band").alias("key"))
    once = hubs.groupBy("x", "y", "n").agg(F.min(F.struct("at", "band")).alias("key")).select("key", "n", F.ceil(F.col("n") / F.lit(block)).cast("long").alias("blocks"))
    units = join_least(large, once, "key", most).groupBy("class").agg(F.collect_list(F.struct("key.at", "key.band", "blocks")).alias("units"))  # one for each band at most
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.col("cluster").alias("band"), F.lit(1).cast("long").alias("blocks")))
    slim = members.withColumnRenamed("node", "class").join(units, "class", "left")
    slim = slim.select("class", "rep", "digest", "size", "bands", F.when(F.col("large"), F.coalesce("units", F.array().cast(f"array<{UNIT}>"))).otherwise(whole.cast(f"array<{UNIT}>")).alias("units"))
    # of a class in a large cluster only the bands of its units are compared; 0 is no band
    kept = F.transform(F.col("bands"), lambda b, i: F.when(F.exists("units", lambda u: u["at"] == i), b).otherwise(F.lit(0)))
    slim = save(slim.withColumn("bands", F.when(F.get("units", F.lit(0))["at"] >= 0, kept).otherwise(F.col("bands"))), "slim")
    key = slim.select(F.col("rep").alias("_rep")).distinct()
    key = F.broadcast(key) if slim.count() <= BROADCAST_ROWS else key
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(key, F.col("_id") == F.col("_rep"), "left_semi")

    def reshingle(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for batch in batches:
            found: list[bytes] = []
            for some in by_bytes(x or "" for x in batch.column(1).to_pylist()):
                found.extend(s.tobytes() for s in shingler.sets(some))
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["rep", "digest", "shingles"])

    # of a class's rows the ones with its smallest id are made again; the digest tells the texts of an id apart
    sets = texts.mapInArrow(reshingle, "rep long, digest binary, shingles binary").join(slim, ["rep", "digest"])
    met = sets.select("class", "size", "bands", "shingles", F.explode("units").alias("unit"))
    own = F.when(F.col("unit.blocks") > 1, F.pmod(F.xxhash64("class"), F.col("unit.blocks"))).otherwise(F.lit(0))
    met = met.select("class", "size", "bands", "shingles", "unit.at", "unit.band", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("unit.blocks") - 1)).alias("other"))
    met = met.select("class", "size", "bands", "shingles", "at", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))

    def verify(key, group):
        import pyarrow as pa

        own, where = np.unique(group.column("class").to_numpy(), return_index=True)
        size, side = group.column("size").to_numpy()[where], group.column("side").to_numpy()[where]
        raw, lists = group.column("shingles"), group.column("bands")
        sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in where]
        bands = np.array([lists[int(k)].as_py() for k in where], np.int64)
        i, j = similar_pairs(sets, bands, None if side[0] == -1 else side, threshold, key[0].as_py())
        links = np.bincount(i, size[j], minlength=len(own)) + np.bincount(j, size[i], minlength=len(own))
        least = _forest(len(own), i, j)  # classes are in ascending order
        hit = np.flatnonzero(links > 0)
        return pa.table([pa.array(own[hit]), pa.array(links[hit].astype(np.int64)), pa.array(own[least[hit]])], names=["class", "links", "least"])

    found = save(met.groupBy("at", "band", "low", "high").applyInArrow(verify, "class long, links long, least long"), "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select("class", "least")).withColumnRenamed("node", "class")
    verdict = classes.select("digest", "class", "rep", "size").join(links, "class", "left").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # a component is called by its smallest id
    named = verdict.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    verdict = join_least(verdict, named, "component", most).select("digest", F.col("component").alias("group"), F.col("rep").alias("set_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), "class_id")
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))
    out = signed.select("doc_id", "digest", key.alias("key")).join(verdict.withColumnRenamed("digest", "key"), "key", "left")
    out = out.select("doc_id", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"), "digest", "group")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group that links join, with all its columns, whatever their names: the one of the smallest id.

    Rows that repeat an id are judged by their own texts, so that no group is lost; where a group's smallest id comes with several sets
    of shingles the one of least digest stays, once. Null ids and texts without words link with nothing and stay. An empty
    table gives an empty one.
    """
    plain, name = numbered(docs)
    verdict = save(_verdicts(docs, doc_id, text, WORDS, THRESHOLD, RECALL, BLOCK), "verdict")
    ids = F.col(name(doc_id)).cast("long")

    def listed(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    # where no id repeats, ids say what goes
    dropped = listed(save(verdict.where("not kept and doc_id is not null").select(F.col("doc_id").alias("dropped")).distinct(), "dropped"))
    twice = save(verdict.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice")), "twice")
    if not twice.limit(1).count():
        return plain.join(dropped, ids == F.col("dropped"), "left_anti").toDF(*docs.columns)
    once = plain.join(listed(twice), ids == F.col("twice"), "left_anti").join(dropped, ids == F.col("dropped"), "left_anti")
    # else a row is known by its id and the digest of its set
    several = plain.join(listed(twice), ids == F.col("twice"), "left_semi")
    digested = several.mapInArrow(_digests(WORDS, plain.columns.index(name(text))), T.StructType([*several.schema, T.StructField("digest", T.BinaryType())]))
    chosen = verdict.where("kept and n_links > 0").groupBy("group").agg(F.min(F.struct("doc_id", "digest")).alias("row")).select("row.*", F.lit(True).alias("chosen"))
    alone = verdict.where("n_links = 0 and doc_id is not null").select("doc_id", "digest", F.lit(False).alias("chosen")).distinct()
    judged = digested.join(chosen.unionByName(alone).withColumnsRenamed({"doc_id": "id", "digest": "set"}), (ids == F.col("id")) & (F.col("digest") == F.col("set")))
    kept = judged.where("not chosen").select(*plain.columns).unionByName(judged.where("chosen").dropDuplicates(["id", "set"]).select(*plain.columns))
    return once.unionByName(kept).toDF(*docs.columns)
