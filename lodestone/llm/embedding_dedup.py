"""Near-duplicate embeddings by PCA-ordered tiled comparison.

1. Equal vectors become one class (a partial aggregate), so a vector that a third of the rows share is compared once.
2. A PCA basis is fitted on a bounded sample. It is a rotation: it orders dimensions, and any basis gives the same links.
3. A k-d tree over the sample's leading dimensions cuts the space into tiles of bounded size; oversized ones are split by hash.
   Two tiles whose boxes are too far apart to hold a link are never compared; which are near is a join of the boxes on cells of the
   two leading dimensions, so neither tiles nor their pairs are ever gathered in the driver.
4. Of the remaining pairs of tiles, dot products grow by blocks of leading dimensions; after each block a pair of vectors is
   dropped when even the product of the remaining norms cannot lift its cosine to the threshold.
5. A task returns, for each vector, a count of links and a spanning forest, not the pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, join_least
from lodestone.llm.runtime import save, ship

THRESHOLD = 0.95
#: Vectors that the basis and the tree are fitted on, at most.
SAMPLE = 20_000
#: Classes in a tile, on average, leaves of the tree at most (beyond that its leaves are cut by hash), and dimensions that the tree and
#: the boxes use. Larger tiles are sent less often, smaller ones give more tasks; two of them are 4 MB of 64 dimensions.
TILE, MOST_LEAVES, BOX_DIMS = 4096, 4096, 8
#: Rounding room: pairs this close to the threshold are decided by the dot product of the vectors themselves, scaled to unit length.
ROOM = 1e-9


class Projection:
    """The rotation and the tiles."""

    def __init__(self, sample: np.ndarray, leaves: int):
        d = sample.shape[1] if sample.size else 0
        if len(sample) > 1:
            _, vectors = np.linalg.eigh(np.cov(sample.T).reshape(d, d))
            self.basis = np.ascontiguousarray(vectors[:, ::-1])
        else:
            self.basis = np.eye(d)
        self.splits: list[tuple[int, float] | None] = []
        self._grow(sample @ self.basis if sample.size else sample, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> None:
        """A heap of splits: node k has children 2k+1 and 2k+2; each splits its widest leading dimension at the median."""
        self.depth = max(0, (leaves - 1).bit_length())
        level = [points]
        for _ in range(self.depth):
            below = []
            for p in level:
                if len(p) < 2:
                    self.splits.append((0, 0.0))
                    below += [p, p]
                    continue
                lead = p[:, :BOX_DIMS]
                k = int(np.argmax(lead.max(axis=0) - lead.min(axis=0)))
                cut = float(np.median(lead[:, k]))
                self.splits.append((k, cut))
                below += [p[lead[:, k] < cut], p[lead[:, k] >= cut]]
            level = below

    def leaf(self, rotated: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rotated), np.int64)
        if self.depth:
            dims, cuts = (np.array(x) for x in zip(*self.splits, strict=True))
            for _ in range(self.depth):
                right = rotated[np.arange(len(rotated)), dims[node]] >= cuts[node]
                node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def unit_rows(flat: np.ndarray) -> np.ndarray:
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def linked_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float = THRESHOLD, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of unit vectors with cosine at least ``threshold``, dimensions in the basis's order."""
    ra, rb = a @ basis, b @ basis
    d = ra.shape[1]
    steps = sorted({min(d, s) for s in (8, 16, 32, d)})
    suffix = lambda r, s: np.sqrt(np.einsum("ij,ij->i", r[:, s:], r[:, s:]))
    ends = [(suffix(ra, s), suffix(rb, s)) for s in steps]
    left, right = [], []
    for low in range(0, len(ra), rows):
        block = ra[low : low + rows]
        part = block[:, : steps[0]] @ rb[:, : steps[0]].T
        i, j = np.nonzero(part + np.outer(ends[0][0][low : low + rows], ends[0][1]) >= threshold - ROOM)
        score = part[i, j]
        for before, (s, (ea, eb)) in zip(steps, list(zip(steps, ends, strict=True))[1:], strict=False):
            for cut in range(0, len(i), 1 << 18):  # bounded memory where many pairs go on
                piece = slice(cut, cut + (1 << 18))
                score[piece] += np.einsum("ij,ij->i", block[i[piece], before:s], rb[j[piece], before:s])
            keep = score + ea[low + i] * eb[j] >= threshold - ROOM
            i, j, score = i[keep], j[keep], score[keep]
        close = np.abs(score - threshold) <= 2 * ROOM
        sure = score >= threshold
        if close.any():
            sure[close] = np.einsum("ij,ij->i", a[low + i[close]], b[j[close]]) >= threshold
        left.append(low + i[sure])
        right.append(j[sure])
    return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n``, by passing labels along the links until they settle."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors are linked when their cosine in double precision is at least ``threshold``. ``n_links`` counts the other vectors
    linked directly, copies included; ``component_id`` is the smallest ``vec_id`` reachable by links, itself included; ``kept`` says
    whether it is that one. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of another length than the commonest. Repeated rows of an id are rows of their own, each with the links of its vector. A
    row without id links with nothing and has a null ``component_id``. Other columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    # powers of ten apart from 1 would lose their squares; a scaled vector has the same direction
    scaled = F.transform(e, lambda x: x / F.array_max(F.transform(e, lambda y: F.abs(y))))
    rows = rows.withColumn("embedding", F.when(e.isNotNull() & finite, e))
    rows = rows.withColumn("embedding", F.when(e.isNotNull(), scaled))
    common = rows.where(e.isNotNull()).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = common[0]["n"] if common else 0
    own = save(rows.withColumn("embedding", F.when(F.size("embedding") == dims, e)), "vectors")
    # identical vectors are one class; it has a number of its own, as an id may come with several vectors
    classes = own.where(e.isNotNull() & F.col("vec_id").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = save(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share) + 1)).select("embedding").limit(SAMPLE).collect() if n else []
    projection = Projection(unit_rows(np.array([r[0] for r in drawn], float)) if drawn else np.zeros((0, dims)), min(MOST_LEAVES, -(-n // tile)))
    sent = spark.sparkContext.broadcast(projection)  # dims squared, and a number for each of at most MOST_LEAVES leaves

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            turned = unit_rows(flat) @ sent.value.basis if batch.num_rows else np.zeros((0, BOX_DIMS))
            leaf = sent.value.leaf(turned) if batch.num_rows else np.zeros(0, np.int64)
            packed = pa.array([x.tobytes() for x in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), packed, pa.array(leaf), pa.array(turned[:, :BOX_DIMS].tolist(), pa.list_(pa.float64()))], names=["class", "size", "vector", "leaf", "lead"])

    placed = save(classes.select("embedding", "class", "size").mapInArrow(place, "class long, size long, vector binary, leaf long, lead array<double>"), "placed")
    # dense leaves are cut by hash into tiles of about the same size
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(1.5 * tile)).cast("long").alias("cuts"))
    tiled = placed.join(F.broadcast(counts), "leaf").withColumn("tile", F.struct("leaf", F.pmod(F.xxhash64("class"), F.col("cuts")).alias("part")))
    lead = min(BOX_DIMS, dims)
    box = [f(F.element_at("lead", k + 1)).alias(f"{name}{k}") for k in range(lead) for f, name in ((F.min, "low"), (F.max, "high"))]
    tiles = save(tiled.groupBy("tile").agg(F.count("*").alias("n"), *box), "tiles")  # a row for each tile of vectors
    # two unit vectors with that cosine are no further apart, so neither are their boxes
    apart = math.sqrt(2 * (1 - threshold) + 1e-7)
    grid = [f"cell{k}" for k in range(min(2, lead))]
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / apart), F.floor(high / apart)))
    one, two = tiles, tiles.toDF(*[f"{c}_" for c in tiles.columns])
    for k, cell in enumerate(grid):
        one = one.withColumn(cell, cells(F.col(f"low{k}"), F.col(f"high{k}")))
        two = two.withColumn(cell, cells(F.col(f"low{k}_") - apart, F.col(f"high{k}_") + apart))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"low{k}_") - F.col(f"high{k}"), F.col(f"low{k}") - F.col(f"high{k}_")), 2) for k in range(lead)), F.lit(0.0))
    near = one.join(two, grid or F.lit(False)).where((F.col("tile") <= F.col("tile_")) & (gap <= apart * apart))
    near = save(near.select(F.col("tile").alias("a"), F.col("tile_").alias("b")).distinct().withColumn("pair", F.monotonically_increasing_id()), "near")
    meets = near.select(F.col("a").alias("tile"), "pair", F.lit(0).alias("side")).unionByName(near.where("a != b").select(F.col("b").alias("tile"), "pair", F.lit(1).alias("side")))
    meets = meets.groupBy("tile").agg(F.collect_list(F.struct("pair", "side")).alias("meets"), F.count("*").alias("n"))  # the tiles near one, not vectors

    def compare(key, group):
        import pyarrow as pa

        rep, size = group.column("class").to_numpy(), group.column("size").to_numpy()
        x = unit_rows(np.frombuffer(b"".join(group.column("vector").to_pylist()), float).reshape(len(rep), -1))
        side = group.column("side").to_numpy() == 1
        both = side.any()
        a, b = (np.flatnonzero(~side), np.flatnonzero(side)) if both else (np.arange(len(rep)),) * 2
        i, j = linked_pairs(x[a], x[b], sent.value.basis, threshold)
        i, j = a[i], b[j]
        if not both:  # a tile with itself: each pair comes twice, and each vector with itself
            i, j = i[i != j], j[i != j]
        links = np.bincount(i, size[j], minlength=len(rep))
        if both:
            links += np.bincount(j, size[i], minlength=len(rep))
        order = np.argsort(rep, kind="stable")
        rank = np.argsort(order, kind="stable")
        label = order[forest(len(rep), rank[i], rank[j])][rank]
        hit = np.flatnonzero(links > 0)
        return pa.table([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(rep[label[hit]])], names=["class", "links", "least"])

    sides = tiles.select("tile", "n").join(meets.drop("n"), "tile").select("tile", "n", "meets")
    met = join_least(tiled.select("tile", "class", "size", "vector"), sides, "tile", n).select("class", "size", "vector", F.explode("meets").alias("meet"))
    met = met.select("class", "size", "vector", "meet.pair", "meet.side")
    found = save(met.groupBy("pair").applyInArrow(compare, "class long, links long, least long"), "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select("class", "least")).withColumnRenamed("node", "class")
    verdict = classes.join(links, "class", "left").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # a component is called by its smallest id
    named = verdict.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    verdict = join_least(verdict, named, "component", n).select("embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = own.withColumn("key", F.when(F.col("vec_id").isNotNull(), e)).join(verdict.withColumnRenamed("embedding", "key"), "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
