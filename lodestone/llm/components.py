"""Connected components of a link table: links are thinned where they lie; few are joined by the driver, many by alternating
large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import save

#: A key with more rows than this, and than the table's rows by ``MOST_HOT`` / 2, is hot; so at most ``MOST_HOT`` keys are.
HOT_ROWS, MOST_HOT = 256, 50_000
#: Thinned links (16 bytes each) up to which the driver joins them in arrays, some 50 MB; more go through rounds. A round of so few
#: is a dozen shuffles whose tasks hold next to nothing, and a plan of a hundred nodes that the driver keeps.
DRIVER_LINKS = 250_000


def join_least(rows: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``least``, which has one row for each key and the number ``n`` of its rows; ``total`` rows at most.

    Hot keys are few, so what is said of them is broadcast and their rows stay where they are; the others meet in a shuffle.
    """
    most = max(HOT_ROWS, 2 * total // MOST_HOT)
    hot = F.broadcast(least.where(F.col("n") > most).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(least.where(F.col("n") <= most).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def _local_forest(batches):
    """The links of one partition, thinned to a spanning forest (components stay the same)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    nodes = [n for n in parent if parent[n] != n]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["u", "v"])


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are linked and aren't their component's smallest, and that one. A turn halves the roots at least: each but the
    smallest of its neighbours goes to a smaller one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(i):
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root != (up := root[root])).any():
            root = up
        i, j = root[i], root[j]
        i, j = i[i != j], j[i != j]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node that is linked and isn't its component's smallest; that one is the component's name.

    ``edges`` has two bigint columns. Loops, repeated links, either direction and nulls are fine (a null links nothing);
    an empty table gives an empty one. Up to ``DRIVER_LINKS`` links, thinned, are joined by the driver. Rounds are joins and partial
    aggregates on node ids: no component, and no node's links, are ever gathered in a task, and each round's table is written to the
    shared folder.
    """
    a, b = edges.columns[:2]
    # the links of a partition are thinned first; what is left has as many rows as nodes at most in each
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    current = save(links.mapInArrow(_local_forest, "u long, v long"), "links")
    if current.count() <= DRIVER_LINKS:
        import pyarrow as pa

        some = current.toArrow()
        found = least_reachable(some.column("u").to_numpy(), some.column("v").to_numpy())
        made = pa.table([pa.array(x, pa.int64()) for x in found], names=["node", "component"])
        return save(current.sparkSession.createDataFrame(made, "node long, component long"), "components")
    mark = None
    for _ in range(most_rounds):
        found = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = join_least(both, least, "u", 2 * found[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_least(large, least, "u", 2 * found[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = save(small.distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
