"""Rankings, quotas and selections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import web as H


def quota_round_robin(df: DataFrame, key: str, role: str, order: str, quotas: dict[str, int], limit: int, default: int = 1) -> DataFrame:
    """Each role's first rows up to its quota, role by role in turns, then the others by order; the first ``limit`` of a key, with their place."""
    quota = F.lit(default)
    for name, n in quotas.items():
        quota = F.when(F.col(role) == name, n).otherwise(quota)
    rank = F.row_number().over(Window.partitionBy(key, role).orderBy(order))
    rows = df.withColumn("role_rank", rank)
    inside = F.col("role_rank") <= quota
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(inside), F.when(inside, F.col("role_rank")).otherwise(0), order))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def protected_sources(df: DataFrame, key: str, source: str, score: str, order: str, flag: Column) -> DataFrame:
    """The best row of each flagged source."""
    w = Window.partitionBy(key, source).orderBy(F.desc(score), order)
    return df.where(flag).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Penalties of a candidate for each selected row: same source, same kind, shared targets, shared intents. Fixed values.
PENALTY = (0.06, 0.04, 0.06, 0.04)


def _ratio(a: list, b: list) -> float:
    return len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5 if len(a) and len(b) else 0.0


def diverse(rows: list[dict], k: int, first: list[int] = ()) -> list[int]:
    """Positions in the order of choice: each time the best of score minus penalties, the earliest of equal ones; ``first`` are chosen before."""
    left, chosen = list(range(len(rows))), []
    cost = [0.0] * len(rows)
    while left and len(chosen) < max(k, len(first)):
        best = first[len(chosen)] if len(chosen) < len(first) else max(left, key=lambda i: (round(rows[i]["score"] - cost[i], 12), -i))
        left.remove(best)
        chosen.append(best)
        b = rows[best]
        for i in left:
            r = rows[i]
            cost[i] += PENALTY[0] * (r["source"] == b["source"]) + PENALTY[1] * (r["kind"] == b["kind"]) + PENALTY[2] * _ratio(r["targets"], b["targets"]) + PENALTY[3] * _ratio(r["intents"], b["intents"])
    return chosen


def diverse_select(df: DataFrame, key: str, order: str, k: int, block: int = 4096) -> DataFrame:
    """Greedy diversity over all candidates of each key (columns score, source, kind, targets, intents), with the place of choice.

    Rows of one source, kind, targets and intents have equal penalties, so only the first k of them can be chosen. A key of more
    than ``block`` such rows is dealt to blocks and chosen from in k rounds, each of which reduces the blocks to their best row.
    """
    same = Window.partitionBy(key, "source", "kind", "targets", "intents").orderBy(F.desc(F.round("score", 12)), order)
    best = df.withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k).drop("_rn")
    counts = best.groupBy(key).agg(F.count("*").alias("_n"))
    large = [r[key] for r in counts.where(F.col("_n") > block).select(key).collect()]
    fields = best.withColumn("place", F.lit(0).cast("long")).schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order).reset_index(drop=True)
        listed = group.assign(targets=[list(x) if x is not None else [] for x in group["targets"]], intents=[list(x) if x is not None else [] for x in group["intents"]])
        chosen = diverse(listed.to_dict("records"), k)
        return group.iloc[chosen].assign(place=range(1, len(chosen) + 1))

    if not large:
        return best.groupBy(key).applyInPandas(run, fields)
    many = best.sparkSession.createDataFrame([(x,) for x in large], best.select(key).schema)
    is_large = F.col(key).eqNullSafe(F.col("_large"))
    mark = F.broadcast(many.select(F.col(key).alias("_large")))  # keys of more than a block of rows
    few = best.join(mark, is_large, "left_anti").groupBy(key).applyInPandas(run, fields)
    left = best.join(mark, is_large, "left_semi")
    row = F.struct(*[F.col(c) for c in best.columns])
    chosen = many.withColumn("_chosen", F.array().cast(T.ArrayType(T.StructType(best.schema.fields))))
    for _ in range(k):
        now = left.join(F.broadcast(chosen.select(F.col(key).alias("_large"), "_chosen")), is_large)
        now = now.where(~F.exists("_chosen", lambda c: c[order].eqNullSafe(F.col(order))))
        cost = F.aggregate("_chosen", F.lit(0.0), lambda s, c: s + _penalty(c))
        # the best of a key is the best of its partitions' best
        top = now.groupBy("_large").agg(F.min_by(row, F.struct(-F.round(F.col("score") - cost, 12), F.col(order))).alias("_next"))
        chosen = chosen.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("_large")), "left")
        chosen = chosen.select(key, F.when(F.col("_next").isNull(), F.col("_chosen")).otherwise(F.concat("_chosen", F.array("_next"))).alias("_chosen"))
        chosen = chosen.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # k rows a large key
    placed = chosen.select(F.posexplode("_chosen").alias("_at", "_row")).select("_row.*", (F.col("_at") + 1).cast("long").alias("place"))
    return few.unionByName(placed)


def _penalty(c: Column) -> Column:
    """What a candidate loses for a chosen row."""

    def ratio(name: str) -> Column:
        a, b = F.coalesce(F.col(name), F.array()), F.coalesce(c[name], F.array())
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double")))

    same = lambda name: F.coalesce((F.col(name) == c[name]).cast("double"), F.lit(0.0))
    return PENALTY[0] * same("source") + PENALTY[1] * same("kind") + PENALTY[2] * ratio("targets") + PENALTY[3] * ratio("intents")


def final_selection(df: DataFrame, key: str, order: str, k: int, kinds: list[str], protected: Column) -> DataFrame:
    """Protected rows, then the best unprotected one of each kind in the given order, then by greedy diversity, until k rows beside the
    protected are chosen. Columns score and kind, and source, targets and intents where penalties are to count them.
    """
    alike = [c for c in ("source", "kind", "targets", "intents") if c in df.columns]
    kept = F.coalesce(protected, F.lit(False))
    rows = df.withColumn("_kept", kept)
    # rows of one combination have equal penalties: only the first k can be chosen
    place = F.row_number().over(Window.partitionBy(key, "_kept", *alike).orderBy(F.desc("score"), order))
    rows = rows.withColumn("_rn", place).where(F.col("_kept") | (F.col("_rn") <= k)).drop("_rn")
    fields = df.withColumns({"tier": F.lit(0), "place": F.lit(0)}).schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", order], ascending=[False, True], kind="stable").reset_index(drop=True)
        listed = [
            {"score": r["score"], "kind": r["kind"], "source": r.get("source", i), **{c: list(r[c]) if r.get(c) is not None else [] for c in ("targets", "intents")}}
            for i, r in enumerate(group.to_dict("records"))
        ]
        safe = [i for i, x in enumerate(group["_kept"]) if x]
        first: list[int] = []
        for kind in kinds:
            best = next((i for i, r in enumerate(listed) if r["kind"] == kind and not group["_kept"][i] and i not in first), None)
            if best is not None and len(first) < k:
                first.append(best)
        chosen = diverse(listed, k + len(safe), safe + first)
        n, m = len(safe), len(first)
        tiers = [0] * n + [1] * m + [2] * (len(chosen) - n - m)
        places = [*range(1, n + 1), *range(1, len(chosen) - n + 1)]
        return group.iloc[chosen].drop(columns="_kept").assign(tier=tiers, place=places)

    return rows.groupBy(key).applyInPandas(run, fields)


def rules_for_injection(df: DataFrame, budget: int = 240) -> DataFrame:
    """Policy rules within a budget: one of each document, then critical ones, then the rest, by kind weight, priority, document, id.

    Columns: document, id, severity, kind_weight, priority.
    """
    cover = [F.desc("kind_weight"), F.desc("priority"), F.col("document"), F.col("id")]
    first = F.row_number().over(Window.partitionBy("document").orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), *cover))
    rows = df.withColumn("_tier", F.when(first == 1, 0).when(F.col("severity") == "critical", 1).otherwise(2))
    return rows.orderBy("_tier", *cover).limit(budget).withColumnRenamed("_tier", "tier")  # the limit is the feature


def ocr_targets(df: DataFrame, key: str, url: str, score: str, order: str, most: int = 24) -> DataFrame:
    """The widest, best, earliest variant of each image; the best ``most`` of those, in page order."""
    width = H.image_width(F.col(url))
    variant = Window.partitionBy(key, H.image_key(F.col(url))).orderBy(F.desc("_width"), F.desc(score), order)
    one = df.withColumn("_width", width).withColumn("_rn", F.row_number().over(variant)).where("_rn = 1")
    best = one.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order))).where(F.col("_place") <= most)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("_width", "_rn", "_place")


def argmax(candidates: Column) -> Column:
    """The value of the highest score, the first of equal ones; ``array<struct<score, value>>``, null values do not count."""
    ranked = F.transform(F.filter(candidates, lambda c: c["value"].isNotNull()), lambda c, i: F.struct(c["score"].alias("s"), (-i).alias("i"), c["value"].alias("v")))
    return F.array_max(ranked)["v"]


def bucket_first(df: DataFrame, key: str, category: str, order: str, most: int = 12) -> DataFrame:
    """The first rows of each category."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key, category).orderBy(order))).where(F.col("rank") <= most)
