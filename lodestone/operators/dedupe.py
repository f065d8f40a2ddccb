"""First-wins deduplication by keys, and order-dependent merges inside a document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def first_wins(df: DataFrame, key: Column | list[Column], *order: str, within: list[str] | None = None) -> DataFrame:
    """The first row in order of each key, inside the ``within`` columns (over the whole table without them)."""
    keys = [F.col(c) for c in within or []] + (key if isinstance(key, list) else [key])
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


# the keys under which things count as the same
def keyword_key(category: Column, keyword: Column) -> Column:
    return F.concat(category, F.lit(":"), F.lower(keyword))


def faq_key(question: Column, answer: Column) -> Column:
    return T.fingerprint(F.concat(question, F.lit(":"), answer))


def section_key(category: Column, text: Column) -> Column:
    return F.concat(category, F.lit(":"), T.fingerprint(text))


def insight_key(category: Column, text: Column) -> Column:
    return F.concat(category, F.lit(":"), F.substring(T.fingerprint(text), 1, 160))


def block_key(title: Column, text: Column) -> Column:
    return T.fingerprint(F.concat(title, F.lit(":"), text))


def question_key(question: Column, answer: Column) -> Column:
    return F.lower(F.concat(question, F.lit("\n"), answer))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def comparison(text: str) -> str:
    return re.sub(r"[\W_]+", "", " ".join(text.split()).lower())


def join_overlapping(first: str, second: str, most_lines: int = 12, least_chars: int = 20) -> str | None:
    """Both texts in one where the first's last lines are the second's first ones (longest match, 20 letters at least)."""
    a, b = first.split("\n"), second.split("\n")
    for n in range(min(most_lines, len(a), len(b)), 0, -1):
        tail, head = comparison("".join(a[-n:])), comparison("".join(b[:n]))
        if tail == head and len(tail) >= least_chars:
            return "\n".join(a + b[n:])
    return None


def absorb(texts: list[str]) -> list[str]:
    """Each text joins the first kept one that equals, contains, is contained in or overlaps it; the longer text stays."""
    kept: list[str] = []
    for t in texts:
        key = comparison(t)
        for i, k in enumerate(kept):
            other = comparison(k)
            if key and (key in other or other in key):
                kept[i] = t if len(key) > len(other) else k
                break
            if joined := join_overlapping(k, t) or join_overlapping(t, k):
                kept[i] = joined
                break
        else:
            kept.append(t)
    return kept


def absorb_texts(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``key, ord, text`` of what is left of each document's texts; order-dependent, so a document is one task's work."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept = absorb(group.sort_values(order)[text].fillna("").tolist())
        return pd.DataFrame({key: [group[key].iloc[0]] * len(kept), "ord": range(len(kept)), text: kept})

    kind = dict(df.dtypes)[key]
    return df.select(key, order, text).groupBy(key).applyInPandas(run, f"{key} {kind}, ord long, {text} string")


def dedupe_by_intent(df: DataFrame, key: str, order: str, question: str, intents: str, preference: str) -> DataFrame:
    """Questions that equal an earlier one or share an intent with it: the preferred of both takes the earlier's place."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in group.sort_values(order).to_dict("records"):
            name, mine = comparison(row[question] or ""), set(row[intents] if row[intents] is not None else ())
            for i, k in enumerate(kept):
                if comparison(k[question] or "") == name or mine & set(k[intents] if k[intents] is not None else ()):
                    if row[preference] > k[preference]:
                        kept[i] = row
                    break
            else:
                kept.append(row)
        out = pd.DataFrame(kept, columns=group.columns)
        out["place"] = range(len(out))
        return out

    return df.groupBy(key).applyInPandas(run, df.withColumn("place", F.lit(0).cast("long")).schema)
