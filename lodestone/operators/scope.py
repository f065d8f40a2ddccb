"""Usage instructions that belong to this product: sentences carry their subject over to the next ones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of product types, to tell one product's instructions from another's. Fixed values.
TYPES = ("serum", "cream", "essence", "ampoule", "toner", "lotion", "cleanser", "mask", "oil", "sunscreen", "세럼", "크림", "에센스", "앰플", "토너", "로션", "클렌저", "마스크", "오일", "선크림")


def types_in(text: str) -> set[str]:
    t = text.lower()
    return {k for k in TYPES if k in t}


def segments(text: str) -> list[str]:
    return [s for s in (" ".join(x.split()) for x in re.split(r"(?<=[.!?。])\s+|[\n;]+", text or "")) if s]


def classify(segment: str, own: set[str], name: str) -> str:
    """current, foreign or orphan (names no product type)."""
    found = types_in(segment)
    if name and name.lower() in segment.lower() or found & own:
        return "current"
    return "foreign" if found else "orphan"


def keep_current(texts: list[str], name: str) -> list[str]:
    """Instructions about this product; a sentence without a subject goes with the last one named, over instructions too."""
    own, last, out = types_in(name), "current", []
    for t in texts:
        kept = []
        for s in segments(t):
            kind = classify(s, own, name)
            last = last if kind == "orphan" else kind
            if last == "current":
                kept.append(s)
        if kept:
            out.append(" ".join(kept))
    return out


def filter_usage(df: DataFrame, key: str, name: str, usage: str) -> DataFrame:
    """``key`` and the ``usage`` array without other products' instructions."""

    @F.pandas_udf("array<string>")
    def run(names: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([keep_current(list(u) if u is not None else [], n or "") for n, u in zip(names, lists, strict=True)])

    return df.select(key, run(F.col(name), F.col(usage)).alias(usage))


def ocr_units(text: str | None) -> list[str]:
    """Wrapped lines joined to sentences: a line goes on when it has no end mark and the next begins in lower case, or a list goes on after a comma."""
    out: list[str] = []
    for line in (" ".join(x.split()) for x in re.split(r"\r?\n", text or "")):
        if not line:
            continue
        goes_on = out and not re.search(r"[.!?。:]$", out[-1]) and (out[-1].endswith(",") or re.match(r"[a-z(,&]", line) or len(out[-1].split()) > 4 and not re.match(r"[A-Z][a-z]+:?$", line))
        if goes_on:
            out[-1] = f"{out[-1]} {line}"
        else:
            out.append(line)
    return out
