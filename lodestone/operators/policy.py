"""Policy rules: list items of policy documents to rules, a budgeted checklist, its coverage and its layout."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.selection import rules_for_injection

#: Weights of document kinds for coverage, and the words of hard rules. Fixed values.
KIND_WEIGHTS = {"geo-research": 100, "eeat": 99, "cep": 98, "schema": 90, "best-practice": 88, "locale": 82, "terminology": 80, "official-docs": 78}
CRITICAL = r"(?iu)\b(must|never|do not|don't|only|required|forbidden|avoid|without)\b|금지|반드시|하지\s*않|말\s*것|않는다"
LEAST_CHARS, MOST_CHARS, NARRATIVE_CAP, PRIORITY = 12, 260, 0.5, 0.8


def rule_items(text: str | None) -> list[dict]:
    """List items outside code fences and tables with the headings above them; indented lines continue an item."""
    out: list[dict] = []
    trail: list[tuple[int, str]] = []
    fenced, item = False, None

    def close() -> None:
        nonlocal item
        if item:
            out.append({"heading": trail[-1][1] if trail else "General", "raw": item})
        item = None

    for line in (text or "").splitlines():
        if line.lstrip().startswith("```"):
            close()
            fenced = not fenced
        elif fenced:
            continue
        elif m := re.match(r"(#{1,6})\s+(.+?)\s*$", line):
            close()
            trail = [x for x in trail if x[0] < len(m[1])] + [(len(m[1]), m[2])]
        elif line.lstrip().startswith("|"):
            close()
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.+)$", line):
            close()
            item = m[1]
        elif item and line.strip() and re.match(r"\s{2,}", line):
            item = f"{item} {line.strip()}"
        else:
            close()
    close()
    return out


def clean_rule(raw: Column, most: int = MOST_CHARS) -> Column:
    """Markdown stripped; a longer text ends at its last full stop or semicolon in the last two fifths, with an ellipsis."""
    t = raw
    for pattern, value in ((r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, value)
    t = F.trim(t)
    head = F.substring(t, 1, most)
    at = F.length(F.regexp_extract(head, r"(?s)^(.*[.;]) ", 1))  # the last break
    cut = F.when(at - 1 > most * 0.6, F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.trim(F.concat(cut, F.lit("…"))))


def rule_prefix(document: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(document, r"(?i)\.[a-z0-9]+$", ""), r"(?i)_v\d+$", "")
    t = F.substring(F.upper(F.regexp_replace(F.regexp_replace(t, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), 1, 32)
    return F.when(t == "", "POLICY").otherwise(t)


def policy_rules(documents: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``document, id, heading, text, kind, severity, extraction, priority, kind_weight`` of each rule.

    ``documents``: ord, name, content. Only the first of equal rules over all documents stays; a document's numbers count those that
    stay. ``index`` (document, kind, extraction, priority) is joined left; without an entry a rule is custom, 0.8.
    """

    @F.pandas_udf("array<struct<heading:string,raw:string>>")
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(rule_items)

    policies = documents.where(F.col("name").rlike(r"(?i)\.(md|markdown|txt)$") | ~F.col("name").rlike(r"(?i)\.[a-z0-9]+$"))
    rows = policies.select("ord", F.col("name").alias("document"), F.posexplode(items(F.col("content"))).alias("line", "item"))
    rows = rows.select("ord", "document", "line", "item.heading", clean_rule(F.col("item.raw")).alias("text")).where(F.length("text") >= LEAST_CHARS)
    same = F.regexp_replace(F.lower("text"), "[^a-z0-9가-힣]+", "")
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(same).orderBy("ord", "line"))).where("_first = 1")
    number = F.row_number().over(Window.partitionBy("ord", "document").orderBy("line"))
    rows = rows.withColumn("id", F.concat(rule_prefix(F.col("document")), F.lit("-"), F.lpad(number.cast("string"), 3, "0")))
    if index is None:
        rows = rows.withColumns({"kind": F.lit("custom"), "extraction": F.lit("rules"), "base": F.lit(PRIORITY)})
    else:
        rows = rows.join(index.select("document", "kind", "extraction", F.col("priority").alias("base")), "document", "left")
        rows = rows.withColumns({"kind": F.coalesce("kind", F.lit("custom")), "extraction": F.coalesce("extraction", F.lit("rules")), "base": F.coalesce("base", F.lit(PRIORITY))})
    told = F.col("extraction") == "narrative"
    weight = F.lit(0)
    for k, v in KIND_WEIGHTS.items():
        weight = F.when(F.col("kind") == k, v).otherwise(weight)
    severity = F.when(~told & F.col("text").rlike(CRITICAL), "critical").otherwise("guidance")
    return rows.select("document", "id", "heading", "text", "kind", severity.alias("severity"), "extraction", F.when(told, F.least("base", F.lit(NARRATIVE_CAP))).otherwise(F.col("base")).alias("priority"), weight.alias("kind_weight"))


def coverage(rules: DataFrame, injected: DataFrame) -> DataFrame:
    """Conditional counts per document and in total (document null), with the share of critical rules that are injected (1 without any)."""
    marked = rules.join(injected.select("id").distinct().withColumn("_in", F.lit(1)), "id", "left")
    inside, critical = F.col("_in") == 1, F.col("severity") == "critical"
    counts = marked.rollup("document").agg(
        F.count("*").alias("total_rules"), F.count_if(inside).alias("injected_rules"), F.count_if(critical).alias("critical_rules"), F.count_if(critical & inside).alias("injected_critical_rules"), F.count_if(F.col("extraction") == "narrative").alias("narrative_rules")
    )
    return counts.withColumn("critical_ratio", F.when(F.col("critical_rules") == 0, 1.0).otherwise(F.col("injected_critical_rules") / F.col("critical_rules")))


def field_group(targets: Column) -> Column:
    public = F.filter(targets, lambda t: ~t.isin("diagnostics", "retrieval"))
    return F.when((F.size(public) == 0) | (F.size(public) > 2), "General / cross-field").otherwise(F.array_join(public, " & "))


def checklist(rules: DataFrame) -> DataFrame:
    """``field, lines``: rules by field group, critical ones first, then by priority."""
    line = F.concat(F.lit("["), "id", F.lit("]["), F.when(F.col("extraction") == "narrative", "brand-context").otherwise(F.col("severity")), F.lit("] "), "text", F.lit(" ("), "document", F.lit(" § "), "heading", F.lit(")"))
    each = F.struct(F.when(F.col("severity") == "critical", 0).otherwise(1).alias("s"), (-F.col("priority")).alias("p"), "id", line.alias("line"))
    return rules.groupBy(field_group(F.col("targets")).alias("field")).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["line"]).alias("lines"))


def compile_policy(documents: DataFrame, index: DataFrame | None = None, budget: int = 240) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rules, the injected ones and the coverage."""
    rules = policy_rules(documents, index)
    injected = rules_for_injection(rules, budget)
    return rules, injected, coverage(rules, injected)
