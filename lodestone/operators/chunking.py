"""Splitters and chunkers: one row to many, with stable ordinals.

Greedy packings are folds over arrays (``aggregate``): sequential, yet inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

STATE = "struct<done:array<string>,now:string>"


def pack(pieces: Column, most: int, joint: str = " ") -> Column:
    """Pieces joined in order to chunks of at most ``most`` characters; a longer piece stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")).cast(STATE)

    def step(s: Column, x: Column) -> Column:
        longer = F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(joint), x))
        over = (F.length(longer) > most) & (s["now"] != "")
        return F.struct(F.when(over, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(over, x).otherwise(longer).alias("now"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def sentence_chunks(text: Column, most: int = 920) -> Column:
    """Cleaned sentences packed; only the last chunk is cut to the limit, longer sentences before it pass."""
    cut = T.sentences(text)
    chunks = pack(F.when(F.size(cut) > 0, cut).otherwise(F.array(text)), most)
    last = F.size(chunks) - 1
    return F.transform(chunks, lambda x, i: F.when(i == last, F.substring(x, 1, most)).otherwise(x))


def evidence_chunks(text: Column, most: int = 700) -> Column:
    """Collapsed text whole if it is short enough, else its sentences packed; a long sentence stays whole."""
    body = T.clean_text(text)
    cut = F.split(body, r"(?<=[.!?。！？])\s+")
    return F.when(F.length(body) <= most, F.array(body)).otherwise(pack(cut, most))


def explode_chunks(df: DataFrame, chunks: Column, key: str, text: str = "text") -> DataFrame:
    """``key, chunk_no`` (from 1)``, chunk_id`` (``key:chunk:n``) and the text."""
    rows = df.select(F.col(key), F.posexplode(chunks).alias("pos", text))
    return rows.select(key, (F.col("pos") + 1).alias("chunk_no"), F.concat(F.col(key).cast("string"), F.lit(":chunk:"), (F.col("pos") + 1).cast("string")).alias("chunk_id"), text)


def evidence_chunk_rows(df: DataFrame, key: str, text: str = "text", title: Column | None = None) -> DataFrame:
    """Evidence chunks with the keywords of title and text."""
    made = explode_chunks(df.withColumn("_title", F.coalesce(title if title is not None else F.lit(""), F.lit(""))), evidence_chunks(F.col(text)), key, "chunk_text")
    titles = df.select(key, F.coalesce(title if title is not None else F.lit(""), F.lit("")).alias("_title")) if title is not None else None
    made = made.join(titles, key) if titles is not None else made.withColumn("_title", F.lit(""))
    return made.withColumn("keywords", T.keywords(F.concat("_title", F.lit(" "), "chunk_text"))).drop("_title")


# markdown


def _long_paragraph(text: str, most: int) -> Iterator[str]:
    """Cuts behind the last space, comma or closing bracket in the last two fifths of the window, else hard."""
    rest = text.strip()
    while len(rest) > most:
        at = max(rest.rfind(c, 0, most + 1) for c in " ,}]")
        at = at + 1 if at >= int(most * 0.6) else most
        yield rest[:at].strip()
        rest = rest[at:].strip()
    if rest:
        yield rest


def _fit(text: str, most: int) -> Iterator[str]:
    import re

    if len(text) <= most:
        yield text
        return
    now = ""
    for paragraph in re.split(r"\n{2,}", text):
        if len(paragraph) > most:
            if now.strip():
                yield now.strip()
            now = ""
            yield from _long_paragraph(paragraph, most)
        elif len(f"{now}\n\n{paragraph}") > most and now.strip():
            yield now.strip()
            now = paragraph
        else:
            now = "\n\n".join(x for x in (now, paragraph) if x)
    if now.strip():
        yield now.strip()


def markdown_sections(text: str | None, most: int | None = 1100) -> list[tuple[str | None, str | None, str]]:
    """``(title, heading path, text)`` at headings of level 1 to 3, the heading line inside; a JSON document is one section."""
    import re

    body = (text or "").replace("\r\n", "\n").strip()
    if not body:
        return []
    found: list[tuple[str | None, str | None, str]] = []
    if body.startswith("{"):
        found = [("JSON terminology map",) * 2 + (body,)]
        return found
    title = path = None
    trail: list[str | None] = []
    lines: list[str] = []

    def close() -> None:
        if whole := "\n".join(lines).strip():
            found.extend((title, path, part) for part in (_fit(whole, most) if most else [whole]))

    for line in body.split("\n"):
        if m := re.match(r"(#{1,3})\s+(.+)$", line):
            close()
            level, title = len(m[1]), m[2].strip()
            trail = (trail + [None] * 3)[: level - 1] + [title]
            path = " > ".join(x for x in trail if x)
            lines = [line]
        else:
            lines.append(line)
    close()
    return found


def split_markdown(df: DataFrame, key: str, text: str, most: int | None = 1100) -> DataFrame:
    """``key, section_no, title, heading_path, text`` of each section; without a limit long sections stay whole."""

    @F.pandas_udf("array<struct<title:string,heading_path:string,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"title": a, "heading_path": b, "text": c} for a, b, c in markdown_sections(t, most)])

    rows = df.select(key, F.posexplode(cut(F.col(text))).alias("section_no", "s"))
    return rows.select(key, "section_no", "s.title", "s.heading_path", "s.text")


# batches


def budget_batches(df: DataFrame, key: str, order: str, size: Column, budget: int = 14_000) -> DataFrame:
    """``key, order, batch``: rows with the number of their batch (from 0): a group's rows in order, a new batch when the running size would pass the budget.

    Where a batch begins depends on all rows before it, so a group is one task's work; it is read in order, and only a sum is kept.
    """
    kinds = dict(df.dtypes)

    def run(batches):
        import pyarrow as pa

        now, used, batch = object(), 0, 0
        for b in batches:
            out = []
            for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now:
                    now, used, batch = k, 0, 0
                elif used + n > budget and used > 0:
                    used, batch = 0, batch + 1
                used += n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=[key, order, "batch"])

    rows = df.select(key, order, F.coalesce(size.cast("long"), F.lit(0)).alias("_size")).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, batch long")


def kind_batches(df: DataFrame, key: str, order: str, kind: str, limits: dict[str, int]) -> DataFrame:
    """Rows with a batch number: runs of one kind, each cut to the kind's limit; kinds are never mixed."""
    w = Window.partitionBy(key).orderBy(order)
    runs = df.withColumn("_new", (F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)) - 1
    limit = F.when(F.lit(False), 1)
    for k, n in limits.items():
        limit = limit.when(F.col(kind) == k, n)
    runs = runs.withColumn("_part", F.floor(place / limit.otherwise(1)))
    return runs.withColumn("batch", F.dense_rank().over(Window.partitionBy(key).orderBy("_run", "_part")) - 1).drop("_new", "_run", "_part")


def slice_plan(df: DataFrame, height: str, width: str) -> DataFrame:
    """Images higher than 2048 px and three times their width get up to 20 slices of 1400 px that overlap by 15 %; one row per slice, others one row."""
    tall = (F.col(height) > 2048) & (F.col(height) > 3 * F.col(width))
    count = F.when(tall, F.least(F.lit(20), F.ceil((F.col(height) - 1400) / 1190) + 1)).otherwise(1).cast("int")
    rows = df.withColumn("slice_no", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumns({"top": F.when(tall, 1190 * F.col("slice_no")).otherwise(0), "slice_height": F.when(tall, F.least(F.lit(1400), F.col(height) - 1190 * F.col("slice_no"))).otherwise(F.col(height))})
