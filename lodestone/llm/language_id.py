"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted on a bounded sample of labelled texts and then
frozen. The code length of a byte is that of the longest context that the tree knows, plus the cost of the escapes on the
way to it (method C: a context with n symbols, d of them distinct, escapes with d / (n + d)); below the empty context
every byte costs 8 bits. A text, in lower case and in UTF-8, costs the sum over all its bytes, spaces, digits and marks included, each
in the context of those before it; the language with the shortest code wins.

A tree is a sorted table of grams; a worker lays it out for hashing and looks up all bytes of many texts at once. Trees of
different languages are apart, so tables grow with the number of languages.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.runtime import by_bytes, crc_of_id, give_back, hold, ship

ORDER = 4
#: Bytes of text learned per language; every language is learned. Beyond 64 languages each gets an equal share of what 64 get, but
#: no less than ``LEAST_BYTES``. Where short texts do not suffice, ``LONG_TEXTS`` long ones, of over a quarter of the bound each, are
#: learned too, all of each.
SAMPLE_BYTES, TOTAL_BYTES, LEAST_BYTES, LONG_TEXTS = 1_500_000, 96_000_000, 50_000, 4
#: Bytes that are looked up at once, and that are counted at once.
BLOCK, COUNTED = 1 << 18, 1 << 22
#: Posterior odds are softened by this factor: neighbouring bytes are not independent evidence.
TEMPERATURE = 0.2
#: Bits a byte above that quantile of a language's texts, as trees see them that have not learned them, at which a text counts as no
#: known language. Texts are measured in two turns, below ``FEW`` texts in ``FOLDS``; below ``FOLDS`` texts nothing can be measured.
SLACK_BITS, QUANTILE, FOLDS, FEW = 1.0, 0.95, 5, 100
#: What a text may cost beyond that as a whole: an address, a number or a name weighs much in a short text and says nothing of it.
ONCE_BITS = 64
#: Words below which a text is too short to measure a ceiling on.
LEAST_WORDS = 5

#: What a text stands behind: so many line feeds, which are context and cost nothing.
FRONT = b"\n" * ORDER
SHIFT = np.uint64(8)


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's category L is in it."""
    return bool(text) and any(map(str.isalpha, text))


class Bytes:
    """The bytes of texts in a row, each behind its ``FRONT``."""

    def __init__(self, texts: list[str]):
        coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.array([len(c) for c in coded], np.int64)
        self.data = np.frombuffer(FRONT + FRONT.join(coded), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + ORDER)[:-1]]).astype(np.int64) + ORDER if coded else np.zeros(0, np.int64)

    def coded(self) -> np.ndarray:
        """Whether a byte is one of a text's."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(edge, self.starts, 1)
        np.add.at(edge, self.starts + self.sizes, -1)
        return np.cumsum(edge[:-1], dtype=np.int8) > 0

    def grams(self, low: int, high: int) -> np.ndarray:
        """The last ``ORDER`` + 1 bytes at each place, the place's own byte lowest."""
        out = np.zeros(high - low, np.uint64)
        for back in range(ORDER, -1, -1):
            out <<= SHIFT
            begin = max(0, back - low)
            out[begin:] |= self.data[low + begin - back : high - back]
        return out


def gram_key(grams: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes, told apart from shorter and longer grams."""
    return (grams & np.uint64((1 << 8 * n) - 1)) | np.uint64((n + 1) << 56)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Tree:
    """Frozen statistics of a language: of each gram the bits of its last byte in the context of those before, and of the escape
    from the gram as a context (0 where it is none)."""

    keys: np.ndarray
    bits: np.ndarray
    escapes: np.ndarray

    def laid_out(self) -> Table:
        return Table(self)


class Table:
    """A tree laid out for hashing, a third full at most."""

    def __init__(self, tree: Tree):
        self.size = max(8, int(3 * len(tree.keys) + 1).bit_length())
        self.mask = (1 << self.size) - 1
        self.keys = np.zeros(1 << self.size, np.uint64)  # no key is 0
        self.values = np.zeros((1 << self.size, 2), np.float32)
        at, left = slots(tree.keys, self.size), np.arange(len(tree.keys))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = tree.keys[left[free]]  # of several for one place the last stays
            placed = self.keys[at] == tree.keys[left]
            self.values[at[placed], 0], self.values[at[placed], 1] = tree.bits[left[placed]], tree.escapes[left[placed]]
            at, left = (at[~placed] + 1) & self.mask, left[~placed]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not in the table."""
        at = slots(keys, self.size)
        there = self.keys[at]
        open_ = np.flatnonzero((there != keys) & (there != 0))
        missing = there == 0
        while len(open_):
            at[open_] = step = (at[open_] + 1) & self.mask
            there = self.keys[step]
            missing[open_[there == 0]] = True
            open_ = open_[(there != keys[open_]) & (there != 0)]
        at[missing] = -1
        return at

    def code_bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each place's byte."""
        out = np.zeros(len(grams), np.float32)
        left = np.arange(len(grams))
        for n in range(ORDER + 1, 0, -1):
            own = grams[left]
            at = self.find(gram_key(own, n))
            known = at >= 0
            known[known] = self.values[at[known], 0] > 0
            out[left[known]] += self.values[at[known], 0]
            left, own = left[~known], own[~known]
            if not len(left):
                return out
            context = self.find(gram_key(own >> SHIFT, n - 1))
            seen = context >= 0
            out[left[seen]] += self.values[context[seen], 1]
        out[left] += 8
        return out


@dataclass
class PPMModel:
    """The trees of all languages, and each language's ceiling in bits a byte."""

    languages: list[str]
    trees: list[Tree]
    ceiling: np.ndarray


def text_bits(tables: list[Table], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths of texts, a column for each table, and the texts' bytes."""
    rows = Bytes(texts)
    total = np.zeros((len(texts), len(tables)))
    places = np.flatnonzero(rows.coded())
    ends = np.concatenate([[0], np.cumsum(rows.sizes)])
    for low in range(0, len(places), BLOCK):
        some = places[low : low + BLOCK]
        grams = rows.grams(int(some[0]), int(some[-1]) + 1)[some - some[0]]
        first, last = np.searchsorted(ends, [low, low + len(some) - 1], "right") - 1
        cuts = np.maximum(ends[first : last + 1] - low, 0)
        filled = rows.sizes[first : last + 1] > 0  # an empty text has no place
        for j, table in enumerate(tables):
            total[first : last + 1, j][filled] += np.add.reduceat(table.code_bits(grams), cuts[filled], dtype=np.float64)
    return total, rows.sizes


def count_tree(texts: list[str]) -> Tree:
    """Count the contexts of a language's texts and freeze them."""
    rows = Bytes(texts)
    coded = rows.coded()
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for low in range(0, len(rows.data), COUNTED):
        high = min(low + COUNTED, len(rows.data))
        grams = rows.grams(low, high)[coded[low:high]]
        for n, parts in enumerate(found, 1):
            parts.append(np.unique(gram_key(grams, n), return_counts=True))
            if len(parts) > 1:  # what is held grows with the distinct grams, not with the texts
                own, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                parts[:] = [(own, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64))]
    keys, bits, contexts, escapes = [], [], [], []
    for n, parts in enumerate(found, 1):
        own, counts = parts[0]
        if not len(own):
            break
        above = gram_key(own >> SHIFT, n - 1)
        begins = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        distinct = np.diff(np.concatenate([begins, [len(own)]]))
        sums = np.add.reduceat(counts, begins) + distinct
        keys.append(own)
        bits.append(np.log2(np.repeat(sums, distinct) / counts))
        contexts.append(above[begins])
        escapes.append(np.log2(sums / distinct))
    if not keys:
        return Tree(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32))
    names = np.unique(np.concatenate([*keys, *contexts]))
    code, escape = np.zeros(len(names), np.float32), np.zeros(len(names), np.float32)
    code[np.searchsorted(names, np.concatenate(keys))] = np.concatenate(bits)
    escape[np.searchsorted(names, np.concatenate(contexts))] = np.concatenate(escapes)
    return Tree(names, code, escape)


def train_ppm(samples: dict[str, list[str]]) -> PPMModel:
    """The trees and ceilings of all languages.

    A language's ceiling stands above a quantile of its texts, each measured by a tree that has not seen it, so that single bad rows
    do not move it. The texts above it are not learned, lest the tree should know them by heart.
    """
    languages, trees, ceiling = sorted(samples), [], []
    for x in languages:
        texts = samples[x]
        judged = [k for k, t in enumerate(texts) if len(t.split()) >= LEAST_WORDS]
        folds = 2 if len(judged) >= FEW else FOLDS if len(judged) >= FOLDS else 0
        rate: dict[int, float] = {}
        for f in range(folds):
            unseen = judged[f::folds]
            hidden = set(unseen)
            tree = count_tree([t for k, t in enumerate(texts) if k not in hidden])
            bits, sizes = text_bits([tree.laid_out()], [texts[k] for k in unseen])
            rate.update(zip(unseen, (bits[:, 0] / sizes).tolist(), strict=True))
        ceiling.append(float(np.quantile([*rate.values()], QUANTILE, method="lower")) + SLACK_BITS if rate else 8.0 + SLACK_BITS)
        trees.append(count_tree([t for k, t in enumerate(texts) if rate.get(k, 0.0) <= ceiling[-1]]))
    return PPMModel(languages, trees, np.array(ceiling))


def learning_sample(docs: DataFrame, learn, doc_id: str, text: str, lang: str) -> dict[str, list[str]]:
    """Whole texts of each language, those of least hash: short ones up to its share of bytes, and long ones where those do not suffice.

    Counts first, so that the second pass sends the driver little more than the sample.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & learn)
    n = F.octet_length("text")
    languages = rows.select("lang").distinct().count()
    bound = min(SAMPLE_BYTES, max(LEAST_BYTES, TOTAL_BYTES // max(1, languages)))
    # one text of more than a quarter of the bound must not stand for many short ones, nor alone for a language that has several
    long = n > bound // 4
    sizes = rows.groupBy("lang").agg(F.sum(F.when(~long, n)).alias("short"), F.max(F.when(~long, n)).alias("longest"), F.count_if(long).alias("n_long")).collect()
    wanted = {r["lang"]: min(1.0, (1.2 * bound + 4 * r["longest"]) / r["short"]) for r in sizes if r["short"]}
    lacking = [(r["lang"],) for r in sizes if r["n_long"] and (r["short"] or 0) < bound]
    # a row that repeats is drawn once, however often it comes
    marked = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("row"), long.alias("long"), "text").withColumn("place", F.pmod("row", F.lit(1_000_000)))
    found: dict[str, list] = defaultdict(list)
    while wanted:
        rates = F.broadcast(docs.sparkSession.createDataFrame([*wanted.items()], "lang string, share double"))  # a row per language
        taken = marked.where("not long").join(rates, "lang").where(F.col("place") < 1_000_000 * F.col("share"))
        for r in taken.select("lang", "row", "place", "text").dropDuplicates(["lang", "row"]).collect():
            found[r["lang"]].append((r["place"], r["text"]))
        # chance may have drawn none of a language's texts
        wanted = {k: min(1.0, 4 * a) for k, a in wanted.items() if k not in found and a < 1}
    out: dict[str, list[str]] = defaultdict(list)
    for language, texts in found.items():
        got = 0
        for _, t in sorted(texts):
            if got >= bound:
                break
            out[language].append(t)
            got += len(t.encode("utf-8", "surrogatepass"))
    if lacking:
        of_long = marked.where("long").join(F.broadcast(docs.sparkSession.createDataFrame(lacking, "lang string")), "lang")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "row"))
        first = of_long.select("lang", "place", "row").distinct().withColumn("rank", rank).where(F.col("rank") <= LONG_TEXTS).select("lang", "row", "rank")
        drawn = of_long.join(F.broadcast(first), ["lang", "row"]).select("lang", "row", "rank", "text").dropDuplicates(["lang", "row"])
        for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["rank"])):
            out[r["lang"]].append(r["text"])
    return dict(out)


class Scorer:
    """Scores texts under a model."""

    def __init__(self, model: PPMModel):
        self.model, self.tables = model, [t.laid_out() for t in model.trees]

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """``(language or und, score, bits a byte, known)`` of each text."""
        out: list[tuple[str, float, float, bool]] = [("und", 0.0, 0.0, False)] * len(texts)
        languages = self.model.languages
        own = [k for k, t in enumerate(texts) if has_letter(t)] if languages else []
        if own:
            bits, sizes = text_bits(self.tables, [texts[k] for k in own])
            for k, total, n in zip(own, bits, sizes.tolist(), strict=True):
                best = int(np.argmin(total))
                odds = np.exp2(np.maximum(-(total - total[best]) * TEMPERATURE, -1000))
                rate = float(total[best] / n)
                out[k] = (languages[best], float(1 / odds.sum()), rate, bool(total[best] <= self.model.ceiling[best] * n + ONCE_BITS))
        return out


_scorers: dict[str, Scorer] = {}
PREDICTED = "lang_pred string, score double, bits_per_byte double, known boolean"


def identify_language(docs: DataFrame, learn=None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``lang_pred, score, bits_per_byte, known`` of each document; whole texts are scored.

    The trees are learned from rows for which ``learn`` holds (all if None) and whose ``lang`` is not null. ``lang_pred`` is a
    learned value, or ``und`` if the text is null, empty or without a letter, or nothing was learned. ``known`` is false
    for ``und`` and for texts that cost far more bits a byte than nearly all texts of the language that were kept from its trees. Ties go to the first
    language in order. Repeated rows are scored each; an empty table gives an empty one. ``carry`` columns keep their names.
    """
    spark = docs.sparkSession
    ship(spark)
    model = train_ppm(learning_sample(docs, F.lit(True) if learn is None else learn, doc_id, text, lang))
    give_back()
    sent, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # 16 bytes for each gram of the bounded sample: 1 to 4 MB a language
    schema = T.StructType([*(docs.schema[c] for c in carry), *T._parse_datatype_string(PREDICTED).fields])
    at = carry.index(text) if text in carry else len(carry)

    def run(batches):
        import pyarrow as pa

        hold("language_id", _scorers.clear)
        if tag not in _scorers:
            _scorers.clear()
            _scorers[tag] = Scorer(sent.value)
        scorer = _scorers[tag]
        for batch in batches:
            found: list = []
            for some in by_bytes(t or "" for t in batch.column(at).to_pylist()):
                found.extend(scorer.score(some))
            columns = [batch.column(i) for i in range(len(carry))]
            columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that the registered query never learns from."""
    return F.pmod(crc_of_id(doc_id), F.lit(3)) == 1
