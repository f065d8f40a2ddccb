"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled texts: one on ordinary text, one on those windows of
toxic texts whose words stand out there. A window is a word between its spaces; it is compressed with the ordinary
dictionary alone and with the toxic one added to it. Both dictionaries end in the same tail and carrier string, which go behind
and before each window, so that even a short window is compressed and searched to its end (zstandard looks for no match
in the last eight bytes); the lengths then differ only by what the toxic dictionary knows of the window. A window's evidence, in
half bytes, is twice that difference, less the bytes that the toxic dictionary leaves unexplained beyond one match: a word that
only begins like a toxic one is no such word. A logistic curve over a text's evidence, fitted to
labelled texts that no dictionary has seen, calibrates the score.

A window's evidence does not depend on its neighbours, so each worker compresses a word once.

What a match cannot show is looked up: short words, which cost as much to point at as to spell, and runs of two or three words, or of one
to three characters in scripts without spaces, that stand out though their words do not. Their number goes into the curve too.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.runtime import by_bytes, crc_of_id, give_back, hold, save, ship

#: Labelled texts of each kind that are learned from, at most, and the characters of each kind, beyond which no further text begins: the
#: sample's bounds. Texts are learned whole, however long.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 4500, 8_000_000
#: Dictionary sizes in bytes; zstandard level and shortest match (an optimal parse keeps lengths comparable).
ORDINARY_BYTES, TOXIC_BYTES, LEVEL, SHORTEST = 32_768, 4_096, 19, 3
#: Log-likelihood ratio above which a word's contexts are more frequent in toxic texts than chance allows (p below 1e-6).
STANDS_OUT = 24.0
#: Characters of a window; longer words are cut into windows that overlap by a quarter.
WINDOW = 48
MOST_KEPT = 400_000
THRESHOLD = 0.3

WORD = re.compile(r"\w+")
#: Characters that are tokens of their own: Thai to Burmese, Khmer, kana, Han, Hangul syllables (to which particles are attached).
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003134f"
ALONE, TOKEN = re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
#: Tokens of a run at most, and characters below which a word is looked up.
RUN, SHORT = 3, 4


def windows_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if all(len(w) <= WINDOW for w in found):
        return found
    step = WINDOW * 3 // 4
    return [w[i : i + WINDOW] for w in found for i in (range(0, max(1, len(w) - WINDOW + step), step) if len(w) > WINDOW else (0,))]


def tokens_of(text: str) -> list[str]:
    low = text.lower()
    return TOKEN.findall(low) if ALONE.search(low) else WORD.findall(low)


@dataclass
class Runs:
    """Runs that stand out: numbers of their tokens from 1, and for each length the runs as sorted numbers to the base of ``len(terms) + 1``."""

    terms: dict[str, int] = field(default_factory=dict)
    keys: list[np.ndarray] = field(default_factory=list)

    def count(self, text: str) -> int:
        """The places of a text at which such a run begins."""
        if not self.terms:
            return 0
        get, tokens = self.terms.get, tokens_of(text)
        ids = np.fromiter((get(t, 0) for t in tokens), np.int64, len(tokens))
        begins = np.zeros(len(ids), bool)
        for n, keys in enumerate(self.keys, 1):
            if len(keys) and len(ids) >= n:
                at = np.flatnonzero(np.all([ids[k : len(ids) - n + 1 + k] > 0 for k in range(n)], axis=0))
                own = np.zeros(len(at), np.int64)
                for k in range(n):
                    own = own * (len(self.terms) + 1) + ids[at + k]
                begins[at[np.isin(own, keys)]] = True
        return int(begins.sum())


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    carrier: bytes = bytes(range(200, 240))
    tail: bytes = bytes(range(240, 256))
    weights: list[float] = field(default_factory=lambda: [0.0] * 13)
    base: float = 0.0
    runs: Runs = field(default_factory=Runs)

    def compressors(self):
        import zstandard as zs

        p = zs.ZstdCompressionParameters.from_level(LEVEL, min_match=SHORTEST, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        made = lambda content: zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p)
        return made(self.ordinary + self.tail + self.carrier), made(self.ordinary + self.toxic + self.tail + self.carrier)


class WindowScorer:
    """Evidence of windows under a model; remembers windows."""

    def __init__(self, model: ToxicModel):
        self.model, self.kept = model, {}
        self.plain, self.with_toxic = model.compressors()
        self.least = len(self.with_toxic.compress(model.carrier + b" " + model.tail))

    def evidence(self, window: str) -> int:
        """In half bytes; ``least`` is the length of an empty window, and a match costs about three bytes."""
        data = self.model.carrier + b" " + window.encode("utf-8", "surrogatepass") + b" " + self.model.tail
        known = len(self.with_toxic.compress(data))
        return 2 * (len(self.plain.compress(data)) - known) - max(0, known - self.least - 3)

    def features(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """Of each text: windows with evidence of 10 or more, those with 13 or more, the largest evidence, runs that stand out."""
        cut = [windows_of(t) for t in texts]
        every: set[str] = set().union(*cut) if cut else set()
        if len(self.kept) + len(every) > MOST_KEPT:
            self.kept = {}
        kept = self.kept
        for w in every.difference(kept):
            kept[w] = self.evidence(w)
        out = []
        for c, t in zip(cut, texts, strict=True):
            e = np.fromiter(map(kept.__getitem__, c), np.int16, len(c))
            out.append((int((e >= 10).sum()), int((e >= 13).sum()), int(e.max()) if len(e) else 0, self.model.runs.count(t)))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        w, base = np.array(self.model.weights), self.model.base
        z = design(self.features(texts)) @ w + base
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def design(features: list[tuple[int, int, int, int]]) -> np.ndarray:
    f = np.array(features, float).reshape(-1, 4)
    return np.stack([*((f[:, 2] >= k).astype(float) for k in range(8, 16)), np.minimum(f[:, 0], 4) / 2, np.minimum(f[:, 1], 3), f[:, 3] >= 1, f[:, 3] >= 2, np.minimum(f[:, 3], 4) / 2], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[list[float], float]:
    """Weights that are not negative (more evidence never lowers a score) and the base, by projected gradient steps."""
    w, rate = np.zeros(x.shape[1]), (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(rate / (1 - rate))
    a = np.hstack([x, np.ones((len(x), 1))])
    step = 4 / max(1e-9, np.linalg.eigvalsh(a.T @ a / max(1, len(x)))[-1])
    for _ in range(rounds * 40):
        p = 1 / (1 + np.exp(-np.clip(x @ w + base, -30, 30)))
        w = np.maximum(0, w - step * (x.T @ (p - y) / max(1, len(y)) + ridge / max(1, len(y)) * w))
        base -= step * (p - y).mean() if len(y) else 0
    return w.tolist(), float(base)


#: Beginnings of words that are counted beside whole words: an inflected word may come once only, its stem often.
STEMS = (4, 5)


def units_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def standing_out(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words and beginnings with more distinct left neighbours in toxic texts than chance allows; copies of a text add no neighbours."""
    ids: dict[str, int] = {"": 0}
    units: dict[str, list[int]] = {}
    sides = []
    for texts in (toxic, ordinary):
        pairs = [np.zeros(0, np.int64)]
        for t in texts:
            before, keys = 0, []
            for w in windows_of(t):
                if (own := units.get(w)) is None:
                    own = units[w] = [ids.setdefault(u, len(ids)) for u in units_of(w)]
                keys += [k << 32 | before for k in own]
                before = own[0]
            pairs.append(np.unique(np.array(keys, np.int64)))
        found = np.bincount(np.unique(np.concatenate(pairs)) >> 32, minlength=1)
        sides.append(found)
    t, o = (np.pad(s, (0, max(0, len(ids) - len(s)))) for s in sides)
    words = float(max(1, sum(t[k[0]] for k in units.values()))), float(max(1, sum(o[k[0]] for k in units.values())))
    nt, no = words

    def ratio(a: int, c: int) -> float:
        expected_a, expected_c = nt * (a + c) / (nt + no), no * (a + c) / (nt + no)
        return 2 * (a * math.log(a / expected_a) + (c * math.log(c / expected_c) if c else 0)) if a > expected_a else 0.0

    return {u for u, k in ids.items() if len(u) >= 4 and t[k] * no > 20 * nt * o[k] and ratio(int(t[k]), int(o[k])) > STANDS_OUT}


def runs_standing_out(toxic: list[str], ordinary: list[str], told: set[str]) -> Runs:
    """Short words and runs of tokens with more distinct left neighbours in toxic texts than chance allows; runs with a unit of ``told``
    are left to the dictionaries."""
    vocabulary: dict[str, int] = {}
    sides = [[np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens_of(t)], np.uint64) for t in texts] for texts in (toxic, ordinary)]
    words = ["", *vocabulary]
    plain = np.array([not w or told.isdisjoint(units_of(w)) for w in words])
    short = np.array([len(w) < SHORT for w in words])
    base = np.uint64(0x9E3779B97F4A7C15)
    found: set[tuple[str, ...]] = set()
    for n in range(1, RUN + 1):

        def runs(ids: np.ndarray, n=n) -> np.ndarray:
            """A hash of the run that begins at each place."""
            out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
            for k in range(n):
                out = (out * base + ids[k : len(ids) - n + 1 + k]) * base
                out ^= out >> np.uint64(29)
            return out

        counts = []
        for side in sides:
            every = [runs(ids) for ids in side]
            own = np.concatenate([np.zeros(0, np.uint64), *every])
            before = np.concatenate([np.zeros(0, np.uint64), *(np.concatenate([[0], ids])[: len(r)].astype(np.uint64) for ids, r in zip(side, every, strict=True))])
            _, once = np.unique((own ^ (own >> np.uint64(31))) * base + before, return_index=True)
            counts.append(np.unique(own[once], return_counts=True))
        (keys, a), (others, n_others) = counts
        if not len(keys):
            continue
        at = np.minimum(np.searchsorted(others, keys), max(0, len(others) - 1))
        c = np.where(others[at] == keys, n_others[at], 0) if len(others) else np.zeros(len(keys), np.int64)
        nt, no = float(a.sum()), float(max(1, n_others.sum()))
        share = (a + c) / (nt + no)
        ratio = 2 * (a * np.log(a / (nt * share)) + np.where(c > 0, c * np.log(np.maximum(c, 1) / (no * share)), 0))
        good = keys[(a * no > 20 * nt * c) & (a > nt * share) & (ratio > STANDS_OUT)]
        for ids in sides[0] if len(good) else []:
            for k in np.flatnonzero(np.isin(runs(ids), good)).tolist():
                run = ids[k : k + n].astype(np.int64)
                if plain[run].all() and (n > 1 or short[run[0]]):
                    found.add(tuple(words[i] for i in run.tolist()))
    terms = {w: i for i, w in enumerate(sorted({w for run in found for w in run}), 1)}
    number = lambda run: sum(terms[w] * (len(terms) + 1) ** (len(run) - 1 - k) for k, w in enumerate(run))
    return Runs(terms, [np.array(sorted(number(r) for r in found if len(r) == n), np.int64) for n in range(1, RUN + 1)])


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary trained on the samples; where all distinct samples fit into it, they are its content, the commonest last."""
    import zstandard as zs

    once = Counter(samples)
    if sum(map(len, once)) > size:
        try:
            return zs.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zs.ZstdError:  # too little to train on
            pass
    return b" ".join(s.strip() for s, _ in reversed(once.most_common()))[-size:]


def train_toxicity(toxic: list[str], ordinary: list[str]) -> ToxicModel:
    """Dictionaries from two thirds of the texts, the curve from the rest."""
    learn_t, learn_o = [t for i, t in enumerate(toxic) if i % 3], [t for i, t in enumerate(ordinary) if i % 3]
    told = standing_out(learn_t, learn_o)
    marked = [f" {w} ".encode("utf-8", "surrogatepass") for t in learn_t for w in windows_of(t) if not told.isdisjoint(units_of(w))]
    plain, size = [], 0
    for t in learn_o:
        if size > SAMPLE_CHARS:
            break
        words = windows_of(t)
        plain.extend((" " + " ".join(words[i : i + 12]) + " ").encode("utf-8", "surrogatepass") for i in range(0, len(words), 12))
        size += len(t)
    model = ToxicModel(_dictionary(ORDINARY_BYTES, plain, 64) if plain else b"", b" " + _dictionary(TOXIC_BYTES, marked, 32) + b" " if marked else b"", runs=runs_standing_out(learn_t, learn_o, told))
    rest = [(t, 1) for i, t in enumerate(toxic) if not i % 3] + [(t, 0) for i, t in enumerate(ordinary) if not i % 3]
    y = np.array([k for _, k in rest], float)
    x = design(WindowScorer(model).features([t for t, _ in rest]))
    model.weights, model.base = fit_logistic(x, y)
    return model


def learning_sample(docs: DataFrame, labels: DataFrame, learn, doc_id: str, text: str, label: str, label_id: str) -> tuple[list[str], list[str]]:
    """Toxic and ordinary texts, those of least hash of their id, within the bounds; the ids are drawn first, so few texts move.

    Of contradicting labels of a document the larger counts; null labels are not learned from. Of an id's several texts one is.
    """
    own = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(learn)
    own = own.groupBy("doc_id").agg((F.max("label") > 0).alias("label"))
    ids: list = []
    for kind, most in ((True, SAMPLE_TOXIC), (False, SAMPLE_ORDINARY)):
        ids += own.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not ids:
        return [], []
    drawn = F.broadcast(docs.sparkSession.createDataFrame(ids, own.schema))  # 6,000 rows at most
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(drawn, "doc_id")
    sample = save(rows.groupBy("label", "doc_id").agg(F.min("text").alias("text")), "sample")
    place = F.xxhash64("doc_id").alias("place")
    size, chosen = Counter(), []
    for r in sample.select("label", "doc_id", place, F.length("text").alias("n")).orderBy("place", "doc_id").collect():
        if size[r["label"]] < SAMPLE_CHARS:
            chosen.append((r["doc_id"],))
            size[r["label"]] += r["n"]
    kept = sample.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, sample.select("doc_id").schema)), "doc_id")
    found: dict[bool, list[str]] = {True: [], False: []}
    for r in sorted(kept.select("label", place, "doc_id", "text").collect(), key=lambda r: (r["place"], r["doc_id"])):
        found[r["label"]].append(r["text"])
    return found[True], found[False]


_scorers: dict[str, WindowScorer] = {}


def score_toxicity(docs: DataFrame, labels: DataFrame, learn=None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", carry: tuple[str, ...] = ("doc_id",), label_id: str | None = None) -> DataFrame:
    """The ``carry`` columns (none of them called ``score``) and ``score`` (0 to 1) of each document; every whole text is scored, null as empty.

    The model is learned from labelled rows for which ``learn``, a condition on ``doc_id``, holds (all if None); ``label_id`` is the
    labels' id column where it is called otherwise than the documents'. Without toxic labels every score is the base rate. Repeated rows are scored each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    model = train_toxicity(*learning_sample(docs, labels, F.lit(True) if learn is None else learn, doc_id, text, label, label_id or doc_id))
    give_back()
    sent, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # under 40 KB, and the runs of the bounded sample that stand out
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("score", T.DoubleType())])
    at = carry.index(text) if text in carry else len(carry)

    def run(batches):
        import pyarrow as pa

        hold("toxicity", _scorers.clear)
        if tag not in _scorers:
            _scorers.clear()
            _scorers[tag] = WindowScorer(sent.value)
        for batch in batches:
            scores: list[float] = []
            for some in by_bytes(x or "" for x in batch.column(at).to_pylist()):
                scores.extend(_scorers[tag].scores(some))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels the registered query never learns from."""
    return F.pmod(crc_of_id(doc_id), F.lit(4)) == 2
