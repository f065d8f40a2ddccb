"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed field by field; normaliser, metaspace marker, unigram scores or BPE merges, and byte fallback are
rebuilt from it. Batches are encoded by the library's threads. ``parity`` compares with the sentencepiece library itself, on
every whole text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import by_bytes, hold, ship
from lodestone.llm.token_ids import Places

MARK = "▁"
#: Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Segments kept by a Python worker, about 130 MB. When there are more, the older half goes.
MOST_KEPT = 600_000


@dataclass
class PieceModel:
    """What is used of a ModelProto, with the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False


def fields(data: bytes):
    """``(number, value)`` of each field of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None or at + size > len(data):
            raise ValueError("not a protobuf message")
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> PieceModel:
    m = PieceModel()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.whitespace_as_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    unknown = [i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN]
    if unknown:
        m.unk_id = unknown[0]
    return m


def bpe_merges(m: PieceModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others; better scores first, as the model would merge them."""
    ids = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER_DEFINED)}
    found = []
    for i, (p, score, kind) in enumerate(m.pieces):
        if kind in (NORMAL, USER_DEFINED):
            found += [(-score, i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(m: PieceModel, prefix: bool = True):
    """The library's tokenizer; without ``prefix``, for segments that already start with their marker and have no spaces."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        unk = m.pieces[m.unk_id][0]
        # segments come to the library once, in rows, so that what it would keep of them is of no use (150 MB in a worker)
        kept = {} if prefix else {"cache_capacity": 0}
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, bpe_merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback, **kept)
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    if m.whitespace_as_suffix or not m.escape_whitespaces:
        raise ValueError("a marker other than a prefix is not supported")
    steps: list = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_whitespaces and prefix:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if m.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK))
    if prefix:
        steps.append(normalizers.Replace(" ", MARK))
    t = Tokenizer(model)
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


#: A segment: spaces, then characters up to the next space. It is known by what stands behind its first space.
SEGMENT = re.compile(" ( *[^ ]+| *)")
#: Segments in a row that the library encodes as one text.
IN_A_ROW = 20


class PieceEncoder:
    """Ids of whole texts.

    When no piece holds the marker behind another character, no merge crosses the place before a space that follows another
    character; segments cut there are encoded once by a worker. Otherwise (and for unigram models, models with a charsmap or
    with white space removed) whole texts go to the library.
    """

    def __init__(self, data: bytes):
        self.model = parse_model(data)
        self.whole = build_tokenizer(self.model)
        inner = any(MARK in p.lstrip(MARK) for p, _, k in self.model.pieces if k in (NORMAL, USER_DEFINED))
        self.by_segment = self.model.kind == BPE and self.model.dummy_prefix and not (inner or self.model.charsmap or self.model.remove_extra_whitespaces)
        self.part = build_tokenizer(self.model, prefix=False) if self.by_segment else None
        #: What each piece stands for; unknown and control pieces stand for nothing that could be compared.
        self.spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, USER_DEFINED) else None for p, _, k in self.model.pieces]
        #: Whether a piece begins with the marker, as the first one of each segment does where the marker is known.
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces], bool)
        #: Of each segment seen its ids, and the places of those that their ids do not spell.
        self.places, self.table, self.odd = Places(), [], set()

    def _segments(self, text: str) -> list[int]:
        # the dummy prefix is a space before a text that is not empty; a marker in a text is as good as a space
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return list(map(self.places.__getitem__, SEGMENT.findall(" " + text)))
        return list(map(self.places.__getitem__, text.split(" "))) if text else []

    def _ids(self, segments: list[str]) -> list[bytes]:
        """Of each segment its ids. Some in a row are one text for the library: no merge crosses their borders, and one with spaces
        inside, or a row that comes apart otherwise than at its markers, is encoded on its own."""
        rows, row = [], []
        for s in segments:
            if " " in s or not s:
                rows.append([s])
                continue
            row.append(s)
            if len(row) == IN_A_ROW:
                rows.append(row)
                row = []
        rows += [row] if row else []
        spelled = lambda some: "".join(MARK + s.replace(" ", MARK) for s in some)
        found: dict[str, bytes] = {}
        for row, e in zip(rows, self.part.encode_batch_fast(list(map(spelled, rows)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.begins[ids]).tolist()
            if len(row) == 1:
                found[row[0]] = ids.tobytes()
            elif len(cuts) == len(row) and cuts[0] == 0:
                raw = ids.tobytes()
                found.update(zip(row, (raw[4 * a : 4 * b] for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)), strict=True))
            else:
                for s, one in zip(row, self.part.encode_batch_fast([spelled([s]) for s in row], add_special_tokens=False), strict=True):
                    found[s] = array("I", one.ids).tobytes()
        return [found[s] for s in segments]

    def encode_bytes(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Of each text its ids as unsigned 32-bit integers, and whether decoding them gives it back.

        Decoding joins what pieces stand for, so a text made of segments that decode to themselves does so too; any other text is
        decoded as a whole by the library.
        """
        if not self.by_segment:
            found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.whole.decode_batch(found, skip_special_tokens=False)
            return [array("I", x).tobytes() for x in found], [a == b for a, b in zip(back, texts, strict=True)]
        if (kept := len(self.table)) > MOST_KEPT:
            self.places.forget(kept // 2)
            del self.table[: kept // 2]
            self.odd = {k - kept // 2 for k in self.odd if k >= kept // 2}
        cut = [self._segments(t) for t in texts]
        new = self.places.names[len(self.table) :]
        for segment, ids in zip(new, self._ids(new), strict=True):
            spelled = [self.spelled[i] for i in array("I", ids)]
            if None in spelled or b"".join(spelled) != b" " + segment.encode("utf-8", "surrogatepass"):
                self.odd.add(len(self.table))
            self.table.append(ids)
        ids = [b"".join(map(self.table.__getitem__, c)) for c in cut]
        same = [MARK not in t and (not self.odd or self.odd.isdisjoint(c)) for t, c in zip(texts, cut, strict=True)]
        for k in [k for k, s in enumerate(same) if not s]:
            same[k] = self.whole.decode(array("I", ids[k]).tolist(), skip_special_tokens=False) == texts[k]
        return ids, same

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, np.uint32) for b in self.encode_bytes(texts)[0]]


_encoders: dict[int, tuple] = {}


def encoders(tag: int, sent) -> tuple:
    """The worker's encoder and the sentencepiece library's for the model that was sent, one model at a time; what they have seen stays for later tasks.

    A task's function comes pickled with copies of the variables it names, so it gets to what the worker keeps only through a function of this module.
    """
    import sentencepiece

    hold("sentencepiece", _encoders.clear)
    if tag not in _encoders:
        _encoders.clear()
        _encoders[tag] = PieceEncoder(sent.value), sentencepiece.SentencePieceProcessor(model_proto=sent.value)
    return _encoders[tag]


ENCODED = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, threads: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, ids (null unless with_ids), n_tokens, ids_crc32, round_trip, parity``.

    Every whole text (null: empty) is encoded. ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers;
    ``round_trip`` says that decoding gives the text back, ``parity`` that the sentencepiece library gives the same ids. ``threads``
    are the library's threads in a task: as many as an executor has cores, two at least, unless given, so that a task that is left with
    long texts uses the cores of those that are done. Repeated rows are encoded each; other columns
    are not read; an empty table gives an empty one. ``model`` is read by the driver and sent along (some hundred KB).
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model, "rb") as f:
        data = f.read()
    sent, tag = spark.sparkContext.broadcast(data), zlib.crc32(data)
    threads = threads or max(2, int(spark.conf.get("spark.executor.cores", "2")))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import pyarrow as pa

        code, own = encoders(tag, sent)
        for batch in batches:
            rows: list[tuple] = []
            for texts in by_bytes(x or "" for x in batch.column(1).to_pylist()):
                ids, same = code.encode_bytes(texts)
                right = own.encode(texts, num_threads=threads, return_type="numpy")
                rows += [(np.frombuffer(i, np.int32) if with_ids else None, len(i) // 4, zlib.crc32(i), s, r.tobytes() == i) for i, s, r in zip(ids, same, right, strict=True)]
            kinds = (pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[x.split()[0] for x in ENCODED.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ENCODED)


DIGESTED = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"


def digest_ids(made: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip, parity`` of what ``encode_pieces`` returns with ids, digested from those ids."""

    def run(batches):
        import pyarrow as pa

        hold("digest_ids")  # Spark may hand this task a worker that has encoded before
        for batch in batches:
            ids = batch.column(1)
            ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGESTED.split(", ")])

    return made.select("doc_id", "ids", "round_trip", "parity").mapInArrow(run, DIGESTED)
