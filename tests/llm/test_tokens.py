"""Token files, packing and SentencePiece against plain loops."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing, sentencepiece_backend, token_files

ROWS = [(5, "Hello, world. Again, world."), (1, None), (3, ""), (None, "no id"), (3, "x"), (9, "word " * 30_000), (4, "日本語 and é"), (7, "<|endoftext|>"), (8, "a <|endoftext|> b İ. <s> </s>")]
KINDS = "doc_id long, text string, start string, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], KINDS)


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text, end: np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files(spark):
    ids = whole("byte_bpe_50k.json")
    uri = token_files.write_token_files(docs := frame(spark, ROWS), public_tokenizers.path("byte_bpe_50k.json"), 0)
    got = [tuple(r) for r in token_files.read_token_files(spark, uri).orderBy("start").collect()]
    place = {(r.doc_id, r.text): r.place for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as place").collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, place[r]))
    want, at = [], 0
    for i, t in order:
        x = ids(t, 0)
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    shards = [s for s in token_files.read_manifest(uri)["shards"] if s["docs"]]
    shard = token_files.TokenShard(uri, shards[0]["name"], "<u2")
    assert isinstance(shard.ids.mapped, np.memmap) and shard.document(0).tolist() == ids(order[0][1], 0).tolist()
    far = token_files.TokenShard(uri, shards[0]["name"], "<u2")
    for kind in ("ids", "offsets", "docs"):  # as in a store without memory maps
        values = getattr(far, kind)
        values.file, values.mapped = token_files._open(uri)[0].open_input_file(str(values.mapped.filename)), None
    for low, high in ((0, len(shard)), (2, 5)):
        assert [d.tolist() for d in far.documents(low, high)[1]] == [d.tolist() for d in shard.documents(low, high)[1]]
        assert [x.tolist() for x in far.names(low, high)] == [x.tolist() for x in shard.names(low, high)]
    empty = token_files.write_token_files(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_many_shards(spark, monkeypatch):
    """Shards follow the bytes; an id that comes often is spread over several."""
    monkeypatch.setattr(token_files, "SHARD_BYTES", 400)
    rows = [(7, f"text number {i}") for i in range(200)] + [(i, "x") for i in range(20)] + [(None, f"n {i}") for i in range(50)]
    uri = token_files.write_token_files(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 0)
    got = token_files.read_token_files(spark, uri).orderBy("start").collect()
    assert len([s for s in token_files.read_manifest(uri)["shards"] if s["docs"]]) > 4
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i)) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def held(lengths, capacity):
    pieces = packing.pack_lengths(lengths, capacity)
    at = dict.fromkeys(range(len(lengths)), 0)
    fill = {}
    for d, s, n, q, o in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert n > 0 and s == at[d]
        at[d] += n
    for d, s, n, q, o in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert o == fill.get(q, 0)
        fill[q] = o + n
    assert all(at[d] == n for d, n in enumerate(lengths))
    assert all(n == capacity or n & (n - 1) == 0 for n in fill.values()) and sum(n < capacity for n in fill.values()) <= capacity.bit_length()
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_pack_lengths(lengths):
    held(lengths, 32)


def test_first_fit_decreasing():
    tree = packing.TournamentTree(5, 10)
    assert [tree.place(n) for n in (7, 6, 4, 3, 4, 6)] == [0, 1, 1, 0, 2, 2]
    held([], 4096)
    rng = np.random.default_rng(0)
    pieces = held(rng.integers(1, 9000, 3000).tolist(), 4096)
    assert len(pieces) < 3000 * 2.2


@pytest.mark.parametrize("group_bytes", [8_000_000, 2_000])
def test_packing(spark, group_bytes):
    ids = whole("word_bpe_49k.json")
    got = packing.pack_documents(frame(spark, ROWS), public_tokenizers.path("word_bpe_49k.json"), 2, group_bytes=group_bytes).collect()
    texts = {}
    for i, t in ROWS:
        texts.setdefault(i, []).append(ids(t, 2))
    for i, wanted in texts.items():
        mine = [r for r in got if r.doc_id == i]
        if len(wanted) == 1:
            joined = sorted(mine, key=lambda r: r.start)
            at = 0
            for r in joined:
                assert r.start == at and r.ids_crc32 == zlib.crc32(wanted[0][at : at + r.length].tobytes()) and r.doc_tokens == len(wanted[0])
                at += r.length
            assert at == len(wanted[0])
        assert sum(r.length for r in mine) == sum(map(len, wanted))
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in fill.values()) and all(r.sequence_tokens == fill[r.sequence_id] for r in got)
    assert packing.pack_documents(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_sentencepiece(spark):
    got = sentencepiece_backend.encode_pieces(frame(spark, ROWS), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(ROWS) and all(r.round_trip and r.parity for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id == 1} == {1: 0}
    assert sentencepiece_backend.encode_pieces(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_sentencepiece_query_digests_the_ids(spark, sf, monkeypatch):
    """The query's columns come from ids that the operator returns."""
    from lodestone.llm import queries

    made = []
    whole = sentencepiece_backend.encode_pieces
    monkeypatch.setattr(sentencepiece_backend, "encode_pieces", lambda *a, **b: made.append(whole(*a, **b)) or made[-1])
    got = {r.doc_id: r for r in queries.op8_sentencepiece(spark, sf).collect()}
    rows = made[0].collect()
    assert len(rows) == len(got) and all(r.ids is not None for r in rows)
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert got[r.doc_id] == (r.doc_id, len(ids), zlib.crc32(ids.tobytes()), r.round_trip, r.parity) and (r.n_tokens, r.ids_crc32) == got[r.doc_id][1:3]


@pytest.fixture(scope="module")
def pair():
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    return sentencepiece_backend.PieceEncoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aebcté  \n\t.,'日😀▁<>0123xyz")), max_size=30))
def test_parity(pair, text):
    code, own = pair
    ids, same = code.encode_bytes([text])
    assert same[0] == (code.whole.decode(np.frombuffer(ids[0], np.uint32).tolist(), skip_special_tokens=False) == text)
    assert code.by_segment and code.encode([text])[0].tolist() == own.encode(text)
    assert code.whole.encode(text).ids == own.encode(text) or "▁" in text


def message(*parts: tuple[int, int | bytes | float]) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_model():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁ab", -2.1, 1), ("ba", -2.3, 1), ("▁b", -4.0, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (40, 0)))) + message((3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    code = sentencepiece_backend.PieceEncoder(data)
    assert not code.by_segment and code.model.kind == sentencepiece_backend.UNIGRAM
    for text in ("ab", "ab ba", "  abba  b ", "b a  ab", "aaa bbb"):
        assert code.encode([text])[0].tolist() == own.encode(text), text
    with pytest.raises(ValueError):
        list(sentencepiece_backend.fields(b"\x0a\xff\x01a"))


def test_segments_in_a_row():
    """The library gets new segments in rows, and gives the ids that whole texts have."""

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **how):
            self.texts += texts
            return self.tokenizer.encode_batch_fast(texts, **how)

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        code = sentencepiece_backend.PieceEncoder(f.read())
    code.part = Counted(code.part)
    texts = [" ".join(f"word{i}, tail{i}" for i in range(50)), "a  b", " a", "a ", " ", "", "▁a ▁", "日本 \n\t x", "a\u0000 b", "   "]
    got = [x.tolist() for x in code.encode(texts)]
    assert got == [code.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(code.part.texts) < 30


def test_tasks_of_a_worker_share_one_encoder(spark, monkeypatch):
    """A task gets its function pickled: the encoder of an earlier task serves the next one, and a worker that digests lets it go."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import cloudpickle

    built, runs = [], []
    begin = sentencepiece_backend.PieceEncoder.__init__
    monkeypatch.setattr(sentencepiece_backend.PieceEncoder, "__init__", lambda self, data: built.append(self) or begin(self, data))
    for name in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS"):
        monkeypatch.setenv(name, "1")
    docs = frame(spark, ROWS)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(cloudpickle.dumps(run)) or docs.selectExpr("doc_id", "array(1) ids", "true round_trip", "true parity"))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: SimpleNamespace(value=value))
    sentencepiece_backend.digest_ids(sentencepiece_backend.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")))
    sentencepiece_backend._encoders.clear()

    task = lambda k, *batches: list(cloudpickle.loads(runs[k])(iter(batches)))
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["Hello, world.", None])], names=["doc_id", "text"])
    first, second = task(0, texts), task(0, texts)
    assert first == second and first[0].column("parity").to_pylist() == [True, True]
    assert len(built) == 1 and len(sentencepiece_backend._encoders) == 1
    task(1)
    assert not sentencepiece_backend._encoders
