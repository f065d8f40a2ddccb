"""Token ids as flat unsigned integer files with 64-bit document offsets, written in id order and memory-mapped to read.

The documents are range-partitioned by id and sorted; each partition becomes one shard of three files: ``.ids`` (the ids of
its documents in a row, unsigned 16 or 32 bits), ``.offsets`` (n + 1 signed 64-bit starts, counted from the shard's beginning)
and ``.docs`` (their ids, 64 bits, and a byte each that is 0 for a null id). A shard's base, the number of ids before it, is
the prefix sum of the shards before; ``manifest.json`` holds it. The driver sees one row per shard.

Files in a local or mounted folder are memory-mapped; in another store the ranges that are asked for are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.runtime import by_bytes, shared_path, ship

SHARD = "shard long, n_docs long, n_ids long"
#: Bytes of text in a shard, on average, and shards at most: beyond 320 GB of text shards grow instead.
SHARD_BYTES, MOST_SHARDS = 16_000_000, 20_000
#: Documents that are read at once.
TOGETHER = 4096


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _shard_writer(uri: str, tokenizer: str, end_id: int, special_as_text: bool):
    """For a sorted partition of ``doc_id, text``: writes its shard, attempt-safe by renaming, and reports it."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from lodestone.llm.token_ids import encoder

        store, root = _open(uri)
        task = TaskContext.get()
        shard, tag = task.partitionId(), task.taskAttemptId()
        code = encoder(tokenizer, special_as_text)
        end = np.array([end_id], code.dtype).tobytes()
        name = f"{root}/{shard:08d}"
        lengths, ids, valid = [0], [], []
        with store.open_output_stream(f"{name}.ids.{tag}") as out:
            for batch in batches:
                ids.extend(batch.column(0).to_pylist())
                for texts in by_bytes(x or "" for x in batch.column(1).to_pylist()):
                    for b in code.encode(texts):
                        out.write(b)
                        out.write(end)
                        lengths.append(len(b) // code.dtype.itemsize + 1)
        offsets = np.cumsum(np.array(lengths, "<i8"), dtype="<i8")
        valid = np.array([x is not None for x in ids], np.uint8)
        names = np.array([x or 0 for x in ids], "<i8")
        for kind, data in (("offsets", offsets.tobytes()), ("docs", names.tobytes() + valid.tobytes())):
            with store.open_output_stream(f"{name}.{kind}.{tag}") as out:
                out.write(data)
        for kind in ("ids", "offsets", "docs"):
            store.move(f"{name}.{kind}.{tag}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(ids)], "n_ids": [int(offsets[-1])]})

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", uri: str | None = None, special_as_text: bool = False) -> str:
    """Encode every whole text (null: empty), append ``end_id``, write the files in ascending ``doc_id`` order; the folder's URI.

    Null ids come first; repeated ids follow each other, in the order of a hash of their text, and may go on in the next shard. Other
    columns are not read. An empty table writes a manifest without documents. The folder is new, in the shared folder unless
    ``uri`` names one. ``special_as_text`` takes special tokens' strings in texts for ordinary text, the default is the library's.
    """
    from lodestone.llm.token_ids import SegmentEncoder

    spark = docs.sparkSession
    ship(spark)
    uri = uri or shared_path(spark, "token-files")
    store, root = _open(uri)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // SHARD_BYTES)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    found = sorted(tuple(r) for r in ordered.mapInArrow(_shard_writer(uri, tokenizer, end_id, special_as_text), SHARD).collect())
    bases = np.cumsum([0, *(n for _, _, n in found)])[:-1].tolist()
    manifest = {"dtype": SegmentEncoder(tokenizer).dtype.str, "end_id": end_id, "shards": [{"name": f"{s:08d}", "base": b, "docs": d, "ids": n} for (s, d, n), b in zip(found, bases, strict=True)]}
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return uri


class Values:
    """A file of numbers: memory-mapped where it is local, else read range by range."""

    def __init__(self, uri: str, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        if uri.startswith("file:"):
            self.file, self.mapped = None, np.memmap(path, self.dtype, "r") if os.path.getsize(path) else np.zeros(0, self.dtype)
        else:
            self.file, self.mapped = _open(uri)[0].open_input_file(path), None

    def __len__(self) -> int:
        return len(self.mapped) if self.file is None else self.file.size() // self.dtype.itemsize

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.file is None:
            return self.mapped[span]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((span.stop - span.start) * size, span.start * size), self.dtype)


class TokenShard:
    """A shard; its documents by position."""

    def __init__(self, uri: str, name: str, dtype: str):
        root = f"{_open(uri)[1]}/{name}"
        self.ids, self.offsets = Values(uri, f"{root}.ids", dtype), Values(uri, f"{root}.offsets", "<i8")
        self.docs = Values(uri, f"{root}.docs", "u1")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def names(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents' ids, and whether each is null."""
        n = len(self)
        return np.frombuffer(self.docs[8 * low : 8 * high].tobytes(), "<i8"), self.docs[8 * n + low : 8 * n + high] == 0

    def documents(self, low: int, high: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The starts of documents, and of the one behind them, in the shard, and the documents' ids."""
        starts = self.offsets[low : high + 1]
        ids = self.ids[int(starts[0]) : int(starts[-1])]
        inner = (starts - starts[0]).tolist()
        return starts, [ids[a:b] for a, b in zip(inner[:-1], inner[1:], strict=True)]

    def document(self, k: int) -> np.ndarray:
        return self.documents(k, k + 1)[1][0]


def read_manifest(uri: str) -> dict:
    store, root = _open(uri)
    with store.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """One row per document, read back from the files: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts all ids before."""
    import pyarrow as pa

    manifest = read_manifest(uri)
    shards, dtype = [x for x in manifest["shards"] if x["docs"]], manifest["dtype"]

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, base = TokenShard(uri, shards[k]["name"], dtype), shards[k]["base"]
                for low in range(0, len(shard), TOGETHER):
                    high = min(low + TOGETHER, len(shard))
                    starts, documents = shard.documents(low, high)
                    crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in documents]
                    names, null = shard.names(low, high)
                    columns = [pa.array(names, pa.int64(), mask=null), pa.array(starts[:-1] + base, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
