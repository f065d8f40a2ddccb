"""What the operators share: the cluster's shared folder, written tables, package shipping, batches."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most (a longer text is a batch of its own), where the session has not set its own.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where that is unset in a local session, as in tests, a temporary folder is made and removed at exit; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _remove(path: str) -> None:
    from pyarrow import fs

    try:
        store, root = fs.FileSystem.from_uri(path)
        store.delete_dir(root)
    except (OSError, ValueError, NotImplementedError):  # gone already, or a store that only Spark can open
        pass


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and lost executors lose nothing.

    The caller's result may still be read from it, so it stays until the driver's process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    atexit.register(_remove, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; Arrow batches get smaller where the session has Spark's defaults."""
    for name, (default, small) in ARROW.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, small)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith((".py", ".json")):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    with tempfile.NamedTemporaryFile(suffix=".zip", prefix="lodestone-", delete=False) as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(f.name)
    atexit.register(lambda: os.path.exists(f.name) and os.unlink(f.name))
    _shipped.add(app)


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None] = lambda: None) -> None:
    """A worker's memory is one operator's at a time: what others have kept is released, and given back to the system, when another one begins."""
    others = [k for k in _held if k != name]
    for other in others:
        _held.pop(other)()
    _held[name] = release
    if others:
        give_back()


def give_back() -> None:
    """Free memory goes to the system: in a worker between operators, in the driver after a model is trained and before a join is planned.

    Python's garbage goes first, and with it the driver's last hold on broadcasts and plans that the JVM may then drop.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The table with its columns called ``c0, c1, ...``, so that no name clashes with an operator's own, and those names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True)).__getitem__


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text, the rule by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def by_bytes(texts: Iterable[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Texts in lists of about that many characters; a longer text is a list of its own."""
    batch: list[str] = []
    size = 0
    for t in texts:
        if batch and size + len(t) > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
