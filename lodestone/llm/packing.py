"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt to groups by a hash; a group, some megabytes of text, is tokenised and packed by one task on its own.
Documents longer than a sequence give full sequences and a rest. The rests go, longest first, each into the first open
sequence that has room; the tree, whose inner nodes hold the largest room below them, finds it in log time. Sequences
that end up with room then take tokens cut from the emptiest ones, so that a group keeps one partial sequence at most, and
that one is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import by_bytes, ship

CAPACITY = 4096
#: Segments that a worker's encoder keeps: a group's tokens need room too.
MOST_KEPT = 500_000
#: Partitions at most; each group is a partition of its own up to that number, then several follow each other in one.
MOST_PARTITIONS = 50_000
#: Bytes of text for a group, on average; a hash deals documents out, so groups vary a little. A longer text is in one group as a whole.
GROUP_BYTES = 8_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class TournamentTree:
    """Room of bins, found from the left: each inner node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with that much room, which it takes."""
        room, k = self.room, 1
        while k < self.size:
            k *= 2
            if room[k] < need:
                k += 1
        found = k - self.size
        room[k] -= need
        while k > 1:
            k //= 2
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
        return found


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents with those lengths; no piece is empty.

    Sequences are full but for at most one remainder, which is cut into powers of two. ``capacity`` is a power of two.
    """
    bins: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        bins.extend([(d, s, capacity)] for s in range(0, whole, capacity))
        if n > whole:
            rests.append((n - whole, d, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree = TournamentTree(max(1, len(rests)), capacity)
    open_bins: dict[int, list[tuple[int, int, int]]] = {}
    for n, d, s in rests:
        open_bins.setdefault(tree.place(n), []).append((d, s, n))
    # the emptiest give to the fullest
    left = sorted(open_bins.values(), key=lambda b: sum(p[2] for p in b))
    fill = [sum(p[2] for p in b) for b in left]
    low, high = 0, len(left) - 1
    while low < high:
        if fill[high] == capacity:
            high -= 1
            continue
        d, s, n = left[low].pop()
        take = min(n, capacity - fill[high])
        left[high].append((d, s, take))
        fill[high] += take
        if take < n:
            left[low].append((d, s + take, n - take))
        fill[low] -= take
        if not left[low]:
            low += 1
    for k in range(low, len(left)):
        if fill[k] == capacity:
            bins.append(left[k])
            continue
        bit = capacity // 2
        parts = left[k][::-1]
        while bit:
            if fill[k] & bit:
                need, now = bit, []
                while need:
                    d, s, n = parts.pop()
                    take = min(n, need)
                    now.append((d, s, take))
                    need -= take
                    if take < n:
                        parts.append((d, s + take, n - take))
                bins.append(now)
            bit //= 2
    out = []
    for q, b in enumerate(bins):
        at = 0
        for d, s, n in b:
            out.append((d, s, n, q, at))
            at += n
    return out


def _packer(tokenizer: str, end_id: int, capacity: int, special_as_text: bool):
    def pack(key, group):
        import pyarrow as pa

        from lodestone.llm.token_ids import encoder

        code = encoder(tokenizer, special_as_text, MOST_KEPT)
        end = np.array([end_id], code.dtype).tobytes()
        ids: list[int | None] = []
        tokens: list[bytes] = []
        for batch in group.to_batches():
            ids.extend(batch.column("doc_id").to_pylist())
            for texts in by_bytes(x or "" for x in batch.column("text").to_pylist()):
                tokens.extend(b + end for b in code.encode(texts))
        # the hash order of the shuffle may vary between attempts; this one doesn't
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, tokens[i]))
        arrays = [np.frombuffer(tokens[i], code.dtype) for i in order]
        pieces = pack_lengths([len(a) for a in arrays], capacity)
        total = np.bincount([p[3] for p in pieces], [p[2] for p in pieces]).astype(np.int64) if pieces else []
        number = key[0].as_py()
        columns = list(zip(*((ids[order[d]], s, n, zlib.crc32(arrays[d][s : s + n].astype("<u4").tobytes()), len(arrays[d]), (number << 32) + q, at, int(total[q])) for d, s, n, q, at in pieces), strict=True))
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in columns or [[]] * len(names)], names=names)

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, special_as_text: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens``.

    Every whole text (null: empty) is encoded and ``end_id`` appended; each id lies in exactly one piece. ``start`` counts its
    document's ids before it, ``offset`` those of its sequence before it. ``sequence_tokens`` is ``capacity`` or a power of two.
    ``special_as_text`` takes special tokens' strings in texts for ordinary text, the default is the library's.
    Repeated rows are packed each; a null id is packed under null. Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    # the text's hash too: null or repeated ids must not fill one group
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)), F.lit(groups)))
    # as many partitions as groups: what a task reads does not grow with the table
    dealt = dealt.repartition(min(groups, MOST_PARTITIONS), "group")
    return dealt.groupBy("group").applyInArrow(_packer(tokenizer, end_id, capacity, special_as_text), PIECE)
