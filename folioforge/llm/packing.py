"""Filling containers of fixed capacity by Karmarkar-Karp multiway differencing.

Items go by hash to groups of about ``group_items``; each group is packed on its
own, so any number of items is packed in parallel and no group depends on the
data's keys.  A group starts with the fewest windows its total allows.  Every
item is a partial partition (one filled window, the rest empty); the two
partitions with the largest spread are merged, the fullest windows of one with
the emptiest of the other, until one partition is left.  If a window exceeds
the capacity the number of windows rises and the group is packed again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import materialize, pick, rows_at_most

#: Ids of oversized texts beyond this number meet their texts by a join.
BROADCAST_ROWS = 200_000


def byte_tokens(text: str) -> Column:
    """Tokens of the byte-level tokenizer: one a UTF-8 byte and an end token; 0 for null and empty texts."""
    return F.when(F.octet_length(text) > 0, F.octet_length(text) + 1).otherwise(0).cast("long")


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item by multiway differencing (largest spread first, ties by item)."""
    if windows == 1:
        return np.zeros(sizes.size, np.int64)
    order = np.argsort(-sizes, kind="stable")
    # each partition: sums in ascending order and, for every place, the tree of items in it
    heap = []
    for rank, i in enumerate(order.tolist()):
        heap.append((-int(sizes[i]), rank, np.array([sizes[i]], np.int64), [i]))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        # a, b: the non-empty windows' sums above the partition's least, descending
        if a.size + b.size <= windows:
            sums, trees = np.concatenate((a, b)), ta + tb
        else:
            fold = a.size + b.size - windows  # the smallest of both meet, smallest with largest of those
            x, y = a[a.size - fold :], b[b.size - fold :][::-1]
            sums = np.concatenate((a[: a.size - fold], b[: b.size - fold], x + y))
            trees = ta[: a.size - fold] + tb[: b.size - fold] + [(p, q) for p, q in zip(ta[a.size - fold :], reversed(tb[b.size - fold :]))]
        if sums.size == windows:
            sums = sums - sums.min()
        o = np.argsort(-sums, kind="stable")
        sums, trees = sums[o], [trees[k] for k in o.tolist()]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, trees))
        serial += 1
    _, _, _, trees = heap[0]
    out = np.empty(sizes.size, np.int64)
    for w, tree in enumerate(trees):
        stack = [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                out[t] = w
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item of one group; no window exceeds ``capacity``."""
    out = np.empty(sizes.size, np.int64)
    whole = np.flatnonzero(sizes >= capacity)
    out[whole] = np.arange(whole.size)
    rest = np.flatnonzero(sizes < capacity)
    if not rest.size:
        return out
    s = sizes[rest]
    windows = max(1, -(-int(s.sum()) // capacity))
    while True:
        w = difference(s, windows) if windows < rest.size else np.arange(rest.size)
        if windows >= rest.size or np.bincount(w, weights=s).max() <= capacity:
            break
        windows += max(1, windows // 400)
    out[rest] = w + whole.size
    return out


def _pieces(capacity: int):
    """Oversized texts cut at characters into runs of at most ``capacity`` tokens; the last holds the end token."""
    names = ["id", "piece_no", "n_pieces", "start_byte", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, start, size, count = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                raw, at, n = value.as_buffer(), 0, 0
                data = memoryview(raw)
                while True:
                    left = len(data) + 1 - at
                    end = len(data) if left <= capacity else at + capacity
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end -= 1
                    if end <= at and left > capacity:
                        raise ValueError("capacity is smaller than one character")
                    who.append(i), start.append(at), size.append(end - at + (left <= capacity))
                    n += 1
                    if left <= capacity:
                        break
                    at = end
                count.append(n)
            n = np.array(count, np.int32)
            no = np.arange(n.sum(), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int32())), pa.array(no, pa.int32()), pa.array(np.repeat(n, n), pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names)

    return run


PACKED = "id long, piece_no int, n_pieces int, start_byte long, n_tokens long, container long"


def pack_texts(docs: DataFrame, id_col: str, text_col: str, capacity: int, group_items: int = 2048) -> DataFrame:
    """Container of every text: ``(id, piece_no, n_pieces, start_byte, n_tokens, container)``.

    A text is split (``n_pieces`` > 1) only if it alone exceeds the capacity.
    Null and empty texts have size 0 and take no container; of several rows of
    an id the longest text is packed, once; rows with a null id are left out; an
    empty table gives none; other columns are ignored.
    """
    if capacity < 4:
        raise ValueError("capacity must hold a character")
    rows = pick(docs, id=id_col, text=text_col).filter("id is not null and text is not null and text <> ''").withColumn("n_tokens", byte_tokens("text")).withColumn("h", F.xxhash64("text"))
    # sizes only; the longest text of an id, told from others of that length by its hash
    sizes = materialize(rows.groupBy("id").agg(F.max(F.struct("n_tokens", "h")).alias("m")).select("id", "m.n_tokens", "m.h"))
    small = sizes.filter(F.col("n_tokens") <= capacity).select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start_byte"), "n_tokens")
    wanted = sizes.filter(F.col("n_tokens") > capacity).select("id", "h")
    large = rows.filter(F.col("n_tokens") > capacity).join(F.broadcast(wanted) if rows_at_most(wanted, BROADCAST_ROWS) else wanted, ["id", "h"], "left_semi")
    cut = large.select("id", F.col("text").cast("binary").alias("raw")).mapInArrow(_pieces(capacity), "id long, piece_no int, n_pieces int, start_byte long, n_tokens long")
    items = materialize(small.union(cut.dropDuplicates(["id", "piece_no"])))
    groups = max(1, -(-items.count() // group_items))

    def pack(table: pa.Table) -> pa.Table:
        ids, no = table.column("id").to_numpy(), table.column("piece_no").to_numpy()
        table = table.take(pa.array(np.lexsort((no, ids))))
        w = pack_group(table.column("n_tokens").to_numpy(), capacity)
        group = table.column("g").to_numpy().astype(np.int64)
        return pa.table({c: table.column(c) for c in ("id", "piece_no", "n_pieces", "start_byte", "n_tokens")} | {"container": (group << 24) + w})

    # a given number of partitions is left alone, so small rows do not end up in one task
    spread = items.withColumn("g", F.pmod(F.xxhash64("id", "piece_no"), F.lit(groups)).cast("long")).repartition(groups, "g")
    return spread.groupBy("g").applyInArrow(pack, PACKED)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the fewest containers possible and the share of unused space."""
    total = packed.agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused"))
