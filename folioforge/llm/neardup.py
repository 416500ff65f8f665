"""Near-duplicate texts: tiled exact comparison of bit sketches, verified on whole shingle sets.

1. Each text becomes the set of its distinct word shingles.  One Arrow pass
   gives its size ``n``, a 64-bit name of the set (equal sets are one *node*, so
   copies cost one node), a 128-bit fingerprint (one bit of each of 128 min-wise
   hashes) and ``bands`` keys of ``rows`` min-wise hashes each.
2. Nodes that share a key form a block.  Blocks are compared exactly, tile by
   tile: exclusive-or and bit counts in numpy over tiles in order of set size; a
   tile pair is skipped when the population counts of its fingerprints differ by
   more than the radius everywhere, or its sizes by more than any pair at the
   threshold can.  Blocks above ``tile`` rows are spread over many tasks, one per
   tile pair, so no block is ever one task.
3. Surviving pairs are compared by eight bits of each min-wise hash, and what is
   left is verified with the exact Jaccard measure of the complete shingle sets,
   both in blocks of up to 32 by 32 nodes, so that a node's bytes travel once a
   block and not once a pair.  Nothing is capped or sampled.

The number of bands follows from the threshold: a pair at it is missed with a
probability of a few in a million, one above it more rarely; the radius lies four
and a half standard deviations beyond the expected distance at the threshold, the
bound on the eight-bit signatures five.  ``exact``
takes the rare shingles of each set as keys instead (a prefix filter: sets at the
threshold share one of them, without exception) and no radius: nothing is missed,
at the cost of counting and shuffling every shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import mix64, shingle_sets
from .components import connected_components
from ..operators.tables import materialize, pick, release, rows_at_most, spread

BITS = 128
BROADCAST_ROWS = 8_192
HOLDER_ROWS = 200_000
MISS = 1e-6
SIDE = 32  # nodes on each side of a block of pairs to verify
BUCKET_PAIRS = 256  # pairs of small groups verified together


def bands_for(threshold: float, rows: int = 3) -> int:
    """Keys that miss a pair at ``threshold`` with a probability of about :data:`MISS`."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - min(threshold, 1 - 1e-9) ** rows)))


def band_members(bands: int, rows: int) -> np.ndarray:
    """Hashes of each key: disjoint runs of the hashes in order, then of the hashes in one mixed order after another."""
    every = np.arange(BITS, dtype=np.uint64)
    orders = [np.arange(BITS)] + [np.argsort(mix64(every + np.uint64(1000 * k + 1))) for k in range(1, -(-bands // (BITS // rows)))]
    return np.array([o[rows * k : rows * (k + 1)] for o in orders for k in range(BITS // rows)][:bands])


def _multipliers() -> np.ndarray:
    odd = mix64(np.arange(1, BITS + 1, dtype=np.uint64))
    return (odd >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _blocks(texts: list[str], limit: int = 200_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters, so arrays stay in cache."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sketches(width: int, min_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _multipliers()
        seen: set[int] = set()
        weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
        members = band_members(bands, rows)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in _blocks(texts):
                h, off, n_words = shingle_sets(texts[lo:hi], width)
                n = np.diff(off)
                use = np.flatnonzero((n_words >= min_words) & (n > 0))
                if not use.size:
                    continue
                starts = off[:-1][n > 0]
                at = np.searchsorted(np.flatnonzero(n > 0), use)
                node = (np.add.reduceat(mix64(h), starts) ^ mix64(np.bitwise_xor.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), starts)))[at]
                h32 = (h >> np.uint64(32)).astype(np.uint32)
                buf = np.empty_like(h32)
                sig = np.empty((BITS, use.size), np.uint32)
                for k in range(BITS):
                    np.multiply(h32, mult[k], out=buf)
                    buf ^= buf >> np.uint32(15)
                    sig[k] = np.minimum.reduceat(buf, starts)[at]
                # one bit of each min-wise hash, and eight others for a closer look
                mixed = mix64(sig.ravel()).reshape(sig.shape).T
                bit, octets = mixed & np.uint64(1), (mixed >> np.uint64(8)).astype(np.uint8)
                fp = [(bit[:, 64 * j : 64 * (j + 1)] * weight).sum(axis=1, dtype=np.uint64).view(np.int64) for j in (0, 1)]
                keys = np.empty((use.size, bands), np.uint64)
                for j in range(bands):
                    x = np.full(use.size, j + 1, np.uint64)
                    for q in members[j]:
                        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + sig[q])
                    keys[:, j] = x
                names = node.view(np.int64)
                fresh = np.zeros(use.size, bool)
                for i, x in enumerate(names.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                counts = np.concatenate(([0], np.cumsum(fresh * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(counts), pa.array(keys[fresh].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][use], pa.int64()), pa.array(names), pa.array(n[use].astype(np.int32)), pa.array(fp[0]), pa.array(fp[1]), lists, pa.array([o.tobytes() if f else None for o, f in zip(octets, fresh)], pa.binary())],
                    ["id", "node", "n", "f0", "f1", "keys", "octets"],
                )

    return run


SKETCH = "id long, node long, n int, f0 long, f1 long, keys array<long>, octets binary"


def sketch_texts(docs: DataFrame, id_col: str, text_col: str, width: int = 3, min_words: int = 40, bands: int = 57, rows: int = 3) -> DataFrame:
    """Sketch rows of all texts with at least ``min_words`` words.

    ``keys`` is filled for the first row of a node in each task and empty for
    its further copies there, so a text that makes up a third of the corpus
    sends one row a task into the shuffle.
    """
    rows_in = pick(docs, id=id_col, text=text_col).filter("id is not null and text is not null and text <> ''")
    return spread(rows_in).mapInArrow(_sketches(width, min_words, bands, rows), SKETCH)


def _radius(threshold: float) -> int:
    p = (1 - threshold) / 2
    return min(BITS, math.ceil(BITS * (p + 4.5 * math.sqrt(p * (1 - p) / BITS))))


def compare_run(node: np.ndarray, n: np.ndarray, f0: np.ndarray, f1: np.ndarray, threshold: float, radius: int, side: np.ndarray | None = None, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one block within the radius, by tiles in order of set size.

    Fingerprints at distance d have population counts at most d apart, so tile
    pairs whose counts differ by more than ``radius`` are skipped whole; so are
    those whose sizes break ``min(n) >= threshold * max(n)``.  With ``side``
    only pairs of different sides are compared.
    """
    order = np.argsort(n, kind="stable")
    ns, a0, a1, names = n[order], f0[order].view(np.uint64), f1[order].view(np.uint64), node[order]
    sides = None if side is None else side[order]
    pop = np.bitwise_count(a0).astype(np.int16) + np.bitwise_count(a1)
    edges = np.arange(0, len(ns), tile)
    least, most = (np.minimum.reduceat(pop, edges), np.maximum.reduceat(pop, edges)) if len(ns) else (pop, pop)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for i in range(0, len(ns), tile):
        I = slice(i, i + tile)
        top = ns[I][-1]
        for j in range(i, len(ns), tile):
            J = slice(j, j + tile)
            if top < threshold * ns[j]:
                break  # every later tile has larger sets still
            if max(least[i // tile], least[j // tile]) - min(most[i // tile], most[j // tile]) > radius:
                continue
            near = np.bitwise_count(a0[I, None] ^ a0[None, J]).astype(np.uint8)
            near += np.bitwise_count(a1[I, None] ^ a1[None, J])
            hit = near <= radius
            if i == j:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            x, y = x + i, y + j
            ok = (ns[x] >= threshold * ns[y]) & (names[x] != names[y])
            if sides is not None:
                ok &= sides[x] != sides[y]
            left.append(order[x[ok]])
            right.append(order[y[ok]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _pairs(threshold: float, radius: int):

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([lo, hi], 1), axis=0) if lo.size else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def work(key, node, n, f0, f1, side) -> Iterator[pa.RecordBatch]:
        f0, f1 = f0.view(np.uint64), f1.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.concatenate((edge, [key.size])))
        out_a, out_b = [], []
        for size in np.unique(length[length > 1]):
            runs = edge[length == size]
            if size <= 24 and side is None:  # all runs of one length at once
                at = runs[:, None] + np.arange(size)
                p, q = np.triu_indices(size, 1)
                x, y = at[:, p].ravel(), at[:, q].ravel()
                small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                near = np.bitwise_count(f0[x] ^ f0[y]) + np.bitwise_count(f1[x] ^ f1[y])
                ok = (near <= radius) & (small >= threshold * large) & (node[x] != node[y])
                out_a.append(node[x[ok]])
                out_b.append(node[y[ok]])
            else:
                for s in runs:
                    r = slice(s, s + size)
                    x, y = compare_run(node[r], n[r], f0[r], f1[r], threshold, radius, None if side is None else side[r])
                    out_a.append(node[r][x])
                    out_b.append(node[r][y])
        if out_a:
            yield emit(np.concatenate(out_a), np.concatenate(out_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a run cut by a batch end is carried over (runs are at most two tiles)."""
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            c = {k: t.column(k).to_numpy() for k in t.column_names}
            cut = int(np.searchsorted(c["key"], c["key"][-1]))
            rest = t.slice(cut)
            if cut:
                yield from work(*(c[k][:cut] for k in ("key", "node", "n", "f0", "f1")), c["side"][:cut] if "side" in c else None)
        if rest is not None and rest.num_rows:
            c = {k: rest.column(k).to_numpy() for k in rest.column_names}
            yield from work(*(c[k] for k in ("key", "node", "n", "f0", "f1")), c.get("side"))

    return run


def candidate_pairs(banded: DataFrame, threshold: float, tile: int = 4096, radius: int | None = None) -> DataFrame:
    """Distinct node pairs ``(a, b)``, a < b, of ``(key, node, n, f0, f1)`` that share a key and lie within the radius."""
    spark = banded.sparkSession
    radius = _radius(threshold) if radius is None else radius
    hot = materialize(banded.groupBy("key").count().filter(F.col("count") > tile).select("key"))
    runs = banded
    pairs = None
    if not hot.isEmpty():
        # copies of one text reach a run once for each task; they go first
        few = F.broadcast(hot) if rows_at_most(hot, BROADCAST_ROWS) else hot
        crowd = materialize(banded.join(few, "key").dropDuplicates(["key", "node"]))
        runs = banded.join(few, "key", "left_anti")
        sizes = crowd.groupBy("key").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
        # half steps of the size ratio: partners lie at most two classes apart
        step = -math.log(threshold) / 2
        own = crowd.join(sizes, "key").withColumn("cls", F.floor(F.log("n") / step).cast("int")).withColumn("own", F.pmod(F.hash("node"), "tiles"))
        # as the smaller side a row visits every tile of its class and the next two; as the larger side, those below
        visits = F.expr("transform(sequence(0, tiles - 1), v -> struct(least(own, v) as lo, greatest(own, v) as hi, v))")
        same = own.select("*", F.explode(visits).alias("p")).select(
            F.xxhash64("key", F.lit(0), "cls", "p.lo", "p.hi").alias("key"), "node", "n", "f0", "f1", F.when(F.col("p.lo") == F.col("p.hi"), F.pmod(F.xxhash64("node"), F.lit(2**31 - 1))).otherwise(F.col("own")).cast("int").alias("side")
        )
        up = own.select("*", F.explode(F.expr("sequence(0, tiles - 1)")).alias("v"), F.lit(0).alias("side")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("d")).select(
            F.xxhash64("key", "d", "cls", "own", "v").alias("key"), "node", "n", "f0", "f1", "side"
        )
        down = own.select("*", F.explode(F.expr("sequence(0, tiles - 1)")).alias("v"), F.lit(1).alias("side")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("d")).select(
            F.xxhash64("key", "d", F.col("cls") - F.col("d"), "v", "own").alias("key"), "node", "n", "f0", "f1", "side"
        )
        tiles = same.union(up).union(down)
        pairs = tiles.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(threshold, radius), "a long, b long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = runs.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_pairs(threshold, radius), "a long, b long")
    return (found if pairs is None else found.union(pairs)).distinct()


def rare_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, node, n)``: of the n shingles of a set the rarest ``n - ceil(threshold n) + 1``, in one order for all sets.

    Sets at the threshold share one of them.  Every shingle of every set is counted.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(lo, 64)]
                size = np.array([v.size for v in values], np.int32)
                take = pa.array(np.repeat(np.arange(size.size, dtype=np.int32), size))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values) if values else np.empty(0, np.int64)), batch.column(0).slice(lo, 64).take(take), pa.array(np.repeat(size, size))], ["key", "node", "n"])

    flat = materialize(sets.select("node", "s").mapInArrow(unpack, "key long, node long, n int"))
    often = flat.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")  # a shingle of one set joins nothing, but fills its place in the prefix
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("c", F.lit(1)), "key"))
    return flat.join(often, "key", "left").withColumn("r", place).filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("c").isNotNull()).select("key", "node", "n")


def _jaccard(threshold: float):
    """Pairs of a block and the sets of its nodes -> pairs at the threshold."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {k: np.frombuffer(v.as_buffer(), np.uint64) for k, v in zip(sets.column("node").to_pylist(), sets.column("s"))}
        a, b, sim = pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), []
        for i, j in zip(a, b):
            p, q = held.get(i), held.get(j)
            if p is None or q is None:
                sim.append(0.0)
                continue
            both = np.concatenate((p, q))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            sim.append(common / (p.size + q.size - common))
        s = np.array(sim)
        keep = pa.array(s >= threshold - 1e-12)
        return pa.table({"a": pairs.column("a").filter(keep), "b": pairs.column("b").filter(keep), "similarity": pa.array(s).filter(keep)})

    return run


def _alike(threshold: float):
    """Pairs of a block and the signatures of its nodes -> pairs that may be at the threshold."""
    p = threshold + (1 - threshold) / 256
    least = math.floor(BITS * (p - 5 * math.sqrt(p * (1 - p) / BITS)))

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        node = held.column("node").to_numpy()
        order = np.argsort(node)
        octets = np.frombuffer(b"".join(held.column("s").to_pylist()), np.uint8).reshape(-1, BITS)[order]
        a, b = (np.searchsorted(node[order], pairs.column(c).to_numpy()) for c in "ab")
        keep = pa.array((octets[a] == octets[b]).sum(axis=1) >= least)
        return pa.table({"a": pairs.column("a").filter(keep), "b": pairs.column("b").filter(keep)})

    return run


def in_blocks(pairs: DataFrame, held: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on blocks of ``pairs(a, b)`` together with the rows ``held(node, s)`` of their nodes.

    Pairs are grouped by the smallest candidate of their first node, so members
    of a crowd share a group; a group of more than :data:`SIDE` nodes on a side is
    cut into blocks by both sides, small groups are done many at a time.  What a
    node holds is shipped once to each block it takes part in.
    """
    lead = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("lead"))
    grouped = materialize(pairs.join(lead, "a", "left").select("a", "b", F.coalesce("lead", "a").alias("g")))
    wide = grouped.groupBy("g").agg(F.ceil(F.count_distinct("a") / SIDE).alias("ka"), F.ceil(F.count_distinct("b") / SIDE).alias("kb")).filter("ka > 1 or kb > 1")
    wide = materialize(wide)
    buckets = max(1, -(-grouped.count() // BUCKET_PAIRS))
    if wide.isEmpty():
        placed = grouped.select("a", "b", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("block"))
    else:
        block = F.when(F.col("ka").isNull(), F.pmod(F.xxhash64("g"), F.lit(buckets))).otherwise(F.xxhash64("g", F.pmod(F.hash("a"), "ka"), F.pmod(F.hash("b"), "kb")))
        placed = grouped.join(F.broadcast(wide) if rows_at_most(wide, BROADCAST_ROWS) else wide, "g", "left").select("a", "b", block.alias("block"))
    placed = materialize(placed)
    release(grouped)
    need = placed.select(F.col("block").alias("in_block"), F.col("a").alias("node")).union(placed.select(F.col("block").alias("in_block"), F.col("b").alias("node"))).distinct()
    shipped = need.join(held, "node").select("in_block", "node", "s")
    return placed.groupBy("block").cogroup(shipped.groupBy("in_block")).applyInArrow(work, schema)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` of the pairs whose sets are at the threshold."""
    return in_blocks(pairs, sets, _jaccard(threshold), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, min_words: int = 1, bands: int | None = None, rows: int = 3, tile: int = 4096, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes: ``members(id, node)`` and ``links(a, b, similarity)``.

    Texts with the same shingle set share a node; ``links`` joins different
    nodes whose exact Jaccard similarity is at least ``threshold``.  Copies are
    not expanded into pairs (see :func:`expand_pairs`).  Rows with a null id or
    text, and texts of fewer than ``min_words`` words or ``width`` words, take
    no part; an id with several rows has each of its texts as a member;
    repeated rows count once; an empty table gives empty results; further
    columns of ``docs`` are ignored.
    """
    bands = bands_for(threshold, rows) if bands is None else bands
    sketches = materialize(sketch_texts(docs, id_col, text_col, width, min_words, bands, rows))
    members = sketches.select("id", "node").distinct()
    texts = pick(docs, id=id_col, text=text_col).filter("id is not null and text is not null and text <> ''")
    firsts = sketches.filter("size(keys) > 0")
    if exact:
        holders = materialize(firsts.groupBy("node").agg(F.min("id").alias("id")))
        sets = materialize(_sets_of(texts.join(holders, "id").select("node", "text"), width))
        banded = rare_keys(sets, threshold).withColumns({"f0": F.lit(0).cast("long"), "f1": F.lit(0).cast("long")})
        return members, verified(materialize(candidate_pairs(banded, threshold, tile, BITS)), sets, threshold)
    banded = firsts.select(F.explode("keys").alias("key"), "node", "n", "f0", "f1")
    close = materialize(candidate_pairs(banded, threshold, tile))
    octets = firsts.dropDuplicates(["node"]).select("node", F.col("octets").alias("s"))
    pairs = materialize(in_blocks(close, octets, _alike(threshold), "a long, b long"))
    release(close)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    # one text of each node in question
    holders = materialize(firsts.join(wanted, "node").groupBy("node").agg(F.min("id").alias("id")))
    few = F.broadcast(holders) if rows_at_most(holders, HOLDER_ROWS) else holders  # keeps the texts of all others out of a shuffle
    # an id may carry other texts too: the one whose shingles name the node is kept
    return members, verified(pairs, materialize(_sets_of(texts.join(few, "id").select("node", "text"), width)), threshold)


def _sets_of(held: DataFrame, width: int) -> DataFrame:
    """``(node, s)``: the packed shingle set of each node, of rows ``(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            want = batch.column(0).to_numpy()
            for lo, hi in _blocks(texts):
                h, off, _ = shingle_sets(texts[lo:hi], width)
                n = np.diff(off)
                full = np.flatnonzero(n > 0)
                if not full.size:
                    continue
                starts = off[:-1][full]
                node = (np.add.reduceat(mix64(h), starts) ^ mix64(np.bitwise_xor.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), starts))).view(np.int64)
                names, sets = [], []
                for x, i in zip(node.tolist(), full.tolist()):
                    if x == want[lo + i]:
                        names.append(x)
                        sets.append(h[off[i] : off[i + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["node", "s"])

    return held.select("node", "text").mapInArrow(run, "node long, s binary").dropDuplicates(["node"])


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All id pairs ``(id_a, id_b)``, id_a < id_b: within nodes and across linked nodes.

    The output is quadratic in the number of copies by definition; use
    :func:`group_members` where classes are enough.
    """
    ma = members.select(F.col("id").alias("x"), F.col("node").alias("a"))
    mb = members.select(F.col("id").alias("y"), F.col("node").alias("b"))
    across = links.select("a", "b").join(ma, "a").join(mb, "b").select("x", "y")
    crowded = members.groupBy("node").count().filter("count > 1").select("node")
    copies = members.join(crowded, "node")
    within = copies.select(F.col("id").alias("x"), "node").join(copies.select(F.col("id").alias("y"), "node"), "node").filter("x < y").select("x", "y")
    return across.union(within).filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def group_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row an id: ``(id, class_id, n_links)``.

    ``class_id`` is the smallest id of the connected component, ``n_links`` the
    number of other texts the id's text is linked to.  Copies are not expanded.
    """
    links = materialize(links)
    comp = connected_components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    rows = members.join(comp, "node", "left").join(degree, "node", "left").select("id", F.coalesce("component", "node").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = rows.groupBy("c").agg(F.min("id").alias("class_id"))
    return rows.join(named, "c").groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
