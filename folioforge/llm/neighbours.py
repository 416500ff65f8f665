"""k most similar vectors of every vector: partitioned search over 4-bit score-aware codes.

*Fit* (driver, on a bounded sample of ``sample`` vectors, eight a cell where that
is more, and never more than ``fit_bytes``): spherical k-means cells, about one per
``per_cell`` vectors and at most ``max_cells`` or a quarter of ``fit_bytes``, as a
two-level tree where there are many, and a product code of two dimensions and 16
words each, fitted on ``word_sample`` vectors of the sample under the anisotropic
loss ``|r|^2 + (eta - 1) (x.r)^2`` that weighs the residual parallel to the
vector ``eta`` times the orthogonal one, as inner products of near neighbours
suffer from the parallel part.

*Search* (cluster): every vector lives in its best cell and visits its
``probes`` best cells.  A group (cell, block, query block) is bounded however
crowded a cell is: large cells are split into blocks of vectors and blocks of
queries.  In a group the residuals are coded (two 4-bit words a byte), each
query's inner products with the words fill byte tables quantised to 8 bits, the
scan adds looked-up entries, and the ``rerank`` best go to an exact dot product
on whole vectors.  Equal vectors are searched once and expanded afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import materialize, pick, spread

WORDS = 16
FLAT = 1024


@dataclass
class Codec:
    """Cell centroids, code words and the anisotropic weight.

    Above ``FLAT`` cells the centroids are the leaves of a two-level tree
    (``tops`` and the first leaf of each), so a vector meets a few hundred
    centroids however many cells there are.
    """

    centroids: np.ndarray  # cells x dim, unit length
    words: np.ndarray  # dim/2 x 16 x 2
    eta: float
    tops: np.ndarray | None = None
    first: np.ndarray | None = None

    def assign(self, x: np.ndarray, probes: int) -> np.ndarray:
        probes = min(probes, len(self.centroids))
        if self.tops is not None:
            return self._descend_tree(x, probes)
        s = x @ self.centroids.T
        if probes == len(self.centroids):
            return np.argsort(-s, axis=1, kind="stable").astype(np.int32)
        top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1).astype(np.int32)

    def _descend_tree(self, x: np.ndarray, probes: int, width: int = 12) -> np.ndarray:
        """Best leaves among those of each vector's ``width`` best top cells."""
        width = min(width, len(self.tops))
        near = np.argpartition(-(x @ self.tops.T), width - 1, axis=1)[:, :width]
        best = np.full((len(x), probes), -9.0, np.float32)
        leaf = np.zeros((len(x), probes), np.int32)
        order = np.argsort(near.ravel(), kind="stable")
        top, row = near.ravel()[order], order // width
        for lo, hi in zip(*(lambda e: (e, np.append(e[1:], top.size)))(np.flatnonzero(np.diff(top, prepend=-1)))):
            at, a, b = row[lo:hi], self.first[top[lo]], self.first[top[lo] + 1]
            s = np.concatenate((best[at], x[at] @ self.centroids[a:b].T), axis=1)
            who = np.concatenate((leaf[at], np.broadcast_to(np.arange(a, b, dtype=np.int32), (hi - lo, b - a))), axis=1)
            k = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
            best[at], leaf[at] = np.take_along_axis(s, k, 1), np.take_along_axis(who, k, 1)
        return np.take_along_axis(leaf, np.argsort(-best, axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, base: np.ndarray, rounds: int = 2) -> np.ndarray:
        """4-bit codes of ``x - base`` by coordinate descent on the anisotropic loss, two to a byte."""
        codes = _descend(x, x - base, self.words, self.eta, rounds)[0]
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Byte tables of each query, queries x bytes x 256, quantised to 8 bits with one scale a query."""
        d = self.words.shape[0]
        lut = np.einsum("bmd,mwd->bmw", q.reshape(len(q), d, 2), self.words)
        if d % 2:
            lut = np.concatenate((lut, np.zeros((len(q), 1, WORDS), lut.dtype)), axis=1)
        pair = (lut[:, 1::2, :, None] + lut[:, 0::2, None, :]).reshape(len(q), -1, 256)
        low = pair.min(axis=2, keepdims=True)
        pair -= low
        scale = 255.0 / np.maximum(pair.max(axis=(1, 2), keepdims=True), 1e-12)
        return np.rint(pair * scale).astype(np.uint8)


def _descend(x, e, words, eta, rounds):
    """Codes and residual inner products of residuals ``e`` of vectors ``x``, in blocks of at most 16 MB of working set (64 rows at least)."""
    rows = max(64, (1 << 17) // words.shape[0])
    if len(x) > rows:
        return tuple(np.concatenate(z) for z in zip(*(_descend(x[lo : lo + rows], e[lo : lo + rows], words, eta, rounds) for lo in range(0, len(x), rows))))
    n, m = len(x), words.shape[0]
    xs, es = x.reshape(n, m, 2), e.reshape(n, m, 2)
    codes = np.zeros((n, m), np.uint8)
    part = np.empty((n, m), np.float32)  # x_m . r_m
    every = np.arange(n)
    error = np.empty((m, n, WORDS), np.float32)  # |r_m|^2 of every word
    along = np.empty((m, n, WORDS), np.float32)  # x_m . r_m of every word
    for j in range(m):
        e_, x_, w = np.ascontiguousarray(es[:, j]), np.ascontiguousarray(xs[:, j]), words[j].T
        np.matmul(e_, w, out=error[j])
        error[j] *= -2
        error[j] += (e_ * e_).sum(1)[:, None]
        error[j] += (w * w).sum(0)
        np.matmul(x_, w, out=along[j])
        np.subtract((x_ * e_).sum(1)[:, None], along[j], out=along[j])
        codes[:, j] = error[j].argmin(1)
        part[:, j] = along[j][every, codes[:, j]]
    total = part.sum(1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - part[:, j]
            loss = along[j] + rest[:, None]
            loss *= loss
            loss *= eta - 1
            loss += error[j]
            best = loss.argmin(1)
            codes[:, j] = best
            part[:, j] = along[j][every, best]
            total = rest + part[:, j]
    return codes, part


def _cells(sample: np.ndarray, cells: int, rng: np.random.Generator, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and the cell of each vector."""
    dim = sample.shape[1]
    cells = max(1, min(cells, len(sample)))
    c = sample[rng.choice(len(sample), cells, replace=False)].copy()
    nearest = lambda: np.concatenate([np.argmax(sample[i : i + 8192] @ c.T, 1) for i in range(0, len(sample), 8192)])
    for _ in range(iterations):
        home = nearest()
        order = np.argsort(home, kind="stable")
        n = np.bincount(home, minlength=cells)
        sums = np.zeros((cells, dim), np.float32)
        filled = np.flatnonzero(n)
        sums[filled] = np.add.reduceat(sample[order], np.concatenate(([0], np.cumsum(n)[:-1]))[filled], axis=0)
        if (n == 0).any():
            sums[n == 0] = sample[rng.choice(len(sample), int((n == 0).sum()))]
        c = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return c, nearest()


def fit_codec(sample: np.ndarray, cells: int, seed: int = 7, iterations: int = 12, threshold: float = 0.2, word_sample: int = 32_768) -> Codec:
    """Fit cells on unit vectors ``sample`` and code words on ``word_sample`` of them, taken at even steps (deterministic)."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    tops = first = None
    if cells <= FLAT:
        c, home = _cells(sample, cells, rng, iterations)
    else:
        tops, parent = _cells(sample, int(np.ceil(np.sqrt(cells))), rng, iterations)
        parts, home, starts = [], np.empty(len(sample), np.int64), [0]
        for t in range(len(tops)):
            at = np.flatnonzero(parent == t)
            leaves, inner = _cells(sample[at], max(1, round(cells * at.size / len(sample))), rng, iterations) if at.size else (tops[t : t + 1], np.empty(0, np.int64))
            home[at] = inner + starts[-1]
            parts.append(leaves)
            starts.append(starts[-1] + len(leaves))
        c, first = np.concatenate(parts), np.array(starts)
    at = np.arange(0, len(sample), max(1, -(-len(sample) // word_sample)))
    x, e = sample[at], sample[at] - c[home[at]]
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    m = dim // 2
    es, xs = e.reshape(len(x), m, 2), x.reshape(len(x), m, 2)
    words = np.stack([es[rng.choice(len(x), WORDS, replace=len(x) < WORDS), j] for j in range(m)]).astype(np.float32)
    for _ in range(iterations // 2):
        codes, part = _descend(x, e, words, eta, 1)
        total = part.sum(1)
        for j in range(m):
            rest = total - part[:, j]
            target = rest + (xs[:, j] * es[:, j]).sum(1)
            for w in range(WORDS):
                at = codes[:, j] == w
                if not at.any():
                    continue
                a, t = xs[at, j], target[at]
                left = at.sum() * np.eye(2) + (eta - 1) * a.T @ a
                words[j, w] = np.linalg.solve(left, es[at, j].sum(0) + (eta - 1) * (a * t[:, None]).sum(0))
    return Codec(c, words, float(eta), tops, first)


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of packed half or single floats (a block holds one kind or a mix); an odd dimension gets a zero beside it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.empty(0, np.uint8)
    size = np.diff(off)
    out = np.zeros((len(column), dim + dim % 2), np.float32)
    for width, kind in ((2, np.float16), (4, np.float32)):
        at = np.flatnonzero(size == width * dim)
        if at.size:
            out[at, :dim] = np.ascontiguousarray(data[off[at][:, None] + np.arange(width * dim)]).view(kind)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def chunk_vectors(docs: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Valid vectors ``(id, chunk, v)`` of an array-of-arrays column, one row an (id, chunk).

    ``v`` is packed, as half floats where that loses nothing.  Vectors that are
    null, of another length, not finite or all zero are left out; ``chunk`` is
    the place in the array from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, outer = batch.column(0), batch.column(1)
            parent = pa.compute.list_parent_indices(outer)
            inner = outer.flatten()
            if not len(inner):
                continue
            row = parent.to_numpy()
            first = np.concatenate(([True], row[1:] != row[:-1]))
            start = np.flatnonzero(first)
            chunk = np.arange(row.size) - np.repeat(start, np.diff(np.concatenate((start, [row.size]))))
            length = pa.compute.list_value_length(inner).fill_null(-1).to_numpy()
            flat = inner.flatten().fill_null(float("nan")).to_numpy()
            begin = np.concatenate(([0], np.cumsum(np.maximum(length, 0))[:-1]))
            at = np.flatnonzero(length == dim)
            x = flat[begin[at][:, None] + np.arange(dim)].astype(np.float32)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            x, at = x[ok], at[ok]
            half = x.astype(np.float16)
            exact = (half.astype(np.float32) == x).all(1)
            packed = [h.tobytes() if f else v.tobytes() for h, v, f in zip(half, x, exact)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[at])), pa.array(chunk[at].astype(np.int32)), pa.array(packed, pa.binary())], ["id", "chunk", "v"])

    rows = pick(docs, id=id_col, vec=vec_col).filter("id is not null and vec is not null")
    return spread(rows).mapInArrow(run, "id long, chunk int, v binary").dropDuplicates(["id", "chunk"])


def _route(codec: Codec, probes: int, dim: int, blocks: dict[int, int], query_blocks: dict[int, int]):
    """Rows of every group a vector takes part in: as member (role 0), as query (1) or both (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = codec.assign(_unpack(batch.column(2), dim), probes)
            salt = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + batch.column(1).to_numpy().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)
            take, cell, blk, qblk, role = [], [], [], [], []
            every = np.arange(batch.num_rows)
            for p in range(cells.shape[1]):
                c = cells[:, p]
                b = np.array([blocks.get(int(k), 1) for k in c])
                q = np.array([query_blocks.get(int(k), 1) for k in c])
                mine, asks = (salt % b).astype(np.int64), ((salt >> np.uint64(8)) % q).astype(np.int64)
                # as a query: every block of the cell, in its own query block
                reps = np.repeat(every, b)
                bb = np.arange(reps.size) - np.repeat(np.cumsum(b) - b, b)
                take.append(reps), cell.append(c[reps]), blk.append(bb), qblk.append(asks[reps])
                role.append(np.where((bb == mine[reps]) if p == 0 else np.zeros(reps.size, bool), 2, 1))
                if p == 0 and (q > 1).any():  # as a member: every further query block of its block
                    reps = np.repeat(every, q)
                    qq = np.arange(reps.size) - np.repeat(np.cumsum(q) - q, q)
                    keep = qq != asks[reps]
                    reps, qq = reps[keep], qq[keep]
                    take.append(reps), cell.append(c[reps]), blk.append(mine[reps]), qblk.append(qq), role.append(np.zeros(reps.size, np.int64))
            t = np.concatenate(take)
            for lo in range(0, t.size, 20_000):
                s = slice(lo, lo + 20_000)
                i = pa.array(t[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)[s].astype(np.int32)) for x in (cell, blk, qblk)] + [pa.array(np.concatenate(role)[s].astype(np.int8))] + [batch.column(k).take(i) for k in range(3)],
                    ["cell", "blk", "qblk", "role", "id", "chunk", "v"],
                )

    return run


def _search(codec: Codec, dim: int, k: int, rerank: int):
    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids, chunks = table.column("id").to_numpy(), table.column("chunk").to_numpy()
        x = _unpack(table.column("v"), dim)
        base = codec.centroids[table.column("cell")[0].as_py()]
        member, query = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        db = np.ascontiguousarray(x[member])
        out_q, out_m, out_s = [], [], []
        if member.size:
            depth = min(max(rerank, k + 1), member.size)
            codes = np.ascontiguousarray(codec.encode(db, base).T.astype(np.intp))
            place = np.full(len(x), -1)
            place[member] = np.arange(member.size)
            for lo in range(0, query.size, 128):
                at = query[lo : lo + 128]
                q = x[at]
                if depth < member.size:
                    lut = codec.tables(q)
                    score = np.zeros((len(at), member.size), np.uint16 if 255 * codes.shape[0] < 1 << 16 else np.uint32)
                    for j in range(codes.shape[0]):
                        score += lut[:, j, :].take(codes[j], axis=1)
                    cand = np.argpartition(score, member.size - depth, axis=1)[:, member.size - depth :]
                else:
                    cand = np.broadcast_to(np.arange(member.size), (len(at), member.size))
                exact = np.einsum("brd,bd->br", db[cand], q)
                exact[cand == place[at][:, None]] = -9
                keep = min(k, depth)
                top = np.argpartition(-exact, keep - 1, axis=1)[:, :keep]
                s = np.take_along_axis(exact, top, 1)
                m = np.take_along_axis(cand, top, 1)
                b, _ = np.nonzero(s > -8)
                out_q.append(at[b]), out_m.append(member[m[s > -8]]), out_s.append(s[s > -8])
        a = np.concatenate(out_q) if out_q else np.empty(0, np.int64)
        m = np.concatenate(out_m) if out_m else np.empty(0, np.int64)
        return pa.table({"id": ids[a], "chunk": chunks[a], "n_id": ids[m], "n_chunk": chunks[m], "score": np.concatenate(out_s).astype(np.float32) if out_s else np.empty(0, np.float32)})

    return run


NEIGHBOURS = "id long, chunk int, n_id long, n_chunk int, score float"


def nearest_neighbours(vectors: DataFrame, dim: int, k: int, probes: int = 6, per_cell: int = 1000, max_cells: int = 65_536, rerank: int = 32, block: int = 8192, sample: int = 32_768, word_sample: int = 32_768, fit_bytes: int = 256 << 20) -> DataFrame:
    """``k`` most similar (cosine) other vectors of every vector of ``(id, chunk, v)``.

    Result ``(id, chunk, n_id, n_chunk, score)``.  Ties go to the smaller
    (n_id, n_chunk).  Fewer than ``k`` rows come out where fewer other vectors
    exist; an empty table gives an empty result.  The index is fitted on
    bounded samples (``sample``, ``word_sample``, together within ``fit_bytes``
    as single floats); every vector is indexed and searched.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors.withColumn("node", F.xxhash64("v")))
    grouped = vectors.groupBy("node").agg(F.min(F.struct("id", "chunk")).alias("m"), F.count("*").alias("copies"))
    repeated = materialize(grouped.filter("copies > 1").select("node", "m.*"))
    same = not repeated.isEmpty()
    # one representative of each set of equal vectors
    reps = vectors.drop("node") if not same else materialize(vectors.join(repeated.select("node", F.col("id").alias("i"), F.col("chunk").alias("c")), "node", "left").filter("i is null or (i = id and c = chunk)").select("id", "chunk", "v"))
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], NEIGHBOURS)
    fit_rows = max(256, fit_bytes // (4 * dim))
    cells = min(max_cells, -(-n // per_cell), max(1, fit_rows // 4))
    sample = min(max(sample, 8 * cells), fit_rows)
    share = min(1.0, sample / n)
    got = reps.filter(F.pmod(F.xxhash64("chunk", "id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(sample + sample // 4).toArrow()
    codec = fit_codec(_unpack(got.column("v"), dim), cells, word_sample=word_sample)
    probes = min(probes, len(codec.centroids))

    def visits(batches):
        for batch in batches:
            if batch.num_rows:
                c = codec.assign(_unpack(batch.column(2), dim), probes)
                total, home = np.bincount(c.ravel(), minlength=len(codec.centroids)), np.bincount(c[:, 0], minlength=len(codec.centroids))
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(home[used].astype(np.int64)), pa.array(total[used].astype(np.int64))], ["cell", "home", "visits"])

    # at most max_cells rows
    sizes = reps.mapInArrow(visits, "cell int, home long, visits long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("visits").alias("visits")).collect()
    blocks = {r.cell: -(-r.home // block) for r in sizes if r.home > block}
    query_blocks = {r.cell: -(-r.visits // (8 * block)) for r in sizes if r.visits > 8 * block}
    routed = reps.mapInArrow(_route(codec, probes, dim, blocks, query_blocks), "cell int, blk int, qblk int, role byte, id long, chunk int, v binary")
    found = routed.groupBy("cell", "blk", "qblk").applyInArrow(_search(codec, dim, k, rerank), NEIGHBOURS)
    order = Window.partitionBy("id", "chunk").orderBy(F.desc("score"), "n_id", "n_chunk")
    if same:
        found = _with_copies(found, vectors, repeated, k)
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _with_copies(found: DataFrame, vectors: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """Neighbours with equal vectors put back: each set offers its k + 1 smallest members, which is all a top k can hold."""
    w = Window.partitionBy("id", "chunk").orderBy(F.desc("score"), "n_id", "n_chunk")
    found = materialize(found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r"))
    heads = repeated.select("node", F.col("id").alias("h_id"), F.col("chunk").alias("h_chunk"))
    members = materialize(vectors.join(heads, "node").select("h_id", "h_chunk", "id", "chunk"))
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("h_id", "h_chunk").orderBy("id", "chunk"))).filter(F.col("r") <= k + 1).drop("r")
    offer = materialize(ranked.select("h_id", "h_chunk", F.col("id").alias("o_id"), F.col("chunk").alias("o_chunk")))
    wide = found.join(offer, (F.col("n_id") == F.col("h_id")) & (F.col("n_chunk") == F.col("h_chunk")), "left").select("id", "chunk", F.coalesce("o_id", "n_id").alias("n_id"), F.coalesce("o_chunk", "n_chunk").alias("n_chunk"), "score")
    own = offer.select(F.col("h_id").alias("id"), F.col("h_chunk").alias("chunk"), F.col("o_id").alias("n_id"), F.col("o_chunk").alias("n_chunk"), F.lit(1.0).cast("float").alias("score"))
    per_head = Window.partitionBy("id", "chunk").orderBy(F.desc("score"), "n_id", "n_chunk")
    wide = wide.union(own).withColumn("r", F.row_number().over(per_head)).filter(F.col("r") <= k + 1).drop("r")
    wide = materialize(wide)
    others = members.select(F.col("h_id"), F.col("h_chunk"), F.col("id").alias("q_id"), F.col("chunk").alias("q_chunk"))
    at_head = (F.col("id") == F.col("h_id")) & (F.col("chunk") == F.col("h_chunk"))
    # two inner parts, so that the copies of one vector can be split over tasks
    lone = wide.join(heads.select("h_id", "h_chunk"), at_head, "left_anti")
    copied = wide.join(others, at_head).select(F.col("q_id").alias("id"), F.col("q_chunk").alias("chunk"), "n_id", "n_chunk", "score")
    return lone.union(copied).filter("not (id = n_id and chunk = n_chunk)")


def exact_neighbours(queries: DataFrame, vectors: DataFrame, dim: int, k: int, groups: int = 32) -> DataFrame:
    """Exact ``k`` nearest of a stated query set: all vectors against all queries, in blocks.

    The reference for measuring recall.  Queries are cut into ``groups`` blocks;
    every block meets every vector block once and only k rows a query leave it.
    """
    q = queries.select(F.pmod(F.hash("id", "chunk"), F.lit(groups)).alias("g"), "id", "chunk", "v", F.lit(1).cast("byte").alias("role"))
    q = q.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    d = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "id", "chunk", "v", F.lit(0).cast("byte").alias("role")).withColumn("d", F.pmod(F.hash("chunk", "id"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        role, ids, chunks = (table.column(c).to_numpy() for c in ("role", "id", "chunk"))
        x = _unpack(table.column("v"), dim)
        m, a = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        rows = []
        for lo in range(0, a.size, 256):
            at = a[lo : lo + 256]
            s = x[at] @ x[m].T
            s[(ids[at][:, None] == ids[m][None]) & (chunks[at][:, None] == chunks[m][None])] = -9
            keep = min(k, m.size)
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if keep else np.empty((len(at), 0), int)
            v = np.take_along_axis(s, top, 1)
            b, c = np.nonzero(v > -8)
            rows.append((at[b], m[top[b, c]], v[b, c]))
        q, t, v = (np.concatenate([r[i] for r in rows]) if rows else np.empty(0, np.int64) for i in range(3))
        return pa.table({"id": ids[q], "chunk": chunks[q], "n_id": ids[t], "n_chunk": chunks[t], "score": v.astype(np.float32)})

    found = q.select("g", "d", "role", "id", "chunk", "v").union(d.select("g", "d", "role", "id", "chunk", "v")).groupBy("g", "d").applyInArrow(run, NEIGHBOURS)
    order = Window.partitionBy("id", "chunk").orderBy(F.desc("score"), "n_id", "n_chunk")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs, the smaller (id, chunk) first."""
    first = F.struct(F.col("id").alias("i"), F.col("chunk").alias("c"))
    second = F.struct(F.col("n_id").alias("i"), F.col("n_chunk").alias("c"))
    return found.select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).distinct().select(F.col("a.i").alias("id_a"), F.col("a.c").alias("chunk_a"), F.col("b.i").alias("id_b"), F.col("b.c").alias("chunk_b"))
