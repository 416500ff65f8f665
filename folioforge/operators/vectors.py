"""Chunk vectors: an article's best chunk for a query vector, by a scan or from a written index of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialize, spread

EXACT_BELOW = 2000
BUCKETS = 256
MAX_CELLS = 16_384


def _flat(outer: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable chunks of a batch of arrays of arrays: row, place in the row, values (doubles)."""
    row, inner = pc.list_parent_indices(outer).to_numpy(), outer.flatten()
    if not len(inner):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dim))
    start = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(row.size) - np.repeat(start, np.diff(np.append(start, row.size)))
    length = pc.fill_null(pc.list_value_length(inner), -1).to_numpy()
    values = pc.fill_null(inner.flatten(), float("nan")).to_numpy()
    begin = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    at = np.flatnonzero(length == dim)
    x = values[begin[at][:, None] + np.arange(dim)].astype(np.float64)
    ok = np.isfinite(x).all(axis=1)
    return row[at][ok], place[at][ok], x[ok]


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with ``q``; 0 where one is all zero."""
    length = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())
    return np.divide(x @ q, length, out=np.zeros(len(x)), where=length > 0)


def best_chunk(vectors: DataFrame, id_col: str, vec_col: str, query: list[float]) -> DataFrame:
    """``(doc_id, score, chunk_no)`` of every row: its score is that of its best chunk, the first on ties.

    One pass of matrix products, nothing is exploded or shuffled; chunks of
    another length than the query, with missing or non-finite values do not
    count, and a row without any gives none.
    """
    q = np.array(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, x = _flat(batch.column(1), q.size)
            if not row.size:
                continue
            s = _cosines(x, q)
            order = np.lexsort((place, -s, row))
            best = order[np.diff(row[order], prepend=-1) > 0]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[best])), pa.array(s[best]), pa.array(place[best].astype(np.int32))], ["doc_id", "score", "chunk_no"])

    rows = spread(vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("vec")).filter("vec is not null"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, chunk_no int")


def best_per_article(scored: DataFrame) -> DataFrame:
    """One row a ``doc_id``: the best of its rows."""
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("chunk_no")).alias("c"))).alias("m")).select("doc_id", "m.score", (-F.col("m.c")).alias("chunk_no"))


def unit_cells(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-30), c).astype(np.float32)
    return c


def write_cells(vectors: DataFrame, path: str, dim: int, id_col: str = "Id", vec_col: str = "Vec", per_cell: int = 1000, sample: int = 32_768) -> dict:
    """Write chunk vectors by cell; returns ``n``, ``dim`` and ``cells``.

    Cells are fitted on at most ``sample`` vectors, every vector is written.
    Below :data:`EXACT_BELOW` vectors there is one cell, so a search is exact.
    """
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("vec")).filter("vec is not null")
    kind = dict(rows.dtypes)["doc_id"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, x = _flat(batch.column(1), dim)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0).astype(np.float32)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)), v], ["doc_id", "chunk_no", "v"])

    chunks = materialize(spread(rows).mapInArrow(unpack, f"doc_id {kind}, chunk_no int, v array<float>"))
    n = chunks.count()
    cells = 1 if n < EXACT_BELOW else min(MAX_CELLS, -(-n // per_cell))
    share = min(1.0, 1.25 * sample / max(n, 1))
    got = chunks.filter(F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(sample).toArrow().column("v").combine_chunks()
    x = got.flatten().to_numpy().reshape(-1, dim) if len(got) else np.zeros((1, dim), np.float32)
    c = unit_cells(np.ascontiguousarray(x, np.float32), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).flatten().to_numpy().reshape(-1, dim)
            home = np.argmax(v @ c.T, axis=1) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((home % BUCKETS).astype(np.int32)), pa.array(home.astype(np.int32)), *batch.columns], ["bucket", "cell", "doc_id", "chunk_no", "v"])

    placed = chunks.mapInArrow(place, f"bucket int, cell int, doc_id {kind}, chunk_no int, v array<float>")
    placed.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vectors")
    chunks.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, v array<float>").write.mode("overwrite").parquet(f"{path}/centroids")
    return {"n": n, "dim": dim, "cells": len(c)}


def search_cells(spark: SparkSession, path: str, query: list[float], probes: int = 256) -> DataFrame:
    """``(doc_id, score, chunk_no)`` of the articles in the ``probes`` cells nearest to the query; only those cells are read."""
    held = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()  # at most MAX_CELLS rows
    c = held.column("v").combine_chunks().flatten().to_numpy().reshape(held.num_rows, -1)
    q = np.array(query, np.float64)
    cells = np.argsort(-(c @ q), kind="stable")[:probes].tolist()
    rows = spark.read.parquet(f"{path}/vectors")
    if len(cells) < len(c):
        rows = rows.filter(F.col("bucket").isin(sorted({x % BUCKETS for x in cells})) & F.col("cell").isin(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, q.size).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_cosines(x, q)), batch.column(1)], ["doc_id", "score", "chunk_no"])

    scored = rows.select("doc_id", "chunk_no", "v").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, chunk_no int")
    return best_per_article(scored)
