"""Hybrid search: keyword and vector pools fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyword import SearchOptions, fetch, matches, parse_query, pool, rank_score
from .snippet import snippet_column
from .vectors import best_chunk, best_per_article

CONSTANT, SCALE = 60, 1e6


def vector_rank(score: Column) -> Column:
    """0 to 100000; negative similarities become 0 after pooling."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0), F.floor(score * 100_000))).cast("int")


def reciprocal(pos: Column) -> Column:
    return F.coalesce(F.lit(SCALE) / (F.lit(CONSTANT) + pos), F.lit(0.0))


def fuse(keyword_pool: DataFrame, vector_pool: DataFrame) -> DataFrame:
    """Full outer join of two pools ``(doc_id, score, pos)``: score, krank and vrank (0: not in that pool)."""
    k = keyword_pool.select("doc_id", F.col("score").alias("ks"), F.col("pos").alias("kpos"))
    v = vector_pool.select("doc_id", F.col("score").alias("vs"), F.col("pos").alias("vpos"))
    both = k.join(v, "doc_id", "full_outer")
    return both.select(
        "doc_id",
        (reciprocal(F.col("kpos")) + reciprocal(F.col("vpos"))).alias("score"),
        F.coalesce(rank_score(F.col("ks")), F.lit(0)).alias("krank"),
        F.coalesce(vector_rank(F.col("vs")), F.lit(0)).alias("vrank"),
        "kpos",
        "vpos",
    )


def fuse_union(keyword_pool: DataFrame, vector_pool: DataFrame) -> DataFrame:
    """The same fusion as a union and one aggregation: ``(doc_id, score)``."""
    both = keyword_pool.select("doc_id", reciprocal(F.col("pos")).alias("r")).unionByName(vector_pool.select("doc_id", reciprocal(F.col("pos")).alias("r")))
    return both.groupBy("doc_id").agg(F.sum("r").alias("score"))


def positions(fused: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows with ``fpos``; ties go to the smaller id."""
    best = fused.orderBy(F.desc("score"), "doc_id").limit(most)
    return best.withColumn("fpos", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def hybrid_search(docs: DataFrame, q: str, query_vector: list[float] | None, id_col: str = "Id", title_col: str = "Title", text_col: str = "Doc", vec_col: str = "Vec", options: SearchOptions = SearchOptions(), index: str | None = None) -> DataFrame:
    """``(fpos, score, krank, vrank, doc_id, title, snippet)`` of at most ``max_fetch`` articles, one row each.

    With ``index`` (the folder of written indexes) only the postings of the
    query's words and the nearest cells are read, without it texts and vectors
    are scanned.  Pools are top-k over the articles, fusion sees at most their
    two sizes; titles and texts are read for the final ids alone.  Where no word
    of the query stands in the text, the snippet begins at the best chunk.
    """
    from .index import search_text_index, search_vector_index

    spark = docs.sparkSession
    query = parse_query(q, options.min_word_length)
    kw = pool(search_text_index(spark, index, query, options) if index else matches(docs, id_col, text_col, query, options), options.pool)
    if query_vector is None:
        vec = kw.limit(0).withColumn("chunk_no", F.lit(None).cast("int"))
    else:
        vec = pool(search_vector_index(spark, index, query_vector, options) if index else best_per_article(best_chunk(docs, id_col, vec_col, query_vector)), options.vector_pool)
    best = positions(fuse(kw, vec), options.max_fetch).join(vec.select("doc_id", "chunk_no"), "doc_id", "left")
    held = best.collect()  # at most max_fetch rows
    rows = fetch(docs, id_col, title_col, text_col, [r["doc_id"] for r in held]).join(F.broadcast(spark.createDataFrame(held, best.schema)), "doc_id", "right")
    return rows.select("fpos", "score", "krank", "vrank", "doc_id", "title", snippet_column("text", query.words, options.snippet, chunk_col="chunk_no").alias("snippet")).orderBy("fpos")
