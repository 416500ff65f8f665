"""Written indexes: postings by term, chunk vectors by cell, rows by id; built once, read by what a query needs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import keyword, vectors
from .keyword import Query, SearchOptions
from .tables import exists, materialize, spread

#: Folders of the postings: one for so many documents, at most TERM_BUCKETS.
TERM_BUCKETS, DOCS_A_BUCKET = 256, 4_000
#: Documents whose postings of one term go to one task of the build.
DOCS_A_TASK = 4_000_000
REGISTRY = "name string, kind string, figures string"


def _term_bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Indexes under ``path``: ``(name, kind, figures)``; empty where none was built."""
    if not exists(spark, f"{path}/registry"):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).json(f"{path}/registry")


def _register(spark: SparkSession, path: str, name: str, kind: str, figures: dict) -> None:
    spark.createDataFrame([(name, kind, json.dumps(figures))], REGISTRY).coalesce(1).write.mode("append").json(f"{path}/registry")


def index_figures(spark: SparkSession, path: str, name: str) -> dict | None:
    """Figures of an index, None where it is missing."""
    row = registry(spark, path).filter(F.col("name") == name).select("figures").first()
    return row and json.loads(row["figures"])


def has_index(spark: SparkSession, path: str, name: str) -> bool:
    return index_figures(spark, path, name) is not None


def build_text_index(docs: DataFrame, path: str, id_col: str = "Id", text_col: str = "Doc") -> bool:
    """Postings with positions, partitioned by the hash of the term; False if the index is there already.

    A query reads the partitions of its own words, sorted by term inside each
    file, so row groups without the word are skipped as well.  A frequent word
    is spread over tasks in proportion to the number of documents.  Repeated
    rows of an id and text are indexed once; several texts of an id are several
    documents, of which the best counts in a search.
    """
    spark = docs.sparkSession
    if has_index(spark, path, "text"):
        return False
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null"))
    toks = rows.select("doc_id", F.xxhash64("text").alias("rid"), T.tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    f = toks.select("doc_id", "rid", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    buckets = min(TERM_BUCKETS, max(1, -(-f["n"] // DOCS_A_BUCKET)))
    words = toks.select("doc_id", "rid", "dl", F.posexplode("toks").alias("pos", "term"))
    posts = words.groupBy("term", "doc_id", "rid").agg(F.first("dl").alias("dl"), F.sort_array(F.collect_set("pos")).alias("places")).withColumn("bucket", _term_bucket("term", buckets))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-f["n"] // DOCS_A_TASK))))
    posts.repartition("bucket", salt).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    _register(spark, path, "text", "postings", {"n": f["n"], "avgdl": f["avgdl"], "buckets": buckets})
    return True


def search_text_index(spark: SparkSession, path: str, query: Query, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``(doc_id, score)`` of the matching documents, as :func:`keyword.matches` gives them, reading the postings of the query's words only."""
    f = index_figures(spark, path, "text")
    if f is None:
        raise FileNotFoundError(f"no text index in {path}")
    posts = spark.read.parquet(f"{path}/postings")
    if not query.words or not f["n"]:
        return posts.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    forms = keyword.word_forms(query, options)
    terms = list(dict.fromkeys(w for x in forms for w in x))
    buckets = {r["b"] for r in spark.createDataFrame([(w,) for w in terms], "w string").select(_term_bucket("w", f["buckets"]).alias("b")).collect()}  # the query's own words
    hit = posts.filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
    of = lambda x, c: F.when(F.col("term").isin(*x), c)
    figures = [c for i, x in enumerate(forms) for c in (F.coalesce(F.sum(of(x, F.size("places"))), F.lit(0)).alias(f"tf{i}"), F.min(of(x, F.element_at("places", 1))).alias(f"p{i}"))]
    if options.proximity and len(forms) > 1:
        label = F.coalesce(*[of(x, F.lit(i)) for i, x in enumerate(forms)])
        gap = keyword.least_gap(F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("i"), label.alias("w")))))))
    else:
        gap = F.lit(None).cast("int")
    found = materialize(hit.groupBy("doc_id", "rid").agg(F.first("dl").alias("dl"), gap.alias("gap"), *figures))
    return keyword.scored(found, len(forms), options, query.exact, f["n"], f["avgdl"] or 1.0)


def build_vector_index(vecs: DataFrame, path: str, dim: int, id_col: str = "Id", vec_col: str = "Vec", **options) -> bool:
    """Chunk vectors by cell; False if the index is there already."""
    spark = vecs.sparkSession
    if has_index(spark, path, "vectors"):
        return False
    _register(spark, path, "vectors", "cells", vectors.write_cells(vecs, path, dim, id_col, vec_col, **options))
    return True


def search_vector_index(spark: SparkSession, path: str, query: list[float], options: SearchOptions = SearchOptions()) -> DataFrame:
    """``(doc_id, score, chunk_no)`` from the ``options.probes`` nearest cells."""
    if not has_index(spark, path, "vectors"):
        raise FileNotFoundError(f"no vector index in {path}")
    return vectors.search_cells(spark, path, query, options.probes)


def build_id_index(docs: DataFrame, table: str, id_col: str = "Id", buckets: int = 64) -> None:
    """The table bucketed and sorted by id: joins on the id need no shuffle of it, look-ups skip what cannot hold the id."""
    docs.write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table)


def vector_backend(chunks: int) -> str:
    """Exact scan for few chunk vectors, cells for many."""
    return "exact" if chunks < vectors.EXACT_BELOW else "cells"
