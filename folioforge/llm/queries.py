"""Queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, neardup, neighbours, packing, quality, residue, splitting
from . import sentences as sent
from . import subjects

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def setting(spark: SparkSession, sf_dir: str, name: str) -> int:
    """One entry of the four-row settings table."""
    return int(spark.read.parquet(f"{sf_dir}/run_settings.parquet").filter(F.col("setting") == name).first()["amount"])


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the first character of every sentence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sent.sentences(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "start_at").distinct()


@query
def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document with their places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sent.sentences(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


def _wikidocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/wikidocs.parquet").filter("Id <> 0")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["subject"] for r in spark.read.parquet(f"{sf_dir}/subjects.parquet").orderBy("subject").collect()]  # a fixed dozen
    labels = spark.read.parquet(f"{sf_dir}/subject_labels.parquet")
    return subjects.assign(_wikidocs(spark, sf_dir), labels, names, "Id", "Doc", "Title")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every record."""
    return _subjects(spark, sf_dir)


@query
def p1_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each subject, and those that have it alone."""
    found = _subjects(spark, sf_dir)
    alone = found.groupBy("id").agg(F.count("*").alias("n"), F.min("subject").alias("subject")).filter("n = 1").groupBy("subject").agg(F.count("*").alias("alone"))
    return found.groupBy("subject").agg(F.count("*").alias("records")).join(alone, "subject", "left").fillna(0, ["alone"])


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which most is not running prose, with their kind; residue records are never cases."""
    types, _ = quality.text_types(_wikidocs(spark, sf_dir), "Id", "Doc")
    per_id = types.groupBy("id").agg(F.min("kind").alias("kind"), F.bool_or("residue").alias("residue"), F.bool_or(F.col("kind") == "prose").alias("prose"))
    return per_id.filter("not residue and not prose").select("id", "kind")


@query
def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, line and symbol statistics of every record."""
    return quality.statistics(_wikidocs(spark, sf_dir), "Id", "Doc").drop("pattern", "residue")


@query
def p2_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of every text type for every record, and whether a unit of it is residue."""
    return quality.text_types(_wikidocs(spark, sf_dir), "Id", "Doc")[0]


@query
def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt firing rates of the labelling functions on each type."""
    return quality.text_types(_wikidocs(spark, sf_dir), "Id", "Doc")[1]


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/wikidocs.parquet").filter("Id <> 0")
    return residue.residue_documents(docs, "Id", "Doc")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with residue in place of content."""
    return _residue(spark, sf_dir).select("id")


@query
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue units of each record, and how many of them a pattern matched itself."""
    return _residue(spark, sf_dir)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/wikivecs.parquet").filter("Id <> 0")
    return splitting.split_texts(docs, "Id", "Doc", setting(spark, sf_dir, "chunk_max_chars"), setting(spark, sf_dir, "chunk_overlap_chars"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that had to be cut."""
    return _pieces(spark, sf_dir).filter("piece_no = 1").select("id").distinct()


@query
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized records."""
    return _pieces(spark, sf_dir)


def _wiki_near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/wikidocs.parquet").filter("Id <> 0")
    return neardup.near_duplicates(docs, "Id", "Doc", threshold=0.6, width=3, min_words=40)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share at least 0.6 of their distinct three-word runs."""
    return neardup.expand_pairs(*_wiki_near(spark, sf_dir))


@query
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every record with 40 words or more."""
    return neardup.group_members(*_wiki_near(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    dim = int(spark.read.parquet(f"{sf_dir}/model_info.parquet").first()["dim"])
    docs = spark.read.parquet(f"{sf_dir}/wikivecs.parquet").filter("Id <> 0")
    return neighbours.chunk_vectors(docs, "Id", "Vec", dim), dim, setting(spark, sf_dir, "neighbours_k")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunk vectors of which one is among the neighbours_k most similar of the other."""
    vectors, dim, k = _chunks(spark, sf_dir)
    return neighbours.neighbour_pairs(neighbours.nearest_neighbours(vectors, dim, k))


@query
def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of the vectors of every id divisible by 20, against all rows."""
    vectors, dim, k = _chunks(spark, sf_dir)
    vectors = neighbours.materialize(vectors)
    return neighbours.exact_neighbours(vectors.filter("id % 20 = 0"), vectors, dim, k)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity = setting(spark, sf_dir, "pack_capacity_tokens")
    return packing.pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", capacity), capacity


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split because they alone exceed a container."""
    return _packed(spark, sf_dir)[0].filter("n_pieces > 1").select(F.col("id").alias("doc_id")).distinct()


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every text and piece."""
    return _packed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, fewest possible, unused share."""
    return packing.fill_report(*_packed(spark, sf_dir))


@query
def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every token packed, none overfull, no text cut without need, at most a twentieth more than the fewest."""
    packed, capacity = _packed(spark, sf_dir)
    packed = packing.materialize(packed)
    texts = packed.groupBy("id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    per_text = texts.agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.count_if(F.col("pieces") > 1).alias("split_texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("needless_pieces"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"), F.count("*").alias("containers"))
    few = F.col("containers") <= 1.05 * F.ceil(F.col("tokens") / capacity) + 1
    return per_text.join(F.broadcast(full)).select("texts", "tokens", "split_texts", "overfull", "needless_pieces", few.alias("few_containers"))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sources whose mixture stays below their share for want of documents."""
    return _mixture(spark, sf_dir).shares().filter("not reachable").select("source")


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by each listed source."""
    return _mixture(spark, sf_dir).shares()


@query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents in the mixture, in mixing order."""
    return _mixture(spark, sf_dir).documents().withColumnRenamed("id", "doc_id").withColumn("finish", F.round("finish", 2))


SQL["p4_found"] = """
SELECT DISTINCT Id::BIGINT AS id FROM wikivecs WHERE Id <> 0 AND length(Doc) > (SELECT amount FROM run_settings WHERE setting = 'chunk_max_chars')"""

SQL["p5_found"] = """
WITH c AS (SELECT Id::BIGINT AS id, unnest(range(len(Vec)))::INTEGER AS chunk, unnest(Vec) AS v FROM wikivecs WHERE Vec IS NOT NULL AND Id <> 0),
x AS (SELECT id, chunk, any_value(v)::DOUBLE[64] AS v FROM c WHERE len(v) = (SELECT dim FROM model_info) AND len(list_filter(v, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0 GROUP BY id, chunk),
s AS (SELECT a.id AS id, a.chunk AS chunk, b.id AS n_id, b.chunk AS n_chunk, array_cosine_similarity(a.v, b.v) AS sim FROM x a, x b WHERE (a.id, a.chunk) <> (b.id, b.chunk)),
t AS (SELECT *, row_number() OVER (PARTITION BY id, chunk ORDER BY sim DESC, n_id, n_chunk) AS r FROM s),
k AS (SELECT * FROM t WHERE r <= (SELECT amount FROM run_settings WHERE setting = 'neighbours_k'))
SELECT DISTINCT CASE WHEN (id, chunk) < (n_id, n_chunk) THEN id ELSE n_id END AS id_a, CASE WHEN (id, chunk) < (n_id, n_chunk) THEN chunk ELSE n_chunk END AS chunk_a,
  CASE WHEN (id, chunk) < (n_id, n_chunk) THEN n_id ELSE id END AS id_b, CASE WHEN (id, chunk) < (n_id, n_chunk) THEN n_chunk ELSE chunk END AS chunk_b FROM k"""

SQL["p6_found"] = r"""
WITH w AS (SELECT DISTINCT Id, regexp_extract_all(lower(Doc), '[\p{L}\p{N}]+') AS w FROM wikidocs WHERE Id <> 0 AND Doc IS NOT NULL),
s AS (SELECT Id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 40),
n AS (SELECT Id, count(*) AS n FROM s GROUP BY Id),
p AS (SELECT a.Id AS ia, b.Id AS ib, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.Id < b.Id GROUP BY ALL)
SELECT ia::BIGINT AS id_a, ib::BIGINT AS id_b FROM p JOIN n x ON x.Id = ia JOIN n y ON y.Id = ib WHERE c >= 0.6 * (x.n + y.n - c)"""

SQL["p7_found"] = """
SELECT doc_id FROM documents
WHERE text <> '' AND octet_length(encode(text)) + 1 > (SELECT amount FROM run_settings WHERE setting = 'pack_capacity_tokens')"""

_SIZES = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[\s\p{Z}_-]+', '_', 'g') AS k,
                  CASE WHEN text <> '' THEN octet_length(encode(text)) + 1 ELSE 0 END AS n FROM documents),
s AS (SELECT m.source, m.weight, m.max_repeat, coalesce(sum(d.n), 0)::BIGINT AS size, count(d.k) FILTER (d.n > 0) AS docs FROM mix_targets m LEFT JOIN d ON d.k = m.source GROUP BY ALL),
total AS (SELECT sum(size)::BIGINT AS budget FROM s)"""

SQL["p8_found"] = _SIZES + " SELECT source FROM s, total WHERE weight * budget > max_repeat * size"

_QUEUE = _SIZES + """,
o AS (SELECT s.*, doc_id, n, sum(n) OVER (PARTITION BY s.source ORDER BY md5(doc_id || ':17'), doc_id)::BIGINT AS upto FROM s JOIN d ON d.k = s.source WHERE n > 0),
c AS (SELECT *, unnest(range(max_repeat)) AS copy FROM o),
f AS (SELECT *, (copy * size + upto)::DOUBLE / weight AS finish FROM c),
q AS (SELECT *, sum(n) OVER (ORDER BY finish, source, doc_id, copy)::BIGINT AS at_token FROM f),
m AS (SELECT q.* FROM q, total WHERE at_token <= budget)"""

SQL["p8_mixture"] = _QUEUE + " SELECT doc_id, source, copy::INTEGER AS copy, n::BIGINT AS n_tokens, round(finish, 2) AS finish, at_token FROM m"

SQL["p8_shares"] = _QUEUE + """,
u AS (SELECT source, sum(n)::BIGINT AS tokens, max(copy)::INTEGER + 1 AS passes FROM m GROUP BY source)
SELECT s.source, weight AS target_share, round(coalesce(tokens, 0) / (SELECT sum(tokens) FROM u), 6) AS actual_share, coalesce(tokens, 0) AS tokens, coalesce(passes, 0) AS passes, max_repeat, size AS source_tokens, docs AS source_docs,
  weight * budget <= max_repeat * size AS reachable FROM total, s LEFT JOIN u USING (source)"""

SQL["p7_totals"] = """
WITH d AS (SELECT CASE WHEN text <> '' THEN octet_length(encode(text)) + 1 ELSE 0 END AS n, amount AS cap FROM documents, run_settings WHERE setting = 'pack_capacity_tokens')
SELECT count(*) AS texts, sum(n)::BIGINT AS tokens, count(*) FILTER (n > cap) AS split_texts, 0::BIGINT AS overfull, 0::BIGINT AS needless_pieces, true AS few_containers FROM d WHERE n > 0"""
