"""Registered queries of the search engine's own operators, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .. import languages
from ..operators import build, fusion, keyword, progress, rerank
from ..operators.vectors import best_chunk
from ..sources import mediawiki
from ..wikitext import cleanup, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def case(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]{2,99}')"

# scans, counts ---------------------------------------------------------------


@case("SELECT doc_id, lang, n_chars FROM documents")
def scan_project(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "n_chars")


@case("SELECT doc_id, source FROM documents WHERE lower(trim(lang)) = 'en' AND n_chars > 200")
def scan_filter_language(s, d):
    return table(s, d, "documents").filter((F.lower(F.trim("lang")) == "en") & (F.col("n_chars") > 200)).select("doc_id", "source")


@case("SELECT count(Id) AS cnt FROM wikivecs")
def count_id(s, d):
    return table(s, d, "wikivecs").agg(F.count("Id").alias("cnt"))


@case("""
WITH last AS (SELECT page_key, arg_max(redirect, byte_offset) AS redirect FROM pages_idx GROUP BY page_key)
SELECT count(*) AS pages, count(*) FILTER (page_key LIKE '0:%' AND redirect = 0) AS articles, count(*) FILTER (page_key LIKE '0:%' AND redirect = 1) AS redirects FROM last""")
def count_articles_redirects(s, d):
    return mediawiki.index_counts(mediawiki.last_places(table(s, d, "pages_idx")))


@case("SELECT page_key, max(byte_offset) AS byte_offset, arg_max(byte_length, byte_offset) AS byte_length, count(*) AS writes FROM pages_idx GROUP BY page_key")
def dedupe_last_written(s, d):
    return mediawiki.last_places(table(s, d, "pages_idx")).select("page_key", "byte_offset", "byte_length", "writes")


@case("SELECT DISTINCT page_key FROM pages_idx WHERE page_key >= '0:D' AND page_key < '0:P'")
def key_range(s, d):
    return mediawiki.key_range(table(s, d, "pages_idx"), "0:D", "0:P").select("page_key").distinct()


@case("SELECT split_part(page_key, ':', 1) AS ns, count(*) AS n, count(DISTINCT page_key) AS keys FROM pages_idx GROUP BY ALL")
def namespace_prefix_counts(s, d):
    return table(s, d, "pages_idx").groupBy(F.split_part("page_key", F.lit(":"), F.lit(1)).alias("ns")).agg(F.count("*").alias("n"), F.countDistinct("page_key").alias("keys"))


@case("SELECT page_key, coalesce(try_cast(id AS BIGINT), 0) AS page_id, count(*) AS n FROM pages_idx GROUP BY ALL")
def page_ids_or_zero(s, d):
    return table(s, d, "pages_idx").groupBy("page_key", F.coalesce(F.col("id").try_cast("bigint"), F.lit(0)).alias("page_id")).agg(F.count("*").alias("n"))


@case("SELECT (doc_id - lo) // width AS slice, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id_place, doc_id FROM documents) p, (SELECT 0 AS lo, ceil(count(*) / 7.0)::BIGINT AS width FROM documents) w GROUP BY 1".replace("(doc_id - lo) // width", "doc_id_place // width"))
def range_slices(s, d):
    placed = build.slices(table(s, d, "documents").select("doc_id"), 7, "doc_id")
    return placed.groupBy(F.col("slice").cast("long").alias("slice")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


# keyword search ------------------------------------------------------------

@case(f"SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def token_frequencies(s, d):
    posts = keyword.postings(table(s, d, "documents"), "doc_id", "text")
    return posts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


@case(f"SELECT doc_id, len({TOKENS}) AS dl FROM documents WHERE text IS NOT NULL")
def document_lengths(s, d):
    return keyword.document_lengths(table(s, d, "documents"), "doc_id", "text")


@case(f"SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM (SELECT doc_id, unnest({TOKENS}) AS term, unnest(range(len({TOKENS}))) AS pos FROM documents) GROUP BY ALL")
def postings(s, d):
    return keyword.postings(table(s, d, "documents"), "doc_id", "text").select("doc_id", "term", "tf", F.col("first_pos").cast("long").alias("first_pos"))


def _bm25(words: list[str], lead: int = 500, where: str = "", tail: str = "") -> str:
    """The same ranking in SQL."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents WHERE text IS NOT NULL),
fig AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t),
p AS (SELECT doc_id, w, len(list_filter(toks, lambda x: x = w))::DOUBLE AS tf, list_position(toks, w) - 1 AS first_pos, len(toks) AS dl FROM t, (SELECT unnest([{listed}]) AS w)),
df AS (SELECT w, count(*) FILTER (tf > 0)::DOUBLE AS df FROM p GROUP BY w),
sc AS (SELECT doc_id, count(*) AS terms, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (1 + {lead} / 1000.0 / (1 + first_pos / 50.0))) AS score
       FROM p JOIN df USING (w), fig WHERE tf > 0 GROUP BY doc_id),
m AS (SELECT * FROM sc WHERE score > 0 {where})
{tail}"""


def _scored(s, d, q: str, **options) -> DataFrame:
    o = keyword.SearchOptions(**options)
    return keyword.matches(table(s, d, "documents"), "doc_id", "text", keyword.parse_query(q), o)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), F.col("pos").cast("long").alias("pos"))


_POOL = "SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM m ORDER BY score DESC, doc_id LIMIT {n}"


@case(_bm25(["harbour", "museum", "railway"], tail=_POOL.format(n=100)))
def keyword_any(s, d):
    return _rounded(keyword.pool(_scored(s, d, "harbour museum railway"), 100))


@case(_bm25(["founded", "kingdom"], where="AND terms = 2", tail=_POOL.format(n=100)))
def keyword_all_match(s, d):
    return _rounded(keyword.pool(_scored(s, d, "founded kingdom", all_match=True), 100))


@case(_bm25(["harbour", "railway"], lead=1000, tail=_POOL.format(n=50)))
def keyword_lead_bias(s, d):
    return _rounded(keyword.pool(_scored(s, d, "harbour railway", lead_bias=1000), 50))


@case(_bm25(["committee", "years"], tail="SELECT doc_id, round(score, 6) AS score, pos FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM m) WHERE pos > 10 AND pos <= 20"))
def keyword_page_two(s, d):
    return _rounded(keyword.pool(_scored(s, d, "committee years"), 100).filter("pos > 10 and pos <= 20"))


@case(_bm25(["committee", "years"], tail="SELECT count(*) AS total, count(*) > 10 AS next_page FROM m"))
def keyword_total(s, d):
    return _scored(s, d, "committee years").agg(F.count("*").alias("total"), (F.count("*") > 10).alias("next_page"))


_FORMS = ["harbours", "harbour", "harboures", "harboured", "harbouring", "harbourer", "harbourers", "harbourly"]


@case(f"""
WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents WHERE text IS NOT NULL),
fig AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t),
p AS (SELECT doc_id, len(list_filter(toks, lambda x: list_contains({_FORMS}, x)))::DOUBLE AS tf, list_min(list_transform({_FORMS}, lambda f: nullif(coalesce(list_position(toks, f), 0), 0))) - 1 AS first_pos, len(toks) AS dl FROM t),
df AS (SELECT count(*) FILTER (tf > 0)::DOUBLE AS df FROM p),
m AS (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (1 + 0.5 / (1 + first_pos / 50.0)) AS score FROM p, df, fig WHERE tf > 0)
""" + _POOL.format(n=100))
def keyword_derivations(s, d):
    return _rounded(keyword.pool(_scored(s, d, "harbours", derivations="en"), 100))


@case(_bm25(["museum"], tail=_POOL.format(n=20)))
def keyword_quoted(s, d):
    return _rounded(keyword.pool(_scored(s, d, '"museum"'), 20))


@case(_bm25(["harbour"], tail="SELECT doc_id, greatest(1, least(1000, floor(1000 * score / (score + 5))))::BIGINT AS krank FROM m"))
def keyword_rank(s, d):
    return _scored(s, d, "harbour").select("doc_id", keyword.rank_score(F.col("score")).cast("long").alias("krank"))


@case(f"""
WITH q AS (SELECT DISTINCT lower(trim(q)) AS q FROM search_rows WHERE q IS NOT NULL AND trim(q) <> ''),
qt AS (SELECT DISTINCT q, unnest(regexp_extract_all(q, '[\\p{{L}}\\p{{M}}\\p{{N}}]{{2,99}}')) AS term FROM q),
t AS (SELECT doc_id, unnest({TOKENS}) AS term, unnest(range(len({TOKENS}))) AS pos FROM documents WHERE text IS NOT NULL),
dl AS (SELECT doc_id, len({TOKENS}) AS dl FROM documents WHERE text IS NOT NULL),
fig AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT term, doc_id, count(*)::DOUBLE AS tf, min(pos) AS first_pos FROM t GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
sc AS (SELECT q, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (1 + 0.5 / (1 + first_pos / 50.0))) AS score
       FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id), fig GROUP BY q, doc_id)
SELECT q, doc_id, round(score, 4) AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS pos FROM sc) WHERE pos <= 10""")
def keyword_batch(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    qs = table(s, d, "search_rows").select(F.lower(F.trim("q")).alias("q")).filter("q is not null and q <> ''").distinct()
    terms = qs.select(F.col("q").alias("qid"), F.explode(F.array_distinct(T.tokens(F.col("q")))).alias("term"))
    pools = keyword.batch_pools(keyword.postings(docs, "doc_id", "text"), keyword.document_lengths(docs, "doc_id", "text"), terms, 10_000_000)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    best = pools.withColumn("pos", F.row_number().over(w)).filter("pos <= 10")
    return best.select(F.col("qid").alias("q"), "doc_id", F.round("score", 4).alias("score"), F.col("pos").cast("long").alias("pos"))


# vectors and fusion ----------------------------------------------------------

_QUERY = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_QSQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _QUERY) + "]"


def _embedding_scores(s, d) -> DataFrame:
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.array("embedding").alias("vec"))
    return best_chunk(vectors, "id", "vec", _QUERY).select("doc_id", "score")


_VSQL = f"v AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) AS score FROM embeddings)"


@case(f"WITH {_VSQL} SELECT doc_id, floor(score * 1e5)::BIGINT AS score5, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM v ORDER BY score DESC, doc_id LIMIT 300")
def vector_pool(s, d):
    return fusion.pool(_embedding_scores(s, d), 300).select("doc_id", F.floor(F.col("score") * 100_000).alias("score5"), F.col("pos").cast("long").alias("pos"))


@case(f"WITH {_VSQL} SELECT doc_id, greatest(0, floor(score * 100000))::BIGINT AS vrank FROM v")
def vector_rank(s, d):
    return _embedding_scores(s, d).select("doc_id", fusion.vector_rank(F.col("score")).cast("long").alias("vrank"))


@case(f"""
WITH c AS (SELECT Id AS doc_id, unnest(Vec) AS v FROM wikivecs WHERE Vec IS NOT NULL),
ok AS (SELECT doc_id, v FROM c WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0),
sim AS (SELECT doc_id, CASE WHEN list_sum(list_transform(v, lambda x: x::DOUBLE * x)) > 0 THEN list_cosine_similarity(v::DOUBLE[], {_QSQL}) ELSE 0 END AS s FROM ok)
SELECT doc_id, floor(max(s) * 100000 + 1e-6)::BIGINT AS best FROM sim GROUP BY doc_id""")
def vector_best_chunk(s, d):
    scored = best_chunk(table(s, d, "wikivecs"), "Id", "Vec", _QUERY)
    return scored.groupBy("doc_id").agg(F.floor(F.max("score") * 100_000 + 1e-6).alias("best"))


_FUSED = _bm25(["harbour", "museum", "railway"], tail=f""", {_VSQL},
k AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM m QUALIFY pos <= 100),
w AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM v QUALIFY pos <= 300),
f AS (SELECT coalesce(k.doc_id, w.doc_id) AS doc_id, coalesce(1e6 / (60 + k.pos), 0) + coalesce(1e6 / (60 + w.pos), 0) AS score,
      CASE WHEN k.score IS NULL THEN 0 ELSE greatest(1, least(1000, floor(1000 * k.score / (k.score + 5)))) END::BIGINT AS krank, CASE WHEN w.score IS NULL THEN 0 ELSE greatest(0, floor(w.score * 100000)) END::BIGINT AS vrank FROM k FULL JOIN w ON k.doc_id = w.doc_id)
""")


def _pools(s, d) -> tuple[DataFrame, DataFrame]:
    return keyword.pool(_scored(s, d, "harbour museum railway"), 100), keyword.pool(_embedding_scores(s, d), 300)


@case(_FUSED + "SELECT doc_id, round(score, 4) AS score, krank, vrank, row_number() OVER (ORDER BY score DESC, doc_id) AS fpos FROM f ORDER BY score DESC, doc_id LIMIT 40")
def hybrid_fused(s, d):
    best = fusion.positions(fusion.fuse(*_pools(s, d)), 40)
    return best.select("doc_id", F.round("score", 4).alias("score"), F.col("krank").cast("long").alias("krank"), F.col("vrank").cast("long").alias("vrank"), F.col("fpos").cast("long").alias("fpos"))


@case(_FUSED + "SELECT doc_id, round(score, 4) AS score FROM f")
def hybrid_union_form(s, d):
    return fusion.fuse_union(*_pools(s, d)).select("doc_id", F.round("score", 4).alias("score"))


@case(_FUSED + "SELECT krank > 0 AS by_keyword, vrank > 0 AS by_vector, count(*) AS n FROM f GROUP BY ALL")
def hybrid_sources(s, d):
    f = fusion.fuse(*_pools(s, d))
    return f.groupBy((F.col("krank") > 0).alias("by_keyword"), (F.col("vrank") > 0).alias("by_vector")).agg(F.count("*").alias("n"))


@case(_FUSED + "SELECT b.doc_id, round(b.score, 4) AS score, x.source FROM (SELECT * FROM f ORDER BY score DESC, doc_id LIMIT 40) b LEFT JOIN documents x ON x.doc_id = b.doc_id")
def hybrid_join_back(s, d):
    best = fusion.positions(fusion.fuse(*_pools(s, d)), 40)
    return table(s, d, "documents").select("doc_id", "source").join(F.broadcast(best), "doc_id", "right").select("doc_id", F.round("score", 4).alias("score"), "source")


def _article_bm25(source: str, words: list[str], tail: str) -> str:
    """The ranking over articles: rows scored one by one, the best of an id counts."""
    listed = ", ".join(f"'{w}'" for w in words)
    toks = TOKENS.replace("lower(text)", "lower(Doc)")
    return f"""
WITH src AS (SELECT * FROM {source}),
t AS (SELECT row_number() OVER () AS rid, Id AS doc_id, {toks} AS toks FROM src WHERE Doc IS NOT NULL),
fig AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t),
p AS (SELECT rid, doc_id, w, len(list_filter(toks, lambda x: x = w))::DOUBLE AS tf, list_position(toks, w) - 1 AS first_pos, len(toks) AS dl FROM t, (SELECT unnest([{listed}]) AS w)),
df AS (SELECT w, count(*) FILTER (tf > 0)::DOUBLE AS df FROM p GROUP BY w),
sc AS (SELECT rid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (1 + 0.5 / (1 + first_pos / 50.0))) AS score FROM p JOIN df USING (w), fig WHERE tf > 0 GROUP BY rid, doc_id),
m AS (SELECT doc_id, max(score) AS score FROM sc WHERE score > 0 GROUP BY doc_id),
page AS (SELECT Id, Title, Doc FROM (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY Title NULLS FIRST, Doc) AS r FROM src WHERE Doc IS NOT NULL) WHERE r = 1),
{tail}"""


_ASKED = ["harbour", "museum", "railway"]
_HYBRID = _article_bm25("(SELECT * FROM wikivecs WHERE Id <> 0)", _ASKED, f"""
c AS (SELECT Id AS doc_id, unnest(Vec) AS v FROM src WHERE Vec IS NOT NULL),
ok AS (SELECT doc_id, v FROM c WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
sim AS (SELECT doc_id, max(CASE WHEN list_sum(list_transform(v, lambda x: x::DOUBLE * x)) > 0 THEN list_cosine_similarity(v::DOUBLE[], {_QSQL}) ELSE 0 END) AS score FROM ok GROUP BY doc_id),
k AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM m QUALIFY pos <= 100),
w AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM sim QUALIFY pos <= 300),
f AS (SELECT coalesce(k.doc_id, w.doc_id) AS doc_id, coalesce(1e6 / (60 + k.pos), 0) + coalesce(1e6 / (60 + w.pos), 0) AS score,
      CASE WHEN k.score IS NULL THEN 0 ELSE greatest(1, least(1000, floor(1000 * k.score / (k.score + 5)))) END::INTEGER AS krank, CASE WHEN w.score IS NULL THEN 0 ELSE greatest(0, floor(w.score * 100000)) END::INTEGER AS vrank FROM k FULL JOIN w ON k.doc_id = w.doc_id),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS fpos FROM f QUALIFY fpos <= 40)
""")


@case(_HYBRID + "SELECT fpos, round(score, 4) AS score, krank, vrank, doc_id, Title AS title FROM b LEFT JOIN page ON Id = doc_id")
def hybrid_search(s, d):
    docs = table(s, d, "wikivecs").filter("Id <> 0")
    return fusion.hybrid_search(docs, " ".join(_ASKED), _QUERY).select("fpos", F.round("score", 4).alias("score"), "krank", "vrank", "doc_id", "title")


@case(_article_bm25("(SELECT * FROM wikidocs WHERE Id <> 0)", ["harbour", "railway"], """
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS pos FROM m)
SELECT doc_id, Title AS title, greatest(1, least(1000, floor(1000 * score / (score + 5))))::INTEGER AS krank, pos, true AS has_word FROM r LEFT JOIN page ON Id = doc_id WHERE pos <= 10"""))
def keyword_search(s, d):
    docs = table(s, d, "wikidocs").filter("Id <> 0")
    page, _ = keyword.keyword_search(docs, "Id", "Title", "Doc", "harbour railway")
    return page.select("doc_id", "title", "krank", "pos", F.lower("snippet").rlike("harbour|railway").alias("has_word"))


_INDEXES: dict[tuple[str, str], str] = {}


def _indexes(s, d) -> str:
    """Text and vector indexes of wikivecs in the shared folder; written once a session."""
    from ..operators import index
    from ..operators.tables import shared_dir

    at = (s.sparkContext.applicationId, d)
    if at not in _INDEXES:
        path = f"{shared_dir(s)}/folioforge/index-{s.sparkContext.applicationId}-{len(_INDEXES)}"
        docs = table(s, d, "wikivecs").filter("Id <> 0")
        index.build_text_index(docs, path)
        index.build_vector_index(docs, path, 64)
        _INDEXES[at] = path
    return _INDEXES[at]


_INDEX_BM25 = _article_bm25("(SELECT DISTINCT Id, Doc, min(Title) OVER (PARTITION BY Id, Doc) AS Title FROM wikivecs WHERE Id <> 0)", ["harbour", "museum"], """
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS pos FROM m)
SELECT doc_id, round(score, 6) AS score, pos FROM r WHERE pos <= 100""")


@case(_INDEX_BM25)
def index_keyword(s, d):
    from ..operators import index

    hits = index.search_text_index(s, _indexes(s, d), keyword.parse_query("harbour museum"))
    return keyword.pool(hits, 100).select("doc_id", F.round("score", 6).alias("score"), "pos")


@case()
def index_hybrid(s, d):
    docs = table(s, d, "wikivecs").filter("Id <> 0")
    return fusion.hybrid_search(docs, " ".join(_ASKED), _QUERY, options=keyword.SearchOptions(probes=48), index=_indexes(s, d))


# result rows: rerank, cut, paging, JSON ---------------------------------------

_SHOWN = "WITH r AS (SELECT req_id, fpos, arg_max(rerank, logged_at) AS rerank, max(Id) AS Id, max(score) AS score FROM search_rows GROUP BY req_id, fpos)"


def _shown(s, d) -> DataFrame:
    """One row a request and place: the last logged."""
    return table(s, d, "search_rows").groupBy("req_id", "fpos").agg(F.max_by("rerank", "logged_at").alias("rerank"), F.max("Id").alias("Id"), F.max("score").alias("score"))


@case(_SHOWN + " SELECT req_id, fpos, row_number() OVER (PARTITION BY req_id ORDER BY coalesce(rerank, -1000) DESC, fpos) AS place FROM r")
def rerank_order(s, d):
    return _shown(s, d).select("req_id", "fpos", rerank.place(["req_id"]).cast("long").alias("place"))


@case(_SHOWN + ", n AS (SELECT req_id, count(*) AS rows, count(rerank) AS reached FROM r GROUP BY req_id) SELECT req_id, rows, reached, reached < 5 AND reached < rows AS given_up FROM n")
def rerank_budget(s, d):
    return rerank.budget_outcome(_shown(s, d), ["req_id"])


@case(_SHOWN + " SELECT req_id, count(*) AS shown FROM r WHERE coalesce(rerank, 0) >= 0 GROUP BY req_id")
def json_cut(s, d):
    return rerank.cut_json(_shown(s, d)).groupBy("req_id").agg(F.count("*").alias("shown"))


@case(_SHOWN + " SELECT req_id, fpos, Id FROM r WHERE fpos <= 20")
def display_cut(s, d):
    return rerank.display_cut(_shown(s, d)).select("req_id", "fpos", "Id")


@case("SELECT fpos, krank > 0 AS k, vrank > 0 AS v, count(*) AS n FROM search_rows GROUP BY ALL")
def pool_flags(s, d):
    return table(s, d, "search_rows").groupBy("fpos", (F.col("krank") > 0).alias("k"), (F.col("vrank") > 0).alias("v")).agg(F.count("*").alias("n"))


@case("SELECT lower(trim(q, ' ''\"')) AS q, count(*) AS n, count(DISTINCT req_id) AS requests FROM search_rows WHERE q IS NOT NULL GROUP BY 1")
def query_counts(s, d):
    return table(s, d, "search_rows").filter("q is not null").groupBy(F.lower(F.btrim("q", F.lit(" '\""))).alias("q")).agg(F.count("*").alias("n"), F.countDistinct("req_id").alias("requests"))


# build: resume, repair, upsert, lookups -----------------------------------------


@case("SELECT Id, count(*) AS n FROM wikidocs w WHERE NOT EXISTS (SELECT 1 FROM wikivecs v WHERE v.Id = w.Id AND v.Vec IS NOT NULL) GROUP BY Id")
def resume_pending(s, d):
    return build.pending(table(s, d, "wikidocs"), table(s, d, "wikivecs")).groupBy("Id").agg(F.count("*").alias("n"))


@case("""
WITH h AS (SELECT Id, bool_or(Vec IS NOT NULL) AS filled FROM wikivecs GROUP BY Id),
a AS (SELECT CASE WHEN h.filled THEN 'skipped' WHEN h.filled IS NOT NULL AND (Doc IS NULL OR trim(Doc) = '') THEN 'skipped' WHEN h.filled IS NOT NULL THEN 'repair' WHEN Doc IS NULL OR trim(Doc) = '' THEN 'empty' ELSE 'insert' END AS action
      FROM wikidocs w LEFT JOIN h ON h.Id = w.Id)
SELECT action, count(*) AS rows FROM a GROUP BY action""")
def repair_actions(s, d):
    return build.counters(build.actions(table(s, d, "wikidocs"), table(s, d, "wikivecs")))


@case("""
WITH b AS (SELECT Id, max(Title) AS Title FROM wikidocs GROUP BY Id), c AS (SELECT Id, upper(max(Title)) AS Title FROM wikivecs GROUP BY Id)
SELECT Id, Title FROM b WHERE Id NOT IN (SELECT Id FROM c) UNION ALL SELECT Id, Title FROM c""")
def upsert_image(s, d):
    base = table(s, d, "wikidocs").groupBy("Id").agg(F.max("Title").alias("Title"))
    changes = table(s, d, "wikivecs").groupBy("Id").agg(F.upper(F.max("Title")).alias("Title"))
    return build.upsert(base, changes)


@case("""
WITH k AS (SELECT page_key, arg_max(byte_offset, byte_offset) AS byte_offset FROM pages_idx GROUP BY page_key)
SELECT doc_id, coalesce(a.byte_offset, b.byte_offset) AS byte_offset FROM documents d
LEFT JOIN k a ON a.page_key = regexp_replace(d.page_key, '^[0-9]+:', '10:') LEFT JOIN k b ON b.page_key = d.page_key""")
def lookup_two_keys(s, d):
    docs = table(s, d, "documents").select("doc_id", F.regexp_replace("page_key", "^[0-9]+:", "10:").alias("k1"), F.col("page_key").alias("k2"))
    return mediawiki.look_up(docs, mediawiki.last_places(table(s, d, "pages_idx")), "k1", "k2").select("doc_id", "byte_offset")


@case("""
WITH RECURSIVE m AS (SELECT c_custkey AS source, c_custkey // 7 AS target FROM customer WHERE c_custkey >= 7),
r AS (SELECT source, target AS now_at, 1 AS hops FROM m UNION ALL SELECT r.source, m.target, r.hops + 1 FROM r JOIN m ON m.source = r.now_at)
SELECT source, now_at AS final, hops::BIGINT AS hops FROM r WHERE now_at NOT IN (SELECT source FROM m)""")
def redirect_chase(s, d):
    moves = table(s, d, "customer").filter("c_custkey >= 7").select(F.col("c_custkey").alias("source"), F.floor(F.col("c_custkey") / 7).alias("target"))
    return build.follow(moves).select("source", "final", F.col("hops").cast("long").alias("hops"))


_LANGS = [("en", "English", False), ("de", "German", False), ("fr", "French", False), ("es", "Spanish", False), ("ru", "Russian", False), ("ar", "Arabic", True), ("zh", "Chinese", False), ("ja", "Japanese", False), ("el", "Greek", False), ("hi", "Hindi", False), ("th", "Thai", False)]


@case("SELECT coalesce(l.english, d.lang) AS language, coalesce(l.rtl, false) AS rtl, count(*) AS n FROM documents d LEFT JOIN (VALUES " + ", ".join(f"('{c}', '{e}', {str(r).lower()})" for c, e, r in _LANGS) + ") l(code, english, rtl) ON l.code = d.lang GROUP BY ALL")
def language_names(s, d):
    return languages.named(table(s, d, "documents"), languages.language_table(s), "lang").groupBy("language", "rtl").agg(F.count("*").alias("n"))


@case("SELECT lang AS code FROM (SELECT DISTINCT lang FROM documents WHERE regexp_matches(lang, '^[a-z-]+$')) ORDER BY lang <> 'en', lang LIMIT 1")
def default_language(s, d):
    return languages.default_row(table(s, d, "documents").filter(F.col("lang").rlike("^[a-z-]+$")).select(F.col("lang").alias("code")).distinct())


@case("SELECT lang AS code FROM (SELECT DISTINCT lang FROM documents WHERE regexp_matches(lang, '^[a-z]{2}$') AND lang <> 'en') ORDER BY lang LIMIT 1")
def default_language_without_english(s, d):
    return languages.default_row(table(s, d, "documents").filter(F.col("lang").rlike("^[a-z]{2}$") & (F.col("lang") != "en")).select(F.col("lang").alias("code")).distinct())


@case("""
WITH k AS (SELECT page_key, arg_max(try_cast(id AS BIGINT), byte_offset) AS page_id FROM pages_idx GROUP BY page_key),
t AS (SELECT Title, max(Id) AS by_title FROM wikidocs WHERE Id <> 0 AND Title IS NOT NULL GROUP BY Title),
i AS (SELECT DISTINCT Id FROM wikidocs WHERE Id <> 0)
SELECT page_key, coalesce(i.Id, t.by_title)::BIGINT AS found FROM k LEFT JOIN i ON i.Id = k.page_id LEFT JOIN t ON t.Title = regexp_replace(k.page_key, '^[0-9]+:', '') WHERE page_key LIKE '0:%'""")
def title_to_row(s, d):
    k = table(s, d, "pages_idx").filter("page_key like '0:%'").groupBy("page_key").agg(F.max_by(F.col("id").try_cast("bigint"), "byte_offset").alias("page_id"))
    docs = table(s, d, "wikidocs").filter("Id <> 0")
    i = docs.select(F.col("Id").cast("long").alias("page_id")).distinct().withColumn("hit", F.col("page_id"))
    t = docs.filter("Title is not null").groupBy("Title").agg(F.max("Id").cast("long").alias("by_title"))
    j = k.join(i, "page_id", "left").withColumn("Title", F.regexp_replace("page_key", "^[0-9]+:", "")).join(t, "Title", "left")
    return j.select("page_key", F.coalesce("hit", "by_title").alias("found"))


# progress ------------------------------------------------------------------


@case("SELECT time_bucket(INTERVAL '2 seconds', ts) AS at, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def progress_windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.windowed(e, "ts", "2 seconds", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("w.start").cast("timestamp_ntz").alias("at"), "event_type", "n", "top")


_REPORTS = "WITH p AS (SELECT run_id, worker_id, ts, max(docs) AS docs, max(elapsed) AS elapsed FROM build_progress GROUP BY ALL)"


def _reports(s, d) -> DataFrame:
    return table(s, d, "build_progress").groupBy("run_id", "worker_id", "ts").agg(F.max("docs").alias("docs"), F.max("elapsed").alias("elapsed"))


@case(_REPORTS + " SELECT run_id, worker_id, ts, docs - lag(docs) OVER w AS dc, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 3) AS dt FROM p WINDOW w AS (PARTITION BY run_id, worker_id ORDER BY ts, docs)")
def progress_deltas(s, d):
    out = progress.deltas(_reports(s, d).withColumn("ts", F.col("ts").cast("timestamp")), ["run_id", "worker_id"], "ts", "docs")
    return out.select("run_id", "worker_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "dc", F.round("dt", 3).alias("dt"))


@case(_REPORTS + ", l AS (SELECT run_id, worker_id, list(docs::DOUBLE ORDER BY ts, docs) AS v FROM p GROUP BY ALL) SELECT run_id, worker_id, round(list_reduce(v, lambda a, x: a * 0.7 + x * 0.3), 4) AS ema FROM l")
def progress_average(s, d):
    ordered = _reports(s, d).groupBy("run_id", "worker_id").agg(F.array_sort(F.collect_list(F.struct("ts", "docs"))).alias("v"))
    return ordered.select("run_id", "worker_id", F.round(progress.moving_average(F.transform("v", lambda r: r["docs"].cast("double")), 0.3), 4).alias("ema"))


@case("""
WITH l AS (SELECT run_id, worker_id, max_by(struct_pack(docs := docs, empty := empty, failed := failed, skipped := skipped, repaired := repaired, total := total, elapsed := elapsed), struct_pack(ts := ts, logged_at := logged_at)) AS r FROM build_progress GROUP BY ALL),
v AS (SELECT run_id, coalesce(r.docs, 0) + coalesce(r.empty, 0) + coalesce(r.failed, 0) + coalesce(r.skipped, 0) + coalesce(r.repaired, 0) AS done, r.total AS total, r.elapsed AS elapsed FROM l)
SELECT run_id, sum(done)::BIGINT AS done, sum(coalesce(total, done))::BIGINT AS expected, round(sum(CASE WHEN elapsed > 0 THEN done / elapsed ELSE 0 END), 4) AS rate,
  round(CASE WHEN sum(CASE WHEN elapsed > 0 THEN done / elapsed ELSE 0 END) > 0 THEN sum(greatest(coalesce(total, done) - done, 0)) / sum(CASE WHEN elapsed > 0 THEN done / elapsed ELSE 0 END) END, 2) AS eta FROM v GROUP BY run_id""")
def progress_eta(s, d):
    latest = progress.latest_per_worker(table(s, d, "build_progress"), ["run_id", "worker_id"], "ts")
    return progress.overall(latest, "run_id").select("run_id", "done", "expected", F.round("rate", 4).alias("rate"), F.round("eta", 2).alias("eta"))


@case("SELECT run_id, worker_id, ts, sum(docs) OVER (PARTITION BY run_id ORDER BY ts, worker_id, docs ROWS UNBOUNDED PRECEDING)::BIGINT AS seen FROM (SELECT run_id, worker_id, ts, max(docs) AS docs FROM build_progress GROUP BY ALL)")
def progress_running(s, d):
    w = Window.partitionBy("run_id").orderBy("ts", "worker_id", "docs").rowsBetween(Window.unboundedPreceding, 0)
    return _reports(s, d).select("run_id", "worker_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.sum("docs").over(w).alias("seen"))


@case("SELECT run_id, worker_id, ts, elapsed, CASE WHEN elapsed < 60 THEN floor(elapsed)::BIGINT || 's' WHEN elapsed < 3600 THEN floor(floor(elapsed) / 60)::BIGINT || 'm' || lpad((floor(elapsed)::BIGINT % 60)::VARCHAR, 2, '0') || 's' ELSE floor(floor(elapsed) / 3600)::BIGINT || 'h' || lpad(floor((floor(elapsed)::BIGINT % 3600) / 60)::BIGINT::VARCHAR, 2, '0') || 'm' END AS shown FROM build_progress")
def format_elapsed(s, d):
    return table(s, d, "build_progress").select("run_id", "worker_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "elapsed", T.format_time(F.col("elapsed")).alias("shown"))


# text: markup, titles, lines, values ---------------------------------------------


def _marked(s, d, before: str, after: str) -> DataFrame:
    """Every document's text inside the given markup."""
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.concat(F.lit(before), "text", F.lit(after)).alias("t"))


def _md5(df: DataFrame, c: Column) -> DataFrame:
    return df.select("doc_id", F.md5(c).alias("h"))


def _wrap(before: str, after: str, expr: str) -> str:
    q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"SELECT doc_id, md5({expr}) AS h FROM (SELECT doc_id, {q(before)} || text || {q(after)} AS t FROM documents WHERE text IS NOT NULL)"


@case(_wrap("a<!-- x\ny -->b ", " <!-- z -->", "regexp_replace(t, '(?s)<!--.*?-->', '', 'g')"))
def markup_comments(s, d):
    return _md5(_marked(s, d, "a<!-- x\ny -->b ", " <!-- z -->"), T.strip_comments(F.col("t")))


@case(_wrap("a<ref name=x /> ", "<ref>n</ref><REF a>q</REF> z", "regexp_replace(t, '(?is)<ref\\b[^>]*?/>|<ref\\b[^>]*>.*?</ref>', '', 'g')"))
def markup_refs(s, d):
    return _md5(_marked(s, d, "a<ref name=x /> ", "<ref>n</ref><REF a>q</REF> z"), T.strip_refs(F.col("t")))


@case(_wrap("one<br/>two<BR >", "<br>x", "regexp_replace(t, '(?i)<br[^>]*>', chr(10), 'g')"))
def markup_breaks(s, d):
    return _md5(_marked(s, d, "one<br/>two<BR >", "<br>x"), T.breaks(F.col("t")))


@case(_wrap("<b>", "</b><i class=\"x\">y</i>", "regexp_replace(t, '</?[A-Za-z][^>]*>', '', 'g')"))
def markup_tags(s, d):
    return _md5(_marked(s, d, "<b>", '</b><i class="x">y</i>'), T.strip_tags(F.col("t")))


@case(_wrap("<gallery>a</gallery><graph x>b</graph> ", "<TIMELINE>c</TIMELINE>", "regexp_replace(regexp_replace(regexp_replace(t, '(?is)<timeline\\b[^>]*>.*?</timeline>', '', 'g'), '(?is)<gallery\\b[^>]*>.*?</gallery>', '', 'g'), '(?is)<graph\\b[^>]*>.*?</graph>', '', 'g')"))
def markup_extensions(s, d):
    return _md5(_marked(s, d, "<gallery>a</gallery><graph x>b</graph> ", "<TIMELINE>c</TIMELINE>"), T.strip_extensions(F.col("t")))


@case(_wrap("Tom &amp; &lt;x&gt; ", " &quot;q&quot; &amp;amp;", "replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"))
def markup_entities(s, d):
    return _md5(_marked(s, d, "Tom &amp; &lt;x&gt; ", " &quot;q&quot; &amp;amp;"), T.html_unescape(F.col("t")))


@case(_wrap("see [[Foo|bar]] and [[Baz]] ", " [[File:a.jpg|thumb|c]] [[Category:Z]] [[de:S]]", "regexp_replace(regexp_replace(regexp_replace(t, '(?i)\\[\\[(?:file|image|category|media):[^\\[\\]]*\\]\\]', '', 'g'), '\\[\\[[a-z]{2,3}:[^\\[\\]]*\\]\\]', '', 'g'), '\\[\\[(?:[^\\[\\]]*\\|)?([^\\[\\]|]*)\\]\\]', '\\1', 'g')"))
def wiki_links(s, d):
    return _md5(_marked(s, d, "see [[Foo|bar]] and [[Baz]] ", " [[File:a.jpg|thumb|c]] [[Category:Z]] [[de:S]]"), T.wiki_links(F.col("t")))


@case(_wrap("go [http://x.org label here] ", " [//y.org] [https://z.org]", "regexp_replace(regexp_replace(t, '\\[(?:https?:)?//[^\\s\\]]* ([^\\]]*)\\]', '\\1', 'g'), '\\[(?:https?:)?//[^\\s\\]]*\\]', '', 'g')"))
def wiki_external_links(s, d):
    return _md5(_marked(s, d, "go [http://x.org label here] ", " [//y.org] [https://z.org]"), T.external_links(F.col("t")))


@case(_wrap("'''Bold''' ", " ''it''", "regexp_replace(t, '''''+', '', 'g')"))
def wiki_emphasis(s, d):
    return _md5(_marked(s, d, "'''Bold''' ", " ''it''"), T.emphasis(F.col("t")))


@case(_wrap("* item\n## two\n", "\n:; three", "regexp_replace(t, '(?m)^[*#:;]+ *', '', 'g')"))
def wiki_lists(s, d):
    return _md5(_marked(s, d, "* item\n## two\n", "\n:; three"), T.list_markers(F.col("t")))


@case(_wrap("__NOTOC__", "__NOEDITSECTION__ __ab__", "regexp_replace(t, '__[A-Z]{3,}__', '', 'g')"))
def wiki_switches(s, d):
    return _md5(_marked(s, d, "__NOTOC__", "__NOEDITSECTION__ __ab__"), T.switches(F.col("t")))


@case("SELECT doc_id, md5(translate(translate(text, " + " || ".join(f"chr({c})" for c in [0xA0, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000]) + ", repeat(' ', 16)), chr(8232) || chr(8233) || chr(65279), chr(10) || chr(10))) AS h FROM documents WHERE text IS NOT NULL")
def unicode_spaces(s, d):
    return _md5(table(s, d, "documents").filter("text is not null"), T.unicode_spaces(F.col("text")))


@case("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS h FROM documents WHERE text IS NOT NULL")
def collapse_blanks(s, d):
    return _md5(table(s, d, "documents").filter("text is not null"), T.collapse_blanks(F.col("text")))


@case("SELECT Id, Title, upper(substring(t, 1, 1)) || substring(t, 2) AS name FROM (SELECT Id, Title, trim(regexp_replace(replace(Title, '_', ' '), '\\s+', ' ', 'g')) AS t FROM wikidocs WHERE Title IS NOT NULL)")
def title_normal_form(s, d):
    return table(s, d, "wikidocs").filter("Title is not null").select("Id", "Title", T.normalize_title(F.col("Title")).alias("name"))


@case("SELECT page_key, split_part(page_key, ':', 1) AS ns, regexp_replace(page_key, '^[^:]*:', '') AS pagename, url_encode(regexp_replace(page_key, '^[^:]*:', '')) AS encoded, replace(regexp_replace(page_key, '^[^:]*:', ''), ' ', '_') AS anchor FROM pages_idx")
def title_parts(s, d):
    name = F.regexp_replace("page_key", "^[^:]*:", "")
    return table(s, d, "pages_idx").select("page_key", F.split_part("page_key", F.lit(":"), F.lit(1)).alias("ns"), name.alias("pagename"), T.url_encode(name).alias("encoded"), T.anchor_encode(name).alias("anchor"))


@case("SELECT Id, 'https://en.wikipedia.org/wiki?curid=' || Id AS link FROM wikidocs")
def article_links(s, d):
    return table(s, d, "wikidocs").select("Id", T.article_link(F.lit("en"), F.col("Id")).alias("link"))


@case("SELECT doc_id, regexp_extract('#Redirect [[' || page_key || ']] ' || coalesce(text, ''), '(?i)^#REDIRECT(?:ION)?\\s*\\[\\[([^\\]]+)\\]\\]', 1) AS target FROM documents")
def redirect_targets(s, d):
    return table(s, d, "documents").select("doc_id", T.redirect_target(F.concat(F.lit("#Redirect [["), "page_key", F.lit("]] "), F.coalesce("text", F.lit("")))).alias("target"))


_LINES = "WITH l AS (SELECT Id, trim(unnest(string_split(Doc, chr(10))), ' ') AS line FROM wikidocs WHERE Doc IS NOT NULL)"


def _lines(s, d) -> DataFrame:
    return table(s, d, "wikidocs").filter("Doc is not null").select("Id", F.explode(F.split("Doc", "\n")).alias("line")).withColumn("line", F.trim("line"))


_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_RULE = f"""(lower(split_part(line, ' ', 1)) IN {_in(cleanup.LEAKED)}
 OR (octet_length(encode(line)) < 40 AND line LIKE '%=') OR line LIKE '">%' OR line LIKE '%">' OR line LIKE '!%' OR line LIKE '|-%'
 OR (octet_length(encode(line)) > 10 AND (line LIKE '%nowrap' OR line LIKE '%noprint')) OR regexp_matches(substring(line, 1, 20), 'colspan|rowspan')
 OR (octet_length(encode(line)) > 2 AND octet_length(encode(line)) < 40 AND regexp_matches(line, '^[a-z-]{{2,}} ?[=:]')))"""


@case(f"{_LINES} SELECT Id, count(*) AS lines, count(*) FILTER ({_RULE}) AS debris FROM l GROUP BY Id")
def line_rules(s, d):
    return _lines(s, d).groupBy("Id").agg(F.count("*").alias("lines"), F.count_if(T.line_is_debris(F.col("line"))).alias("debris"))


_WORDS = "CASE WHEN line <> '' THEN len(string_split_regex(line, '\\s+')) ELSE 0 END"
_DIGITS = "len(regexp_extract_all(line, '[0-9٠-٩۰-۹०-९]'))"


@case(f"{_LINES} SELECT Id, count(*) FILTER ({_WORDS} >= 3 AND {_DIGITS} * 2 < length(regexp_replace(line, '\\s+', '', 'g'))) AS prose, count(*) FILTER ({_DIGITS} * 2 >= length(regexp_replace(line, '\\s+', '', 'g')) AND line <> '') AS figures FROM l GROUP BY Id")
def prose_lines(s, d):
    heavy = (T.digit_count(F.col("line")) * 2 >= T.char_count(F.col("line"))) & (F.col("line") != "")
    return _lines(s, d).groupBy("Id").agg(F.count_if(T.is_prose(F.col("line"), 3)).alias("prose"), F.count_if(heavy).alias("figures"))


_VALUES = ["yes", "12px", "#fff", "ab", "thumb", "photo.JPG", "text-align:left", "bar21-font-size-90%", 'colspan="2"', "ang-Latn", '{"type":1}', "mid-century", "Iranian footballer", "Tokyo", "born 28 July 1996", "navbox", "3.5", "Vignette", "font-size=100%"]
_CONTROL, _PARAMS = sorted(values.SWITCHES | values.LAYOUT), sorted(values.PARAMETER_WORDS)


@case(f"""
WITH v AS (SELECT unnest([{', '.join("'" + x + "'" for x in _VALUES)}]) AS v UNION SELECT p_name FROM part UNION SELECT p_type FROM part),
n AS (SELECT v, octet_length(encode(v)) AS n, lower(v) AS low FROM v)
SELECT v, (n < 2 OR regexp_matches(v, '^[\\{{\\[]..') OR low IN {_in(_CONTROL)} OR regexp_matches(v, '^[0-9.%pxem]+$') OR (n <= 8 AND v LIKE '#%') OR (regexp_matches(v, '^[A-Za-z_-]+$') AND (n <= 3 OR low IN {_in(_PARAMS)}))
 OR regexp_matches(v, '(?i).\\.(?:jpg|png|svg|gif|jpeg|webp)$') OR (n < 40 AND (regexp_matches(v, '[a-z-]{{3,}}[:;]') OR (regexp_matches(v, '[a-z-]{{3,}}=') AND regexp_matches(v, '[a-z]-[a-z-]*=|-[a-z-]+='))))
 OR (n >= 5 AND n < 40 AND regexp_matches(v, '^[a-z0-9.%-]+$') AND contains(v, '-') AND regexp_matches(v, '[0-9]')) OR (n >= 4 AND n < 40 AND regexp_matches(v, '^[A-Za-z-]{{2,}}=["'']')) OR regexp_matches(v, '^[a-z]{{2,3}}-[A-Z][a-z]{{3}}$')) AS dropped FROM n""")
def value_filters(s, d):
    fixed = s.createDataFrame([(x,) for x in _VALUES], "v string")
    part = table(s, d, "part")
    v = fixed.union(part.select("p_name")).union(part.select("p_type")).distinct()
    return v.select("v", T.drop_value(F.col("v")).alias("dropped"))


@case("SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '\"')) % 2 AS open_quote FROM documents WHERE text IS NOT NULL")
def character_counts(s, d):
    t = F.col("text")
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.char_length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("digits"), (F.regexp_count(t, F.lit('"')) % 2).cast("long").alias("open_quote"))


# parser functions, expressions, magic words -----------------------------------


@case("SELECT o_orderkey, CASE WHEN length(trim(substring(o_orderpriority, 3))) > 0 THEN 'named' ELSE 'bare' END AS a, CASE WHEN o_orderstatus = 'F' OR try_cast(o_orderstatus AS DOUBLE) = try_cast('F' AS DOUBLE) THEN 'y' ELSE 'n' END AS b FROM orders")
def pf_if_ifeq(s, d):
    return table(s, d, "orders").select("o_orderkey", T.pf_if(F.substring("o_orderpriority", 3, 100), F.lit("named"), F.lit("bare")).alias("a"), T.pf_ifeq(F.col("o_orderstatus"), F.lit("F"), F.lit("y"), F.lit("n")).alias("b"))


@case("SELECT p_size, CASE WHEN p_size::DOUBLE::VARCHAR = p_size::VARCHAR OR p_size::DOUBLE = p_size THEN 'same' ELSE 'other' END AS r, count(*) AS n FROM part GROUP BY ALL")
def pf_ifeq_numeric(s, d):
    p = table(s, d, "part")
    return p.groupBy("p_size", T.pf_ifeq(F.col("p_size").cast("double").cast("string"), F.col("p_size").cast("string"), F.lit("same"), F.lit("other")).alias("r")).agg(F.count("*").alias("n"))


@case("SELECT o_orderstatus, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS r, count(*) AS n FROM orders GROUP BY ALL")
def pf_switch(s, d):
    r = T.pf_switch(F.col("o_orderstatus"), [(["O", "P"], F.lit("open")), (["F"], F.lit("done"))], F.lit(""))
    return table(s, d, "orders").groupBy("o_orderstatus", r.alias("r")).agg(F.count("*").alias("n"))


@case("SELECT o_orderkey, format('{:,}', o_custkey * 1234567) AS n FROM orders")
def pf_formatnum(s, d):
    return table(s, d, "orders").select("o_orderkey", T.formatnum((F.col("o_custkey") * 1234567).cast("string")).alias("n"))


@case("SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 6 THEN lpad(p_partkey::VARCHAR, 6, '0') ELSE p_partkey::VARCHAR END AS l, CASE WHEN length(p_brand) < 12 THEN rpad(p_brand, 12, 'x') ELSE p_brand END AS r FROM part")
def pf_pad(s, d):
    return table(s, d, "part").select("p_partkey", T.pad_left(F.col("p_partkey").cast("string"), 6).alias("l"), T.pad_right(F.col("p_brand"), 12, "x").alias("r"))


@case("SELECT Id, Title, translate(Title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lc, translate(Title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS uc, translate(substring(Title, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substring(Title, 2) AS ucfirst FROM wikidocs WHERE Title IS NOT NULL")
def pf_case(s, d):
    t = F.col("Title")
    return table(s, d, "wikidocs").filter("Title is not null").select("Id", "Title", T.lower_ascii(t).alias("lc"), T.upper_ascii(t).alias("uc"), T.upper_first(t).alias("ucfirst"))


_EXPR = "3 * x + 2 ^ 2 - y mod 7"


@case("SELECT l_linenumber, l_quantity, count(*) AS n, printf('%d', (3 * l_linenumber + 4 - (l_quantity::BIGINT % 7))::BIGINT) AS value FROM lineitem GROUP BY ALL")
def expr_operators(s, d):
    """The evaluator over two columns, through its column function."""
    text = F.replace(F.replace(F.lit(_EXPR), F.lit("x"), F.col("l_linenumber").cast("string")), F.lit("y"), F.col("l_quantity").cast("long").cast("string"))
    rows = table(s, d, "lineitem").groupBy("l_linenumber", "l_quantity").agg(F.count("*").alias("n"))
    return rows.select("l_linenumber", "l_quantity", "n", T.expression(text).alias("value"))


@case("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%B') AS mon, strftime(o_orderdate, '%b') AS mab, strftime(o_orderdate, '%d') AS dd, strftime(o_orderdate, '%A') AS dn, strftime(o_orderdate, '%w') AS dow, strftime(o_orderdate, '%H:%M') AS t, weekofyear(o_orderdate)::VARCHAR AS w, strftime(o_orderdate, '%Y%m%d%H%M%S') AS st FROM orders")
def magic_dates(s, d):
    m = T.magic_dates(F.col("o_orderdate"))
    names = {"y": "CURRENTYEAR", "m": "CURRENTMONTH", "mon": "CURRENTMONTHNAME", "mab": "CURRENTMONTHABBREV", "dd": "CURRENTDAY2", "dn": "CURRENTDAYNAME", "dow": "CURRENTDOW", "t": "CURRENTTIME", "w": "CURRENTWEEK", "st": "CURRENTTIMESTAMP"}
    return table(s, d, "orders").select("o_orderkey", *[m[v].alias(k) for k, v in names.items()])


# arbitrary code: snippets, rendering, dump, embedding, streams -------------------


@case()
def snippets(s, d):
    from ..operators.snippet import snippet_column

    best = keyword.pool(_scored(s, d, "harbour museum railway"), 40)
    texts = table(s, d, "documents").select("doc_id", "text")
    return texts.join(F.broadcast(best.select("doc_id", "pos")), "doc_id").select("doc_id", "pos", snippet_column("text", ["harbour", "museum", "railway"]).alias("snippet"))


@case("""
WITH e AS (SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, regexp_replace(t, '(^|[^\\p{L}\\p{M}\\p{N}])(harbour|museum)(?:([^\\p{L}\\p{M}\\p{N}])|$)', '\\1<b>\\2</b>\\3', 'gi') AS marked FROM e)
SELECT doc_id, md5(marked) AS h FROM h WHERE marked LIKE '%<b>%'""")
def highlighted(s, d):
    terms = F.array(F.lit("harbour"), F.lit("museum"))
    return table(s, d, "documents").filter("text is not null").select("doc_id", T.highlight(F.col("text"), terms).alias("marked")).filter(F.col("marked").contains("<b>")).select("doc_id", F.md5("marked").alias("h"))


@case(_HYBRID + """,
o AS (SELECT b.*, page.Title AS title, 'https://en.wikipedia.org/wiki?curid=' || b.doc_id AS link FROM b LEFT JOIN page ON Id = b.doc_id)
SELECT (fpos - 1)::INTEGER AS place, round(score, 4) AS score, krank, vrank, title, link FROM o""")
def json_answer(s, d):
    """The JSON answer of a fused search, read back row by row."""
    docs = table(s, d, "wikivecs").filter("Id <> 0")
    rows = rerank.rerank(fusion.hybrid_search(docs, " ".join(_ASKED), _QUERY), " ".join(_ASKED), None)
    answer = rerank.to_json(rerank.cut_json(rows), "en")
    shape = "results array<struct<score: double, krank: int, vrank: int, text: string, title: string, link: string>>, timings struct<fused: double, rerank: double>"
    return answer.select(F.posexplode(F.from_json("json", shape)["results"]).alias("place", "r")).select("place", F.round("r.score", 4).alias("score"), "r.krank", "r.vrank", "r.title", "r.link")


@case()
def json_reranked(s, d):
    docs = table(s, d, "wikivecs").filter("Id <> 0")
    rows = rerank.rerank(fusion.hybrid_search(docs, "harbour museum railway", _QUERY), "harbour museum railway", rerank.overlap_scorer)
    return rerank.to_json(rerank.cut_json(rows), "en")


_DUMPS: dict[tuple[str, str], str] = {}


def _dump(s, d) -> str:
    """The wiki's records as a dump in the shared folder, one template beside them; written once a session."""
    from ..operators.tables import shared_dir

    held = _DUMPS.get((s.sparkContext.applicationId, d))
    if held:
        return held

    docs = table(s, d, "wikidocs").filter("Doc is not null and Title is not null")
    body = F.concat(F.lit("'''"), "Title", F.lit("''' {{note|1=see}} [[File:a.jpg|x]]\n"), F.regexp_replace("Doc", r"[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}]", " "))
    page = F.struct(F.col("Title").alias("title"), F.lit(0).alias("ns"), F.col("Id").alias("id"), F.struct(F.lit(1).alias("id"), body.alias("text")).alias("revision"))
    note = s.createDataFrame([(("Template:Note", 10, 9_000_001, (1, "<noinclude>doc</noinclude>({{{1}}})")),)], "p struct<title: string, ns: int, id: int, revision: struct<id: int, text: string>>")
    path = f"{shared_dir(s)}/folioforge/dump-{abs(hash(d)) % 10**8}"
    docs.select(page.cast("struct<title: string, ns: int, id: int, revision: struct<id: int, text: string>>").alias("p")).union(note).select("p.*").write.mode("overwrite").format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    _DUMPS[(s.sparkContext.applicationId, d)] = path
    return path


@case("SELECT count(*) AS pages, count(DISTINCT Id) AS ids FROM wikidocs WHERE Doc IS NOT NULL AND Title IS NOT NULL")
def dump_read_back(s, d):
    from ..sources.mediawiki import read_pages

    return read_pages(s, _dump(s, d)).filter("ns = 0").agg(F.count("*").alias("pages"), F.countDistinct("page_id").alias("ids"))


@case("SELECT count(DISTINCT Title) + 1 AS pages, count(DISTINCT Title) AS articles, 0::BIGINT AS redirects FROM wikidocs WHERE Doc IS NOT NULL AND Title IS NOT NULL")
def dump_counts(s, d):
    from ..sources.mediawiki import page_counts, page_index, read_pages

    return page_counts(page_index(read_pages(s, _dump(s, d))))


@case()
def dump_rendered(s, d):
    from ..sources.mediawiki import read_pages, render_articles

    return render_articles(read_pages(s, _dump(s, d)))


@case()
def wikitext_rendered(s, d):
    from ..sources.mediawiki import render_articles

    docs = table(s, d, "documents").filter("text is not null")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("ns"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.lit(None).cast("string").alias("redirect_to"), F.lit(False).alias("is_redirect"), F.concat(F.lit("{{#if:x|'''Head'''}} [[a|b]]\n"), "text").alias("wikitext"), F.lit(0).cast("long").alias("rev"))
    return render_articles(pages)


@case()
def chunk_embedded(s, d):
    from ..models import HashEmbedder, chunk_embed

    docs = table(s, d, "wikidocs").filter("Doc is not null and Doc <> ''")
    return docs.select("Id", F.size(chunk_embed(lambda: HashEmbedder(64), F.col("Doc"), F.col("Title"))).alias("chunks"))


@case("SELECT time_bucket(INTERVAL '1 hour', ts) AS at, event_type, count(*) AS count FROM events GROUP BY ALL")
def stream_windows(s, d):
    from ..streaming import ingest

    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    out = ingest.run_to_memory(ingest.tumbling_counts(stream, "ts", "1 hour", "event_type"), "stream_windows", "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("at"), "event_type", "count")


@case("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_deduplicated(s, d):
    from ..streaming import ingest

    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    return ingest.run_to_table(ingest.deduplicated(stream, "ts", ["event_id"])).agg(F.count("event_id").alias("n"))
