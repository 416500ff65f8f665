"""Ranked full-text search: postings, BM25 with lead weight, pools, paging, counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stems import derivations
from .tables import materialize, rows_at_most, spread

K1, B, SATURATION = 1.2, 0.75, 5.0


@dataclass(frozen=True)
class SearchOptions:
    """Settings of one search; nothing sticks to a session."""

    pool: int = 100
    vector_pool: int = 300
    lead_bias: int = 500
    proximity: bool = False
    all_match: bool = False
    min_word_length: int = 2
    derivations: str | None = None
    min_derived_length: int = 5
    page: int = 10
    max_fetch: int = 40
    max_show: int = 20
    max_rerank: int = 30
    probes: int = 256
    snippet: int = 400

    @classmethod
    def of_language(cls, code: str, **more) -> SearchOptions:
        """Settings with the derivations of a language."""
        return cls(**{"derivations": code, **more})


@dataclass(frozen=True)
class Query:
    """Words of a query; ``exact`` where the whole query was one quoted word."""

    text: str
    words: list[str] = field(default_factory=list)
    exact: bool = False


def parse_query(q: str | None, min_word_length: int = 2) -> Query:
    """Lower-case words of at least ``min_word_length`` characters, each once, in order."""
    import regex

    q = (q or "").strip()
    exact = bool(regex.fullmatch(r'"\s*[\p{L}\p{M}\p{N}]+\s*"', q))
    words = dict.fromkeys(w for w in regex.findall(T.TOKEN, q.lower()) if len(w) >= min_word_length)
    return Query(q, list(words), exact)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, doc_id, tf, first_pos)``; one shuffle, terms counted before it."""
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    words = texts.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def document_lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(T.tokens(F.col(text_col))).cast("long").alias("dl")).filter("dl >= 0")


def term_score(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, first_pos: Column, lead_bias: int) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    return idf * gain * (1 + lead_bias / 1000.0 / (1 + first_pos / 50.0))


def _occurrences(forms: list[str]) -> Column:
    return F.size(F.filter("toks", lambda t: t.isin(*forms)))


def _first_place(forms: list[str]) -> Column:
    places = [F.nullif(F.array_position("toks", F.lit(w)), F.lit(0)) for w in forms]
    return (F.least(*places) if len(places) > 1 else places[0]) - 1


def least_gap(placed: Column) -> Column:
    """Least distance between neighbours ``(i, w)`` of different words, null where there are none."""
    gaps = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))), lambda a, b: F.when(a["w"] != b["w"], b["i"] - a["i"]))
    return F.array_min(gaps)


def _closeness(words: list[list[str]]) -> Column:
    """Least distance between two different query words, null where they do not meet."""
    label = lambda t: F.coalesce(*[F.when(t.isin(*forms), F.lit(i)) for i, forms in enumerate(words)])
    placed = F.filter(F.transform("toks", lambda t, i: F.struct(i.alias("i"), label(t).alias("w"))), lambda s: s["w"].isNotNull())
    return least_gap(placed)


def word_forms(query: Query, options: SearchOptions) -> list[list[str]]:
    """What counts as each word of a query: the word alone if it was quoted, else its derivations too."""
    return [[w] if query.exact else derivations(w, options.derivations, options.min_derived_length) for w in query.words]


def scored(found: DataFrame, words: int, options: SearchOptions, exact: bool, n: float, avgdl: float) -> DataFrame:
    """``(doc_id, score)``, score > 0, one row an article, of rows ``(doc_id, dl, tf0, p0, ..., gap)``.

    ``found`` is a written table; the words' document counts are one row.  An
    article with several rows has the score of its best.
    """
    df = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(words)]).first()
    lit = lambda x: F.lit(float(x))
    parts = [F.when(F.col(f"tf{i}") > 0, term_score(F.col(f"tf{i}"), lit(df[f"df{i}"]), lit(n), F.col("dl"), lit(avgdl), F.col(f"p{i}"), options.lead_bias)).otherwise(0.0) for i in range(words)]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    score = score * (1 + F.coalesce(0.5 / F.col("gap"), F.lit(0.0)))
    hit = found.filter(" and ".join(f"tf{i} > 0" for i in range(words))) if options.all_match or exact else found
    return hit.select("doc_id", score.alias("score")).filter("score > 0").groupBy("doc_id").agg(F.max("score").alias("score"))


def matches(docs: DataFrame, id_col: str, text_col: str, query: Query, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Every matching document with its score: ``(doc_id, score)``, score > 0, one row an article.

    Without a written index.  One pass over the text: only the query's words are looked up in each
    document, and what is found there (a few numbers a document) is written, so
    corpus figures and scores read that; nothing is shuffled but one row of sums.
    """
    spark = docs.sparkSession
    if not query.words:
        return spark.createDataFrame([], "doc_id long, score double")
    toks = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", T.tokens(F.col("text")).alias("toks")).filter("toks is not null")
    forms = word_forms(query, options)
    found = toks.select("doc_id", F.size("toks").alias("dl"), *[_occurrences(w).alias(f"tf{i}") for i, w in enumerate(forms)], *[_first_place(w).alias(f"p{i}") for i, w in enumerate(forms)], (_closeness(forms) if options.proximity and len(forms) > 1 else F.lit(None).cast("int")).alias("gap"))
    found = materialize(found)
    figures = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    if not figures["n"] or not figures["avgdl"]:
        return spark.createDataFrame([], "doc_id long, score double")
    return scored(found, len(forms), options, query.exact, figures["n"], figures["avgdl"])


def rank_score(score: Column) -> Column:
    """1 to 1000; null stays null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(1000), F.floor(1000 * score / (score + SATURATION))))).cast("int")


def pool(scored: DataFrame, size: int) -> DataFrame:
    """The best ``size`` rows with their 1-based position; ties go to the smaller id."""
    best = scored.orderBy(F.desc("score"), "doc_id").limit(size)
    return best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def fetch(docs: DataFrame, id_col: str, title_col: str, text_col: str, ids: list[int]) -> DataFrame:
    """``(doc_id, title, text)`` of a page's ids, one row each (the first in order of title and text); the ids reach the scan."""
    rows = docs.filter(F.col(id_col).isin(ids)).select(F.col(id_col).alias("doc_id"), F.col(title_col).alias("title"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.groupBy("doc_id").agg(F.min(F.struct("title", "text")).alias("m")).select("doc_id", "m.title", "m.text")


def keyword_search(docs: DataFrame, id_col: str, title_col: str, text_col: str, q: str, skip: int = 0, options: SearchOptions = SearchOptions(), index: str | None = None) -> tuple[DataFrame, int]:
    """One page ``(doc_id, title, krank, pos, snippet)`` and the number of matching articles.

    With ``index`` (the folder of a written index) only the postings of the
    query's words are read.  Titles and texts come for the page's ids alone.
    """
    from .index import search_text_index
    from .snippet import snippet_column

    query = parse_query(q, options.min_word_length)
    hits = search_text_index(docs.sparkSession, index, query, options) if index else matches(docs, id_col, text_col, query, options)
    total = hits.count()
    ranked = pool(hits, max(options.pool, skip + options.page)).filter((F.col("pos") > skip) & (F.col("pos") <= skip + options.page))
    held = ranked.collect()  # one page
    if not held:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)[id_col]}, title string, krank int, pos int, snippet string"), total
    page = fetch(docs, id_col, title_col, text_col, [r["doc_id"] for r in held]).join(F.broadcast(docs.sparkSession.createDataFrame(held, ranked.schema)), "doc_id", "right")
    return page.select("doc_id", "title", rank_score(F.col("score")).alias("krank"), "pos", snippet_column("text", query.words, options.snippet).alias("snippet")).orderBy("pos"), total


def query_frame(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    """Queries as a table ``(qid, term)``."""
    rows = [(i, w) for i, q in queries for w in parse_query(q).words]
    return spark.createDataFrame(rows, "qid long, term string")


def batch_pools(posts: DataFrame, lengths: DataFrame, queries: DataFrame, size: int, lead_bias: int = 500) -> DataFrame:
    """Pools of many queries ``(qid, doc_id, score, pos)`` from postings; ranks are cut per partition before the shuffle."""
    figures = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = queries.select("term").distinct()
    small = rows_at_most(wanted, 100_000)
    hit = posts.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    # one row a term: its document count and the queries it is in, so postings of a stop word are not gathered in one task
    asked = df.join(queries.groupBy("term").agg(F.collect_set("qid").alias("qids")), "term")
    placed = hit.join(lengths, "doc_id").join(F.broadcast(asked) if small else asked, "term").join(F.broadcast(figures))
    s = term_score(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"), F.col("first_pos"), lead_bias)
    total = placed.select("doc_id", s.alias("s"), F.explode("qids").alias("qid")).groupBy("qid", "doc_id").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= size)
