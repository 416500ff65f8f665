"""Search and build from Python, and the command line (``python -m folioforge``)."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .operators import build, fusion, keyword, rerank
from .operators import index as index_
from .operators.keyword import SearchOptions
from .sources import mediawiki


def keyword_search(docs: DataFrame, q: str, skip: int = 0, options: SearchOptions | None = None, code: str = "en", index: str | None = None) -> dict:
    """One page of results as plain values: rows, total, and whether a next page exists.

    Derivations follow the language ``code`` unless ``options`` are given;
    ``index`` names the folder of a written index.
    """
    rows, total = keyword.keyword_search(docs, "Id", "Title", "Doc", q, skip, options or SearchOptions.of_language(code), index)
    shown = [r.asDict() for r in rows.collect()]
    return {"results": shown, "total": total, "next": rerank.has_next_page(total, len(shown), skip)}


def hybrid_search(vecs: DataFrame, q: str, embedder: models.Embedder, sidecar: dict | None = None, engine: str = "onnx", scorer=None, as_json: bool = False, code: str = "en", options: SearchOptions | None = None, index: str | None = None) -> DataFrame:
    """Fused and optionally reranked rows, or one JSON row; an empty query gives an empty result."""
    options = options or SearchOptions.of_language(code)
    if sidecar is not None:
        models.guard(sidecar, sidecar["alias"], engine, embedder.dim)
    vector = [float(x) for x in embedder.embed([q], "query")[0]] if q.strip() else None
    rows = fusion.hybrid_search(vecs, q, vector, options=options, index=index)
    rows = rerank.rerank(rows, q, scorer, most=options.max_rerank)
    if as_json:
        return rerank.to_json(rerank.cut_json(rows), code)
    return rows.limit(options.max_show)


@dataclass(frozen=True)
class Request:
    """What a search page is asked for: query, language, rows to skip, rerank or not, HTML or JSON."""

    q: str = ""
    lc: str = "en"
    skip: int = 0
    rr: bool = False
    fmt: str = "html"

    @classmethod
    def parse(cls, params: dict[str, str], path: str = "", available: list[str] | None = None) -> Request:
        """Request of URL parameters: ``rr`` counts if it is there, a path ending in ``.json`` asks for JSON, an unknown language gives the default one."""
        codes = sorted(available or ["en"])
        code = params.get("lc") or ""
        code = code if code in codes else "en" if "en" in codes else codes[0]
        skip = params.get("skip", "")
        return cls(params.get("q", "").strip(), code, int(skip) if skip.isdigit() else 0, "rr" in params, "json" if params.get("fmt") == "json" or path.endswith(".json") else "html")


def answer(table: DataFrame, request: Request, embedder: models.Embedder | None = None, scorer=None, index: str | None = None) -> str:
    """The page for a request: fused search where an embedder is given, else keyword search."""
    options = SearchOptions.of_language(request.lc)
    words = keyword.parse_query(request.q).words
    if embedder is None:
        rows, total = keyword.keyword_search(table, "Id", "Title", "Doc", request.q, request.skip, options, index)
    else:
        rows, total = hybrid_search(table, request.q, embedder, scorer=scorer if request.rr else None, code=request.lc, options=options, index=index), 0
    if request.fmt == "json":
        full = rows if "fpos" in rows.columns else rows.withColumn("fpos", F.col("pos")).withColumn("score", F.col("krank").cast("double")).withColumn("vrank", F.lit(0))
        return rerank.to_json(rerank.cut_json(full) if "rerank" in full.columns else full, request.lc).first()["json"]
    return rerank.to_html(rows, request.lc, request.q, words, total, request.skip, options.page).first()["html"]


def build_indexes(table: DataFrame, folder: str, dim: int | None = None) -> list[str]:
    """Build what is missing of the text index and, with ``dim``, the vector index; names of those built."""
    built = ["text"] if index_.build_text_index(table, folder) else []
    if dim is not None and index_.build_vector_index(table, folder, dim):
        built.append("vectors")
    return built


def build_docs(spark: SparkSession, dump: str | None, target: str, on_existing: str = "keep", sibling: str | None = None) -> dict:
    """Build a document table from a sibling table or a dump; failing articles go to ``<target>_errors``."""
    if not build.prepare_target(spark, target, on_existing):
        return {"built": False}
    if sibling and build.table_exists(spark, sibling):
        spark.table(sibling).select("Id", "Title", "Doc").write.mode("append").saveAsTable(target)
        return {"built": True, "source": "table"}
    if not dump:
        raise FileNotFoundError("neither a sibling table nor a dump to build from")
    pages = mediawiki.read_pages(spark, dump)
    done = build_cache(mediawiki.render_articles(pages, mediawiki.read_siteinfo(spark, dump), as_of=datetime.now(UTC)))
    good = done.filter("error is null").select("Id", "Title", "Doc")
    if on_existing == "resume" and build.table_exists(spark, target):
        good = good.join(spark.table(target).select("Id"), "Id", "left_anti")
    good.write.mode("append").saveAsTable(target)
    bad = done.filter("error is not null").select("Id", "Title", "error")
    bad.write.mode("overwrite").saveAsTable(f"{target}_errors")
    return {"built": True, "source": "dump", **mediawiki.page_counts(mediawiki.page_index(pages)).first().asDict(), "errors": bad.count()}


def build_cache(df: DataFrame) -> DataFrame:
    from .operators.tables import materialize

    return materialize(df)


def build_vecs(spark: SparkSession, source: DataFrame, target: str, make_embedder, model: str, sidecar_dir: str, engine: str = "onnx", on_existing: str = "resume") -> dict:
    """Add vectors: new rows inserted, rows without vector repaired, filled rows skipped."""
    held = models.read_sidecar(sidecar_dir)
    build.prepare_target(spark, target, on_existing, model, held and held["alias"])
    dim = make_embedder().dim
    if held is None or on_existing == "drop":
        models.write_sidecar(sidecar_dir, model, engine, dim, None, datetime.now(UTC).isoformat())
    embed = lambda df: df.select("Id", "Title", "Doc", models.chunk_embed(make_embedder, F.col("Doc"), F.col("Title")).alias("Vec"))
    if not build.table_exists(spark, target):
        build.write_bucketed(embed(source), target)
        return {"inserted": spark.table(target).count()}
    acted = build_cache(build.actions(source, spark.table(target)))
    counts = {r["action"]: r["rows"] for r in build.counters(acted).collect()}
    changes = build_cache(embed(acted.filter("action in ('insert', 'repair', 'empty')")))
    build.update_bucketed(spark, target, changes)
    return counts


def rerender(spark: SparkSession, docs: DataFrame, dump: str, ids: list[int] | None = None, title: str | None = None, q: str | None = None) -> DataFrame:
    """The document table with the chosen articles rendered anew (by id, by title, or all that match every word of a query)."""
    pages = mediawiki.read_pages(spark, dump)
    if q is not None:
        hit = keyword.matches(docs, "Id", "Doc", keyword.parse_query(q), SearchOptions(all_match=True)).select(F.col("doc_id").alias("page_id"))
        pages = pages.filter("ns <> 0").unionByName(pages.filter("ns = 0").join(hit, "page_id", "left_semi"))
        where = None
    else:
        where = F.col("title") == title if title is not None else F.col("page_id").isin(*(ids or [-1]))
    new = mediawiki.render_articles(pages, mediawiki.read_siteinfo(spark, dump), where=where).filter("error is null").select("Id", "Title", "Doc")
    return build.upsert(docs.select("Id", "Title", "Doc"), build_cache(new))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="folioforge")
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("dump"), b.add_argument("table"), b.add_argument("--on-existing", choices=["keep", "drop", "resume"], default="keep"), b.add_argument("--index")
    fe = sub.add_parser("fetch")
    fe.add_argument("url"), fe.add_argument("target")
    sh = sub.add_parser("showpage")
    sh.add_argument("dump"), sh.add_argument("title"), sh.add_argument("--raw", action="store_true")
    se = sub.add_parser("search")
    se.add_argument("table"), se.add_argument("q"), se.add_argument("--skip", type=int, default=0), se.add_argument("--lc", default="en"), se.add_argument("--index")
    sub.add_parser("models")
    r = sub.add_parser("resolve")
    r.add_argument("alias"), r.add_argument("store")
    e = sub.add_parser("engine")
    e.add_argument("formats", help="comma-separated: gguf,onnx"), e.add_argument("--wanted")
    th = sub.add_parser("threads")
    th.add_argument("kind", choices=["parse", "embed"])
    rr = sub.add_parser("reranker")
    rr.add_argument("folder")
    a = p.parse_args(argv)
    if a.what == "models":
        for alias, dim, multi, cost in models.MENU:
            print(f"{alias}\t{dim}\t{'multilingual' if multi else 'English'}\t{cost}x")
        return
    if a.what == "resolve":
        return print(models.resolve_model(a.alias, a.store))
    if a.what == "engine":
        return print(models.choose_engine(set(a.formats.split(",")), a.wanted))
    if a.what == "threads":
        return print(models.default_threads(a.kind))
    if a.what == "reranker":
        return print("ready" if rerank.load_scorer(a.folder) else "none")
    if a.what == "fetch":
        return print(mediawiki.fetch_dump(a.url, a.target))
    spark = SparkSession.builder.appName("folioforge").getOrCreate()
    if a.what == "build":
        print(json.dumps(build_docs(spark, a.dump, a.table, a.on_existing)))
        if a.index:
            print(json.dumps(build_indexes(spark.table(a.table), a.index)))
    elif a.what == "showpage":
        plain = not a.dump.endswith(".bz2")
        print((mediawiki.show_page(spark, a.dump, a.title, a.raw) if plain else mediawiki.expand_page(mediawiki.read_pages(spark, a.dump), a.title, a.raw)) or "no such article")
    else:
        print(json.dumps(keyword_search(spark.table(a.table), a.q, a.skip, code=a.lc, index=a.index), ensure_ascii=False))
