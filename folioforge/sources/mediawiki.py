"""MediaWiki dumps: pages, site information, templates, page index and rendered articles."""

from __future__ import annotations

import bz2
import re
import shutil
import urllib.request
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.build import follow
from ..operators.tables import materialize, release, spread
from ..wikitext import article, cleanup
from ..wikitext.expand import normalize_title
from ..wikitext.magic import clock_words, site_words

PAGE = "id LONG, ns INT, title STRING, redirect STRUCT<_title: STRING>, revision STRUCT<id: LONG, timestamp: STRING, text: STRUCT<_VALUE: STRING>>"
SITE = "sitename STRING, dbname STRING, base STRING, namespaces STRUCT<namespace: ARRAY<STRUCT<_key: INT, _VALUE: STRING>>>"
#: Templates beyond this many bytes are joined to the articles that use them instead of broadcast.
BROADCAST_BYTES = 64 << 20
#: Keys of repeated pages beyond this number meet the pages by a join.
BROADCAST_ROWS = 50_000
_OPEN, _CLOSE = "<page>", "</page>"


def _pages_of(xml: DataFrame) -> DataFrame:
    """Pages of a column ``xml``, each value a whole ``<page>`` element."""
    raw = xml.select(F.from_xml("xml", PAGE, {"rowTag": "page", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}).alias("p")).select("p.*")
    return raw.select(
        F.coalesce("id", F.lit(0)).cast("long").alias("page_id"),
        "ns",
        "title",
        F.col("redirect._title").alias("redirect_to"),
        F.col("redirect").isNotNull().alias("is_redirect"),
        F.col("revision.text._VALUE").alias("wikitext"),
        F.coalesce(F.col("revision.id"), F.lit(0)).alias("rev"),
    ).filter("title is not null and ns is not null and wikitext is not null")


def read_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(page_id, ns, title, redirect_to, is_redirect, wikitext, rev)`` of every page with title, namespace and text.

    Plain and bzip2 dumps are cut into splits at ``</page>`` (bzip2 at its
    blocks), so one file is read by many tasks; the markup of a page is parsed
    in the JVM.  ``limit`` keeps the first pages in title order.
    """
    records = spark.read.option("lineSep", _CLOSE).text(path).filter(F.col("value").contains(_OPEN))
    # the marks cannot stand inside a page: there they are written as entities
    pages = _pages_of(records.select(F.concat(F.lit(_OPEN), F.substring_index("value", _OPEN, -1), F.lit(_CLOSE)).alias("xml")))
    return pages if limit is None else pages.orderBy("ns", "title").limit(limit)


def read_siteinfo(spark: SparkSession, path: str) -> dict:
    """``sitename, dbname, urlbase, namespaces`` (number to name) from the dump's head."""
    head = spark.read.option("lineSep", "</siteinfo>").text(path).filter(F.col("value").contains("<siteinfo>")).limit(1)
    xml = F.concat(F.lit("<siteinfo>"), F.substring_index("value", "<siteinfo>", -1), F.lit("</siteinfo>"))
    row = head.select(F.from_xml(xml, SITE, {"rowTag": "siteinfo"}).alias("s")).select("s.*").first()
    if row is None:
        return {"sitename": "", "dbname": "", "urlbase": "", "namespaces": {}}
    names = {int(n["_key"]): n["_VALUE"] or "" for n in (row["namespaces"]["namespace"] if row["namespaces"] else None) or [] if n["_key"] is not None}
    return {"sitename": row["sitename"] or "", "dbname": row["dbname"] or "", "urlbase": (row["base"] or "").rsplit("/", 1)[0], "namespaces": names}


# the page index: places of pages in a plain dump ---------------------------------

_TITLE, _NS, _ID, _REDIRECT = re.compile(rb"<title>([^<]*)</title>"), re.compile(rb"<ns>(\d+)</ns>"), re.compile(rb"<id>(\d+)</id>"), re.compile(rb"<redirect\b")
INDEX = "page_key string, byte_offset double, byte_length double, redirect int, id string, path string"


def scan_offsets(spark: SparkSession, paths: list[str], range_bytes: int = 32 << 20) -> DataFrame:
    """``(page_key, byte_offset, byte_length, redirect, id, path)`` of every page of plain dumps.

    Workers seek to ranges of ``range_bytes``; the range in which ``<page>``
    begins owns the page and reads on to its end.  Pages without title,
    namespace or text are left out.
    """
    import html

    from pyarrow import fs

    rows = []
    for path in paths:
        system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{Path(path).absolute()}")
        rows += [(path, start) for start in range(0, max(1, system.get_file_info(name).size), range_bytes)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{Path(path).absolute()}")
                out: list[tuple] = []
                with system.open_input_file(name) as f:
                    size = f.size()
                    mark, close = _OPEN.encode(), _CLOSE.encode()
                    data = f.read_at(min(range_bytes + len(mark) - 1, size - start), start)
                    at = data.find(mark)
                    while at >= 0:
                        end = data.find(close, at)
                        step = 1 << 20
                        while end < 0 and start + len(data) < size:
                            seen = max(at, len(data) - len(close))
                            data += f.read_at(min(step, size - start - len(data)), start + len(data))
                            end, step = data.find(close, seen), step * 2
                        if end < 0:
                            break
                        page = data[at : end + len(close)]
                        text = page.find(b"<text")
                        head = page[: text if text >= 0 else len(page)]
                        title, ns, ident = _TITLE.search(head), _NS.search(head), _ID.search(head)
                        if title and ns and text >= 0 and not re.match(rb"<text[^>]*/>", page[text : text + 400]):
                            out.append((f"{int(ns[1])}:{html.unescape(title[1].decode('utf-8', 'replace'))}", float(start + at), float(len(page)), int(bool(_REDIRECT.search(head))), ident[1].decode() if ident else None, path))
                        at = data.find(mark, end)
                        if at >= range_bytes:
                            break
                kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["page_key", "byte_offset", "byte_length", "redirect", "id", "path"])

    return spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)), "path", "start").mapInArrow(scan, INDEX)


def last_places(index: DataFrame) -> DataFrame:
    """One row a ``page_key``: the place written last (the largest offset) is in force; ``writes`` counts them."""
    rest = [c for c in index.columns if c not in ("page_key", "byte_offset")]
    return index.groupBy("page_key").agg(F.max_by(F.struct(*rest), "byte_offset").alias("m"), F.max("byte_offset").alias("byte_offset"), F.count("*").alias("writes")).select("page_key", "byte_offset", "m.*", "writes")


def index_counts(places: DataFrame) -> DataFrame:
    """One row: pages, articles and redirects of a page index with one row a key."""
    main = F.col("page_key").startswith("0:")
    return places.agg(F.count("*").alias("pages"), F.count_if(main & (F.col("redirect") == 0)).alias("articles"), F.count_if(main & (F.col("redirect") == 1)).alias("redirects"))


def key_range(places: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``start <= page_key < end``; the bounds reach the scan."""
    return places.filter((F.col("page_key") >= start) & (F.col("page_key") < end))


def look_up(keys: DataFrame, places: DataFrame, *tries: str) -> DataFrame:
    """``byte_offset`` of the first of a row's key columns ``tries`` that the index holds (null where none does)."""
    held = places.select("page_key", "byte_offset")
    out = keys
    for i, c in enumerate(tries):
        out = out.join(held.select(F.col("page_key").alias(c), F.col("byte_offset").alias(f"_o{i}")), c, "left")
    return out.withColumn("byte_offset", F.coalesce(*[F.col(f"_o{i}") for i in range(len(tries))])).drop(*[f"_o{i}" for i in range(len(tries))])


def read_range(path: str, offset: int, length: int) -> str:
    """``length`` bytes from ``offset`` on, as text; nothing else of the file is read."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{Path(path).absolute()}")
    with system.open_input_file(name) as f:
        return f.read_at(length, offset).decode("utf-8", "replace")


def page_at(spark: SparkSession, places: DataFrame, key: str) -> DataFrame:
    """The page of a key of the index, as :func:`read_pages` gives it, by one ranged read; empty for an unknown key."""
    row = places.filter(F.col("page_key") == key).orderBy(F.desc("byte_offset")).first()
    held = [(read_range(row["path"], int(row["byte_offset"]), int(row["byte_length"])),)] if row else []
    return _pages_of(spark.createDataFrame(held, "xml string"))


def fetch_dump(url: str, target: str, chunk: int = 1 << 20) -> str:
    """Download a dump, going on where an earlier attempt stopped, and unpack bzip2 to a plain file beside it; returns the plain file."""
    part = Path(f"{target}.part")
    have = part.stat().st_size if part.exists() else 0
    if not Path(target).exists():
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        with urllib.request.urlopen(request) as source:
            resumed = have and getattr(source, "status", None) == 206
            with part.open("ab" if resumed else "wb") as out:
                shutil.copyfileobj(source, out, chunk)
        part.rename(target)
    if not target.endswith(".bz2"):
        return target
    plain = target[: -len(".bz2")]
    if not Path(plain).exists():
        with bz2.open(target) as source, Path(f"{plain}.part").open("wb") as out:
            shutil.copyfileobj(source, out, chunk)
        Path(f"{plain}.part").rename(plain)
    return plain


# pages in force, templates, rendering ----------------------------------------------


def page_index(pages: DataFrame) -> DataFrame:
    """One row a ``(ns, title)``: the last written is in force.

    Only pages of repeated keys are gathered by key; the others, as a rule all,
    pass without a shuffle of their texts.  ``pages`` is read twice, once for
    its keys.
    """
    repeated = pages.groupBy("ns", "title").agg(F.count("*").alias("_c")).filter("_c > 1").select("ns", "title")
    some = repeated.limit(BROADCAST_ROWS + 1).collect()
    if not some:
        return pages
    few = F.broadcast(pages.sparkSession.createDataFrame(some, repeated.schema)) if len(some) <= BROADCAST_ROWS else materialize(repeated)
    order = Window.partitionBy("ns", "title").orderBy(F.desc("rev"), F.desc("page_id"))
    last = pages.join(few, ["ns", "title"], "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return pages.join(few, ["ns", "title"], "left_anti").select(pages.columns).unionByName(last.select(pages.columns))


def page_counts(pages: DataFrame) -> DataFrame:
    """One row: pages of all namespaces, articles and redirects of the main one."""
    return pages.agg(F.count("*").alias("pages"), F.count_if((F.col("ns") == 0) & ~F.col("is_redirect")).alias("articles"), F.count_if((F.col("ns") == 0) & F.col("is_redirect")).alias("redirects"))


def articles(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("ns") == 0) & ~F.col("is_redirect"))


def templates(pages: DataFrame) -> DataFrame:
    """``(name, body)`` of namespace 10, redirects followed however long the chain (cycles end in no body)."""
    bare = F.regexp_replace("title", "^[^:]*:", "")
    t = pages.filter("ns = 10").select(T.normalize_title(bare).alias("name"), "wikitext", "is_redirect", F.coalesce("redirect_to", F.nullif(T.redirect_target(F.col("wikitext")), F.lit(""))).alias("to"))
    target = F.when(F.col("to").isNotNull(), T.normalize_title(F.regexp_replace("to", "^[^:]*:", "")))
    t = materialize(t.select("name", "wikitext", target.alias("target")).dropDuplicates(["name"]))
    bodies = t.filter("target is null").select("name", F.col("wikitext").alias("body"))
    moves = t.filter("target is not null").select(F.col("name").alias("source"), "target")
    ends = bodies.limit(0) if moves.isEmpty() else follow(moves).join(bodies.withColumnRenamed("name", "final"), "final").select(F.col("source").alias("name"), "body")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cleanup.template_body(x or "") for x in b.column(1).to_pylist()], pa.string())], ["name", "body"])

    return bodies.unionByName(ends).mapInArrow(clean, "name string, body string")


def template_closure(articles_: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(page_id, name)``: every template an article can reach, by joins on names in the text until none is added."""
    names = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\{\{\s*([^|{}#<>\[\]\n]+)"), F.lit(1)), T.normalize_title))
    edges = materialize(bodies.select("name", F.explode(names(F.col("body"))).alias("uses")).join(bodies.select(F.col("name").alias("uses")), "uses").select("name", "uses").distinct())
    reach = frontier = materialize(articles_.select("page_id", F.explode(names(F.col("wikitext"))).alias("name")).join(bodies.select("name"), "name").select("page_id", "name").distinct())
    while True:
        new = frontier.join(edges, "name").select("page_id", F.col("uses").alias("name")).distinct().join(reach, ["page_id", "name"], "left_anti")
        frontier = materialize(new)
        if frontier.isEmpty():
            return reach
        former, reach = reach, materialize(reach.unionByName(frontier))
        release(former)


def _renderer(fixed: dict[str, str] | None, words: dict[str, str], namespaces: list[str], compat: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, errors = [], []
            own = b.column(3).to_pylist() if fixed is None else None
            for i, (title, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                bodies = fixed if fixed is not None else dict(own[i] or [])
                try:
                    docs.append(article.render(text, title or "", lambda n, d=bodies: d.get(normalize_title(n)), words, namespaces, compat))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one bad article must not end the build
                    docs.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(docs, pa.string()), pa.array(errors, pa.string())], ["Id", "Title", "Doc", "error"])

    return run


def render_articles(pages: DataFrame, site: dict | None = None, as_of: datetime | None = None, language: str = "en", where=None, compat: bool = False) -> DataFrame:
    """``(Id, Title, Doc, error)`` of every article; redirects and empty texts give no row, failures an error row.

    The dump is parsed once, into a written table, of which keys, templates and
    articles are then read column by column; texts are not shuffled.  ``where``
    (a condition on title and page_id) is applied before expansion.  Templates
    are broadcast up to a checked size; beyond it each article gets the bodies
    it can reach by a join.
    """
    site = site or {}
    index = page_index(materialize(pages))
    todo = articles(index)
    if where is not None:
        todo = todo.filter(where)
    bodies = materialize(templates(index))
    words = {**site_words(site.get("sitename") or "Wikipedia", site.get("urlbase") or "https://en.wikipedia.org/wiki", language), **clock_words(as_of or datetime(2000, 1, 1))}
    names = [site["namespaces"][k] for k in (6, 14) if site.get("namespaces", {}).get(k)]
    size = bodies.agg(F.sum(F.octet_length("body") + F.octet_length("name"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        fixed = {r["name"]: r["body"] for r in bodies.collect()}
        done = spread(todo.select("page_id", "title", "wikitext")).mapInArrow(_renderer(fixed, words, names, compat), "Id long, Title string, Doc string, error string")
    else:
        used = template_closure(todo, bodies).join(bodies, "name").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "body"))).alias("bodies"))
        rows = todo.join(used, "page_id", "left").select("page_id", "title", "wikitext", "bodies")
        done = rows.mapInArrow(_renderer(None, words, names, compat), "Id long, Title string, Doc string, error string")
    return done.filter("error is not null or length(Doc) > 0")


def expand_page(pages: DataFrame, title: str, raw: bool = False, **how) -> str | None:
    """One article's text (or wikitext); null for a missing page, the empty text of a redirect counts as null."""
    one = F.col("title") == title
    if raw:
        row = pages.filter((F.col("ns") == 0) & one).orderBy(F.desc("rev"), F.desc("page_id")).select("wikitext").first()
        return row and row["wikitext"]
    row = render_articles(pages.filter((F.col("ns") != 0) | one), **how).first()
    return row and row["Doc"]


def show_page(spark: SparkSession, path: str, title: str, raw: bool = False, places: DataFrame | None = None, **how) -> str | None:
    """One article of a plain dump by its place: a ranged read, and for the text one of each template the dump holds.

    ``places`` is a written page index (:func:`scan_offsets`, :func:`last_places`);
    without it the dump is scanned for one.
    """
    places = places if places is not None else last_places(scan_offsets(spark, [path]))
    page = page_at(spark, places, f"0:{title}")
    if raw:
        row = page.select("wikitext").first()
        return row and row["wikitext"]
    helpers = key_range(places, "10:", "10;")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([read_range(p, int(o), int(n)) for p, o, n in zip(*(c.to_pylist() for c in b.columns))], pa.string())], ["xml"])

    bodies = _pages_of(helpers.select("path", "byte_offset", "byte_length").mapInArrow(read, "xml string"))
    return expand_page(page.unionByName(bodies), title, **how)
