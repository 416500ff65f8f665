import bz2
from datetime import datetime

import pytest

from folioforge import api, languages, models
from folioforge.sources import mediawiki as mw
from folioforge.streaming import ingest

DUMP = """<mediawiki><siteinfo><sitename>Testwiki</sitename><dbname>testwiki</dbname><base>https://test.wikipedia.org/wiki/Main_Page</base>
<namespaces><namespace key="0" /><namespace key="6">Bild</namespace><namespace key="10">Vorlage</namespace><namespace key="14">Kategorie</namespace></namespaces></siteinfo>
<page><title>AT&amp;amp;T</title><ns>0</ns><id>1</id><revision><id>11</id><text>'''AT&amp;amp;T''' is a firm. {{note|one}} [[Bild:x.jpg|y]] [[Kategorie:Z]]</text></revision></page>
<page><title>Old</title><ns>0</ns><id>2</id><redirect title="AT&amp;amp;T" /><revision><id>12</id><text>#REDIRECT [[AT&amp;amp;T]]</text></revision></page>
<page><title>None</title><ns>0</ns><id>3</id><revision><id>13</id><text /></revision></page>
<page><title>Twice</title><ns>0</ns><id>4</id><revision><id>14</id><text>first text here</text></revision></page>
<page><title>Twice</title><ns>0</ns><id>4</id><revision><id>15</id><text>second text here
on {{PAGENAME}} in {{CURRENTMONTHNAME}} of {{SITENAME}}</text></revision></page>
<page><title>Blank</title><ns>0</ns><id>5</id><revision><id>16</id><text>&lt;!-- nothing --&gt;</text></revision></page>
<page><title>Noid</title><ns>0</ns><revision><id>17</id><text>page without id</text></revision></page>
<page><title>Vorlage:Note</title><ns>10</ns><id>6</id><revision><id>18</id><text>&lt;noinclude&gt;doc&lt;/noinclude&gt;({{inner|{{{1}}}}})</text></revision></page>
<page><title>Vorlage:Inner</title><ns>10</ns><id>7</id><redirect title="Vorlage:Deep" /><revision><id>19</id><text>#REDIRECT [[Vorlage:Deep]]</text></revision></page>
<page><title>Vorlage:Deep</title><ns>10</ns><id>8</id><revision><id>20</id><text>see {{{1}}}</text></revision></page>
<page><title>Vorlage:A</title><ns>10</ns><id>9</id><redirect title="Vorlage:B" /><revision><id>21</id><text>#REDIRECT [[Vorlage:B]]</text></revision></page>
<page><title>Vorlage:B</title><ns>10</ns><id>10</id><redirect title="Vorlage:A" /><revision><id>22</id><text>#REDIRECT [[Vorlage:A]]</text></revision></page>
</mediawiki>"""


@pytest.fixture(params=["plain", "bz2"])
def dump(request, tmp_path):
    p = tmp_path / ("d.xml.bz2" if request.param == "bz2" else "d.xml")
    p.write_bytes(bz2.compress(DUMP.encode()) if request.param == "bz2" else DUMP.encode())
    return str(p)


def test_dump(spark, dump):
    pages = mw.read_pages(spark, dump)
    assert pages.count() == 11
    site = mw.read_siteinfo(spark, dump)
    assert site["sitename"] == "Testwiki" and site["urlbase"] == "https://test.wikipedia.org/wiki" and site["namespaces"][14] == "Kategorie"
    counts = mw.page_counts(mw.page_index(pages)).first()
    assert (counts.articles, counts.redirects) == (4, 1)
    rows = {r.Title: r for r in mw.render_articles(pages, site, datetime(2021, 1, 1)).collect()}
    assert set(rows) == {"AT&amp;T", "Twice", "Noid"} and rows["Noid"].Id == 0
    assert rows["AT&amp;T"].Doc == "AT&T is a firm. (see one)"
    assert rows["Twice"].Doc == "second text here\non Twice in January of Testwiki"
    assert mw.expand_page(pages, "Twice", raw=True).startswith("second") and mw.expand_page(pages, "Old") is None
    assert mw.read_pages(spark, dump, limit=2).count() == 2


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_places(spark, tmp_path, size):
    p = tmp_path / "d.xml"
    p.write_text(DUMP)
    index = mw.scan_offsets(spark, [str(p)], size)
    rows = index.collect()
    assert len(rows) == 11 and all(DUMP[int(r.byte_offset) :][:6] == "<page>" and DUMP[: int(r.byte_offset + r.byte_length)].endswith("</page>") for r in rows)
    places = mw.last_places(index)
    assert mw.index_counts(places).first().asDict() == {"pages": 10, "articles": 4, "redirects": 1}
    assert mw.show_page(spark, str(p), "Twice", raw=True, places=places).startswith("second") and mw.show_page(spark, str(p), "Twice", places=places).startswith("second text here")
    assert mw.show_page(spark, str(p), "Nowhere", places=places) is None and mw.show_page(spark, str(p), "Nowhere", raw=True, places=places) is None


def test_many_splits_of_one_dump(spark, tmp_path):
    page = "<page><title>T{0}</title><ns>0</ns><id>{0}</id><revision><id>1</id><text>{1}</text></revision></page>\n"
    p = tmp_path / "big.xml"
    p.write_text("<mediawiki>\n" + "".join(page.format(i, f"word &amp; text {i} " * 60) for i in range(2000)) + "</mediawiki>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        pages = mw.read_pages(spark, str(p))
        assert pages.rdd.getNumPartitions() > 5
        assert pages.count() == 2000 and pages.select("page_id").distinct().count() == 2000 and pages.filter("wikitext like 'word & text%'").count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fetch(tmp_path):
    src = tmp_path / "s.xml.bz2"
    src.write_bytes(bz2.compress(DUMP.encode()))
    plain = mw.fetch_dump(src.as_uri(), str(tmp_path / "t.xml.bz2"))
    assert open(plain).read() == DUMP and mw.fetch_dump(src.as_uri(), str(tmp_path / "t.xml.bz2")) == plain


def test_templates_by_join(spark, dump, monkeypatch):
    monkeypatch.setattr(mw, "BROADCAST_BYTES", 0)
    rows = {r.Title: r.Doc for r in mw.render_articles(mw.read_pages(spark, dump), mw.read_siteinfo(spark, dump)).collect()}
    assert rows["AT&amp;T"] == "AT&T is a firm. (see one)"


def test_models(tmp_path):
    assert models.default_alias("simple") == "bge-small-en-v1.5" and models.default_alias("de") == "bge-m3"
    assert models.choose_engine({"gguf", "onnx"}) == "gguf" and models.choose_engine({"onnx"}) == "onnx" and models.choose_engine({"gguf", "onnx"}, "onnx") == "onnx"
    with pytest.raises(ValueError, match="no onnx"):
        models.choose_engine({"gguf"}, "onnx")
    assert models.default_threads("parse", 20) == 8 and models.default_threads("embed", 20) == 12 and models.default_threads("embed", 20, True) == 4
    models.write_sidecar(str(tmp_path), "m", "onnx", 8, None, "now")
    side = models.read_sidecar(str(tmp_path))
    models.guard(side, "m", "onnx", 8)
    with pytest.raises(ValueError, match="built with"):
        models.guard(side, "other", "onnx", 8)
    assert models.chunk_text("a b\n\nc d\n\n" + "x " * 450, "T", 200)[0] == "T\na b c d" and len(models.chunk_text("x " * 450, "", 200)) == 3
    v = models.HashEmbedder(16).embed(["a b", "a b", ""])
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-5 and not v[2].any()


def test_build_resume_repair(spark, dump, tmp_path):
    spark.sql("DROP TABLE IF EXISTS t_docs")
    spark.sql("DROP TABLE IF EXISTS t_docs_errors")
    spark.sql("DROP TABLE IF EXISTS t_vecs")
    made = api.build_docs(spark, dump, "t_docs", "drop")
    assert made["source"] == "dump" and spark.table("t_docs").count() == 3
    assert api.build_docs(spark, dump, "t_docs", "keep") == {"built": False}
    make = lambda: models.HashEmbedder(8)
    assert api.build_vecs(spark, spark.table("t_docs"), "t_vecs", make, "hash", str(tmp_path)) == {"inserted": 3}
    assert api.build_vecs(spark, spark.table("t_docs"), "t_vecs", make, "hash", str(tmp_path)) == {"skipped": 3}
    with pytest.raises(ValueError, match="holds vectors"):
        api.build_vecs(spark, spark.table("t_docs"), "t_vecs", make, "other", str(tmp_path))
    from folioforge.operators import build

    changed = spark.createDataFrame([(4, "Twice", "new text", [[1.0] * 8])], "Id long, Title string, Doc string, Vec array<array<float>>")
    before = {r.f for r in spark.table("t_vecs").filter("Id <> 4").selectExpr("input_file_name() as f").collect()}
    assert build.update_bucketed(spark, "t_vecs", changed) == 1
    assert {r.f for r in spark.table("t_vecs").filter("Id <> 4").selectExpr("input_file_name() as f").collect()} == before
    assert {r.Id: r.Doc for r in spark.table("t_vecs").collect()}[4] == "new text" and spark.table("t_vecs").count() == 3
    page = api.keyword_search(spark.table("t_docs"), "firm")
    assert page["total"] == 1 and not page["next"]
    rows = api.hybrid_search(spark.table("t_vecs"), "firm", models.HashEmbedder(8), models.read_sidecar(str(tmp_path)))
    assert rows.count() >= 1
    assert api.hybrid_search(spark.table("t_vecs"), "", models.HashEmbedder(8), as_json=True).first().json.startswith('{"results":[]')
    again = api.rerender(spark, spark.table("t_docs"), dump, title="Twice")
    assert again.count() == 3


def test_languages(spark):
    t = languages.language_table(spark)
    got = {r.code: r for r in t.filter("code in ('en', 'ar', 'simple')").collect()}
    assert got["ar"].rtl and not got["en"].rtl and got["simple"].english == "Simple English" and t.count() > 150
    assert languages.default_language(t) == "en" and languages.default_language(t.filter("code in ('de', 'ar')")) == "ar"
    spark.sql("CREATE DATABASE IF NOT EXISTS zh_yue_docs_search")
    assert "zh-yue" in {r.code for r in languages.discover(spark).collect()}


def test_stream_ingest(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "Id long, Doc string").write.parquet(src)
    ingest.ingest(ingest.read_stream(spark, src), out, mark).awaitTermination()
    spark.createDataFrame([(2, "x"), (3, "c")], "Id long, Doc string").write.mode("append").parquet(src)
    ingest.ingest(ingest.read_stream(spark, src), out, mark).awaitTermination()
    assert {(r.Id, r.Doc) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "b"), (3, "c")}
