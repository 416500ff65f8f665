import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions.words import shingle_sets, word_hashes
from folioforge.operators import build, fusion, index, keyword, progress, rerank, tables, vectors
from folioforge.operators.snippet import best_window

# words ------------------------------------------------------------------------


def test_word_hashes_agree_with_a_plain_split():
    texts = ["Ab cd, AB-x1", "", "  ", "Ünïcode ÜNÏCODE 東京 x", "a" * 700]
    h, owner = word_hashes(texts)
    plain = [(i, w) for i, t in enumerate(texts) for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    assert owner.tolist() == [i for i, _ in plain]
    seen = {}
    for x, (_, w) in zip(h.tolist(), plain):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingles():
    h, off, n = shingle_sets(["a b c d a b c", "a b", "b c d"], 3)
    assert np.diff(off).tolist() == [4, 0, 1] and n.tolist() == [7, 2, 3]
    assert h[off[2]] in h[off[0] : off[1]]


# search -------------------------------------------------------------------------


def test_query_parsing():
    q = keyword.parse_query('  "Harbour" ')
    assert q.words == ["harbour"] and q.exact
    assert keyword.parse_query("a the THE x-ray").words == ["the", "ray"]
    assert keyword.parse_query(None).words == [] and keyword.parse_query("!!").words == []


def test_empty_query(spark, data):
    docs = spark.read.parquet(f"{data}/wikidocs.parquet")
    rows, total = keyword.keyword_search(docs, "Id", "Title", "Doc", "")
    assert total == 0 and rows.count() == 0


def test_fusion_scores(spark):
    k = spark.createDataFrame([(1, 9.0, 1), (2, 5.0, 2), (3, 1.0, 100)], "doc_id long, score double, pos int")
    v = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 3), (3, -0.2, 300), (4, 0.7, 1)], "doc_id long, score double, pos int")
    got = {r.doc_id: (round(r.score, 4), r.krank, r.vrank) for r in fusion.fuse(k, v).collect()}
    assert got[1][0] == 32786.8852 and got[2][0] == 32002.0481 and got[3][0] == 9027.7778 and got[4][0] == 16393.4426
    assert got[3][2] == 0 and got[4][1] == 0
    assert {r.doc_id: round(r.score, 4) for r in fusion.fuse_union(k, v).collect()} == {i: s[0] for i, s in got.items()}


def test_rerank_policy(spark):
    assert rerank.apply_policy([0.5] * 30, 40) == ([0.5] * 30 + [-1000.0] * 10, False)
    assert rerank.apply_policy([0.5] * 3, 40) == ([0.0] * 40, True)
    assert rerank.apply_policy([0.5] * 3, 3) == ([0.5] * 3, False)
    rows = spark.createDataFrame([(i, f"word{i}", i) for i in range(1, 41)], "fpos int, snippet string, doc_id long")
    out = rerank.rerank(rows, "word7", rerank.overlap_scorer).collect()
    assert out[0].fpos == 7 and [r.fpos for r in out[-10:]] == list(range(31, 41)) and out[-1].rerank == -1000
    assert [r.fpos for r in rerank.rerank(rows, "q", None).collect()] == list(range(1, 41))
    assert rerank.cut_json(rerank.rerank(rows, "word7", rerank.overlap_scorer)).count() == 30
    assert not rerank.has_next_page(10, 10, 0) and rerank.has_next_page(21, 10, 10)


def test_derivations_and_proximity(spark):
    from folioforge.functions.stems import derivations
    from folioforge.operators.snippet import windows

    assert derivations("harbours", "en")[0] == "harbours" and "harbour" in derivations("harbours", "simple") and derivations("cat", "en") == ["cat"] and derivations("harbours", None) == ["harbours"]
    df = spark.createDataFrame([(1, "the harbour museum"), (2, "harbours x x x x x x x x museum"), (3, "nothing"), (4, None)], "Id long, Doc string")
    run = lambda **o: {r.doc_id: r.score for r in keyword.matches(df, "Id", "Doc", keyword.parse_query("harbour museum"), keyword.SearchOptions(**o)).collect()}
    plain, near, derived = run(), run(proximity=True), run(derivations="en", all_match=True)
    assert set(plain) == {1, 2} and set(derived) == {1, 2} and near[1] > plain[1] and near[2] == plain[2]
    assert set(run(all_match=True)) == {1}
    t = "alpha " + "x " * 500 + "omega end"
    assert "alpha" in windows(t, ["alpha", "omega"]) and "omega" in windows(t, ["alpha", "omega"]) and len(windows(t, ["alpha", "omega"])) <= 235


def test_snippets():
    t = "start " * 200 + "harbour museum " + "end " * 200
    assert "harbour museum" in best_window(t, ["harbour", "museum"]) and len(best_window(t, ["harbour"])) <= 400
    assert best_window(t, ["nothing"]) == t[:230] and best_window("short", ["x"]) == "short"


def test_late_text(spark, data):
    """Titles and texts are read for the page's ids alone: they reach the scan."""
    docs = spark.read.parquet(f"{data}/wikivecs.parquet")
    plan = fusion.hybrid_search(docs, "harbour", [0.1] * 64)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(Doc), In(Id, [" in plan or "In(Id, [" in plan.split("PushedFilters")[1]


def test_one_row_an_article(spark):
    rows = [(1, "a", "harbour town", [[1.0, 0.0]]), (1, "b", "harbour harbour", [[0.0, 1.0]]), (2, "c", "harbour x", [[1.0, 1.0]]), (3, None, None, [[0.5, 0.0]]), (1, "a", "harbour town", [[1.0, 0.0]]), (4, "d", "nothing " * 300 + "at the end", [[0.0, 0.0], [2.0, 0.0]])]
    docs = spark.createDataFrame(rows, "Id long, Title string, Doc string, Vec array<array<float>>")
    got = fusion.hybrid_search(docs, "harbour", [1.0, 0.0]).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4] and [r.fpos for r in got] == [1, 2, 3, 4]
    assert {r.doc_id: r.title for r in got} == {1: "a", 2: "c", 3: None, 4: "d"}
    page, total = keyword.keyword_search(docs, "Id", "Title", "Doc", "harbour")
    assert total == 2 and page.count() == 2


def test_seeded_snippets():
    from folioforge.models import chunk_spans, chunk_text
    from folioforge.operators.snippet import chunk_window

    t = "alpha " * 150 + "\n\n" + "beta " * 180 + "\n\n" + "gamma " * 90
    assert [t[a:b].split()[0] for a, b in chunk_spans(t)] == ["alpha", "beta", "gamma"] and len(chunk_text(t, "T")) == 3
    assert chunk_window(t, ["none"], 100, 1).startswith("beta") and chunk_window("", [], 10, 0) == ""


def test_pruned_scan(spark, data):
    from folioforge.plans import catalog

    plan = catalog.QUERIES["scan_filter_language"](spark, data)._jdf.queryExecution().toString()
    assert "GreaterThan(n_chars,200)" in plan and "text" not in plan.split("ReadSchema")[1]


# builds --------------------------------------------------------------------------


def test_actions_and_upsert(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, "d"), (5, None)], "Id long, Doc string")
    tgt = spark.createDataFrame([(1, [[1.0]]), (2, None), (5, None)], "Id long, Vec array<array<float>>")
    assert {r.Id: r.action for r in build.actions(src, tgt).collect()} == {1: "skipped", 2: "repair", 3: "empty", 4: "insert", 5: "skipped"}
    assert {r.Id for r in build.pending(src, tgt).collect()} == {2, 3, 4, 5}
    up = build.upsert(src, spark.createDataFrame([(2, "B"), (9, "n")], "Id long, Doc string"))
    assert {r.Id: r.Doc for r in up.collect()} == {1: "a", 2: "B", 3: "", 4: "d", 5: None, 9: "n"}


@pytest.mark.parametrize(("total", "n", "sizes"), [(10, 4, [3, 3, 3, 1]), (5, 4, [2, 2, 1]), (0, 3, [])])
def test_slices(spark, total, n, sizes):
    got = build.slices(spark.range(total).toDF("v"), n, "v").groupBy("slice").count().orderBy("slice").collect()
    assert [r["count"] for r in got] == sizes


def test_redirects(spark):
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")], "source string, target string")
    assert {(r.source, r.final, r.hops) for r in build.follow(moves).collect()} == {("a", "c", 2), ("b", "c", 1)}


def test_averages(spark):
    df = spark.createDataFrame([(1, [10.0, 20.0, 30.0]), (2, [5.0])], "k int, v array<double>")
    got = {r.k: r.e for r in df.select("k", progress.moving_average(F.col("v"), 0.5).alias("e")).collect()}
    assert got == {1: 22.5, 2: 5.0}


def test_long_chains_of_redirects(spark):
    moves = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (2000, 1000)], "source long, target long")
    got = {r.source: (r.final, r.hops) for r in build.follow(moves).collect()}
    assert got == {i: (300, 300 - i) for i in range(300)}


def test_text_index(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    path = str(tmp_path / "ix")
    assert index.build_text_index(docs, path, "doc_id", "text") and not index.build_text_index(docs, path, "doc_id", "text")
    for q, o in (("harbour museum railway", keyword.SearchOptions()), ("founded kingdom", keyword.SearchOptions(all_match=True)), ("harbours museums", keyword.SearchOptions(derivations="en", proximity=True)), ('"harbour"', keyword.SearchOptions()), ("", keyword.SearchOptions())):
        a = {r.doc_id: round(r.score, 9) for r in index.search_text_index(spark, path, keyword.parse_query(q), o).collect()}
        b = {r.doc_id: round(r.score, 9) for r in keyword.matches(docs, "doc_id", "text", keyword.parse_query(q), o).collect()}
        assert a == b
    plan = spark.read.parquet(f"{path}/postings").filter("bucket in (3, 7) and term = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "EqualTo(term,x)" in plan
    with pytest.raises(FileNotFoundError):
        index.search_text_index(spark, str(tmp_path / "none"), keyword.parse_query("x"))
    assert index.vector_backend(10) == "exact" and index.vector_backend(5000) == "cells"


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 12))
    x = centre[np.arange(3000) % 20] + rng.normal(size=(3000, 12)) * 0.4
    rows = [(i, [x[2 * i].tolist(), x[2 * i + 1].tolist()]) for i in range(1500)] + [(5000, None), (5001, [[0.0] * 12]), (5002, [[float("nan")] * 12, [1.0]]), (0, [x[0].tolist()])]
    vecs = spark.createDataFrame(rows, "Id int, Vec array<array<float>>")
    path = str(tmp_path / "vx")
    assert index.build_vector_index(vecs, path, 12, per_cell=100) and not index.build_vector_index(vecs, path, 12)
    assert index.index_figures(spark, path, "vectors")["cells"] == 31
    hits = asked = 0
    for i in range(6):
        q = (x[i * 100] + 0.1).tolist()
        exact = {r.doc_id for r in fusion.pool(vectors.best_per_article(vectors.best_chunk(vecs, "Id", "Vec", q)), 10).collect()}
        near = {r.doc_id for r in fusion.pool(index.search_vector_index(spark, path, q, keyword.SearchOptions(probes=6)), 10).collect()}
        full = {r.doc_id for r in fusion.pool(index.search_vector_index(spark, path, q), 10).collect()}
        assert full == exact
        hits, asked = hits + len(near & exact), asked + len(exact)
    assert hits >= 0.9 * asked
    docs = vecs.withColumn("Title", F.lit("t")).withColumn("Doc", F.concat(F.lit("harbour town "), F.col("Id").cast("string")))
    index.build_text_index(docs, path)
    a, b = ([(r.fpos, r.doc_id, r.krank) for r in fusion.hybrid_search(docs, "harbour town", x[0].tolist(), index=i).collect()] for i in (path, None))
    assert a == b


def test_shared_folder(spark, monkeypatch):
    held = tables.materialize(spark.range(5))
    assert tables.exists(spark, held._written_path) and held.count() == 5
    tables.release(held)
    assert not tables.exists(spark, held._written_path)
    tables.release(spark.range(3))

    class Cluster:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: type("G", (), {"get": lambda self, k: None})()})()

    named = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_dir(spark) == named
    monkeypatch.setattr(Cluster, "conf", type("N", (), {"get": lambda self, k, d=None: None})())
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Cluster())


def test_answers(spark, tmp_path):
    from folioforge import api
    from folioforge.models import HashEmbedder

    rows = [(i, f"T<{i}>", f"the harbour of town {i}", [HashEmbedder(8).embed([f"harbour {i}"])[0].tolist()]) for i in range(1, 13)]
    docs = spark.createDataFrame(rows, "Id long, Title string, Doc string, Vec array<array<float>>")
    r = api.Request.parse({"q": " harbour ", "lc": "xx", "skip": "10"}, "/search.html", ["de", "fr"])
    assert (r.lc, r.skip, r.fmt, r.rr) == ("de", 10, "html", False)
    first, last = api.answer(docs, api.Request("harbour")), api.answer(docs, r)
    assert first.count("<li>") == 10 and "skip=10" in first and "<b>harbour</b>" in first and "T&lt;1&gt;" in first
    assert last.count("<li>") == 2 and "next" not in last
    out = json.loads(api.answer(docs, api.Request.parse({"q": "harbour", "rr": ""}, "/x.json"), HashEmbedder(8), rerank.overlap_scorer))
    assert len(out["results"]) == 12 and out["results"][0]["link"].startswith("https://en.")
    assert len(json.loads(api.answer(docs, api.Request("harbour", fmt="json")))["results"]) == 10
    assert rerank.load_scorer(None) is None and rerank.load_scorer(str(tmp_path)) is None
    assert api.build_indexes(docs, str(tmp_path / "i"), 8) == ["text", "vectors"] and api.build_indexes(docs, str(tmp_path / "i"), 8) == []
