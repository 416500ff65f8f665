"""Time-budgeted reranking and result shapes."""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOT_REACHED = -1000.0
Scorer = Callable[[str, str], float]


def overlap_scorer(query: str, text: str) -> float:
    """Share of the query's words that occur in the text; stands in for a model."""
    words = set(query.lower().split())
    return len(words & set(text.lower().split())) / len(words) if words else 0.0


class OnnxScorer:
    """A cross-encoder of query and text from a local ONNX model; the first output of the pair is its score.

    Made once in the process that uses it, so that rows are shipped and not the model.
    """

    def __init__(self, model: str, tokenizer: str, most: int = 512) -> None:
        self.model, self.tokenizer, self.most = model, tokenizer, most
        self._session = None

    def _load(self) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self._session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        self._encoder = Tokenizer.from_file(self.tokenizer)
        self._encoder.enable_truncation(self.most)
        self._names = {i.name for i in self._session.get_inputs()}

    def __getstate__(self) -> dict:
        return {"model": self.model, "tokenizer": self.tokenizer, "most": self.most, "_session": None}

    def __call__(self, query: str, text: str) -> float:
        import numpy as np

        if self._session is None:
            self._load()
        code = self._encoder.encode(query, text)
        feed = {"input_ids": code.ids, "attention_mask": code.attention_mask, "token_type_ids": code.type_ids}
        out = self._session.run(None, {k: np.array([v], np.int64) for k, v in feed.items() if k in self._names})[0]
        return float(np.ravel(out)[0])


def load_scorer(folder: str | None) -> Scorer | None:
    """The reranker of a folder with ``model.onnx`` and ``tokenizer.json``; None, so that search goes on without it, where one is missing."""
    if not folder:
        return None
    model, tokenizer = Path(folder) / "model.onnx", Path(folder) / "tokenizer.json"
    if not (model.exists() and tokenizer.exists() and importlib.util.find_spec("onnxruntime")):
        return None
    return OnnxScorer(str(model), str(tokenizer))


def apply_policy(scores: list[float], candidates: int, least: int = 5) -> tuple[list[float], bool]:
    """Scores of all candidates and whether reranking was given up.

    Rows the budget did not reach get -1000; if fewer than ``least`` (and fewer
    than possible) were reached, all get 0 and reranking is switched off.
    """
    if len(scores) < least and len(scores) < candidates:
        return [0.0] * candidates, True
    return scores + [NOT_REACHED] * (candidates - len(scores)), False


def rerank(rows: DataFrame, query: str, scorer: Scorer | None, text_col: str = "snippet", most: int = 30, budget_ms: int = 5000, least: int = 5) -> DataFrame:
    """Rows of one search with ``rerank``, best first (ties by ``fpos``).

    Without a scorer every row gets 0.  The rows are a page (bounded by the
    search), so one partition and one model serve them.
    """
    if scorer is None:
        return rows.withColumn("rerank", F.lit(0.0)).orderBy(F.desc("rerank"), "fpos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        page = pd.concat(parts).sort_values("fpos").reset_index(drop=True)
        until, scores = time.monotonic() + budget_ms / 1000, []
        for text in page[text_col].head(most):
            if time.monotonic() > until:
                break
            scores.append(float(scorer(query, text or "")))
        page["rerank"] = apply_policy(scores, len(page), least)[0]
        yield page

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", rerank double"
    return rows.coalesce(1).mapInPandas(run, schema).orderBy(F.desc("rerank"), "fpos")


def place(by: list[str], score: str | Column = "rerank") -> Column:
    """Place of a row in its search: best score first, ties by ``fpos``; without a score it counts as not reached."""
    c = F.col(score) if isinstance(score, str) else score
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.coalesce(c, F.lit(NOT_REACHED))), "fpos"))


def budget_outcome(shown: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Of logged searches: rows, rows reached within the budget, and whether reranking was given up, by the rule of :func:`apply_policy`."""
    n = shown.groupBy(*by).agg(F.count("*").alias("rows"), F.count("rerank").alias("reached"))
    return n.withColumn("given_up", (F.col("reached") < least) & (F.col("reached") < F.col("rows")))


def display_cut(rows: DataFrame, most: int = 20) -> DataFrame:
    """Rows a result page shows."""
    return rows.filter(F.col("fpos") <= most)


def cut_json(rows: DataFrame) -> DataFrame:
    """What the JSON answer shows: rows up to the first negative rerank (rows are sorted by it)."""
    return rows.filter(F.coalesce("rerank", F.lit(0.0)) >= 0)


def to_json(rows: DataFrame, code: str, fused_ms: float = 0.0, rerank_ms: float = 0.0) -> DataFrame:
    """One row ``json``: the results in order and the timings."""
    item = F.struct("fpos", "score", "krank", "vrank", F.col("snippet").alias("text"), "title", F.format_string("https://%s.wikipedia.org/wiki?curid=%d", F.lit(code), F.col("doc_id")).alias("link"))
    ordered = F.array_sort(F.collect_list(item))
    plain = F.transform(ordered, lambda r: F.struct(r["score"].alias("score"), r["krank"].alias("krank"), r["vrank"].alias("vrank"), r["text"].alias("text"), r["title"].alias("title"), r["link"].alias("link")))
    return rows.agg(F.to_json(F.struct(plain.alias("results"), F.struct(F.lit(fused_ms).alias("fused"), F.lit(rerank_ms).alias("rerank")).alias("timings"))).alias("json"))


def to_html(rows: DataFrame, code: str, q: str, words: list[str], total: int, skip: int = 0, page: int = 10) -> DataFrame:
    """One row ``html``: the results as list items with links and highlighted snippets, and the link to the next page."""
    from urllib.parse import quote

    terms = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    item = F.format_string('<li><a href="%s">%s</a><p>%s</p></li>', T.article_link(F.lit(code), F.col("doc_id")), T.html_escape(F.coalesce("title", F.lit(""))), T.highlight(F.coalesce("snippet", F.lit("")), terms))
    order = "fpos" if "fpos" in rows.columns else "pos"
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("h")))).alias("a"), F.count("*").alias("n"))
    body = F.concat(F.lit("<ol>"), F.array_join(F.transform("a", lambda x: x["h"]), ""), F.lit("</ol>"))
    link = f'<a class="next" href="?q={quote(q)}&amp;lc={quote(code)}&amp;skip={skip + page}">next</a>'
    return listed.select(F.when(F.lit(total) > F.col("n") + skip, F.concat(body, F.lit(link))).otherwise(body).alias("html"))


def has_next_page(total: int, shown: int, skip: int) -> bool:
    return total > shown + skip
