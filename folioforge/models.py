"""Embedding models: menu, choice of engine, sidecar files, and embedders behind one protocol."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Alias, dimension, multilingual, relative cost on a CPU.
MENU = [
    ("all-minilm-l6-v2", 384, False, 1.0),
    ("bge-small-en-v1.5", 384, False, 1.0),
    ("bge-base-en-v1.5", 768, False, 1.5),
    ("nomic-embed-text-v1.5", 768, False, 2.5),
    ("multilingual-e5-small", 384, True, 1.5),
    ("multilingual-e5-base", 768, True, 3.0),
    ("bge-m3", 1024, True, 6.0),
    ("qwen3-embedding-0.6b", 1024, True, 10.0),
]


def menu(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MENU, "alias string, dim int, multilingual boolean, cost double")


def menu_entry(alias: str) -> dict | None:
    return next(({"alias": a, "dim": d, "multilingual": m, "cost": c} for a, d, m, c in MENU if a == alias), None)


def default_alias(code: str) -> str:
    """English has a small model of its own; other languages need a multilingual one."""
    return "bge-small-en-v1.5" if code in ("en", "simple") else "bge-m3"


def choose_engine(formats: set[str], wanted: str | None = None) -> str:
    """gguf by default, onnx if asked for or all there is."""
    if wanted is not None and wanted not in ("gguf", "onnx"):
        raise ValueError(f"unknown engine {wanted!r}")
    if wanted:
        if wanted not in formats:
            raise ValueError(f"model has no {wanted} file")
        return wanted
    for engine in ("gguf", "onnx"):
        if engine in formats:
            return engine
    raise ValueError("model has no usable file")


def default_threads(kind: str, cpus: int | None = None, gpu: bool = False) -> int:
    cpus = cpus or os.cpu_count() or 1
    if kind == "parse":
        return min(cpus, 8)
    return 4 if gpu else min(cpus, 12)


def platform() -> dict:
    import platform as p

    return {"os": p.system().lower(), "arch": p.machine(), "cuda": Path("/proc/driver/nvidia").exists(), "cpus": os.cpu_count() or 1}


def resolve_model(alias: str, store: str) -> Path:
    """Local folder of a model; nothing is downloaded."""
    path = Path(store) / alias
    if not path.exists():
        raise FileNotFoundError(f"no model {alias} in {store}")
    return path


def write_sidecar(folder: str, alias: str, engine: str, dim: int, multilingual: bool | None, created: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "model.json").write_text(json.dumps({"alias": alias, "engine": engine, "dim": dim, "multilingual": multilingual, "created": created}))


def read_sidecar(folder: str) -> dict | None:
    p = Path(folder) / "model.json"
    return json.loads(p.read_text()) if p.exists() else None


def guard(sidecar: dict | None, alias: str, engine: str, dim: int) -> None:
    """A table's vectors and a query's must come from one model and engine."""
    if sidecar and (sidecar["alias"], sidecar["engine"], sidecar["dim"]) != (alias, engine, dim):
        raise ValueError(f"table was built with {sidecar['alias']}/{sidecar['engine']}/{sidecar['dim']}, query uses {alias}/{engine}/{dim}")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray: ...


@dataclass
class HashEmbedder:
    """Deterministic stand-in without weights: hashed words and character trigrams, signed, unit length."""

    dim: int = 64
    query_prompt: str = ""
    document_prompt: str = ""

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray:
        from .functions.words import mix64, word_hashes

        prompt = self.query_prompt if kind == "query" else self.document_prompt
        out = np.zeros((len(texts), self.dim), np.float32)
        full = [prompt + (t or "") for t in texts]
        if any(any(c.isalnum() for c in t) for t in full):
            h, owner = word_hashes(full)
            spread = mix64(h)
            sign = np.where(spread & np.uint64(1), 1.0, -1.0)
            np.add.at(out, (owner, (h % np.uint64(self.dim)).astype(np.int64)), sign)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class OnnxEmbedder:
    """A local ONNX model and tokenizer; mean of the token states, unit length."""

    model: str
    tokenizer: str
    dim: int
    prompts: str | None = None

    def __post_init__(self) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self._session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        self._tokenizer = Tokenizer.from_file(self.tokenizer)
        self._prompts = json.loads(Path(self.prompts).read_text()) if self.prompts else {}

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray:
        codes = self._tokenizer.encode_batch([self._prompts.get(kind, "") + t for t in texts])
        width = max(len(c.ids) for c in codes)
        ids = np.array([c.ids + [0] * (width - len(c.ids)) for c in codes], np.int64)
        mask = np.array([[1] * len(c.ids) + [0] * (width - len(c.ids)) for c in codes], np.int64)
        names = {i.name for i in self._session.get_inputs()}
        feed = {k: v for k, v in {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}.items() if k in names}
        states = self._session.run(None, feed)[0]
        v = states if states.ndim == 2 else (states * mask[:, :, None]).sum(1) / mask.sum(1, keepdims=True)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


_WORD = re.compile(r"\S+")
_SECTION = re.compile(r"(?:\r\n|\n){2,}")


def chunk_spans(doc: str, most: int = 200) -> list[tuple[int, int]]:
    """Where the chunks of a text lie: whole sections packed to at most ``most`` words, longer sections cut."""
    spans: list[tuple[int, int]] = []
    first, end, held, at = 0, 0, 0, 0
    for stop in [*((m.start(), m.end()) for m in _SECTION.finditer(doc)), (len(doc), len(doc))]:
        section, begin, at = doc[at : stop[0]], at, stop[1]
        n = len(section.split())
        if held and held + n > most:
            spans.append((first, end))
            held = 0
        if n > most:
            words = [(begin + m.start(), begin + m.end()) for m in _WORD.finditer(section)]
            cuts = range(0, n - most, most)
            spans += [(words[i][0], words[i + most - 1][1]) for i in cuts]
            rest = len(cuts) * most
            n, start = n - rest, words[rest][0]
        else:
            start = begin + len(section) - len(section.lstrip())
        if n:
            first, end, held = start if not held else first, begin + len(section.rstrip()), held + n
    if held:
        spans.append((first, end))
    return spans


def chunk_text(doc: str, title: str = "", most: int = 200) -> list[str]:
    """Texts of the chunks, the title in front of each."""
    return [f"{title}\n{' '.join(doc[a:b].split())}".strip() for a, b in chunk_spans(doc, most)]


def chunk_embed(make: Callable[[], Embedder], doc: Column, title: Column, most: int = 200) -> Column:
    """Vectors of a document's chunks; null where there is no text.  The model is made once a worker task."""

    @F.pandas_udf("array<array<float>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for docs, titles in batches:
            out = []
            for d, t in zip(docs, titles):
                parts = chunk_text(d, t or "", most) if isinstance(d, str) and d.strip() else []
                out.append([list(map(float, v)) for v in model.embed(parts)] if parts else None)
            yield pd.Series(out)

    return run(doc, title)
