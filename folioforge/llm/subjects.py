"""Subject areas by classifier chains over term, source and structure features.

*Terms*: words get a likelihood under every subject and under "no subject" by
expectation maximisation on the sentences of labelled documents (a document's
labels are the prior of its sentences, with room for missing and wrong ones).
A document's term evidence is the share of its subject-bearing sentences, list
items and cells that fall to each subject.  *Source*: the words of the title,
read like a sentence.  *Structure*: the rank of a subject's share and its distance
from the next larger and smaller one, how many sentences bear any subject and how
large a part of the text they are.

The chain asks for the subjects in turn, most frequent first; every classifier
also sees the decisions before it, which is how co-occurrence enters.  The
response to a share is learnt as a step function over even knots, pooled over
subjects.  Hand-made labels are incomplete, so each probability is calibrated by
the rate at which a document's leading subject is among its labels.  Beam search
finds the best combination.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import materialize, pick, spread
from .quality import fold, text_statistics
from .residue import _NAME, _NUMBER, Trusted, _unit_tables, unit_features

BEAM = 6
SHRINK = 4.0
SEPARATORS = ";·•|\t"
_SUSPECT = re.compile("[ÃÂÐ\ufffd\x00-\x08\xad\u200b]")


def _sentences(texts: list[str], tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (numbers and names left out), sentence of each word, text of each sentence; in blocks of texts."""
    words, sentences, owners, before = [], [], [], 0
    for lo in range(0, len(texts), 128):
        part = texts[lo : lo + 128]
        if not any(_has_word(t) for t in part):
            continue
        # a text in capitals has no names to tell; accents do not make another word
        part = [t if t.isascii() else fold(t) for t in (t.lower() if t.isupper() else t for t in part)]
        f = unit_features(part, tables, SEPARATORS, hashes=False, quoted=True)
        sentence = np.repeat(np.arange(f["n"].size, dtype=np.int32), f["n"])
        keep = (f["words"] != _NUMBER) & (f["words"] != _NAME)
        words.append(f["words"][keep])
        sentences.append(sentence[keep] + np.int32(before))
        owners.append((f["owner"] + lo).astype(np.int32))
        before += f["n"].size
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(words), np.concatenate(sentences), np.concatenate(owners)


@dataclass
class Terms:
    """Log-likelihoods of known words under each subject and under none (last column)."""

    words: np.ndarray
    log: np.ndarray  # words x (subjects + 1)
    prior: np.ndarray  # log prior of a sentence

    def posteriors(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.words, words)
        at[at == self.words.size] = 0
        known = self.words[at] == words if self.words.size else np.zeros(words.size, bool)
        at, sentence = at[known], sentence[known]
        score = np.tile(self.prior, (n, 1))
        if at.size:
            first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
            score[sentence[first]] += np.add.reduceat(self.log[at], first, axis=0)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def fit_terms(words: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int = 10) -> Terms:
    """EM on sentences; ``labels`` is documents x subjects (0/1)."""
    k = labels.shape[1]
    vocab, at, count = np.unique(words, return_inverse=True, return_counts=True)
    at = at.astype(np.int32)
    use = count >= 2
    prior = np.full((len(labels), k + 1), 0.02)
    n = np.maximum(labels.sum(axis=1, keepdims=True), 1)
    prior[:, :k] += 0.55 * labels / n
    prior[:, k] = 0.35
    prior /= prior.sum(axis=1, keepdims=True)
    log_prior = np.log(prior)
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    # start: words by the labels of their documents; one subject at a time keeps the working set small
    post = prior[owner]
    log = np.empty((vocab.size, k + 1))
    for _ in range(rounds):
        for c in range(k + 1):
            like = np.bincount(at, weights=post[:, c][sentence], minlength=vocab.size)
            # a word seen a few times says little: every word starts with SHRINK sightings in proportion to the subject's size
            like += SHRINK * max(like.sum() / words.size, 1e-4)
            log[:, c] = np.log(like / like.sum())
        for c in range(k + 1):
            post[:, c] = log_prior[owner, c]
            post[sentence[first], c] += np.add.reduceat(log[:, c][at], first)
        post -= post.max(axis=1, keepdims=True)
        np.exp(post, out=post)
        post /= post.sum(axis=1, keepdims=True)
    share = post.mean(axis=0)
    flat = np.concatenate((np.full(k, share[:k].sum() / k), share[k:]))
    return Terms(vocab[use], log[use].astype(np.float32), np.log(np.maximum(flat, 1e-3)).astype(np.float32))


@dataclass
class Chain:
    terms: Terms
    shared: np.ndarray  # weights common to all subjects
    order: list[int]
    weights: list[np.ndarray]
    carry: np.ndarray  # rate at which a document's leading subject is among its labels

    def probabilities(self, j: int, x: np.ndarray, decided: np.ndarray) -> np.ndarray:
        c = self.order[j]
        z = _pooled(x, c) @ self.shared + np.concatenate((_view(x, c), decided[:, self.order[:j]]), axis=1) @ self.weights[j]
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))) / self.carry[c], 1e-6, 1 - 1e-6)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label combination of every document by beam search along the chain."""
        n, k = len(x), len(self.order)
        state = np.zeros((n, 1, k))
        score = np.zeros((n, 1))
        for j in range(k):
            b = state.shape[1]
            p = self.probabilities(j, np.repeat(x, b, axis=0), state.reshape(n * b, k)).reshape(n, b)
            on = state.copy()
            on[:, :, self.order[j]] = 1
            state, score = np.concatenate((state, on), axis=1), np.concatenate((score + np.log(1 - p), score + np.log(p)), axis=1)
            if score.shape[1] > BEAM:
                top = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
                score = np.take_along_axis(score, top, 1)
                state = np.take_along_axis(state, top[:, :, None], 1)
        return state[np.arange(n), score.argmax(axis=1)] > 0


KNOTS = np.arange(0.05, 0.66, 0.05)


def _pooled(x: np.ndarray, c: int) -> np.ndarray:
    """What holds alike for all subjects: the share over even knots, its rank and its distance from the largest other share."""
    k = (x.shape[1] - 2) // 2
    share = x[:, :k]
    mine = share[:, c]
    others = np.delete(share, c, axis=1) if k > 1 else np.zeros((len(x), 1))
    above = (others > mine[:, None]).sum(axis=1)
    return np.stack([np.ones(len(x)), mine, *(1 / (1 + np.exp(-np.clip((mine - t) * 60, -30, 30))) for t in KNOTS), others.max(axis=1), above == 0, np.minimum(above, 4)], axis=1)


def _view(x: np.ndarray, c: int) -> np.ndarray:
    """What is the subject's own: a level, its title evidence, how many sentences bear a subject and what part of the text they are."""
    k = (x.shape[1] - 2) // 2
    return np.stack([np.ones(len(x)), x[:, k + c], x[:, 2 * k], x[:, 2 * k + 1]], axis=1)


def features(terms: Terms, texts: list[str], titles: list[str], tables) -> np.ndarray:
    """Documents x (shares, title evidence, log number of subject-bearing sentences, their share)."""
    k = terms.log.shape[1] - 1
    n = len(texts)
    x = np.zeros((n, 2 * k + 2))
    for part, values in enumerate((texts, titles)):
        if not any(_has_word(t) for t in values):
            continue
        # the words of a title are not names because they are written large
        words, sentence, owner = _sentences(values if part == 0 else [(t or "").lower() for t in values], tables)
        p = terms.posteriors(words, sentence, owner.size)
        # a sentence, item or cell belongs to a subject only where that outweighs all else together
        sure = p >= 0.5
        subject = np.stack([np.bincount(owner, weights=sure[:, c], minlength=n) for c in range(k)], axis=1)
        total = subject.sum(axis=1)
        if part == 0:
            sentences = np.bincount(owner, minlength=n)
            x[:, :k] = subject / np.maximum(total, 0.5)[:, None]
            x[:, 2 * k] = np.log1p(total)
            x[:, 2 * k + 1] = total / np.maximum(sentences, 1)
        else:
            x[:, k : 2 * k] = subject
    return x


def _has_word(t: str | None) -> bool:
    return bool(t) and any(c.isalnum() for c in t)


def _logistic(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps; ``offset`` is a known part of the logit."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        g = x.T @ (y - p) - penalty @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(texts: list[str], titles: list[str], labels: np.ndarray) -> Chain:
    """Fit terms and chain on labelled documents (deterministic)."""
    tables = _unit_tables()
    words, sentence, owner = _sentences(texts, tables)
    terms = fit_terms(words, sentence, owner, labels)
    x = features(terms, texts, titles, tables)
    k = labels.shape[1]
    # labels made by hand are incomplete and sometimes wrong: a label counts, and so does its lack where the text shows little of the subject
    order = np.argsort(-labels.sum(axis=0), kind="stable").tolist()
    weights, carry = [], np.ones(k)
    shared = _logistic(np.concatenate([_pooled(x, c) for c in range(k)]), labels.T.ravel(), ridge=0.1)
    plain = (x[:, :k] > 0) & (x[:, :k] == x[:, :k].max(axis=1, keepdims=True))
    whole = (labels[plain].sum() + 3) / (plain.sum() + 4)
    for j, c in enumerate(order):
        rate = (labels[plain[:, c], c].sum() + 10 * whole) / (plain[:, c].sum() + 10)
        carry[c] = min(1.0, max(0.3, rate))
        view = np.concatenate((_view(x, c), labels[:, order[:j]]), axis=1)
        weights.append(_logistic(view, labels[:, c], _pooled(x, c) @ shared, ridge=3.0))
    return Chain(terms, shared, order, weights, carry)


def _reads_as_prose(text: str) -> bool:
    """A cheap sufficient test: enough common words, clean encoding, little repetition."""
    low = text.lower()
    common = low.count(" the ") + low.count(" of ") + low.count(" a ") + low.count(" and ") + low.count(" in ") + low.count(" was ")
    if common * 90 < len(text):
        return False
    if not text.isascii() and _SUSPECT.search(text):
        return False
    words = low.split()
    return len(set(words)) * 4 > len(words)


def _usable(texts: list[str], trusted: Trusted) -> list[str]:
    """The texts without their residue units, whatever their length; empty for junk."""
    out = []
    for text in trusted.without(texts):
        if not _reads_as_prose(text):
            s = text_statistics(text)
            if s["junk_share"] >= 0.5 or s["symbol_ratio"] >= 0.25 or s["broken_share"] >= 0.03 or s["odd_word_share"] >= 0.25 or s["repeat_share"] >= 0.7:
                text = ""
        out.append(text)
    return out


def assign(docs: DataFrame, labels: DataFrame, subjects: list[str], id_col: str, text_col: str, title_col: str, max_labelled: int = 20_000, max_labelled_bytes: int = 64 << 20) -> DataFrame:
    """``(id, subject)`` of every document.

    ``labels(id, subject)`` are hand-made; the chain is fitted on at most
    ``max_labelled`` labelled documents of together ``max_labelled_bytes``, taken
    in hash order, none longer than a 64th of that (the only bounds: every
    document is classified, whole).  Null, empty, blank, junk and
    residue-only texts, and null ids, have no subject; null titles count as
    empty; an id with several texts has the subjects of each; repeated rows and
    labels count once; unknown subjects in ``labels`` are ignored; without any
    usable label the result is empty; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "id long, subject string"
    rows = pick(docs, id=id_col, text=text_col, title=title_col).withColumn("title", F.coalesce("title", F.lit("")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    wanted = pick(labels, id="id", subject="subject").filter(F.col("subject").isin(subjects)).groupBy("id").agg(F.collect_set("subject").alias("labels"))
    wanted = wanted.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    held = rows.filter(F.octet_length("text") <= max_labelled_bytes // 64).join(F.broadcast(wanted), "id").groupBy("id", "labels").agg(F.min(F.struct("text", "title")).alias("t"))
    held = materialize(held.select("id", "labels", "t.text", "t.title", F.octet_length("t.text").alias("size")))
    # at most max_labelled short rows in one window
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id"))
    chosen = held.select("id", "size").withColumn("upto", upto).filter(F.col("upto") <= max_labelled_bytes).select("id")
    sample = held.join(F.broadcast(chosen), "id").orderBy("id").toArrow()
    texts = _usable(sample.column("text").to_pylist(), Trusted())
    keep = [i for i, t in enumerate(texts) if _has_word(t)]
    if not keep:
        return spark.createDataFrame([], schema)
    place = {s: i for i, s in enumerate(subjects)}
    y = np.zeros((len(keep), len(subjects)))
    given, titles = sample.column("labels").to_pylist(), sample.column("title").to_pylist()
    for r, i in enumerate(keep):
        y[r, [place[s] for s in given[i]]] = 1
    chain = fit_chain([texts[i] for i in keep], [titles[i] for i in keep], y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, trusted = _unit_tables(), Trusted()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 128):
                use = _usable(batch.column(1).slice(lo, 128).to_pylist(), trusted)
                at = [i for i, t in enumerate(use) if _has_word(t)]
                if not at:
                    continue
                title = batch.column(2).slice(lo, 128).to_pylist()
                x = features(chain.terms, [use[i] for i in at], [title[i] for i in at], tables)
                d, c = np.nonzero(chain.decode(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + np.array(at)[d]], pa.int64()), pa.array([subjects[j] for j in c], pa.string())], ["id", "subject"])

    return spread(rows).mapInArrow(run, schema).distinct()
