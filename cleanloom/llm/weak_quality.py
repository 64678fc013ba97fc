"""Quality classifier from weak labels.

Ten heuristic labellers vote good, bad or nothing on every document. How often each combination of votes occurs is counted
over all documents (at most 3**10 rows reach the driver, whatever the input's size), and expectation-maximisation estimates
from those counts each labeller's chances to vote so on good and on bad documents, and the share of good ones. The
posterior of a document's votes is its weak label. A linear scorer over hashed features (classes of four
consecutive bytes, and bucketed statistics) learns the weak labels of a bounded sample, SAMPLE documents by hash of doc_id,
and scores every document; those under THRESHOLD are rejected. No human label is used.

Defined cases: a null or empty text, or one without words, has score 0 and is rejected. Rows that repeat are scored alike. If
all documents get the same weak label, the scorer learns that. Empty tables give empty results. Other columns are ignored
by `scores` and kept by `keep_good`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, give_back
from .words import Words

LABELLERS, DIMENSIONS, SAMPLE, THRESHOLD = 10, 1024, 4000, 0.5
BAD, GOOD, NOTHING = 0, 1, 2
#: Prior votes for bad and for good by class, as shares of all documents: labellers seldom err on good documents.
GOOD_PRIOR, BAD_PRIOR = (0.01, 0.99), (0.05, 0.05)

#: Classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 sentence sign, 5 other sign, 6 bar and bracket, 7 beyond ASCII.
_CLASS = np.full(256, 5, np.int64)
_CLASS[list(range(0x61, 0x7B))], _CLASS[list(range(0x41, 0x5B))], _CLASS[list(range(0x30, 0x3A))] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]], _CLASS[list(b".,;:'\"-()?")], _CLASS[list(b"|[]{}<>=\\/_~^")], _CLASS[0x80:] = 3, 4, 6, 7
_GRAM = (np.arange(4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64) % DIMENSIONS
_sentences = re.compile(r"[.!?\n]+").split


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NOTHING


def statistics(text: str, raw: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[str, float]:
    """What labellers look at. raw: the bytes; hashes, begin, end: of the words."""
    count = np.bincount(_CLASS[raw], minlength=8).tolist()
    n, letters = max(1, len(raw)), count[0] + count[1] + count[7]
    seen = [p for s in _sentences(text) if (p := s.strip())]
    words = len(hashes)
    return {
        "words": words,
        "parts": len(seen),
        "letters": (letters + count[2]) / max(1, n - count[3]),
        "signs": count[5] / max(1, words),
        "upper": count[1] / max(1, count[0] + count[1]),
        "exclaims": text.count("!") / max(1, words),
        "lone": int((_CLASS[raw[begin[end - begin == 1]]] > 3).sum()) / max(1, words),
        "bars": count[6] / max(1, words),
        "distinct": len(np.unique(hashes)) / max(1, words) ** 0.75,
        "stuttered": int((hashes[1:] == hashes[:-1]).sum()) / max(1, words),
        "repeated": 1 - len(set(seen)) / max(1, len(seen)),
        "length": (n - count[3]) / max(1, words),
        "digits": count[2] / n,
    }


def votes(s: dict[str, float]) -> list[int]:
    long, words = s["words"] >= 30, s["words"] > 0
    return [
        _vote(not words or long and s["letters"] < 0.9, s["letters"] > 0.93),
        _vote(s["signs"] > 0.3, words and s["signs"] < 0.1),
        _vote(long and s["upper"] > 0.3, words and s["upper"] < 0.15),
        _vote(s["exclaims"] > 0.3, words and s["exclaims"] < 0.1),
        _vote(s["bars"] > 0.2, words and s["bars"] < 0.05),
        _vote(long and s["distinct"] < 0.6, long and s["distinct"] > 1.2),
        _vote(long and s["stuttered"] > 0.25, long and s["stuttered"] < 0.1),
        _vote(s["parts"] >= 6 and s["repeated"] > 0.4, s["parts"] >= 6 and s["repeated"] < 0.2),
        _vote(not words or s["length"] > 16 and long, 3 < s["length"] < 12),
        _vote(long and s["lone"] > 0.15, words and s["lone"] < 0.05),
    ]


def features(s: dict[str, float], raw: np.ndarray) -> np.ndarray:
    out = np.zeros(DIMENSIONS, np.float32)
    if len(raw) > 3:
        c = _CLASS[raw]
        code = ((c[:-3] * 8 + c[1:-2]) * 8 + c[2:-1]) * 8 + c[3:]
        out += np.sqrt(np.bincount(_GRAM[code], minlength=DIMENSIONS) / len(code))
    for name, value in s.items():
        step = int(np.log2(1 + value)) if name in ("words", "parts") else min(30, int(value * 10))
        out[zlib.crc32(f"{name}={step}".encode()) % DIMENSIONS] += 0.3
    return out


def _seen(texts: list[str]) -> Iterator[tuple[dict[str, float], np.ndarray]]:
    encoded = [t.encode() for t in texts]
    words = Words(encoded)
    for i, (text, raw) in enumerate(zip(texts, encoded, strict=True)):
        raw = np.frombuffer(raw, np.uint8)
        own = slice(words.first[i], words.first[i + 1])
        yield statistics(text, raw, words.hashes[own], words.begin[own], words.end[own]), raw


def _code(v: list[int]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior chance to be good of each vote pattern (rows of BAD, GOOD, NOTHING), by expectation-maximisation.

    A labeller that is silent says nothing. It starts from documents with no vote for bad as good ones, which is also what tells
    the classes apart: labellers are written to vote bad rarely on good documents, and bad ones differ in what betrays them.
    """
    p = np.where((patterns == BAD).any(1), 0.1, 0.95)
    shown = np.stack([patterns == v for v in (BAD, GOOD)], 2).astype(float)  # pattern, labeller, vote
    for _ in range(rounds):
        chance, total = [], []
        for weight, prior in ((counts * (1 - p), BAD_PRIOR), (counts * p, GOOD_PRIOR)):
            table = np.einsum("p,plv->lv", weight, shown) + 1.0 + counts.sum() * np.array(prior)
            chance.append(np.log(table / table.sum(1, keepdims=True)))
            total.append(weight.sum() + 1.0)
        logs = [np.einsum("plv,lv->p", shown, c) + np.log(t / sum(total)) for c, t in zip(chance, total, strict=True)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent with momentum; classes weigh the same."""
    weight = np.where(y > 0.5, 0.5 / max(1.0, (y > 0.5).sum()), 0.5 / max(1.0, (y <= 0.5).sum()))
    x, y, weight = x.astype(np.float32), y.astype(np.float32), weight.astype(np.float32)
    w, b, v, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    rate = np.float32(4.0 / ((x**2).sum(1).max() + 1))
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        v = 0.9 * v - rate * (x.T @ error + ridge * w)
        vb = 0.9 * vb - float(rate) * float(error.sum())
        w, b = w + v, b + vb
    return w, b


@dataclass
class Model:
    posterior: dict[int, float]
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> tuple[list[float], list[float]]:
        """Weak labels and scores."""
        weak, out = [], []
        for s, raw in _seen(texts):
            weak.append(self.posterior.get(_code(votes(s)), 0.5))
            z = float(features(s, raw) @ self.weights + self.bias)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if s["words"] else 0.0)
        return weak, out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    rows = docs.count()
    taken = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample / max(1, rows))) + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rows, at = [], [], 0
            chosen = batch.column("taken").to_pylist()
            for part in chunks(batch.column("text")):
                for s, raw in _seen(part):
                    codes.append(_code(votes(s)))
                    rows.append(features(s, raw).astype("<f4").tobytes() if chosen[at] and s["words"] else None)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(rows, pa.binary())], ["code", "features"])

    table = cut(docs.select("text", taken.alias("taken")).mapInArrow(run, "code int, features binary"), "quality-votes")
    counted = table.groupBy("code").count().collect()  # 3**LABELLERS rows at most
    if not counted:
        return Model({}, np.zeros(DIMENSIONS), 0.0)
    codes, counts = np.array([r["code"] for r in counted]), np.array([r["count"] for r in counted], float)
    patterns = codes[:, None] // 3 ** np.arange(LABELLERS) % 3
    posterior = dict(zip(codes.tolist(), estimate(patterns, counts).tolist(), strict=True))
    learnt = table.filter(F.col("features").isNotNull()).limit(2 * sample).collect()  # expected to be `sample` rows
    if not learnt:
        return Model(posterior, np.zeros(DIMENSIONS), 0.0)
    x = np.stack([np.frombuffer(r["features"], "<f4") for r in learnt])
    return Model(posterior, *fit_linear(x, np.array([posterior[r["code"]] for r in learnt])))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, weak_label, score and kept of each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak, score = [], []
            for part in chunks(batch.column("text")):
                a, b = model.score(part)
                weak += a
                score += b
            columns = [pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= THRESHOLD for s in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "weak_label", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    model = model or fit(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [s >= THRESHOLD for part in chunks(batch.column("text")) for s in model.score(part)[1]]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return scores(docs, fit(docs))
