"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled. Its features are the byte n-grams around each of its letters (two to four bytes, so affixes with
the word's ends are among them) and whether it is in a language's lexicon (the words that occur most in that language's
training documents and seldom in others'). Transitions between labels are learnt too, on code-switched sequences put together from
segments of training documents. Forward-backward gives each word's chances; a document's language is the one with the
greatest sum over its words, and its score is that sum's share.

The field is trained on at most about SAMPLE documents a language, taken by hash of doc_id, and on at most SEGMENTS segments of
these; the lexicon is counted on all words of them. Documents are then labelled in whole and
independently, in one pass without a shuffle; the recursions run over many documents at once, longest first.

Defined cases: a null text, or one without letters, is `und` with score 0, as is every text where nothing could be learnt. Words
without letters take part in the chain but not in the sum. Ties go to the first language in alphabetical order. Rows that repeat
are labelled alike. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .words import Words

SAMPLE, FEATURES, LEXICON, SEQUENCE, CHUNK = 200, 1 << 15, 300, 60, 1_000_000
#: Segments of training documents a language that sequences are put together from.
SEGMENTS = 20_000
#: What a byte counts as in n-grams: itself if it is part of a letter, else the mark of a word's end.
_PART = np.full(256, 0x20, np.uint32)
_PART[0x61:0x7B], _PART[0x80:] = np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_has_letter = regex.compile(r"\p{L}").search


class Observed:
    """Words of texts with what the field sees of them. Text i has words first[i]:first[i + 1]."""

    def __init__(self, texts: list[str]) -> None:
        lower = [t.lower().encode() for t in texts]
        self.words = Words(lower)
        self.first = self.words.first
        raw = np.frombuffer(b"  " + b" ".join([*lower, b"  "]), np.uint8)
        part = _PART[raw]
        at = np.flatnonzero(part != 0x20)
        offset = np.repeat(np.cumsum([0, *(len(t) + 1 for t in lower)])[:-1], np.diff(self.first)) + 2
        start = self.words.begin + offset
        self.word = np.searchsorted(start, at, "right") - 1
        before2, before, own, after = part[at - 2], part[at - 1], part[at], part[at + 1]
        before2 = np.where(before == 0x20, 0x20, before2)
        multiply = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)
        two = before << np.uint32(8) | own
        three = two << np.uint32(8) | after
        four = three * np.uint32(0x85EBCA6B) ^ before2
        self.grams = [multiply(two ^ np.uint32(0x51ED270B)), multiply(three), multiply(four)]
        self.edges = np.flatnonzero(np.diff(self.word, prepend=-1))  # where a word's letters begin
        self.lettered = self.word[self.edges]

    def emissions(self, weights: np.ndarray, lexicon: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Scores of each word (row) for each label: weights by n-gram, and member by place in the sorted lexicon."""
        out = np.zeros((len(self.words.hashes), weights.shape[1]), np.float32)
        if len(self.edges):
            each = weights[self.grams[0]]
            for g in self.grams[1:]:
                each += weights[g]
            out[self.lettered] = np.add.reduceat(each, self.edges, 0)
        out += member[self.places(lexicon)]
        return out

    def places(self, lexicon: np.ndarray) -> np.ndarray:
        """Of each word its place in the sorted lexicon, or the place after all."""
        if not len(lexicon):
            return np.zeros(len(self.words.hashes), np.int64)
        at = np.minimum(np.searchsorted(lexicon, self.words.hashes), len(lexicon) - 1)
        return np.where(lexicon[at] == self.words.hashes, at, len(lexicon))


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Chances of each label of each word, by forward-backward over all sequences at once."""
    if not len(scores):
        return scores
    local = np.exp(scores - scores.max(1, keepdims=True))
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    # At step t the sequences of more than t words are the first active[t] ones.
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    forward, backward = np.empty_like(local), np.ones_like(local)
    message = None
    for t, n in enumerate(active.tolist()):
        at = begin[:n] + t
        message = local[at] if t == 0 else (message[:n] @ step) * local[at]
        message = message / message.sum(1, keepdims=True)
        forward[at] = message
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        at = begin[:n] + t
        message = (local[at + 1] * backward[at + 1]) @ step.T
        backward[at] = message / message.sum(1, keepdims=True)
    both = forward * backward
    return both / both.sum(1, keepdims=True)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    transitions: np.ndarray

    def words(self, texts: list[str]) -> tuple[Observed, np.ndarray]:
        seen = Observed(texts)
        return seen, marginals(seen.emissions(self.weights, self.lexicon, self.member), seen.first, self.transitions)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return ["und"] * len(texts), [0.0] * len(texts)
        seen, chance = self.words(texts)
        counted = np.zeros((len(seen.words.hashes) + 1, len(self.labels)))
        counted[seen.lettered] = chance[seen.lettered]
        sums = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(counted, 0)])
        total = sums[seen.first[1:]] - sums[seen.first[:-1]]
        best, names, shares = total.argmax(1), [], []
        for text, row, b in zip(texts, total, best.tolist(), strict=True):
            fine = bool(_has_letter(text))
            names.append(self.labels[b] if fine else "und")
            shares.append(float(np.clip(row[b] / max(row.sum(), 1e-9), 0, 1)) if fine else 0.0)
        return names, shares


def gradient(chance: np.ndarray, first: np.ndarray, transitions: np.ndarray, scores: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood, by words' scores and by transitions; sequences all have the same length."""
    labels = chance.shape[1]
    by_word = -chance
    by_word[np.arange(len(target)), target] += 1
    length = int(first[1])
    shaped, goal = scores.reshape(-1, length, labels), target.reshape(-1, length)
    alpha, beta = np.zeros_like(shaped), np.zeros_like(shaped)
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    alpha[:, 0] = shaped[:, 0]
    for t in range(1, length):
        alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + transitions, 1) + shaped[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = lse(transitions + (shaped[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    all_ways = lse(alpha[:, -1], 1)
    pair = np.exp(alpha[:, :-1, :, None] + transitions + (shaped[:, 1:] + beta[:, 1:])[:, :, None, :] - all_ways[:, None, None, None]).sum((0, 1))
    seen = np.zeros_like(transitions)
    np.add.at(seen, (goal[:, :-1].ravel(), goal[:, 1:].ravel()), 1)
    return by_word, seen - pair


def learn(texts: list[str], langs: list[str], sequences: int = 1500, epochs: int = 3, seed: int = 6, segments: int = SEGMENTS) -> Crf:
    """A field from texts and their languages."""
    labels = sorted(set(langs))
    rng = random.Random(seed)
    pools: dict[int, list[list[str]]] = {k: [] for k in range(len(labels))}
    mentions: dict[str, np.ndarray] = {}
    for text, lang in zip(texts, langs, strict=True):
        w = [x for x in text.split() if _has_letter(x)]
        k = labels.index(lang)
        for x in {x.lower() for x in w}:
            mentions.setdefault(x, np.zeros(len(labels)))[k] += 1
        at = 0
        while at < len(w) and len(pools[k]) < segments:
            n = rng.randint(3, 30)
            pools[k].append(w[at : at + n])
            at += n
    usable = [k for k, p in pools.items() if p]
    if not usable:
        return Crf([], np.empty(0), np.empty(0), np.empty(0), np.empty(0))
    known: dict[str, int] = {}
    for k in range(len(labels)):
        own = [(c[k], w) for w, c in mentions.items() if c[k] > 0.7 * c.sum() and c[k] > 1]
        known.update((w, k) for _, w in sorted(own, key=lambda x: (-x[0], x[1]))[:LEXICON])
    hashes = Words([w.encode() for w in known]).hashes if known else np.empty(0, np.uint64)
    lexicon = np.unique(hashes)
    lines, target = [], []
    for _ in range(sequences):
        w: list[str] = []
        y: list[int] = []
        while len(w) < SEQUENCE:
            k = rng.choice(usable)
            for segment in rng.choices(pools[k], k=rng.randint(1, 3)):
                w += segment
                y += [k] * len(segment)
        lines.append(" ".join(w[:SEQUENCE]))
        target.append(y[:SEQUENCE])
    n = len(labels)
    weights, member, transitions = np.zeros((FEATURES, n), np.float32), np.zeros((len(lexicon) + 1, n), np.float32), np.zeros((n, n))
    grown, grown_member, grown_t = (np.full(x.shape, 1e-2) for x in (weights, member, transitions))
    for epoch in range(epochs):
        order = list(range(sequences))
        rng.shuffle(order)
        for k in range(0, sequences, 50):
            batch = order[k : k + 50]
            seen, goal = Observed([lines[i] for i in batch]), np.array([y for i in batch for y in target[i]])
            scores = seen.emissions(weights, lexicon, member).astype(np.float64)
            chance = marginals(scores.astype(np.float32), seen.first, transitions).astype(np.float64)
            by_word, by_t = gradient(chance, seen.first, transitions, scores, goal)
            own, rate = by_word[seen.word], 0.3 / (1 + epoch)
            g = np.zeros(weights.shape)
            for f in seen.grams:
                for label in range(n):
                    g[:, label] += np.bincount(f, own[:, label], FEATURES)
            m = np.zeros(member.shape)
            np.add.at(m, seen.places(lexicon), by_word)
            m[-1] = 0
            for x, dx, s in ((weights, g, grown), (member, m, grown_member), (transitions, by_t, grown_t)):
                s += dx * dx
                x += (rate * dx / np.sqrt(s)).astype(x.dtype)
    return Crf(labels, weights, lexicon, member, transitions)


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Crf:
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = usable.groupBy("lang").count().collect()  # a row for each language
    draw = F.pmod(F.xxhash64(F.lit(31), F.col("doc_id")), F.lit(1_000_003))
    rate = F.lit(0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], F.lit(int(1_000_003 * min(1.0, sample / r["count"])) + 1)).otherwise(rate)
    rows = usable.filter(draw < rate).select("doc_id", "lang", "text").limit(2 * sample * max(1, len(sizes))).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return learn([r["text"] for r in rows], [r["lang"] for r in rows])


def predictions(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text"), CHUNK):
                names, shares = crf.predict(part)
                columns = [batch.column("doc_id").slice(at, len(part)), pa.array(names, pa.string()), pa.array(shares, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    return predictions(docs, fit(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
