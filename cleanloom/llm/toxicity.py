"""Toxicity by a subsequence string kernel, a Nyström map and a linear support vector machine.

The string kernel compares words, with marks at both ends, by the ordered triples of letters that they share, with gaps: triples
that span up to SPAN letters count DECAY for each letter skipped. Digits and signs written for letters are these letters, and
other signs are skipped, so `1diot` and `id-iot` are `idiot`. A letter put in makes a word's vector longer than one inserted letter
should (`idxiot` has half as many triples again), so a word is a bag of its own forms, as a document is of words: it is worth the
greatest value of the word and, less MISSING a letter, of what is left when a stretch of up to OMIT letters is left out.
Normalised to S it enters the machine's kernel exp((S - 1) / WIDTH). Landmarks are words that tell toxic from other training
documents, and frequent other words. The Nyström map takes a word to its kernel values with the landmarks, whitened; a linear
SVM on these separates insults from other words. Labelled sentences have their document's label only, so training is by
multiple instances: a toxic document's evidence is its highest-scoring word, another document's are all its words, above all
its highest-scoring ones; the choice and the machine are improved in turn. Soft sums of a document's TOP highest values are calibrated to a
probability on the training documents.

Every word of every text is screened first: a linear machine on the string kernel itself, whose feature space is finite, folds
into one weight for each triple, so that table lookups score all words of a text; only words above its threshold, which
nearly all signs of toxicity pass, are valued by the full machine. A word of more than WHOLE letters (a sentence joined by
signs or letter by letter, or script without spaces) is screened and valued in overlapping windows of several sizes that cover
all of it, each like a word of its own; the greatest value is the word's. The model is fitted on at most about SAMPLE labelled documents
a class, taken by hash.

Defined cases: a null or empty text, or one without letters, scores what a document without insults does. Rows that repeat are
scored alike. Without training documents of both classes every score is the share of toxic ones (0 if there are none). Empty tables
give empty results. Extra columns are ignored; labels that are null are not learnt from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

SAMPLE, SPAN, DECAY, WIDTH, TOP = 2000, 6, 0.6, 0.2, 8
#: Letters that may be left out of a word to find an insult in it, what must be left, and what each of them costs.
OMIT, SHORTEST, MISSING = 2, 4, 0.3
#: The value of a word that resembles no sign of toxicity.
FLOOR = -1.2
#: 26 letters, 10 classes of letters beyond ASCII, and the marks at a word's ends.
LETTERS, OPEN, CLOSE = 38, 36, 37
LANDMARKS, OTHERS = 80, 40
_SKIPPED, _SPACE = 30, 31
#: What a byte stands for: letters of either case, digits and signs written for letters, space; other ASCII and the first
#: bytes of longer characters are skipped, their other bytes are 26 to 35.
_CODE = np.full(256, _SKIPPED, np.int64)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(26)
_CODE[0x80:0xC0] = 26 + np.arange(64) % 10
for _sign, _letter in zip("013457@", "oieasta", strict=True):
    _CODE[ord(_sign)] = ord(_letter) - 97
_CODE[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: Longer words are valued in windows (letters, step): each stretch of up to 40 letters, the most that are learnt, lies in one.
WHOLE = 40
WINDOWS = ((6, 1), (9, 1), (13, 2), (20, 4), (30, 6), (48, 9))
WINDOWS_AT_ONCE = 8192
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


class Letters:
    """The words of texts as codes: word k has codes[start[k]:start[k + 1]]; text i has the words of owner i."""

    def __init__(self, texts: list[str]) -> None:
        encoded = [t.encode() for t in texts]
        raw = _CODE[np.frombuffer(b" ".join([*encoded, b""]) or b" ", np.uint8)]
        base = np.cumsum([len(t) + 1 for t in encoded])
        kept = np.flatnonzero(raw != _SKIPPED)
        raw = raw[kept]
        space = raw == _SPACE
        text = np.searchsorted(base, kept[~space], "right")
        word = np.cumsum(space)[~space]
        self.codes = raw[~space]
        fresh = np.diff(word, prepend=-1) != 0
        # Letters set apart by spaces are one word.
        start = np.flatnonzero(fresh)
        single = np.diff(start, append=len(self.codes)) == 1
        if len(start) > 1:
            merge = single[1:] & single[:-1] & (text[start[1:]] == text[start[:-1]])
            start = start[np.concatenate([[True], ~merge])]
        self.owner = text[start]
        n = len(start)
        # Put the marks at both ends of each word.
        word = np.zeros(len(self.codes), np.int64)
        word[start[1:]] = 1
        word = np.cumsum(word)
        at = np.arange(len(self.codes)) + 2 * word + 1
        marked = np.full(len(self.codes) + 2 * n, CLOSE)
        marked[at] = self.codes
        self.start = start + 2 * np.arange(n)
        marked[self.start] = OPEN
        self.codes = marked
        self.word = np.repeat(np.arange(n), np.diff(self.start, append=len(marked)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Letters:
        """Words of one length as rows of codes."""
        out = cls.__new__(cls)
        marked = np.pad(rows, ((0, 0), (1, 1)))
        marked[:, 0], marked[:, -1] = OPEN, CLOSE
        out.codes, out.start = marked.ravel(), np.arange(len(rows)) * marked.shape[1]
        out.word = np.repeat(np.arange(len(rows)), marked.shape[1])
        return out

    def sizes(self) -> np.ndarray:
        return np.diff(self.start, append=len(self.codes)) - 2

    def windows(self, k: int) -> Iterator[Letters]:
        """The windows of word k, so many at once that memory is bounded; the last one of each size ends with the word."""
        codes = self.codes[self.start[k] + 1 : self.start[k + 1] - 1 if k + 1 < len(self.start) else -1]
        for size, step in WINDOWS:
            size = min(size, len(codes))
            last = len(codes) - size
            at = np.append(np.arange(0, last, step), last)
            for i in range(0, len(at), WINDOWS_AT_ONCE):
                yield Letters.of(sliding_window_view(codes, size)[at[i : i + WINDOWS_AT_ONCE]])

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each pair of gaps: where triples begin, their codes, and their weight."""
        c = self.codes
        for a, b in GAPS:
            if len(c) > a + b:
                at = np.flatnonzero(self.word[: -a - b] == self.word[a + b :])
                yield at, (c[at] * LETTERS + c[at + a]) * LETTERS + c[at + a + b], DECAY ** (a + b - 2)

    def strings(self, which: np.ndarray) -> list[str]:
        """The letters of words, one character for each code."""
        signs = np.frombuffer(_SIGNS, np.uint8)
        ends = np.append(self.start, len(self.codes))
        return [signs[self.codes[self.start[k] + 1 : ends[k + 1] - 1]].tobytes().decode() for k in which.tolist()]

    def sums(self, each: np.ndarray) -> np.ndarray:
        return np.add.reduceat(each, self.start) if len(self.start) else np.empty(0)

    def screened(self, table: np.ndarray) -> np.ndarray:
        """Of each word, the inner product of its feature vector with the table, over a bound of the vector's length from below.

        (Each triple's weights are squared one by one.) So the screen's value is no nearer to 0 than that of the normalised vector.
        """
        value, norm = np.zeros(len(self.codes), np.float32), np.zeros(len(self.codes), np.float32)
        for at, triple, weight in self.triples():
            value[at] += table[triple] * np.float32(weight)
            norm[at] += np.float32(weight * weight)
        return self.sums(value) / np.sqrt(np.maximum(self.sums(norm), 1.0))


_SIGNS = b"abcdefghijklmnopqrstuvwxyz0123456789"


def similarities(words: list[str], base: np.ndarray) -> np.ndarray:
    """The string kernel of words (rows) with the feature vectors that are base's columns."""
    code = {c: i for i, c in enumerate(_SIGNS.decode())}
    letters = Letters.__new__(Letters)
    sizes = np.array([len(w) + 2 for w in words])
    letters.codes = np.array([x for w in words for x in (OPEN, *map(code.__getitem__, w), CLOSE)], np.int64)
    letters.start = np.cumsum(sizes) - sizes
    letters.word = np.repeat(np.arange(len(words)), sizes)
    value, keys, weights = np.zeros((len(letters.codes), base.shape[1]), np.float32), [], []
    for at, triple, weight in letters.triples():
        value[at] += base[triple] * np.float32(weight)
        keys.append(letters.word[at] * LETTERS**3 + triple)
        weights.append(np.full(len(at), weight))
    # The length of a word's vector: triples that occur more than once are summed before they are squared.
    key, place = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_inverse=True)
    total = np.bincount(place, np.concatenate(weights or [np.empty(0)]), len(key))
    length = np.sqrt(np.bincount(key // LETTERS**3, total**2, len(words)))
    return np.add.reduceat(value, letters.start, 0) / np.where(length > 0, length, 1.0)[:, None]


def vectors(words: list[str]) -> np.ndarray:
    """Normalised feature vectors of some words, a column for each."""
    out = np.zeros((LETTERS**3, len(words)), np.float32)
    code = {c: i for i, c in enumerate(_SIGNS.decode())}
    for k, word in enumerate(words):
        c = np.array([OPEN, *(code[x] for x in word), CLOSE])
        for a, b in GAPS:
            if len(c) > a + b:
                np.add.at(out[:, k], (c[: -a - b] * LETTERS + c[a : len(c) - b]) * LETTERS + c[a + b :], DECAY ** (a + b - 2))
        out[:, k] /= np.linalg.norm(out[:, k]) or 1.0
    return out


def omissions(word: str) -> list[str]:
    """The word, and what is left of it without each stretch of up to OMIT letters: at least SHORTEST letters."""
    sizes = range(1, min(OMIT, len(word) - SHORTEST) + 1)
    return list(dict.fromkeys([word, *(word[:k] + word[k + n :] for n in sizes for k in range(len(word) - n + 1))]))


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss; y is 1 or -1, and classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b, v, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 2.0 / ((x**2).sum(1).max() + 1 + ridge)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * y * weight
        v = 0.9 * v + rate * (2 * (x.T @ slack) - ridge * w)
        vb = 0.9 * vb + rate * 2 * slack.sum()
        w, b = w + v, b + vb
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression of y on the columns of z, by Newton's method; toxic documents weigh a third in all."""
    weight = np.where(y > 0, 1 / 3 / max(1, (y > 0).sum()), 2 / 3 / max(1, (y <= 0).sum()))
    design, beta = np.column_stack([z, np.ones(len(z))]), np.zeros(z.shape[1] + 1)
    ridge = np.diag([1e-3] * z.shape[1] + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design.T * (weight * p * (1 - p))) @ design + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1], float(beta[-1])


@dataclass
class Model:
    landmarks: list[str]
    screen: np.ndarray  # a weight for each triple
    least: float  # what a word must reach on the screen
    machine: np.ndarray  # from kernel values to the machine's value
    bias: float
    slopes: np.ndarray
    shift: float

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}
        self.base: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "base": None}

    def alone(self, strings: list[str]) -> np.ndarray:
        """The machine's values of words as they stand."""
        if self.base is None:
            self.base = vectors(self.landmarks)
        value = [np.exp((similarities(strings[k : k + 500], self.base) - 1) / WIDTH) @ self.machine + self.bias for k in range(0, len(strings), 500)]
        return np.maximum(np.concatenate([*value, np.empty(0)]), FLOOR)

    def valued(self, strings: list[str]) -> np.ndarray:
        """The machine's values of words: of each the greatest of its own and, less MISSING a letter, those of what omissions leave."""
        if len(self.known) > 200_000:
            self.known.clear()
        new = [w for w in dict.fromkeys(strings) if w not in self.known]
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            forms = [omissions(w) for w in part]
            size = np.array([len(f) for f in forms])
            flat = [w for form in forms for w in form]
            lost = np.repeat([len(w) for w in part], size) - [len(w) for w in flat]
            distinct = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            value = self.alone(list(distinct))[[distinct[w] for w in flat]] - MISSING * lost
            best = np.maximum.reduceat(value, np.cumsum(size) - size)
            self.known.update(zip(part, np.maximum(best, FLOOR).tolist(), strict=True))
        return np.array([self.known[w] for w in strings])

    def passed(self, letters: Letters) -> np.ndarray:
        return letters.screened(self.screen) >= self.least

    def words(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The words that pass the screen: their texts, letters (of long ones the window of the greatest value) and values."""
        letters = Letters(texts)
        long = letters.sizes() > WHOLE
        which = np.flatnonzero(self.passed(letters) & ~long)
        strings = letters.strings(which)
        owner, value = letters.owner[which].tolist(), self.valued(strings).tolist()
        for k in np.flatnonzero(long).tolist():
            best: list[tuple[float, str]] = []
            for part in letters.windows(k):
                found = list(dict.fromkeys(part.strings(np.flatnonzero(self.passed(part)))))
                best = sorted([*best, *zip(self.valued(found).tolist(), found, strict=True)])[-1:]
            for v, word in best:
                owner.append(int(letters.owner[k]))
                strings.append(word)
                value.append(v)
        return np.array(owner, np.int64), strings, np.array(value, np.float64)

    def raw(self, texts: list[str]) -> np.ndarray:
        """Of each text the greatest value of its words, and the soft sums of the TOP greatest ones at two sharpnesses."""
        z = np.full((len(texts), TOP), FLOOR)
        if self.landmarks:
            owner, _, value = self.words(texts)
            order = np.lexsort((-value, owner))
            owner, value = owner[order], value[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            z[owner[place < TOP], place[place < TOP]] = value[place < TOP]
        return np.stack([z[:, 0], *(z[:, 0] + np.log(np.exp(k * (z - z[:, :1])).sum(1)) / k for k in (2.0, 6.0))], 1)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) @ self.slopes + self.shift, -30, 30)))


def _constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model([], np.empty(0), 0.0, np.empty(0), 0.0, np.zeros(3), float(np.log(share / (1 - share))))


def learn(texts: list[str], toxic: list[int], turns: int = 2) -> Model:
    """A model from texts and their labels."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.0)
    bags: list[set[str]] = [set() for _ in texts]
    for k in range(0, len(texts), 200):
        letters = Letters(texts[k : k + 200])
        for owner, word in zip(letters.owner.tolist(), letters.strings(np.arange(len(letters.start))), strict=True):
            if 3 <= len(word) <= 40:
                bags[k + owner].add(word)
    counts = [Counter(w for bag, t in zip(bags, toxic, strict=True) if t == c for w in bag) for c in (0, 1)]
    n0, n1 = (y == 0).sum(), (y == 1).sum()

    def strength(word: str) -> float:
        """How far the word's rates in the two classes differ, in standard errors."""
        a, b = counts[1][word] / n1, counts[0][word] / n0
        mean = (counts[1][word] + counts[0][word] + 1) / (n0 + n1 + 2)
        return (a - b) / np.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1))

    # Signs of toxicity: the word is much commoner in toxic documents, and more so than chance allows.
    of = {w: strength(w) for w, n in counts[1].items() if n >= 3 and n / n1 > 3 * counts[0][w] / n0}
    best = sorted((w for w in of if of[w] > 3.5), key=lambda w: (-of[w], w))[:LANDMARKS] or sorted(of, key=lambda w: (-of[w], w))[:1]
    if not best:
        return _constant(float(y.mean()))
    frequent = [w for w, _ in sorted(counts[0].items(), key=lambda x: (-x[1], x[0])) if w not in set(best)][:1500]
    landmarks = best + frequent[:OTHERS]
    base = vectors(landmarks)

    def nystrom(kernel) -> tuple:
        value, vector = np.linalg.eigh(kernel(similarities(landmarks, base)).astype(np.float64))
        fine = value > 1e-4 * value.max()
        whiten = vector[:, fine] / np.sqrt(value[fine])
        return whiten, lambda words: np.concatenate([kernel(similarities(words[k : k + 500], base)) @ whiten for k in range(0, len(words), 500)])

    chosen = set(best)
    positive = [w for bag, t in zip(bags, toxic, strict=True) if t for w in sorted(bag & chosen, key=lambda w: -of[w])[:5]]
    # Insults with a letter put in, each as often as three documents' worth, so that the machine keeps room for them.
    inserted = [w[:k] + c + w[k:] for w in best for k, c in ((len(w) // 2, "x"), (len(w) // 3 + 1, w[0]), (2 * len(w) // 3, "e"))]
    positive += inserted
    signs = [1] * len(positive)
    whiten, mapped = nystrom(lambda s: s)
    x = mapped(positive + frequent)
    w, _ = svm(x, np.array(signs + [-1] * len(frequent)))
    screen = (base @ (whiten @ w)).astype(np.float32)
    least = float(np.quantile(x[: len(positive)] @ w, 0.02)) * 0.6
    whiten, mapped = nystrom(lambda s: np.exp((s - 1) / WIDTH))
    negative = frequent
    for turn in range(turns):
        w, b = svm(mapped(positive + negative), np.array([1] * len(positive) + [-1] * len(negative)))
        model = Model(landmarks, screen, least, whiten @ w, float(b), np.zeros(3), 0.0)
        if turn + 1 < turns:
            found: list[list[tuple[float, str]]] = [[] for _ in texts]
            for k in range(0, len(texts), 200):
                for i, word, v in zip(*(list(c) for c in model.words(texts[k : k + 200])), strict=True):
                    found[k + i].append((float(v), word))
            # Highest words, each as often as documents have it.
            positive = [w for own, t in zip(found, toxic, strict=True) if t for v, w in sorted(set(own))[::-1][:5] if v > -0.5] or positive
            positive += inserted
            negative = frequent + [w for own, t in zip(found, toxic, strict=True) if not t for v, w in sorted(set(own))[::-1][:2]]
    z = np.concatenate([model.raw(texts[k : k + 200]) for k in range(0, len(texts), 200)])
    model.slopes, model.shift = calibrate(z, y)
    return model


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learnt from at most about `sample` labelled documents of each class, taken by hash, none of them held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(23), F.col("doc_id")), F.lit(1_000_003))
    parts = [usable.filter((F.col("toxic") == c) & (draw < int(1_000_003 * min(1.0, sample / n)) + 1)).limit(2 * sample) for c, n in sorted(sizes.items())]
    if not parts:
        return learn([], [])
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # A row for each doc_id and label: 4 * sample rows at most, also where rows repeat.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy("doc_id", "toxic").collect()
    return learn([r["text"] or "" for r in rows], [r["toxic"] for r in rows])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(part) for part in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
