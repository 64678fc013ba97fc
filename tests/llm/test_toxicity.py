import itertools
import random
import zlib

import numpy as np
from cleanloom.llm import toxicity as X


def brute_kernel(a, b):
    """Gap-weighted triples by enumeration, with marks at the ends."""
    feature = {}
    for k, word in enumerate((a, b)):
        w = f"<{word}>"
        for i, j, m in itertools.combinations(range(len(w)), 3):
            if m - i < X.SPAN:
                feature.setdefault(w[i] + w[j] + w[m], [0, 0])[k] += X.DECAY ** (m - i - 2)
    norm = [sum(x[k] ** 2 for x in feature.values()) ** 0.5 for k in (0, 1)]
    return sum(x * y for x, y in feature.values()) / norm[0] / norm[1]


def test_kernel():
    words = ["idiot", "idxiot", "toidi", "aab", "scum", "aaaa", "grobnik", "grobnik" * 8]
    got = X.similarities(words, X.vectors(words))
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert abs(got[i, j] - brute_kernel(words[i], words[j])) < 1e-5
    assert got[0, 1] > 2 * got[0, 2] and np.abs(got).max() <= 1 + 1e-5


def test_screen_loses_nothing_that_counts():
    """Values with the screen and without it: no label of an insult changes, whole or with a letter put in."""
    docs, labels = made()
    model = X.learn([d[1] for d in docs[: len(labels)]], [t for _, _, t in labels])
    words = [w[:k] + c + w[k:] for w in ("numpty", "dimwit", "blockhead") for k in range(1, len(w)) for c in ("", "x", "q", "-")]
    texts = [f"{docs[1][1]} {w} {docs[2][1]}" for w in words] + [d[1] for d in docs[:200]]
    screened = model.score(texts)
    model.least = -np.inf
    whole = model.score(texts)
    lost = ((whole >= 0.5) & (screened < 0.5)).sum()
    assert lost <= 0.01 * len(texts), lost


def test_omissions():
    assert X.omissions("abcd") == ["abcd"] and X.omissions("a") == ["a"] and X.omissions("") == [""]
    assert X.omissions("abcde") == ["abcde", "bcde", "acde", "abde", "abce", "abcd"]
    for word in ("aabbaa", "numpty", "scuummm"):
        want = {word} | {word[:k] + word[k + n :] for n in (1, 2) for k in range(len(word) - n + 1) if len(word) - n >= 4}
        got = X.omissions(word)
        assert set(got) == want and len(got) == len(want)


def test_values_are_the_greatest_of_the_omissions():
    docs, labels = made()
    model = X.learn([d[1] for d in docs[: len(labels)]], [t for _, _, t in labels])
    words = ["numpty", "nuxmpty", "nuxympty", "dimwwit", "scum", "abc", "tharon", "tharon"]
    want = [max(float(model.alone([f])[0]) - X.MISSING * (len(w) - len(f)) for f in X.omissions(w)) for w in words]
    for _ in range(2):  # the second time from what is known
        assert np.allclose(model.valued(words), np.maximum(want, X.FLOOR), atol=1e-6)
    assert len(model.valued([])) == 0


def test_letters_put_into_insults():
    """Any letter at any place, none of them trained with: insults stay flagged, while what is no insult stays clean."""
    docs, labels = made()
    model = X.learn([d[1] for d in docs[: len(labels)]], [t for _, _, t in labels])
    rng = random.Random(5)
    clean = [d[1] for d, (_, _, t) in zip(docs, labels, strict=False) if not t][:60]
    insults = ["numpty", "dimwit", "blockhead"]
    forms = [w[:k] + c + w[k:] for w in insults for k in range(1, len(w)) for c in ("q", "z", "v", "u", "gk")]
    put = lambda word: " ".join([*(t := rng.choice(clean).split())[:20], word, *t[20:]])
    assert (model.score([put(w) for w in forms]) >= 0.5).mean() > 0.9
    # Without as many letters of the insult, or with letters of other words: few are flagged.
    others = ["".join(rng.sample(w, len(w))) for w in insults for _ in range(20)]
    assert (model.score([put(w) for w in others]) >= 0.5).mean() < 0.1
    assert (model.score(clean) >= 0.5).mean() < 0.03


def made(n=900):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    insults = ["numpty", "dimwit", "blockhead"]
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            w[10] = w[25] = rng.choice(insults)
        docs.append((i, " ".join(w), "en", 1.0))
        labels.append((i, 1, int(toxic)))
    docs.append((n, " ".join([*w[:9], "dim-wit", "num.pty", "bl0ckhead"]), "en", 1.0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in X.query(frame, marks).collect()}
    assert len(got) == len(docs)
    right = []
    for i, _, toxic in labels:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["predicted"] == toxic)
    assert np.mean(right) > 0.97 and got[len(labels)]["predicted"] == 1


def test_insults_in_long_words():
    docs, labels = made()
    model = X.learn([d[1] for d in docs[: len(labels)]], [t for _, _, t in labels])
    plain = docs[1][1].split() + docs[2][1].split()
    for sign in ("", ".", "_"):
        clean = sign.join(plain)
        ends = [f"{clean}{sign}numpty {clean}{sign}dimwit", f"{sign.join([*plain, 'numpty', *plain])} {sign.join(['x', *plain, 'blockhead'])}"]
        got = model.score([clean, *ends, " ".join(ends[0].replace(" ", ""))])
        assert got[0] < 0.5 and (got[1:3] > 0.5).all() and got[3] > got[0]
    # Every stretch of as many letters as are learnt lies in a window.
    long = X.Letters(["".join(plain)])
    size = int(long.sizes()[0])
    text = long.strings(np.array([0]))[0]
    seen = [w for part in long.windows(0) for w in part.strings(np.arange(len(part.start)))]
    for k in range(0, size - 39):
        assert any(text[k : k + 40] in w for w in seen)


def test_edges(spark):
    kinds = "doc_id long, text string", "doc_id long, quality int, toxic int"
    empty, none = spark.createDataFrame([], kinds[0]), spark.createDataFrame([], kinds[1])
    assert X.query(empty, none).collect() == []
    odd = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, ""), (3, "x" * 200_000)], kinds[0])
    rows = X.query(odd, none).collect()
    assert len(rows) == 5 and all(0 <= r["score"] < 0.5 for r in rows)
    rows = X.query(odd, spark.createDataFrame([(2, 1, 1), (3, 1, 0)], kinds[1])).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
