import itertools
import random
import zlib

import numpy as np
from cleanloom.llm import language_crf as L


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    first, t = np.array([0, 3, 3, 4, 8]), rng.standard_normal((3, 3))
    scores = rng.standard_normal((8, 3)).astype(np.float32)
    got = L.marginals(scores, first, t)
    for a, b in zip(first, first[1:], strict=False):
        total = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + k, y[k]] for k in range(b - a)) + sum(t[y[k], y[k + 1]] for k in range(b - a - 1)))
            for k in range(b - a):
                total[k, y[k]] += w
        if b > a:
            assert np.allclose(got[a:b], total / total.sum(1, keepdims=True), atol=1e-5)


def test_gradient_by_difference():
    rng = np.random.default_rng(1)
    scores, t, goal = rng.standard_normal((8, 2)), rng.standard_normal((2, 2)), rng.integers(0, 2, 8)
    first = np.array([0, 4, 8])

    def likelihood(t):
        out = 0.0
        for a in (0, 4):
            way = lambda y: sum(scores[a + k, y[k]] for k in range(4)) + sum(t[y[k], y[k + 1]] for k in range(3))  # noqa: B023, E731
            out += way(goal[a : a + 4]) - np.log(sum(np.exp(way(y)) for y in itertools.product(range(2), repeat=4)))
        return out

    _, by_t = L.gradient(L.marginals(scores.astype(np.float32), first, t), first, t, scores, goal)
    for i, j in itertools.product(range(2), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-5
        assert abs((likelihood(t + d) - likelihood(t - d)) / 2e-5 - by_t[i, j]) < 1e-4


def made():
    rng = random.Random(5)
    parts = {"aa": ["tha", "ing", "er", "sho", "wi"], "bb": ["ßen", "sch", "ü", "keit", "ung"], "cc": ["ción", "os", "ll", "ña", "er"]}
    word = lambda k: "".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(240):
        k = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(word(k) for _ in range(rng.choice((6, 40)))), k, k, 0.0))
    switched = " ".join([word("aa") for _ in range(20)] + [word("bb") for _ in range(12)])
    return rows, switched


def test_held_out_accuracy_and_switching(spark):
    rows, switched = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = {r["doc_id"]: r for r in L.query(docs).collect()}
    assert len(got) == len(rows)
    for i, _, lang, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, *_ in rows if got[i]["held_out"]]) > 0.97
    crf = L.fit(docs)
    _, chance = crf.words([switched])
    labels = [crf.labels[k] for k in chance.argmax(1)]
    assert np.mean([a == b for a, b in zip(labels, ["aa"] * 20 + ["bb"] * 12, strict=True)]) > 0.9
    assert crf.predict([switched])[0] == ["aa"]


def test_edges(spark):
    kind = "doc_id long, text string, lang string"
    assert L.query(spark.createDataFrame([], kind)).collect() == []
    odd = [(None, "a b", "aa"), (1, None, "aa"), (2, "", None), (3, "12 !! 😀", "aa"), (3, "12 !! 😀", "aa"), (4, "x" * 300_000, None), (5, "tha ing", "aa")]
    rows = L.query(spark.createDataFrame(odd, kind)).collect()
    assert len(rows) == 7
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] == "und" for r in L.query(spark.createDataFrame([(1, "abc", None)], kind)).collect())
