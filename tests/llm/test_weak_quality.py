import random

import numpy as np
from cleanloom.llm import weak_quality as Q


def made():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghinoö") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(300):
        w = [word() + "." * (rng.random() < 0.1) for _ in range(rng.randint(40, 150))]
        kind = ("clean", "clean", "clean", "signs", "bars", "stutter", "shout")[i % 7]
        if kind == "signs":
            w = [x + rng.choice(("%%%", "&&&", "***")) for x in w]
        elif kind == "bars":
            w = [y for x in w for y in (x, "|")]
        elif kind == "stutter":
            w = [x for x in w for _ in range(8)]
        elif kind == "shout":
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), kind))
    return rows


def test_posterior_is_that_of_single_documents():
    """EM over counts of vote patterns equals EM over the documents one by one."""
    rng = np.random.default_rng(1)
    each = rng.integers(0, 3, (400, 4))
    patterns, inverse, counts = np.unique(each, axis=0, return_inverse=True, return_counts=True)
    many = Q.estimate(patterns, counts.astype(float))[inverse]
    assert np.allclose(many, Q.estimate(each, np.ones(len(each))), atol=1e-3)


def test_rejects_junk_and_keeps_clean_texts(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, score long, taken string").repartition(3)
    got = {r["doc_id"]: r for r in Q.query(docs).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    kept = [got[i]["kept"] for i, _, k in rows if k == "clean"]
    dropped = [not got[i]["kept"] for i, _, k in rows if k != "clean"]
    assert np.mean(kept) > 0.98 and np.mean(dropped) > 0.95
    out = Q.keep_good(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, r in got.items() if r["kept"]}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.query(empty).collect() == [] and Q.keep_good(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c"), (1, None), (2, " \n"), (3, "x" * 300_000), (3, "x" * 300_000)], "doc_id long, text string")
    got = Q.query(odd).collect()
    assert len(got) == 5 and [r["score"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
