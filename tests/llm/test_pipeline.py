import random

import corpus_pipeline as P
from cleanloom.llm import minhash_bayes, weak_quality
from cleanloom.llm.common import cut, keyed_rows

from .test_minhash_bayes import brute as near_brute
from .test_suffix_dedup import brute as passage_brute
from .test_suffix_dedup import words


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghinoö") for _ in range(rng.randint(2, 8)))
    passage = [word() for _ in range(70)]
    texts = []
    for i in range(80):
        w = [word() + "." * (rng.random() < 0.1) for _ in range(rng.randint(60, 150))]
        if i % 9 == 0:
            w[30:30] = passage
        if i % 8 == 1:
            w = [x + "%%%" for x in w]
        texts.append(" ".join(w))
        if i % 10 == 3:
            texts += [texts[-1].replace(" ", "\n "), " ".join([*w[:-2], word(), word()])]
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(texts)] + [(len(texts), None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = weak_quality.fit(docs)
    left = {i: t for (i, t, *_), s in zip(rows, model.score([r[1] or "" for r in rows])[1], strict=True) if s >= 0.5}
    assert not any("%%%" in t for t in left.values()) and len(left) > 80
    seen = {}
    for i in sorted(left):
        seen.setdefault(" ".join(words(left[i])), i)
    kept = {i: left[i] for i in seen.values()}
    near = near_brute(list(kept.items()), 80)
    first = {i: t for i, t in kept.items() if near[i][1] == i}
    repeated = passage_brute(list(first.items()))
    want = {}
    for i, t in first.items():
        gone = {k + j for k in repeated[i] for j in range(50)}
        if own := [w for k, w in enumerate(words(t)) if k not in gone]:
            want[i] = own
    for expected, (_, stage) in zip((left, kept, first, want), P.STAGES, strict=False):
        docs = cut(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in docs.collect()} == set(expected)
    assert {r["doc_id"]: words(r["text"]) for r in docs.collect()} == want
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(want)
    assert minhash_bayes.BANDS * minhash_bayes.ROWS == 125


def test_rows_that_repeat_a_doc_id_with_other_texts(spark):
    """Rows by row through all stages: none is lost or cut for what another text of its doc_id holds."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghinoprst") for _ in range(rng.randint(2, 8)))
    text = lambda n=90: [word() + "." * (rng.random() < 0.1) for _ in range(n)]
    passage, base = text(70), text()
    lone, long_one = [text(), text(), text()], text(300)
    rows = [
        (1, base), (2, [*base, "more"]), (2, lone[0]), (3, lone[1]), (3, lone[1]), (3, lone[2]),  # near copies; others are no copies
        (4, passage + text(40)), (5, passage + text(40)), (5, long_one), (6, text(40) + passage), (6, text(80)), (6, text(80)),
        (None, text()), (None, text()),
    ]
    rows = [(i, " ".join(w), "a", i) for i, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, id long").repartition(3).cache()
    near = minhash_bayes.drop_near_copies(docs)
    assert near.columns == docs.columns
    assert sorted(r.text for r in near.collect()) == sorted(t for i, t, *_ in rows if t != " ".join([*base, "more"]))
    exact = P.exact(spark, docs, "")
    assert sorted(r.text for r in exact.collect()) == sorted({t for _, t, *_ in rows})
    left = {}
    for r in P.passages(spark, cut(exact, "test"), "").collect():
        left.setdefault(r.doc_id, []).append(words(r.text))
    # Brute force, with further texts of a doc_id as documents after all others.
    seen, numbered = set(), []
    order = {t: k for k, t in enumerate(sorted({t for i, t, *_ in rows if i is not None}, key=lambda t: min(i for i, u, *_ in rows if u == t)))}
    assert [] not in [w for ws in left.values() for w in ws] and len(order) == 11
    for ws in left.values():
        for w in ws:
            numbered.append(w)
            seen |= {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
    windows = [tuple(w[k : k + 50]) for w in numbered for k in range(len(w) - 49)]
    assert len(windows) == len(set(windows))  # no passage is left twice
    every = {tuple(w[k : k + 50]) for _, t, *_ in rows for w in [words(t)] for k in range(len(w) - 49)}
    assert every - seen <= {x for x in every if set(x) & set(passage) or set(x) & set(base)}  # and only repeated ones went
    assert words(" ".join(long_one)) in left[5] and all(words(" ".join(w)) in left[i] for i, w in ((2, lone[0]), (3, lone[1]), (3, lone[2])))


def test_row_keys(spark):
    rows = [(1, "a", 0), (1, "a", 1), (1, "b", 2), (2, None, 3), (2, "", 4), (None, "x", 5), (3, "y", 6)] + [(9, f"t{k}", 10 + k) for k in range(20)]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t, n) for i, t, n in rows], f"doc_id {kind}, text string, n int")
        got = {r.n: r.k for r in keyed_rows(docs, "k").collect()}
        assert got[0] == got[1] != got[2] and got[3] == got[4] and got[5] is None and str(got[6]) == "3"
        assert len({got[10 + k] for k in range(20)}) == 20 and len({v for v in got.values() if v is not None}) == 24
