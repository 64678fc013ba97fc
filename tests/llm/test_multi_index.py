import numpy as np
from cleanloom.llm import multi_index as M


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 50 == 0:
            score = (x * v).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((v * v).sum())
            order = np.lexsort((ids, -score))
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order if ids[j] != i][:k]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 32)).astype(np.float32)
    x[300:900] = x[299]  # a large group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(50_000, None), (50_050, [0.0] * 32), (50_100, [float("nan")] * 32), (None, rows[0][1]), (50_150, [1.0]), (50_200, [None] * 32), (50_250, [float("inf")] * 32)]
    frame = spark.createDataFrame([(i, v, 1, b"r") for i, v in rows + odd], "vec_id long, embedding array<float>, label int, raw binary").repartition(4)
    got = {}
    for r in M.query(frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hit = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hit / (5 * len(want)) >= 0.9
    assert [v for _, (v, _) in sorted(got[350].items())] == [299, 300, 301, 302, 303]
    of = dict(rows)
    for q, answers in got.items():
        for v, s in answers.values():
            a, b = np.array(of[q]), np.array(of[v])
            assert abs(s - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12


def test_probe_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    asked = codes[:20] ^ (1 << rng.integers(0, 16, (20, 4))).astype(np.uint16)
    for radius in (3, 10, 26):
        for code, at in zip(asked, M.probe(codes, asked, radius), strict=True):
            assert at.tolist() == np.flatnonzero(M._ONES[codes ^ code].sum(1) <= radius).tolist()


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert M.query(spark.createDataFrame([], kind)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 0.0])], kind)
    assert [tuple(r) for r in sorted(M.query(few).collect())] == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]
