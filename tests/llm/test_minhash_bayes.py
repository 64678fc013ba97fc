import random
import re

from cleanloom.llm import minhash_bayes as M


def brute(texts, limit):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= limit * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((3, 30, 150)))]
        for k in range(rng.choice((1, 3, 60))):  # a large group of near copies, some apart from the first
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            texts.append("  ".join(own) + "\n" * (k % 2) if k % 3 else " ".join(own).upper().replace("É", "é"))
    texts += [None, "", " \n", "one two", "one two", "ONE  TWO", "x " * 40_000, "x " * 40_000 + "y"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, sig string, rep long").selectExpr("*", "'w' word", "1 bits", "2 _word", "3 _bit", "4 id", "5 at").repartition(4)
    want = brute(rows, 85)
    for small in (32, 3):
        got = M.near_groups(docs, small=small).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = M.drop_near_copies(docs, 0.85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_links_after_the_leaders_of_a_bucket(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    core = [word() for _ in range(200)]
    # 80 documents that are apart from all others, then two that are near each other: the core is all that they share.
    rows = [(i, " ".join([*core, *(word() for _ in range(22 if i < 80 else 15))])) for i in range(82)]
    want = brute(rows, 85)
    assert [i for i, (_, c) in want.items() if i != c] == [81]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    held = {}
    for r in M.buckets(M.signatures(docs).withColumnRenamed("doc_id", "rep")).collect():
        held.setdefault(r["bucket"], []).append(r["rep"])
    met = [len(b) for b in held.values() if {80, 81} <= set(b)]
    assert met and all(34 <= n <= 64 for n in met)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_groups(docs).collect()} == want


def test_edges(spark):
    assert M.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in M.query(odd).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]


def test_needed_is_the_binomial_tail():
    for n, m in M.needed(0.85):
        assert 0 < m < n
