import random

from cleanloom.llm.components import components
from cleanloom.llm.words import Words, shingle_sets


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(700, i) for i in range(701, 800)] + [(900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes_follow_content_only():
    texts = [b"a b\x0bc  d", b"", b" ", b"x a b c d", "é\xa0b".encode()]
    words = Words(texts)
    assert words.first.tolist() == [0, 4, 4, 4, 9, 10]
    assert words.hashes[:4].tolist() == words.hashes[5:9].tolist() and len(set(words.hashes.tolist())) == 6
    assert [t[b:e] for t, k in ((texts[0], range(4)), (texts[3], range(4, 9))) for b, e in ((words.begin[i], words.end[i]) for i in k)] == [b"a", b"b", b"c", b"d", b"x", b"a", b"b", b"c", b"d"]
    four = words.sequences(4)
    assert four[0] == four[5] and four[0] != four[4]
    a, b, c, d = shingle_sets([b"a b c d e f", b"f a b c d e", b"a b", b"a b c"])
    assert len(a) == len(b) == 2 and len(set(a.tolist()) & set(b.tolist())) == 1 and len(c) == len(d) == 1 and c[0] != d[0]
