import random
import re

from cleanloom.llm import suffix_dedup as S

N = S.LENGTH


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows):
    """{doc_id: repeated window starts}, by the order of (doc_id, start)."""
    seen, out = set(), {}
    for i, t in sorted({i: t for i, t in rows}.items()):
        w, own = words(t), set()
        for k in range(len(w) - N + 1):
            h = tuple(w[k : k + N])
            own |= {k} if h in seen else set()
            seen.add(h)
        out[i] = own
    return out


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(5))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 120, 300)]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(rng.choice((0, 20, 70, 200)))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            a = rng.randint(0, max(0, len(s) - 55)) if rng.random() < 0.5 else 0
            w[(k := rng.randint(0, len(w))) : k] = s[a:]
        texts.append(rng.choice((" ", "  ", "\n")).join(w))
    texts += [texts[3], texts[7] + " ", None, "", "x " * 3000, "x " * 3000 + "y", "a b " * 900]
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "doc_id long, text string, word int, key int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {}
    for r in S.repeats(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"] - N + 1))
        own, first = words(dict(rows)[r["doc_id"]]), words(dict(rows)[r["first_doc_id"]])
        assert own[r["start"] : r["start"] + r["n_words"]] == first[r["first_start"] : r["first_start"] + r["n_words"]]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: s for i, s in brute(rows).items() if s}


def test_cut_leaves_each_passage_once(spark):
    rows = made(2)
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in rows] + [(None, "n", 1, "s")], "doc_id long, text string, n_chars long, spans string")
    docs = docs.selectExpr("*", "'w' word", "1 bits", "2 _word", "3 _bit", "4 id", "5 _id", "6 _spans", "7 gone", "8 _gone", "9 at", "1 `a b`").repartition(3)
    out = S.cut_repeats(docs)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r for r in out.collect()}
    repeated = brute(rows)
    for i, t in rows:
        gone = {k + j for k in repeated[i] for j in range(N)}
        want = [w for k, w in enumerate(words(t)) if k not in gone]
        if not want and gone:
            assert i not in left
        else:
            assert words(left[i]["text"]) == want
            assert left[i]["n_chars"] == len(left[i]["text"] or "") and (gone or left[i]["text"] == t)
    assert left[None]["text"] == "n"


def test_windows_over_many_sorted_partitions(spark):
    """One window in most rows goes over many partitions; its first occurrence is found in each, and rows that repeat are one."""
    rng = random.Random(4)
    rows = [(7, 7, d, s) for d in range(5, 305) for s in (3, 9)] + [(rng.randint(0, 40), rng.randint(0, 2), rng.randint(0, 300), rng.randint(0, 50)) for _ in range(400)]
    rows += rows[::3]
    first = {}
    for a, b, d, s in rows:
        first[a, b] = min(first.get((a, b), (d, s)), (d, s))
    want = sorted({(d, s, *first[a, b]) for a, b, d, s in rows if (d, s) != first[a, b]})
    df = spark.createDataFrame(rows, "h1 long, h2 long, doc_id long, start int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for partitions, batch in ((40, 3), (1, 7), (5, 1000)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert sorted(map(tuple, S._again(df).distinct().collect())) == want
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_that_repeat_an_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "a " + text), (1, "a " + text), (2, text + " b"), (None, text)], "doc_id long, text string").repartition(3)
    assert [tuple(r) for r in S.repeats(docs).collect()] == [(2, 0, 60, 1, 1)]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.query(empty).collect() == [] and S.cut_repeats(empty).collect() == []
