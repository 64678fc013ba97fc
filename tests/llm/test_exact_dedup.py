import hashlib
import re

from cleanloom.llm import exact_dedup as E
from pyspark.sql import functions as F


def brute(rows):
    text = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    out = {}
    for i, t in text.items():
        group = [j for j, u in text.items() if u == t]
        out[i] = (min(group), len(group), i == min(group), hashlib.sha256(t.encode()).hexdigest())
    return out


ROWS = [(5, "a  b"), (3, "a\n\tb"), (9, "a b"), (1, "a b "), (2, None), (4, ""), (6, "\x0b"), (7, " "), (8, "é\xa0x"), (10, "é x"), (11, "y" * 300_000), (12, "y" * 300_000)] + [(100 + i, "copy") for i in range(200)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, b"d", 1) for i, t in rows], "doc_id long, text string, digest binary, keep_id int").repartition(4)


def test_against_brute_force(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in E.query(frame(spark)).collect()}
    assert got == brute(ROWS)
    left = E.drop_exact_copies(frame(spark).selectExpr("*", "'w' word", "1 bits", "2 _word", "3 _bit", "4 at", "5 bit", "6 normalised", "7 turn", "8 `a.b`"))
    assert left.columns == ["doc_id", "text", "digest", "keep_id", "word", "bits", "_word", "_bit", "at", "bit", "normalised", "turn", "a.b"]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, x in got.items() if x[2])


def test_equal_digests_of_different_texts_are_told_apart(spark):
    """With a digest of one hexadecimal digit nearly all hits are false; byte verification must sort them out."""
    weak = lambda c: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(c, 256), 1, 1)))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_groups(frame(spark), weak).collect()}
    assert got == {i: x[:3] for i, x in brute(ROWS).items()}


def test_index_of_batches(spark):
    """Lookups after each batch, over runs of three levels, against all batches so far."""
    index, seen = E.MergeIndex(fanout=2), {}
    for k in range(5):
        batch = [(100 * k + i, f"text {(i * (k + 3)) % 23}" if i else None) for i in range(12)]
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in index.find(frame(spark, batch)).collect()}
        assert got == {i: (min(seen[t or ""]), len(seen[t or ""])) for i, t in batch if (t or "") in seen}
        index.add(frame(spark, batch))
        for i, t in batch:
            seen.setdefault(t or "", []).append(i)
    assert [len(level) for level in index.levels] == [1, 0, 1]


def test_drops_are_judged_by_row(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (2, "c"), (None, "c"), (None, "d"), (None, "d"), (3, "d")]
    left = sorted(((r["doc_id"], r["text"]) for r in E.drop_exact_copies(frame(spark, rows)).collect()), key=str)
    assert left == [(1, "a"), (2, "b"), (2, "c"), (3, "d")]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert E.query(empty).collect() == [] and E.drop_exact_copies(empty).collect() == []
    odd = [(None, "a"), (1, "a"), (1, "a"), (None, "b")]
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.query(frame(spark, odd)).collect()), key=str)
    assert rows == [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)]


def test_query_reads_a_compacted_index(spark):
    rows = [(k, f"text {k % 7}") for k in range(40)] + [(None, "text 3"), (50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for batches in (1, 3, 4, 9):
        level0, index = E.build_index(docs, batches=batches)
        assert level0.columns == ["doc_id", "digest"] and level0.count() == 43
        assert sorted((r.keep_id, r.group_size) for r in index.collect()) == sorted([(k, len(range(k, 40, 7)) + (k == 3)) for k in range(7)] + [(50, 2)])
    merged = E.MergeIndex(fanout=2)
    for k in range(5):
        merged.add(docs.filter(f"pmod(doc_id, 5) = {k}"))
    assert [len(level) for level in merged.levels] == [1, 0, 1]  # five runs, compacted by twos
    assert merged.compact().count() == 8 and [len(level) for level in merged.levels] == [0, 0, 0, 1]
    assert {r.doc_id: r.keep_id for r in merged.find(docs.filter("doc_id in (10, 50)")).collect()} == {10: 3, 50: 50}
