import random
from collections import Counter, defaultdict

import duckdb
import pytest

from cleanloom.llm import source_divergence as D
from cleanloom.llm.source_divergence import grouped_texts, occurrences, query, report, vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, term string, part int"


def terms_of(text):
    out, word = [], ""
    for c in [*(text or ""), " "]:
        if ord(c) >= 128 or c.isascii() and c.isalpha():
            word += c.lower() if ord(c) < 128 else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", terms_of(text)) for _, text, lang, source, *_ in rows]
    df, out = defaultdict(Counter), []
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    for lang in {x[0] for x in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        count = {s: Counter() for own, s, _ in docs if own == lang}
        for own, s, terms in docs:
            if own == lang:
                count[s].update(t for t in terms if t in set(kept))

        def chance(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: chance(c) for s, c in count.items()}
        q = chance(sum(count.values(), Counter()))
        for s in count:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)]
    return sorted(out)


def made(n=150, seed=11):
    rng = random.Random(seed)
    words = ["a", "aa", "Aa", "été", "ÉTÉ", "the-end", "x1y", "don't", "日本", "zz", "_", "i", "İ", "naïve"]
    text = lambda: rng.choice([" ", ". ", "\n", "9"]).join(rng.choices(words, k=rng.randint(0, 9)))
    rows = [(i, rng.choice([None, "", text(), text(), text()]), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "S3", None, "é"]), "x", 1) for i in range(n)]
    return [*rows, *rows[:3], (None, "only one source here", "de", "s1", "x", 1), (None, "", "xx", "s1", "x", 1), (None, None, "xx", "s2", "x", 1)]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_report_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, COLUMNS)
    assert rows_of(query(docs)) == brute(rows)
    assert rows_of(report(docs, least=1, top=2, part=10)) == brute(rows, 1, 2)  # the vocabulary in many parts


def test_many_sources_in_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 7)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=12)), "en", f"s{i % 23}", "", 1) for i in range(120)]
    assert rows_of(query(spark.createDataFrame(rows, COLUMNS))) == brute(rows)


def test_query_equals_sql(spark, tmp_path):
    docs = spark.createDataFrame(made(400, 2), COLUMNS).coalesce(1)
    docs.write.parquet(f"{tmp_path}/d")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert rows_of(query(docs)) == sorted(db.execute(D.SQL).fetchall())


def test_terms_and_their_occurrences(spark):
    rows = [(1, "Ab ab AB-ab1ab", "en", "s", "", 0), (2, "ab" + "c" * 3000 + " ab", "en", "s", "", 0), (3, None, "en", "s", "", 0)]
    texts = grouped_texts(spark.createDataFrame(rows, COLUMNS))
    kept = sorted(r.term for r in vocabulary(texts, 1).collect())
    assert kept == ["ab", "ab" + "c" * 3000]
    assert {r.term[:3]: r.n for r in occurrences(texts, {"en": kept}, "test").collect()} == {"ab": 6, "abc": 1}


@pytest.mark.parametrize("text", ["", "1 2 3 -", None])
def test_no_terms(spark, text):
    rows = [(1, text, "en", "a", "", 0), (2, text, "en", "b", "", 0)]
    assert rows_of(query(spark.createDataFrame(rows, COLUMNS))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_empty_table(spark):
    assert query(spark.createDataFrame([], COLUMNS)).collect() == []
