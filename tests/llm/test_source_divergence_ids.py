"""Kept terms are counted, shuffled and ranked by ids."""

from cleanloom.llm import source_divergence as D

ROWS = [("en", f"s{k % 3}", f"Zoo zoo Äpfel ant{k % 2} bee ant{k % 2} \U0001f600 ￮") for k in range(9)] + [("de", "s0", "Zoo ant1"), ("de", None, None)]


def counted(spark, part):
    texts = D.grouped_texts(spark.createDataFrame(ROWS, "lang string, source string, text string"))
    kept = D.with_ids(D.cut(D.vocabulary(texts, 1), "test-terms"))
    posts = D.postings(texts, kept, part)
    assert posts.columns == ["lang", "source", "id", "n"]
    term = {(r.lang, r.id): r.term for r in kept.collect()}
    return kept, sorted((r.lang, r.source, term[r.lang, r.id], r.n) for r in posts.collect())


def test_ids_are_in_the_order_of_utf8(spark):
    kept, _ = counted(spark, D.PART)
    terms = [r.term for r in kept.filter("lang = 'en'").orderBy("id").collect()]
    assert terms == sorted(terms, key=str.encode) and terms[-2:] == ["￮", "\U0001f600"]


def test_small_bounds_and_parts_give_the_same_counts(spark):
    want = {}
    for lang, source, text in ROWS:
        for term in D.spaced(text).decode().split():
            want[lang, source or "", term] = want.get((lang, source or "", term), 0) + 1
    want = sorted((*k, n) for k, n in want.items())
    assert counted(spark, D.PART)[1] == counted(spark, 8)[1] == want


def test_sums_settle_as_often_as_needed(monkeypatch):
    monkeypatch.setattr(D, "SORTED", 3)
    sums = D._Sums()
    for k in range(20):
        sums.add(D.np.array([k % 4, 7, 7, (5 << 32) + k % 2]))
    sums.settle()
    assert dict(zip(sums.keys.tolist(), sums.counts.tolist(), strict=True)) == {0: 5, 1: 5, 2: 5, 3: 5, 7: 40, 5 << 32: 10, (5 << 32) + 1: 10}
