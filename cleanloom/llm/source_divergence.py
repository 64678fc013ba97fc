"""Source divergence audit by a two-pass vocabulary automaton.

1. First pass: exact document frequencies. Terms are runs of ASCII letters and of signs beyond ASCII, A-Z in lower case. Tasks
   add up what they read before anything is shuffled; each language keeps the terms of at least LEAST of its documents.
2. Second pass: kept terms, each between two delimiters, form an Aho-Corasick automaton for each language, which recounts their
   occurrences in whole texts. The vocabulary is taken in parts of about PART characters, by hash of the term, so that a worker's
   automaton and what is broadcast stay bounded however large it grows; each part is a scan of its own, written before the next.
   Kept terms have ids in their order, which stand for them in all that is counted, shuffled and ranked.
3. Counts are sparse postings (lang, source, id, n). A group's terms without occurrences share one probability, so the value of
   a pair of sources is that of two empty postings for all terms, corrected by sums over the terms of each (aggregated by
   probability first) and over those that both have (summed in tasks, term by term, before they are shuffled).

All arithmetic is on integers: products that may pass 64 bits are decimals, and sums of f stay under (10**9 + V)**2.

Null texts, languages and sources are empty strings; these are a language and a source like others. Rows count as they come, so a
repeated row is a further document. A group without terms takes part with counts of 0; with no kept term all pairs are 0 and there are
no term rows. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

LEAST, TOP = 3, 200
#: Characters of a part of the vocabulary, and entries that a task of the first pass adds up before it hands them on.
PART, HELD = 12_000_000, 600_000
#: Occurrences that a task of the second pass sorts at once, entries that it adds up before it hands them on, and rows of a batch of these.
SORTED, SUMMED, BATCH = 2_000_000, 2_000_000, 200_000
#: Pairs of postings compared at once.
PAIRS = 2_000_000
#: What each byte of UTF-8 becomes: A-Z lower case, other ASCII but a-z a space.
_TO_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def spaced(text: str | None) -> bytes:
    """The text's terms with spaces between, in UTF-8."""
    return (text or "").encode().translate(_TO_TERMS)


def _rows(held: dict[tuple[str, ...], Counter], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counters, by key columns, as rows; they are emptied."""
    for key, counter in held.items():
        terms = pa.array(list(counter)).cast(pa.string())  # terms are text or UTF-8
        own = [pa.repeat(pa.scalar(k, pa.string()), len(counter)) for k in key]
        yield pa.RecordBatch.from_arrays([*own, terms, pa.array(list(counter.values()), pa.int64())], names)
    held.clear()


def grouped_texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text_or_empty().alias("text"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term and n, the documents of the language that have the term; docs as grouped_texts() gives them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, ...], Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held[lang,].update(set(spaced(text.as_py()).split()))
            if sum(map(len, held.values())) > HELD:
                yield from _rows(held, ["lang", "term", "n"])
        yield from _rows(held, ["lang", "term", "n"])

    each = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return each.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang and term of the kept terms."""
    return document_frequencies(docs).filter(F.col("n") >= least).select("lang", "term")


def with_ids(kept: DataFrame) -> DataFrame:
    """lang, term and id; ids of a language's terms are in the terms' order by UTF-8. kept is a written table."""
    return cut(kept.orderBy("lang", "term").withColumn("id", F.monotonically_increasing_id()), "divergence-ids")


_automata: dict[tuple[str, str], object] = {}


def automaton(part: str, lang: str, terms: list[str]):
    """One for each worker, language and part, which gives the places of terms; those of an earlier part go."""
    import ahocorasick

    if (part, lang) not in _automata:
        for key in [k for k in _automata if k[0] != part]:
            del _automata[key]
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at, term in enumerate(terms):
            found.add_word(f" {term} ", at)
        found.make_automaton()
        _automata[part, lang] = found
    return _automata[part, lang]


class _Sums:
    """Occurrences by group and place of the term, as one number each, sorted and added up in numpy."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.many = 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.many += len(keys)
        if self.many > SORTED:
            self.settle()

    def settle(self) -> None:
        keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self.waiting]), return_counts=True)
        self.waiting, self.many = [], 0
        if len(self.keys):
            keys, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            counts, own = np.zeros(len(keys), np.int64), counts
            counts[place[: len(self.keys)]] = self.counts
            counts[place[len(self.keys) :]] += own
        self.keys, self.counts = keys, counts


def _counted(docs: DataFrame, terms: dict[str, list[str]], ids: dict[str, list[int]], name: str) -> DataFrame:
    """lang, source, id and n, the occurrences in the group, of the given terms of each language (a part of bounded size)."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, {lang: np.array(x, np.int64) for lang, x in ids.items()}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, number), last, sums = shared.value, itemgetter(1), _Sums()
        groups: dict[tuple[str, str], int] = {}
        first = dict(zip(own, np.cumsum([0, *map(len, own.values())]).tolist(), strict=False))
        every = np.concatenate([np.empty(0, np.int64), *(number[lang] for lang in own)])

        def rows() -> Iterator[pa.RecordBatch]:
            sums.settle()
            of = [pa.array([g[k] for g in groups], pa.string()) for k in (0, 1)]
            for at in range(0, len(sums.keys), BATCH):
                keys, counts = sums.keys[at : at + BATCH], sums.counts[at : at + BATCH]
                group = pa.array(keys >> 32)
                columns = [of[0].take(group), of[1].take(group), pa.array(every[keys & 0xFFFFFFFF]), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "id", "n"])
            groups.clear()
            sums.__init__()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                if lang in own:
                    padded = f" {spaced(text.as_py()).decode()} "
                    places = np.fromiter(map(last, automaton(name, lang, own[lang]).iter(padded)), np.int64)
                    sums.add(places + ((groups.setdefault((lang, source), len(groups)) << 32) + first[lang]))
            if len(sums.keys) > SUMMED:
                yield from rows()
        yield from rows()

    # A task's rows are added up already, so they are spread first and then added up once.
    each = docs.mapInArrow(run, "lang string, source string, id long, n long").repartition("id")
    return each.groupBy("lang", "source", "id").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, terms: dict[str, list[str]], name: str) -> DataFrame:
    """lang, source, term and n, the occurrences in the group, of the given terms of each language (a part of bounded size)."""
    rows = [(k, term) for k, term in enumerate(t for own in terms.values() for t in own)]
    known = iter(range(len(rows)))
    counts = _counted(docs, terms, {lang: [next(known) for _ in own] for lang, own in terms.items()}, name)
    return counts.join(docs.sparkSession.createDataFrame(rows, "id long, term string"), "id").select("lang", "source", "term", "n")


def postings(docs: DataFrame, kept: DataFrame, part: int = PART) -> DataFrame:
    """lang, source, id and n of each kept term in each group that has it; kept is a written table of lang, term and id."""
    size = kept.agg(F.sum(F.length("term") + 2)).first()[0] or 0
    parts = -(-size // part)
    found = []
    for k in range(parts):
        own = kept.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)
        terms: dict[str, list[str]] = defaultdict(list)
        ids: dict[str, list[int]] = defaultdict(list)
        for row in own.toLocalIterator():
            terms[row.lang].append(row.term)
            ids[row.lang].append(row.id)
        table = _counted(docs, dict(terms), dict(ids), uuid.uuid4().hex)
        found.append(cut(table, "divergence-counts"))
    if not found:
        return docs.sparkSession.createDataFrame([], "lang string, source string, id long, n long")
    return reduce(DataFrame.unionByName, found)


def probability(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)); null where there are no terms."""
    return F.expr(f"case when {terms} > 0 then 1 + (1000000000BD * cast({n} + 1 as decimal(20, 0))) div cast({total} + {terms} as decimal(20, 0)) end")


def divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _common(lists: DataFrame) -> DataFrame:
    """lang, source, other, and the correction for the terms that both have, from lang and posts (source, p, empty) of each term."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posts = batch.column("posts")
            sizes = np.diff(posts.offsets.to_numpy())
            flat = posts.flatten()
            groups = pa.DictionaryArray.from_arrays(np.repeat(np.arange(batch.num_rows), sizes), batch.column("lang")).cast(pa.string())
            # A group is its language's and its source's number; the languages of a pair are the same.
            langs, sources = groups.dictionary_encode(), flat.field("source").dictionary_encode()
            lang, source = langs.indices.to_numpy().astype(np.int64), sources.indices.to_numpy().astype(np.int64)
            n = max(1, len(sources.dictionary))
            p, empty = flat.field("p").to_numpy(), flat.field("empty").to_numpy()
            size, first = np.repeat(sizes, sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            ends, sums = np.cumsum(size), defaultdict(int)
            at = 0
            while at < len(p):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                i = np.repeat(np.arange(at, to), size[at:to])
                j = np.repeat(first[at:to], size[at:to]) + np.arange(len(i)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
                i, j = i[i != j], j[i != j]
                both = f(p[i], p[j]) - f(p[i], empty[j]) - f(empty[i], p[j]) + f(empty[i], empty[j])
                key, inverse = np.unique((lang[i] * n + source[i]) * n + source[j], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, inverse, both)
                for k, v in zip(key.tolist(), total.tolist(), strict=True):
                    sums[k] += v
                at = to
            keys = list(sums)
            columns = [langs.dictionary.take(pa.array([k // n // n for k in keys], pa.int64())), *(sources.dictionary.take(pa.array(x, pa.int64())) for x in ([k // n % n for k in keys], [k % n for k in keys]))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sums[k] for k in keys], pa.int64())], ["lang", "source", "other", "common"])

    return lists.mapInArrow(run, "lang string, source string, other string, common long").groupBy("lang", "source", "other").agg(F.sum("common").alias("common"))


def pairs(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value.

    groups: lang, source, terms and empty (the probability of a term without occurrences), written; posts: lang, source, id, p, empty.
    """
    levels = groups.groupBy("lang", F.col("empty").alias("level")).agg(F.lit(1).alias("one")).drop("one")
    alike = posts.groupBy("lang", "source", "p", "empty").agg(F.count(F.lit(1)).alias("m"))
    own = alike.join(levels, "lang").groupBy("lang", "source", "level").agg(
        F.sum(F.expr(f"m * ({divergence('p', 'level')} - {divergence('empty', 'level')})")).alias("as_first"),
        F.sum(F.expr(f"m * ({divergence('level', 'p')} - {divergence('level', 'empty')})")).alias("as_second"),
    )
    own = cut(own, "divergence-levels")
    lists = posts.groupBy("lang", "id").agg(F.collect_list(F.struct("source", "p", "empty")).alias("posts")).filter("size(posts) > 1").select("lang", "posts")
    common = _common(lists)
    left = groups.select("lang", "source", "terms", F.col("empty").alias("p"))
    right = groups.select("lang", F.col("source").alias("other"), F.col("empty").alias("q"))
    both = left.join(right, "lang").filter("source <> other")
    both = both.join(own.select("lang", "source", F.col("level").alias("q"), "as_first"), ["lang", "source", "q"], "left")
    both = both.join(own.select("lang", F.col("source").alias("other"), F.col("level").alias("p"), "as_second"), ["lang", "other", "p"], "left")
    both = both.join(common, ["lang", "source", "other"], "left")
    parts = [f"terms * ({divergence('p', 'q')})", "as_first", "as_second", "common"]
    return both.select("lang", "source", F.col("other").alias("item"), F.expr(" + ".join(f"coalesce({x}, 0L)" for x in parts)).alias("value"))


def report(docs: DataFrame, least: int = LEAST, top: int = TOP, part: int = PART) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    texts = grouped_texts(docs)
    kept = with_ids(cut(vocabulary(texts, least), "divergence-terms"))
    counts = cut(postings(texts, kept, part), "divergence-postings")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "terms"])
    groups = cut(groups.select("lang", "source", "total", "terms", probability("0", "total", "terms").alias("empty")), "divergence-groups")
    posts = counts.join(groups, ["lang", "source"]).select("lang", "source", "id", probability("n", "total", "terms").alias("p"), "empty")
    posts = cut(posts, "divergence-posts")
    all_of = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    base = counts.groupBy("lang", "id").agg(F.sum("n").alias("n")).join(all_of, "lang").select("id", probability("n", "total", "terms").alias("q"))
    terms = posts.join(base, "id").filter("p > q").select("lang", "source", "id", F.expr(divergence("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_id = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id")
    first = terms.withColumn("rank", F.row_number().over(by_id)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    first = first.join(kept.select("id", F.col("term").alias("item")), "id")
    second = pairs(groups, posts).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return second.select(*names).unionByName(first.select(*names))


def query(docs: DataFrame) -> DataFrame:
    return report(docs)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.*, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v) AS q
      FROM s JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM ranked)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
