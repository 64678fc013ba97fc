"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Every task is a memtable that sorts the digests of its rows. Memtables are flushed in batches as runs of level 0 of a `MergeIndex`, each
sorted and with a filter of its digests; FANOUT runs of a level are compacted into one of the next, which keeps for each digest the
smallest identifier and the count. `exact_groups` and `drop_exact_copies` read the compacted index; `MergeIndex.find` asks the
filters of all runs and joins only those that may hold a digest. A fixed-size filter over the documents whose digest occurs more
than once selects the rows that may be hits, and only the texts of those are read again, to be compared byte by byte within their
digest (least and greatest text, combined map-side, so a digest that holds a third of all rows moves one pair of texts for each
task). Digests whose texts differ are split by text.

Defined cases: a null text is an empty text. Texts are equal when they are identical after every run of white space has become
one space. In `exact_groups` rows that repeat a doc_id and a text share one decision. A null doc_id comes after every other; a group of only null
identifiers has a null keep_id and all its rows are kept. An empty table gives an empty result. Other columns are ignored
by `exact_groups` and kept by `drop_exact_copies`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, fresh, key_filter, may_contain, quoted, text_or_empty


#: Batches in which one table goes into an index, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 4


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Run:
    """Digests with their smallest identifier and count, sorted; filter: which digests the run may hold."""

    rows: DataFrame
    filter: DataFrame


class MergeIndex:
    """An index over batches that come one after the other: each is a run of level 0, and FANOUT runs of a level are merged into one
    run of the next. A lookup asks each run's filter first and joins only the digests that the run may hold."""

    def __init__(self, digest: Callable[[Column], Column] = sha256, fanout: int = FANOUT) -> None:
        self.digest, self.fanout = digest, fanout
        self.levels: list[list[Run]] = []

    def _flush(self, counted: DataFrame, level: int) -> None:
        rows = cut(counted.sortWithinPartitions("digest"), f"exact-level{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(Run(rows, cut(key_filter(rows, "digest"), f"exact-filter{level}")))
        if len(self.levels[level]) >= self.fanout:  # compaction
            full, self.levels[level] = self.levels[level], []
            self._flush(_merged([r.rows for r in full]), level + 1)

    def add(self, docs: DataFrame) -> None:
        self.add_digests(docs.select("doc_id", self.digest(normalised()).alias("digest")))

    def add_digests(self, rows: DataFrame) -> None:
        """A batch of rows (doc_id, digest)."""
        self._flush(_merged([rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))]), 0)

    def compact(self) -> DataFrame:
        """Merge all runs into one of the highest level; its rows."""
        runs = [run for level in self.levels for run in level]
        if len(runs) > 1:
            top = len(self.levels)
            self.levels = [[] for _ in self.levels]
            self._flush(_merged([r.rows for r in runs]), top)
            return self.levels[top][0].rows
        return runs[0].rows

    def find(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id and group_size of the rows of docs whose digest an earlier batch has; hits are by digest."""
        asked = cut(docs.select("doc_id", self.digest(normalised()).alias("digest")), "exact-asked")
        empty = asked.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).limit(0)
        keys = asked.select("digest").distinct()
        hits = [empty, *(may_contain(keys, run.filter, "digest").join(run.rows, "digest") for level in self.levels for run in level)]
        return asked.join(_merged([h.select("digest", "keep_id", "group_size") for h in hits]), "digest").select("doc_id", "digest", "keep_id", "group_size")


def _merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: of each digest the smallest identifier and all its rows."""
    return reduce(DataFrame.unionByName, runs).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def build_index(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """What memtables hold (doc_id, digest; a row per document), and the rows of the compacted index (digest, keep_id, group_size).

    Every task is a memtable, a sorted file of its own; the index takes them in batches, so that a flush is a part of the table.
    """
    flushed = docs.select("doc_id", digest(normalised()).alias("digest")).withColumn("memtable", F.spark_partition_id()).sortWithinPartitions("digest")
    level0, index = cut(flushed, "exact-runs"), MergeIndex(digest)
    for k in range(batches):
        index.add_digests(level0.filter(F.pmod("memtable", F.lit(batches)) == k))
    return level0.drop("memtable"), index.compact()


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row of docs."""
    level0, level1 = build_index(docs, digest)
    several = level1.filter("group_size > 1")
    # Only texts of documents whose digest occurs again are normalised a second time.
    again = level0.join(several.select("digest"), "digest", "left_semi")
    texts = may_contain(docs.select("doc_id", "text"), cut(key_filter(again, "doc_id"), "exact-filter"), "doc_id")
    texts = texts.select("doc_id", normalised().alias("text")).withColumn("digest", digest(F.col("text")))
    hits = may_contain(texts, key_filter(several, "digest"), "digest")
    differ = cut(
        hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most").select("digest"),
        "exact-differ",
    )
    out = level0.join(several, "digest", "left").select(
        "doc_id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    if not differ.isEmpty():
        clash = hits.join(differ, "digest", "left_semi")
        split = clash.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = clash.join(split, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        out = out.join(differ, "digest", "left_anti").select("doc_id", "digest", "keep_id", "group_size").unionByName(split)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, with all its columns: that of the smallest doc_id (null last; of equal ones, any).

    Rows are judged by their text alone, so those that repeat a doc_id with another text stay. Only rows whose doc_id may be that of
    a repeated digest are moved, and of a group one for each task; byte verification is that the text itself is part of the key.
    """
    level0, level1 = build_index(docs)
    again = level0.join(level1.filter("group_size > 1").select("digest"), "digest", "left_semi")
    bloom = cut(key_filter(again, "doc_id"), "exact-filter")
    digest, text, turn = fresh(docs.columns, "digest", "normalised", "turn")
    kept = [quoted(c) for c in docs.columns]
    hits = may_contain(docs, bloom, "doc_id").withColumn(text, normalised()).withColumn(digest, sha256(F.col(text)))
    order = Window.partitionBy(digest, text).orderBy(F.col("doc_id").asc_nulls_last())
    first = hits.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1).select(*kept)
    return may_contain(docs, bloom, "doc_id", found=False).select(*kept).unionByName(first)


def query(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
