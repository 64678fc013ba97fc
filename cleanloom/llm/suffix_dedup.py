"""Repeated passages by a sparse suffix array.

1. In each text the words that begin a minimiser (the least hash of KGRAM words among SPARSE consecutive places) are kept. Any
   two equal passages of LENGTH words keep the same places, so no repeat is lost. Their suffixes, cut to the words that
   every such passage still has after the place, are range-sorted over the cluster and each is compared with its
   neighbours; the sorted partitions' first and last rows (two a partition) are compared apart.
2. From each place whose suffix repeats, the match is extended left and right: of the LENGTH-word windows for which this
   place is the minimiser, each that occurs elsewhere is a match, and consecutive windows with one alignment are one span.
   Windows are range-sorted by 128-bit hashes; the first of each run of equal neighbours is where the passage occurs first.

A window is a repeat if it occurs before, in the order of (doc_id, word); its first occurrence is not reported. Documents with
the same words as an earlier one are set apart first, by a range sort too, and reported whole, so large groups of copies bring no
windows at all. A passage that a third of all documents share is spread by both range sorts; no step gathers it in one task.

Defined cases: a null text is empty; texts under LENGTH words have no repeats. Rows with a null doc_id take no part; a doc_id that is no
number raises. Rows that
repeat a doc_id are one document of `repeats`; `cut_repeats` takes each text of such a doc_id for itself. Periodic texts repeat themselves and are reported after their first LENGTH words. Empty
tables give empty results. Other columns are ignored by `repeats` and kept by `cut_repeats`, which removes the spans from
text, adjusts n_chars if there is such a column, and drops documents of which no word remains.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import chunks, cut, fresh, give_back, key_filter, keyed_rows, may_contain, quoted
from .words import STEP, Words, mix, powers

LENGTH, SPARSE, KGRAM = 50, 32, 8
#: Windows whose least hash is found at once.
AT_ONCE = 1 << 14
#: Odd, for a second and independent hash.
STEP2 = 0xA0761D6478BD642F


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def minimisers(grams: np.ndarray, windows: int) -> np.ndarray:
    """For each of the first `windows` places, the place of the least (leftmost) hash among the SPARSE from there."""
    seen = sliding_window_view(grams, SPARSE)
    parts = [seen[k : min(k + AT_ONCE, windows)].argmin(1) for k in range(0, windows, AT_ONCE)]  # argmin copies what it is given
    return np.arange(windows) + np.concatenate(parts)


def suffixes(docs: DataFrame) -> DataFrame:
    """For each kept place: key (hash of the cut suffix), doc_id, word. For each document: word -1, key and other (hash of all), n_words."""
    rest = LENGTH - SPARSE + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids = 0, batch.column("doc_id").to_numpy()
            for part in chunks(batch.column("text")):
                words = Words([t.encode() for t in part])
                grams, keys = words.sequences(KGRAM), words.sequences(rest)
                first = words.first
                sizes = np.diff(first)
                places, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i in np.flatnonzero(sizes >= LENGTH):
                    kept = np.unique(minimisers(grams[first[i] : first[i + 1] - KGRAM + 1], sizes[i] - LENGTH + 1))
                    places.append(kept)
                    owner.append(np.full(len(kept), i))
                place, own = np.concatenate(places), np.concatenate(owner)
                whole = []
                for step in (STEP, STEP2):
                    sums = np.zeros(len(words.hashes) + 1, np.uint64)
                    np.cumsum(words.hashes * powers(step, len(words.hashes)), out=sums[1:], dtype=np.uint64)
                    inverse = powers(pow(step, -1, 1 << 64), len(words.hashes) + 1)
                    whole.append(mix((sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]] ^ sizes.astype(np.uint64)))
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(np.concatenate([keys[first[own] + place] if len(own) else np.empty(0, np.uint64), whole[0]])),
                        _signed(np.concatenate([np.zeros(len(own), np.uint64), whole[1]])),
                        pa.array(ids[at : at + n][np.concatenate([own, np.arange(n)])]),
                        pa.array(np.concatenate([place, np.full(n, -1)]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(len(own), np.int64), sizes]).astype(np.int32)),
                    ],
                    ["key", "other", "doc_id", "word", "n_words"],
                )
                at += n
        give_back()

    usable = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return usable.mapInArrow(run, "key long, other long, doc_id long, word int, n_words int")


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition the rows that equal a neighbour in key, and its first and last row."""
    names = ["key", "doc_id", "word"]
    held, start = None, True  # the last row so far, whether it equals the one before it, and whether it is the partition's first

    def out(keys, ids, words, same, edge) -> pa.RecordBatch:
        keep = same | edge
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (keys, ids, words, same, edge)], [*names, "same", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids, words = (batch.column(k).to_numpy() for k in names)
        if held is not None:
            keys, ids, words = (np.concatenate([x, y]) for x, y in zip(held[:3], (keys, ids, words), strict=True))
        equal = keys[1:] == keys[:-1]
        same = np.concatenate([equal, [False]]) | np.concatenate([[held is not None and held[3]], equal])
        edge = np.zeros(len(keys), bool)
        edge[0] = start
        if len(keys) > 1:
            yield out(keys[:-1], ids[:-1], words[:-1], same[:-1], edge[:-1])
            start = False
        held = (keys[-1:], ids[-1:], words[-1:], bool(same[-1]))
    if held is not None:
        yield out(*held[:3], np.array([held[3]]), np.array([True]))


def _repeated_places(places: DataFrame) -> DataFrame:
    """doc_id and words (an array) of the kept places whose cut suffix occurs more than once."""
    ordered = places.repartitionByRange("key", "doc_id", "word").sortWithinPartitions("key", "doc_id", "word")
    rows = cut(ordered.mapInArrow(_neighbours, "key long, doc_id long, word int, same boolean, edge boolean"), "suffix-neighbours")
    ends = rows.filter("edge").groupBy("key").count().filter("count > 1").select("key")  # two rows a partition
    more = rows.filter("edge and not same").join(ends, "key", "left_semi")
    return rows.filter("same").unionByName(more).groupBy("doc_id").agg(F.collect_set("word").alias("words"))


def _windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """h1, h2, doc_id, start of the windows whose minimiser is one of places (doc_id, words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, places = 0, batch.column("doc_id").to_numpy(), batch.column("words")
            for part in chunks(batch.column("text")):
                words = Words([t.encode() for t in part])
                grams, first = words.sequences(KGRAM), words.first
                starts, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i in range(len(part)):
                    n = first[i + 1] - first[i]
                    if n >= LENGTH:
                        chosen = np.zeros(n, bool)
                        own = np.asarray(places[at + i].as_py(), np.int64)
                        chosen[own[own < n]] = True
                        begin = np.flatnonzero(chosen[minimisers(grams[first[i] : first[i + 1] - KGRAM + 1], n - LENGTH + 1)])
                        starts.append(begin)
                        owner.append(np.full(len(begin), i))
                start, own = np.concatenate(starts), np.concatenate(owner)
                where = first[own] + start
                h1, h2 = (words.sequences(LENGTH, step)[where] if len(where) else np.empty(0, np.uint64) for step in (STEP, STEP2))
                yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(ids[at : at + len(part)][own]), pa.array(start.astype(np.int32))], ["h1", "h2", "doc_id", "start"])
                at += len(part)
        give_back()

    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = may_contain(texts, key_filter(places, "doc_id"), "doc_id")
    return texts.join(places, "doc_id").mapInArrow(run, "h1 long, h2 long, doc_id long, start int")


def _earlier(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition of windows those that aren't the first of their hash, with the first one in this partition.

    The hash of the partition's first row may go on from the partition before, so that row comes too, and rows with that hash carry
    it. Rows with `edge` are the first ones of the partition's first and of its last hash (the latter without doc_id).
    """
    names = ["h1", "h2", "doc_id", "start"]
    lead, held = None, None  # the partition's first hash; its last row so far with the first one of its hash

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in names]
        if held is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(held[:4], columns, strict=True)]
        h1, h2, ids, starts = columns
        same = np.zeros(len(h1), bool)
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h1))))
        first_ids, first_starts = ids[first], starts[first]
        keep, edge = same.copy(), np.zeros(len(h1), bool)
        keep[1:] &= (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])  # rows that repeat a doc_id
        if held is None:
            lead = h1[0], h2[0]
            keep[0] = edge[0] = True
        else:
            first_ids[first == 0], first_starts[first == 0] = held[4][0], held[5][0]
        other = ~((h1 == lead[0]) & (h2 == lead[1]))[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1[keep], mask=other), pa.array(h2[keep], mask=other), *[pa.array(x[keep]) for x in (ids, starts, first_ids, first_starts, edge)]],
            [*names, "first_doc_id", "first_start", "edge"],
        )
        held = [x[-1:] for x in (*columns, first_ids, first_starts)]
    if held is not None:
        h1, h2, _, _, first_id, first_start = (pa.array(x) for x in held)
        yield pa.RecordBatch.from_arrays([h1, h2, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), first_id, first_start, pa.array([True])], [*names, "first_doc_id", "first_start", "edge"])


def _again(windows: DataFrame) -> DataFrame:
    """doc_id, start, first_doc_id, first_start of the windows that occur before; windows is a written table.

    Windows are range-sorted by hash and place, so one that is in a third of all documents is spread over many tasks, and its first
    occurrence is the first row of its run. Runs that go over partitions are joined by two rows a partition.
    """
    order = ["h1", "h2", "doc_id", "start"]
    ordered = windows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ordered.mapInArrow(_earlier, "h1 long, h2 long, doc_id long, start int, first_doc_id long, first_start int, edge boolean"), "suffix-earlier")
    own = F.struct("first_doc_id", "first_start")
    edges = rows.filter("edge").groupBy("h1", "h2").agg(F.min(own).alias("before"))
    joined = rows.filter("doc_id is not null").join(F.broadcast(edges), ["h1", "h2"], "left").withColumn("first", F.coalesce("before", own))
    again = joined.select("doc_id", "start", F.col("first.first_doc_id").alias("first_doc_id"), F.col("first.first_start").alias("first_start"))
    return again.filter("doc_id <> first_doc_id or start <> first_start")


def repeats(docs: DataFrame) -> DataFrame:
    """A row for each repeated span: doc_id, start, n_words, and first_doc_id, first_start of where it occurs first."""
    table = cut(suffixes(docs), "suffixes")
    # A document's hashes are sorted in the same way; its number of words, which they settle, stands for its place.
    wholes = table.filter("word = -1 and n_words > 0").selectExpr("key h1", "other h2", "doc_id", "n_words start")
    copies = cut(_again(wholes).selectExpr("doc_id", "first_doc_id rep", "start n_words"), "suffix-copies")
    places = table.filter("word >= 0").select("key", "doc_id", "word").join(copies.select("doc_id"), "doc_id", "left_anti")
    found = cut(_repeated_places(cut(places, "suffix-places")), "suffix-repeated")
    again = _again(cut(_windows(docs, found), "suffix-windows"))
    # Consecutive windows of one alignment form a run; a document's windows are bounded by its own length.
    order = Window.partitionBy("doc_id").orderBy("start")
    joined = (F.lag("start").over(order) == F.col("start") - 1) & (F.lag("first_doc_id").over(order) == F.col("first_doc_id")) & (F.lag("first_start").over(order) == F.col("first_start") - 1)
    runs = again.withColumn("fresh", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    spans = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"),
        (F.max("start") - F.min("start") + LENGTH).cast("int").alias("n_words"),
        F.min("first_doc_id").alias("first_doc_id"),
        F.min("first_start").alias("first_start"),
    )
    whole = copies.filter(F.col("n_words") >= LENGTH).select("doc_id", F.lit(0).alias("start"), "n_words", F.col("rep").alias("first_doc_id"), F.lit(0).alias("first_start"))
    return spans.drop("run").unionByName(whole)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    words = Words([raw])
    keep = np.ones(len(raw), bool)
    for start, n in spans:
        end = min(start + n, len(words.begin))
        if start < end:
            keep[words.begin[start] : words.end[end - 1]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode()


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without their repeated spans; documents of which no word remains go.

    Spans belong to a row's text: those that repeat a doc_id with another text are documents of their own, after all others.
    """
    names = docs.columns
    key, own_spans, flag = fresh(names, "id", "spans", "gone")
    keyed = keyed_rows(docs, key)
    spans = cut(repeats(keyed.select(F.col(key).alias("doc_id"), "text")).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("spans")), "suffix-spans")
    bloom = cut(key_filter(spans, "doc_id"), "suffix-filter")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text"), batch.column(own_spans), strict=True):
                if own.as_py() is None or text.as_py() is None:
                    out.append(text.as_py())
                    continue
                left = _without(text.as_py(), [(s["start"], s["n_words"]) for s in own.as_py()])
                out.append(left if left.strip(" \t\n\v\f\r") else None)
            gone = pa.array([a is None and b.as_py() is not None for a, b in zip(out, batch.column("text"), strict=True)])
            columns = [pa.array(out, pa.string()) if k == "text" else batch.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*columns, gone], [*names, flag])

    kept = [quoted(c) for c in names]
    fine = may_contain(keyed, bloom, key, found=False).select(*kept)
    touched = may_contain(keyed, bloom, key)
    touched = touched.join(spans.select(F.col("doc_id").alias(key), F.col("spans").alias(own_spans)), key, "left")
    schema = StructType([*docs.schema.fields, StructField(flag, BooleanType())])
    done = touched.select(*kept, own_spans).mapInArrow(run, schema).filter(~F.col(flag)).select(*kept)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return fine.unionByName(done)


def query(docs: DataFrame) -> DataFrame:
    return repeats(docs)
