"""MinHash near-duplicates with sequential Bayesian verification.

1. One Arrow pass over the texts gives each document's number of distinct shingles, a digest of the set and a MinHash
   signature of BANDS * ROWS values. Documents with equal sets are one class, held by its smallest doc_id.
2. Classes whose signatures agree on a band are candidates. First each class of a band's bucket meets one other: the smallest
   one, or, in buckets of more than SMALL classes, the most central one, which has the smallest share of shingles of its own.
   Components are formed from what these confirm, and then all pairs across components are candidates, but for those of
   large buckets that the exact differences of both from the center rule out (`_many_across`). No pair within a component is
   made, so a group of n near copies of one text costs about n comparisons, and no link between components is lost.
3. A candidate's signatures are compared in batches: once the posterior chance (uniform prior) that the similarity reaches the
   threshold is under MISS, the pair is dropped. Survivors are verified exactly on the full sets of 64-bit shingle hashes.

The bounds separate variants of one text whose edits are mostly their own. A large bucket of many texts that share the same few
edits in all combinations, all just below the threshold, would still have all its pairs compared.

With 25 bands of 5 rows a pair at the threshold of 0.85 shares a band but for a chance of 4e-7 (at 0.8, 5e-5); MISS is 1e-6 for each batch.

Defined cases: a null text or one without words has the empty set and is linked with nothing. A null doc_id takes no part: its
component_id is null and the row is kept. Rows that repeat a doc_id are one node of `near_groups`; `drop_near_copies` judges each
text of such a doc_id for itself. Empty tables give empty results. Other
columns are ignored by `near_groups` and kept by `drop_near_copies`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, fresh, give_back, key_filter, keyed_rows, may_contain, quoted, without_keys
from .components import components
from .words import mix, shingle_sets

BANDS, ROWS, WORDS = 25, 5, 5
MISS = 1e-6
SMALL = 32
_random = np.random.default_rng(10)
_A = _random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a non-empty set."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(high), 512):
        np.minimum(least, (high[k : k + 512] * _A + _B).min(0), out=least)
    return least


def sets_of(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    return shingle_sets([t.encode().lower() for t in texts], words)  # bytes.lower() changes A-Z only


def needed(threshold: float, miss: float = MISS, batch: int = 25) -> list[tuple[int, int]]:
    """(n, m): after n values, pairs with fewer than m equal ones have a posterior chance under `miss` to reach the threshold.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is that of a binomial of n + 1 draws.
    """
    out = []
    for n in range(batch, BANDS * ROWS + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sig; digest and sig are null for the empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text")):
                sets = sets_of(part, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "sig"],
                )
                at += len(part)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sig binary")


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key ^ (sig[:, :, r] + np.uint64(0x9E3779B97F4A7C15)))
            rep = batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), rep], ["bucket", "rep"])


def buckets(classes: DataFrame) -> DataFrame:
    """bucket, rep, leader (the bucket's smallest) and size, of the buckets with more than one class."""
    every = classes.select("rep", "sig").mapInArrow(_bands, f"bucket long, rep {classes.schema['rep'].dataType.simpleString()}")
    shared = every.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return cut(every.join(shared, "bucket"), "buckets")


def _pruned(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that survive the sequential comparison of their signatures."""
    steps = needed(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for k in ("sig_a", "sig_b"))
                alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
                for n, m in steps:
                    equal = equal + (a[alive, done:n] == b[alive, done:n]).sum(1)
                    alive, equal, done = alive[equal >= m], equal[equal >= m], n
                yield batch.select(["a", "b"]).take(pa.array(alive))

    kind = pairs.schema["a"].dataType.simpleString()
    left = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and set (hashes) of the documents named in ids; a filter of bounded size keeps other texts from being shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text")):
                sets = sets_of(part, words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "set"])
                at += len(part)

    kind = ids.schema["id"].dataType.simpleString()
    texts = may_contain(docs.select(F.col("doc_id").alias("id"), "text"), key_filter(ids, "id"), "id")
    return texts.join(ids, "id", "left_semi").distinct().mapInArrow(run, f"id {kind}, set array<long>")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, the sizes of their full sets and what these have in common. Sets are compared row by row in the JVM, not in batches."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y")).alias("both")
    return pairs.join(right, "b").join(left, "a").select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), both).distinct()


def _links(met: DataFrame, limit: int) -> DataFrame:
    return met.filter(F.expr(f"100L * both >= {limit} * (n_a + n_b - both)")).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _central(many: DataFrame, sets: DataFrame) -> DataFrame:
    """The members (bucket, rep) of large buckets, with n, the size of their sets, alone, how many of their shingles no other
    member of any large bucket has, and center, the member of the bucket with the smallest share of such shingles."""
    own = sets.join(many.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    single = own.select("id", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    sizes = own.select(F.col("id").alias("rep"), F.size("set").alias("n")).distinct()
    sizes = cut(sizes.join(single.groupBy("rep").agg(F.count(F.lit(1)).cast("int").alias("alone")), "rep", "left").fillna(0, ["alone"]), "large-members")
    members = many.join(sizes, "rep")
    centers = members.groupBy("bucket").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), F.col("rep").alias("center"))).alias("best"))
    return cut(members.join(centers.select("bucket", "best.center"), "bucket").select("bucket", "rep", "n", "alone", "center"), "large-buckets")


def _few_across(few: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs (a, b) across components in buckets of bounded size: at most small ** 2 / 2 each."""
    labelled = few.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("part"))
    several = labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    open_ = cut(labelled.join(several.select("bucket"), "bucket"), "few-across")
    return open_.alias("x").join(open_.alias("y"), "bucket").filter("x.rep < y.rep and x.part <> y.part").select(*_pair("x.rep", "y.rep"))


def _many_across(many: DataFrame, met: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) across components in large buckets that may be links.

    Against the center's set a member has `own` shingles more and `lost` ones less; `alone` of its own no other member has. Two
    sets differ at least by own and lost of both, less twice what these can have in common, which is no more than the lesser
    lost and the lesser own that isn't alone. Where that is too much for a link, the pair is never made. The bound depends on
    four numbers, so it is taken for the distinct ones of a bucket, its profiles, and only members of profiles that fit are paired.
    """
    key = ["n", "own", "lost", "alone"]
    root = roots.withColumnRenamed("node", "rep")
    of_center = root.select(F.col("rep").alias("center"), F.col("root").alias("main"))
    with_center = met.select("a", "b", "both", F.col("n_a"), F.col("n_b"))
    seen = (
        many.filter("rep <> center")
        .select("*", *_pair("rep", "center"))
        .join(with_center, ["a", "b"])
        .select("bucket", "rep", "center", "n", "alone", (F.col("n") - F.col("both")).alias("own"), (F.col("n_a") + F.col("n_b") - F.col("n") - F.col("both")).alias("lost"))
    )
    center = many.filter("rep = center").select("bucket", "rep", "center", "n", "alone", F.lit(0).alias("own"), F.lit(0).alias("lost"))
    members = seen.unionByName(center).join(root, "rep", "left").join(of_center, "center", "left")
    members = members.select("bucket", "rep", *key, F.coalesce("root", "rep").alias("part"), F.coalesce("main", "center").alias("main"))
    members = cut(members, "large-profiles")
    # Those of the center's component are linked with each other already: one side of a pair is always another component's.
    apart = members.filter("part <> main")
    left = apart.select("bucket", *(F.col(k).alias(f"{k}_x") for k in key)).distinct()
    right = members.select("bucket", *(F.col(k).alias(f"{k}_y") for k in key)).distinct()
    common = "least(own_x - alone_x, own_y - alone_y) + least(lost_x, lost_y)"
    fits = F.expr(f"(100 + {limit}) * (own_x + lost_x + own_y + lost_y - 2 * ({common})) <= (100 - {limit}) * (n_x + n_y)")
    profiles = cut(left.join(right, "bucket").filter(fits), "profiles-that-fit")
    one = apart.select("bucket", F.col("rep").alias("x"), F.col("part").alias("part_x"), *(F.col(k).alias(f"{k}_x") for k in key))
    other = members.select("bucket", F.col("rep").alias("y"), F.col("part").alias("part_y"), *(F.col(k).alias(f"{k}_y") for k in key))
    wide = one.join(profiles, ["bucket", *(f"{k}_x" for k in key)]).select("bucket", "x", "part_x", *(f"{k}_y" for k in key))
    return wide.join(other, ["bucket", *(f"{k}_y" for k in key)]).filter("part_x <> part_y").select(*_pair("x", "y"))


def roots_of(classes: DataFrame, docs: DataFrame, threshold: float, words: int = WORDS, small: int = SMALL) -> DataFrame:
    """node and root of the classes that links connect to a smaller one; what all links of shared buckets would connect."""
    limit = round(threshold * 100)
    table = buckets(classes)
    few, many = table.filter(F.col("size") <= small), table.filter(F.col("size") > small).select("bucket", "rep")
    stars = few.filter("rep <> leader").groupBy("rep").agg(F.min("leader").alias("leader")).select(*_pair("rep", "leader"))
    pairs = cut(_pruned(stars, classes, threshold), "survivors")
    ids = cut(_ends(pairs).unionByName(many.select(F.col("rep").alias("id"))).distinct(), "compared")
    sets = cut(_sets(docs, ids, words), "sets")
    large = not many.isEmpty()
    if large:
        many = _central(many, sets)
        pairs = pairs.unionByName(many.filter("rep <> center").select(*_pair("rep", "center"))).distinct()
    met = cut(_met(pairs, sets), "met")
    links = _links(met, limit)
    roots = components(links)
    more = _few_across(few.select("bucket", "rep"), roots)
    if large:
        more = more.unionByName(_many_across(many, met, roots, limit))
    tested = met.select("a", "b").unionByName(stars)
    more = cut(more.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    pairs = cut(_pruned(more, classes, threshold), "survivors")
    if pairs.isEmpty():
        return roots
    sets = cut(_sets(docs, _ends(pairs).distinct(), words), "sets")
    return components(links.unionByName(_links(cut(_met(pairs, sets), "met"), limit)))


def near_groups(docs: DataFrame, threshold: float = 0.85, words: int = WORDS, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    table = cut(signatures(docs, words), "signatures")
    usable = table.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    roots = roots_of(classes, docs, threshold, words, small)
    of_class = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("digest", F.coalesce("root", "rep").alias("root"))
    out = table.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that are the first of their group, and those with a null doc_id, with all their columns.

    Rows are judged by their text: those that repeat a doc_id with another text are documents of their own.
    """
    (key,) = fresh(docs.columns, "row_key")
    rows = keyed_rows(docs, key)
    dropped = near_groups(rows.select(F.col(key).alias("doc_id"), "text"), threshold).filter(~F.col("kept")).select(F.col("doc_id").alias(key))
    return without_keys(rows, cut(dropped.distinct(), "near-dropped"), key).select(*map(quoted, docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return near_groups(docs)
