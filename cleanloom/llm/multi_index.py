"""Approximate nearest neighbours by multi-index hashing of learnt rotated binary codes.

A rotation is learnt (principal axes, then iterative quantisation) on a bounded sample, SAMPLE vectors by hash of vec_id; the signs
of the rotated coordinates are a vector's code of up to BITS bits. Codes are split into substrings of PART bits, each indexed. By
the pigeonhole principle a code within Hamming radius r of a query's agrees with it up to r // parts bits in at least one
substring, so probing the substrings' values that near retrieves every code within the radius; what is within it is ranked by
cosine in double precision on the original vectors. The radius is learnt on the sample too: RECALL of its true neighbours lie
within it, and in the whole table neighbours are nearer still. Queries with fewer than k answers within it are searched again
without a radius.

Every vector is indexed, in blocks of about BLOCK rows by hash of vec_id; the stated set of queries meets every block in
blocks of its own, so no task holds more than two blocks. Of equal vectors only the k + 1 of smallest vec_id can be
answers, so a group of equal vectors that holds a third of all rows adds k + 1 rows.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or have another length than most, and rows with
a null vec_id, take no part. Rows that repeat a vec_id with the same vector are one; other repeats answer and are answered as
their best. Ties go to the smaller vec_id. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS, PART, SAMPLE, RECALL, BLOCK, QUERIES = 64, 16, 3000, 0.97, 8192, 2048
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and raw (little-endian doubles) of the vectors that take part."""
    length = F.size("embedding")
    usual = embeddings.filter("embedding is not null").agg(F.mode(length, True)).first()[0] or 0
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (length == usual) & ~bad & F.exists("embedding", lambda x: x != 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([row.tobytes() for row in matrix], pa.binary())], ["vec_id", "raw"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return embeddings.filter(fine).select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, raw binary")


def _matrix(raw: Iterable[bytes]) -> np.ndarray:
    raw = list(raw)
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # lengths of very large or small vectors stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        signs = (_unit(x) - self.mean) @ self.rotation > 0
        short = -signs.shape[1] % PART
        signs = np.pad(signs, ((0, 0), (0, short)))
        return np.packbits(signs, axis=1).view(">u2").astype(np.uint16)


def learn(x: np.ndarray, k: int, rounds: int = 25) -> Codes:
    unit = _unit(x)
    mean = unit.mean(0)
    axes = np.linalg.svd(unit - mean, full_matrices=True)[2][: min(BITS, x.shape[1])].T
    flat, bits = (unit - mean) @ axes, axes.shape[1]
    turn = np.linalg.qr(np.random.default_rng(8).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    codes = Codes(mean, axes @ turn, bits)
    own = codes.of(x)
    asked = np.arange(0, len(x), max(1, len(x) // 300))
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, 1)[:, : min(k, len(x) - 1)]
    far = _ONES[own[asked][:, None] ^ own[best]].sum(2)
    codes.radius = int(np.quantile(far, RECALL)) if far.size else bits
    return codes


def probe(codes: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """For each asked code the indices of all codes within the radius, found through their substrings."""
    parts = codes.shape[1]
    each = radius // parts
    tables = []
    for p in range(parts):
        value, at = np.unique(codes[:, p], return_inverse=True)
        order = np.argsort(at, kind="stable")
        tables.append((value, order, np.searchsorted(at[order], np.arange(len(value) + 1))))
    for code in asked:
        found = np.zeros(len(codes), bool)
        for p, (value, order, first) in enumerate(tables):
            hit = _ONES[value ^ code[p]] <= each
            # The rows of the probed values, which lie together in the index.
            found[order[np.repeat(hit, np.diff(first))]] = True
        at = np.flatnonzero(found)
        yield at[_ONES[codes[at] ^ code].sum(1) <= radius]


def search(table: DataFrame, asked: DataFrame, codes: Codes, k: int, radius: int) -> DataFrame:
    """query_id, vec_id and score of the k best of each block and query; table and asked have an id and raw."""
    rows, queries = table.count(), asked.count()
    blocks, sets = -(-rows // BLOCK) or 1, -(-queries // QUERIES) or 1

    def one(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index) and len(wanted):
            index = index.sort_values("vec_id")
            ids, x, q = index["vec_id"].to_numpy(), _matrix(index["raw"]), _matrix(wanted["raw"])
            scale, scale_q = np.abs(x).max(1), np.abs(q).max(1)
            x, q = x / scale[:, None], q / scale_q[:, None]
            length, length_q = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            for i, at in enumerate(probe(codes.of(x), codes.of(q), radius)):
                own = int(wanted["query_id"].iloc[i])
                at = at[ids[at] != own]
                score = (x[at] * q[i]).sum(1) / (length[at] * length_q[i])
                best = np.argsort(-score, kind="stable")[:k]
                out += [(own, int(ids[at[b]]), float(score[b])) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def dealt(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    left = table.withColumn("block", dealt("vec_id", blocks)).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = asked.withColumn("set", dealt("query_id", sets)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "set").cogroup(right.groupBy("block", "set")).applyInPandas(one, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors of each row for which is_query holds."""
    every = cut(vectors(embeddings), "vectors")
    asked = every.filter(is_query).select(F.col("vec_id").alias("query_id"), "raw").distinct()
    turn = F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))
    table = cut(every.distinct().withColumn("n", turn).filter(F.col("n") <= k + 1).select("vec_id", "raw"), "index")
    rows = every.count()
    draw = F.pmod(F.xxhash64(F.lit(29), F.col("vec_id")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / max(1, rows))) + 1
    sample = every.filter(draw).limit(2 * SAMPLE).select("vec_id", "raw").collect()  # expected to be SAMPLE rows
    if not sample:
        sample = every.limit(1).collect()
    if not sample:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(r["raw"] for r in sorted(sample, key=lambda r: (r["vec_id"], r["raw"])))
    codes = learn(np.unique(x, axis=0), k)
    columns = ["query_id", "rank", "vec_id", "score"]
    found = cut(search(table, asked, codes, k, codes.radius).select(columns), "nearest")
    few = asked.join(found.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    few = cut(few, "unanswered")
    if few.isEmpty():
        return found
    again = search(table, few, codes, k, 16 * len(codes.of(x[:1])[0])).select(columns)
    return found.join(few.select("query_id").distinct(), "query_id", "left_anti").select(columns).unionByName(again)


def query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
