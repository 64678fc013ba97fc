"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has VNODES points on a ring of 62-bit hashes. A document's doc_id has a place on the ring and a turn (a second
hash, ties by checksum and size, then by a row number that is written with the turns). In the order of their turns documents go to the first shard clockwise that is not full; the shards'
capacities sum to the number of documents and differ by one at most, so the law is `rows`: counts are at most one apart.

That order looks sequential but is not: a document's shard depends only on its arc and on which shards were full at its
turn, so the whole outcome follows from the turn at which each shard fills. Those turns are found from histograms of
(arc, turn bin) of bounded size: bins in which no shard fills are added at once; a bin in which one fills is divided again
by further bits of the turn, then of checksum and size, then of the row number, until it has few enough documents (FINE) to
be placed one after the other on the driver. Then every document is placed independently, in one scan.

Defined cases: a null text has size 1 and the checksum of no bytes. A null doc_id hashes like any other value. Rows that
repeat a doc_id start from one place and go on to the next shard where theirs is full, so the law holds for them too; which of
the rows that are equal in all columns goes on makes no difference to the result. An empty table gives an empty result. Equal texts need not share a shard: a group may be larger than a shard.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

VNODES = 32
#: Histograms have SHARDS * VNODES arcs by 2**BITS bins at most; FINE bounds what is placed one by one.
BITS = 8
FINE = 4096
HASH_BITS = 62


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, by place."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> 64 - HASH_BITS
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def clockwise(points: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """For each arc, which ends at the point of that index, the shards in the order met from there; the last arc is the first again."""
    n, out = len(points), []
    for i in range(n):
        out.append(tuple(dict.fromkeys(points[(i + k) % n][1] for k in range(n))))
    return [*out, out[0]]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - HASH_BITS)


def _arc(points: list[tuple[int, int]]) -> Column:
    """The index of the first virtual node at or after `place`, by binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("place") <= F.lit(points[mid][0]), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(points))


#: The order in which rows are placed; no two rows are equal in all three.
KEY = ("turn", "mark", "number")


def _mark() -> Column:
    """Checksum and size in 62 bits."""
    return F.shiftleft("text_crc32", 30).bitwiseOR(F.col("size").bitwiseAND(F.lit((1 << 30) - 1)))


def _key(r) -> tuple:
    return tuple(r[k] for k in KEY)


class _Filling:
    """The state of all shards as turns go by."""

    def __init__(self, room: list[int], order: list[tuple[int, ...]]) -> None:
        self.room, self.order = list(room), order
        self.closed = {s: None for s, r in enumerate(room) if r == 0}

    def _first(self, arc: int) -> int:
        return next(s for s in self.order[arc] if s not in self.closed)

    def add(self, counts: dict[int, int]) -> bool:
        """All of a bin at once, if no shard fills in it."""
        need: dict[int, int] = defaultdict(int)
        for arc, n in counts.items():
            need[self._first(arc)] += n
        if any(n >= self.room[s] for s, n in need.items()):
            return False
        for s, n in need.items():
            self.room[s] -= n
        return True

    def one(self, row) -> None:
        s = self._first(row["arc"])
        self.room[s] -= 1
        if not self.room[s]:
            self.closed[s] = row


def fill(placed: DataFrame, room: list[int], order: list[tuple[int, ...]], spans: tuple[int, ...], fine: int = FINE) -> dict[int, object]:
    """For each shard that fills, the last row that it takes (None for a shard without room). spans: the bits of each part of KEY."""
    state = _Filling(room, order)

    def go(rows: DataFrame, level: int, span: int) -> None:
        key, shift = KEY[level], max(0, span - BITS)
        bins: dict[int, dict[int, int]] = defaultdict(dict)
        ends: dict[int, set[int]] = defaultdict(set)
        counts = rows.groupBy(F.shiftrightunsigned(key, shift).alias("bin"), "arc").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for r in counts.collect():
            bins[r["bin"]][r["arc"]] = r["n"]
            ends[r["bin"]] |= {r["low"], r["high"]}
        for b in sorted(bins):
            if state.add(bins[b]):
                continue
            # A range of turns is pushed down to the scan of the written table.
            inside = rows.filter((F.col(key) >= b << shift) & (F.col(key) < b + 1 << shift))
            if sum(bins[b].values()) <= fine:
                for r in sorted(inside.collect(), key=_key):
                    state.one(r)
            elif len(ends[b]) > 1:
                go(inside, level, shift)
            else:  # one value, so the next part of the key tells these rows apart
                go(inside.filter(F.col(key) == min(ends[b])), level + 1, spans[level + 1])

    go(placed, 0, spans[0])
    return state.closed


def assign(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, fine: int = FINE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    order = clockwise(points)
    raw = F.encode(text_or_empty(), "UTF-8")
    placed = (
        docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
        .withColumn("place", _hash(11))
        .select("doc_id", "size", "text_crc32", _arc(points).alias("arc"), _hash(13).alias("turn"), _mark().alias("mark"), F.monotonically_increasing_id().alias("number"))
    )
    placed = cut(placed, "ring-placed")
    rows, last_number = placed.agg(F.count(F.lit(1)), F.max("number")).first()
    closed = fill(placed, capacities(rows, shards), order, (HASH_BITS, HASH_BITS, (last_number or 0).bit_length()), fine)
    orders = spark.createDataFrame(list(enumerate(map(list, order))), "arc int, clockwise array<int>")
    own = F.struct(*KEY)

    def takes(s: Column) -> Column:
        """Whether shard s has room at this row's turn."""
        out = F.lit(True)
        for shard, last in closed.items():
            if last is None:
                out = F.when(s == shard, F.lit(False)).otherwise(out)
            else:
                end = F.struct(*[F.lit(last[k]).cast("long").alias(k) for k in KEY])
                out = F.when(s == shard, own <= end).otherwise(out)
        return out

    # A row for each arc: shards * vnodes + 1 rows, whatever the input's size.
    dealt = placed.join(F.broadcast(orders), "arc").withColumn("shard", F.get(F.filter("clockwise", takes), 0))
    # Slots count in the order of turns: counts of (shard, bin of turns) summed up, then the rank within the bin.
    bits = min(14, max(4, (rows // 20_000).bit_length()))
    dealt = dealt.withColumn("bin", F.shiftrightunsigned("turn", HASH_BITS - bits))
    before = (
        dealt.groupBy("shard", "bin")
        .count()
        .select("shard", "bin", (F.sum("count").over(Window.partitionBy("shard").orderBy("bin")) - F.col("count")).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy("shard", "bin").orderBy(*KEY)) - 1
    # shards * 2**14 rows at most.
    return dealt.join(F.broadcast(before), ["shard", "bin"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + inside).alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns under the law `rows`, over shards 0 to 7."""
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
