"""Records of delimited files, cut in many tasks though fields may hold line breaks.

Whether a line begins inside a quoted field depends on all lines before it. Each block of a file is therefore read for both cases,
which gives it a function from its first state to its last; functions of a file's blocks (a row each) are combined in order by
windows, so every block knows how it begins. A second pass then cuts records: those within a block as they come, and those that go
over blocks from their fragments, which are few. Nothing but such records is shuffled.

Quotes count where a field begins; a doubled quote is one; a quote elsewhere in a field without quotes is a sign like others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records of a block have numbers below 2**BITS.
BITS = 33
_START, _PLAIN, _QUOTED, _CLOSED = range(4)


def after(line: str, inside: bool) -> tuple[bool, int]:
    """Whether the line ends inside a quoted field, and how many delimiters of it part fields."""
    state, n, parts = _QUOTED if inside else _START, 0, line.split('"')
    for k, part in enumerate(parts):
        if part and state != _QUOTED:
            n += part.count(",")
            state = _START if part[-1] == "," else _PLAIN
        if k < len(parts) - 1:
            if state == _QUOTED:
                state = _CLOSED
            elif state in (_START, _CLOSED):
                state = _QUOTED  # it opens a field, or is the second of two
    return state == _QUOTED, n


def fields_of(record: str) -> int:
    inside, total = False, 1
    for line in record.split("\n"):
        inside, n = after(line, inside)
        total += n
    return total


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with one value of the column each."""
    values = batch.column(column).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1 if len(values) else []
    for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def _functions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, for either first state, its last state and whether a record ends in it."""
    held = None  # rank, states, ended

    def row(held) -> pa.RecordBatch:
        rank, states, ended = held
        return pa.RecordBatch.from_pydict({"rank": pa.array([rank], pa.int64()), "end_out": [states[0]], "end_in": [states[1]], "ended_out": [ended[0]], "ended_in": [ended[1]]})

    for batch in batches:
        for run in _runs(batch, "rank"):
            rank = run.column("rank")[0].as_py()
            if held is None or held[0] != rank:
                if held is not None:
                    yield row(held)
                held = (rank, [False, True], [False, False])
            _, states, ended = held
            values, before = run.column("value"), -1
            for at in [*np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist(), len(values)]:
                for k in (0, 1):
                    # Lines without quotes are records, or ends of them, where the state is outside.
                    ended[k] |= at - before > 1 and not states[k]
                    if at < len(values):
                        states[k] = after(values[at].as_py(), states[k])[0]
                        ended[k] |= not states[k]
                before = at
    if held is not None:
        yield row(held)


def held(blocks: DataFrame) -> DataFrame:
    """The rows of blocks, which are a row for each part of a file that a task reads (128 MB by default), by way of the driver: they
    are read several times, and a cache by plan would outlive a file that is written anew."""
    return blocks.sparkSession.createDataFrame(blocks.collect(), blocks.schema)


def beginnings(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, block, rank, inside (whether the block begins inside a quoted field), origin (the rank of the block in which the record
    begins that goes on there) and last (of its file).

    lines: path, block, value; blocks: path, block and quotes, a row for each block.
    """
    order = Window.partitionBy("path").orderBy("block")
    ranked = blocks.select("path", "block", "quotes", (F.row_number().over(Window.orderBy("path", "block")) - 1).cast("long").alias("rank"), (F.lead("block").over(order).isNull()).alias("last"))
    if ranked.filter("quotes > 0 and not last").isEmpty():  # no block but the last of a file can end inside a field
        return ranked.select("path", "block", "rank", F.lit(False).alias("inside"), F.lit(None).cast("long").alias("origin"), "last")
    keyed = lines.join(F.broadcast(ranked.select("path", "block", "rank")), ["path", "block"]).select("rank", "value")
    found = ranked.join(keyed.mapInArrow(_functions, "rank long, end_out boolean, end_in boolean, ended_out boolean, ended_in boolean"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when(F.col("end_out") & ~F.col("end_in"), 1).otherwise(0)
    found = found.withColumn("swaps", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").cast("int").alias("to"), F.col("swaps").alias("at")))
    found = found.withColumn("fixed", F.last(fixed, True).over(before))
    odd = (F.coalesce("fixed.to", F.lit(0)) + F.col("swaps") - F.coalesce("fixed.at", F.lit(0))) % 2
    found = found.withColumn("inside", odd == 1)
    opens = F.when(F.col("inside"), F.col("end_in") & F.col("ended_in")).otherwise(F.col("end_out"))
    return found.select("path", "block", "rank", "inside", F.last(F.when(opens, F.col("rank")), True).over(before).alias("origin"), "last")


class _Cutter:
    """Records of one block: whole ones, and fragments of those that go over its ends."""

    def __init__(self, path: str, rank: int, inside: bool, origin: int | None, last: bool) -> None:
        self.path, self.rank, self.inside, self.last = path, rank, inside, last
        self.open: list[str] = []
        self.key = origin if inside else None  # where the open record begins, if not here
        self.fields, self.n = 0, 0
        self.out: list[tuple[int | None, int | None, str, int]] = []  # rid, key of a fragment, record, fields

    def _rid(self) -> int:
        self.n += 1
        return (self.rank << BITS) + self.n - 1

    def line(self, line: str) -> None:
        if '"' in line:
            self.inside, n = after(line, self.inside)
        else:
            n = 0 if self.inside else line.count(",")
        self.fields += n
        self.open.append(line)
        if not self.inside:
            record = "\n".join(self.open)
            record = record[:-1] if record.endswith("\r") else record
            if self.key is not None:
                self.out.append((None, self.key, record, 0))
            elif record.strip(" \t\r"):
                self.out.append((self._rid(), None, record, self.fields + 1))
            self.open, self.key, self.fields = [], None, 0

    def end(self) -> None:
        if self.open:
            if self.last:
                raise ValueError(f"A quoted field of {self.path} is not closed before the end of the file")
            self.out.append((None if self.key is not None else self._rid(), self.rank if self.key is None else self.key, "\n".join(self.open), 0))

    def taken(self) -> pa.RecordBatch:
        rids, keys, texts, fields = zip(*self.out, strict=True) if self.out else ([], [], [], [])
        self.out = []
        return _batch(self.path, self.rank, pa.array(rids, pa.int64()), pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(fields, pa.int32()))


def _batch(path: str, rank: int, rids: pa.Array, keys: pa.Array, texts: pa.Array, fields: pa.Array) -> pa.RecordBatch:
    n = len(rids)
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.repeat(pa.scalar(rank, pa.int64()), n), rids, keys, texts, fields], ["path", "rank", "rid", "fragment", "record", "fields"])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter: _Cutter | None = None
    for batch in batches:
        for run in _runs(batch, "rank"):
            first = {k: run.column(k)[0].as_py() for k in ("path", "rank", "inside", "origin", "last")}
            if cutter is None or cutter.rank != first["rank"]:
                if cutter is not None:
                    cutter.end()
                    yield cutter.taken()
                cutter = _Cutter(**first)
            values = run.column("value")
            if not cutter.inside and not pc.any(pc.match_substring(values, '"')).as_py():
                # No quotes: lines are records.
                texts = pc.replace_substring_regex(values, r"\r$", "")
                texts = texts.filter(pc.not_equal(pc.utf8_trim(texts, " \t\r"), ""))
                rids = (cutter.rank << BITS) + cutter.n + np.arange(len(texts))
                cutter.n += len(texts)
                yield _batch(cutter.path, cutter.rank, pa.array(rids, pa.int64()), pa.nulls(len(texts), pa.int64()), texts, pc.cast(pc.add(pc.count_substring(texts, ","), 1), pa.int32()))
                continue
            for line in values.to_pylist():
                cutter.line(line)
            yield cutter.taken()
    if cutter is not None:
        cutter.end()
        yield cutter.taken()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = pa.array([fields_of(r) for r in batch.column("record").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, fields], [*batch.schema.names, "fields"])


def records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, rid (rising in the order of path and place), record, fields (how many it has) and head (whether it is its file's first)
    of all records but blank ones."""
    starts = held(beginnings(lines, blocks))
    own = lines.join(F.broadcast(starts), ["path", "block"]).select("path", "rank", "inside", "origin", "last", "value")
    cut = own.mapInArrow(_cut, "path string, rank long, rid long, fragment long, record string, fields int")
    found = cut.filter("fragment is null").select("path", "rid", "record", "fields")
    if not starts.filter("not last").isEmpty():
        parts = cut.filter("fragment is not null").groupBy("path", "fragment").agg(F.max("rid").alias("rid"), F.array_sort(F.collect_list(F.struct("rank", "record"))).alias("each"))
        joined = parts.select("path", "rid", F.array_join(F.transform("each", lambda x: x["record"]), "\n").alias("record"))
        found = found.unionByName(joined.mapInArrow(_counted, "path string, rid long, record string, fields int"))
    first = starts.filter("block = 0").select("path", F.shiftleft("rank", BITS).alias("begin"))
    return found.join(F.broadcast(first), "path").select("path", "rid", "record", "fields", (F.col("rid") == F.col("begin")).alias("head"))
