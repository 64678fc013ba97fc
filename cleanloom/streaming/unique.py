"""Uniqueness on streams: issues as repeated values occur, from state kept by value within a time limit.

A value's first row is held until a second one comes; then both get their issue, and every later row gets its own at once, so a stream
that ended would have given the issues of the table, in whatever batches its rows came. State is two fields a value, in the
checkpoint, and goes once the watermark has passed a value's last row by the limit: what comes later counts as a first row again.
A row that repeats many values is one task per value and batch, which reads row numbers only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import is_missing

ISSUES = "row {kind}, field string, check string, severity string, message string"


def uniqueness_stream(stream: DataFrame, fields: list[str], row: str, event_time: str, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Issues of the unique fields of a stream (row, field, check, severity, message), in append mode.

    row: the column that tells rows apart; event_time: a timestamp, whose watermark lags by delay; within: how long a value is held.
    """
    limit = int(pd.Timedelta(within).total_seconds() * 1000)
    kind = stream.schema[row].dataType.simpleString()
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.when(~is_missing(f"`{f}`"), F.col(f"`{f}`").cast("string")).alias("value")) for f in fields])
    long = stream.withWatermark(event_time, delay).select(F.col(f"`{row}`").alias("row"), F.col(f"`{event_time}`").alias("at"), F.explode(each).alias("e"))

    def run(key: tuple[str, str], parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        field, value = key
        first, last = state.get if state.exists else (None, 0)
        held = first is not None  # a first row that has no issue yet
        seen = state.exists
        message = f"Value '{value}' is not unique in field '{field}'"
        for part in parts:
            if part.empty:
                continue
            rows = part.sort_values(["at", "row"])
            last = max(last, int(rows["at"].max().timestamp() * 1000))
            found = rows["row"].tolist()
            if not seen:
                first, held, seen, found = str(found[0]), True, True, found[1:]
            if found and held:
                found, held = [type(found[0])(first) if not isinstance(found[0], str) else first, *found], False
            if found:
                yield pd.DataFrame({"row": found, "field": field, "check": "uniqueness", "severity": "error", "message": message})
        state.update((first if held else None, last))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))

    keyed = long.select("row", "at", "e.field", "e.value").filter("value is not null").groupBy("field", "value")
    return keyed.applyInPandasWithState(run, ISSUES.format(kind=kind), "first string, last long", "append", GroupStateTimeout.EventTimeTimeout)
