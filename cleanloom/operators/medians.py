"""Exact medians of many columns, without any column's values in one task.

Each round takes sketches of all columns in one aggregate, whose quantiles enclose the middle ranks, and counts in a second what lies
below, at and between them; ranks at an end are settled, and the next round looks between the ends only. A round leaves
some hundredth of the values, however they are distributed, so a table of any size takes a few. What is left, once it is
few values, is sorted by the driver. Sketches only choose where to look: counts decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of a sketch, and how many values are few enough to be sorted.
ACCURACY, FEW = 1000, 4096


@dataclass
class _Search:
    """The ranks of a column's middle values among those between two values (not included), or all of them."""

    value: Column
    n: int
    low: float | None = None
    high: float | None = None
    ranks: tuple[int, int] = (0, 0)
    found: float | None = None

    def inside(self) -> Column:
        own = self.value
        if self.low is not None:
            own = F.when(own > self.low, own)
        if self.high is not None:
            own = F.when(own < self.high, own)
        return own

    def narrow(self, low: float, high: float, got) -> None:
        """By counts of the values below low, at it, between, at high; and the least and greatest ones between."""
        a, b = self.ranks
        at_low, between, at_high = got["below"] + got["at_low"], got["between"], got["at_high"]
        if low == high:
            at_high, between = 0, 0

        def at(rank: int) -> float | None:
            """The value of a rank where the counts settle it."""
            if got["below"] <= rank < at_low:
                return low
            if at_low + between <= rank < at_low + between + at_high:
                return high
            return got["least"] if rank == at_low and between else got["most"] if between and rank == at_low + between - 1 else None

        first, second = at(a), at(b)
        if first is not None and second is not None:
            self.found = first if a == b else (first + second) / 2
        elif a < got["below"]:  # a sketch that missed: look below
            self.high, self.n = low, got["below"]
        elif b >= at_low + between + at_high:
            self.low, self.ranks, self.n = high, (a - at_low - between - at_high, b - at_low - between - at_high), self.n - at_low - between - at_high
        else:
            self.low, self.high, self.n, self.ranks = low, high, between, (a - at_low, b - at_low)


def medians(df: DataFrame, values: dict[str, Column], few: int = FEW) -> dict[str, float]:
    """The median of each column of doubles by name, nulls apart, as the mean of the two middle values; columns of nulls have none."""
    names = list(values)
    if not names:
        return {}
    own = df.select(*(v.alias(f"v{k}") for k, v in enumerate(values.values())))
    counts = own.agg(*(F.count(f"v{k}").alias(f"v{k}") for k in range(len(names)))).first()
    all_ = {k: _Search(F.col(f"v{k}"), counts[f"v{k}"], ranks=((counts[f"v{k}"] - 1) // 2, counts[f"v{k}"] // 2)) for k in range(len(names)) if counts[f"v{k}"]}
    while wide := {k: s for k, s in all_.items() if s.found is None and s.n > few}:
        margin = 2 / ACCURACY
        asked = {k: [max(0.0, s.ranks[0] / s.n - margin), min(1.0, s.ranks[1] / s.n + margin)] for k, s in wide.items()}
        near = own.agg(*(F.percentile_approx(s.inside(), asked[k], ACCURACY).alias(f"q{k}") for k, s in wide.items())).first()
        totals = []
        for k, s in wide.items():
            v, (low, high) = s.inside(), near[f"q{k}"]
            middle = F.when((v > low) & (v < high), v)
            totals.append(F.struct(F.count_if(v < low).alias("below"), F.count_if(v == low).alias("at_low"), F.count(middle).alias("between"), F.count_if(v == high).alias("at_high"), F.min(middle).alias("least"), F.max(middle).alias("most")).alias(f"c{k}"))
        got = own.agg(*totals).first()
        for k, s in wide.items():
            s.narrow(*near[f"q{k}"], got[f"c{k}"])
    if left := {k: s for k, s in all_.items() if s.found is None}:
        each = F.array(*(F.struct(F.lit(k).alias("k"), s.inside().alias("v")) for k, s in left.items()))
        rows = own.select(F.explode(each).alias("e")).select("e.*").filter("v is not null").groupBy("k", "v").count().collect()  # `few` rows a column at most
        for k, s in left.items():
            ordered = [v for v, n in sorted((r["v"], r["count"]) for r in rows if r["k"] == k) for _ in range(n)]
            a, b = (ordered[r] for r in s.ranks)
            s.found = a if s.ranks[0] == s.ranks[1] else (a + b) / 2
    return {names[k]: s.found for k, s in all_.items()}
