"""Audit of a later export against what was delivered, by key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, strip
from ..sources.rows import RID, with_order


def _normal(c: str) -> Column:
    return F.when(is_missing(f"`{c}`"), F.lit("")).otherwise(strip(f"`{c}`"))


@dataclass
class AuditResult:
    """Keys and all numbers come from sides grouped by key once: keys that each side has once are compared there, and of those that a side
    repeats (blank ones, as a rule) pairs are counted without making them. Rows are joined, n by m, only where `mismatches` is read."""

    missing_keys: DataFrame  # key, in order
    unexpected_keys: DataFrame
    mismatches: DataFrame  # key, field, expected, imported; field by field, in the order of the expected rows
    fields: list[str]
    tallies: Callable[[], dict]

    def _counts(self) -> dict:
        if not hasattr(self, "_seen"):
            self._seen = self.tallies()
        return self._seen

    @property
    def expected_records(self) -> int:
        return self._counts()["expected_records"]

    @property
    def imported_records(self) -> int:
        return self._counts()["imported_records"]

    def mismatches_by_field(self) -> dict[str, int]:
        return self._counts()["mismatches_by_field"]

    def stats(self) -> dict:
        by_field = self.mismatches_by_field()
        figures = {k: self._counts()[k] for k in ("expected_records", "imported_records", "missing_records", "unexpected_records")}
        return {**figures, "mismatched_values": sum(by_field.values()), "mismatches_by_field": by_field}


def side(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, and row: _rid and the fields' normal values."""
    return with_order(df).select(_normal(key).alias("key"), F.struct(F.col(RID).alias("rid"), *[_normal(f).alias(f"f{k}") for k, f in enumerate(fields)]).alias("row"))


def by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of each key how many rows the sides have (e, i), and a row of each (x, y): the only one, where it has one. Combined map-side."""
    none = F.lit(None).cast(left.schema["row"].dataType)
    both = left.select("key", F.col("row").alias("x"), none.alias("y")).unionByName(right.select("key", none.alias("x"), F.col("row").alias("y")))
    return both.groupBy("key").agg(F.count("x").alias("e"), F.count("y").alias("i"), F.max("x").alias("x"), F.max("y").alias("y"))


#: Keys that both sides have, once each, or more often.
ONCE, OFTEN = "e = 1 and i = 1", "e > 0 and i > 0 and (e > 1 or i > 1)"


def _unlike(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rid of either row, pos and values of each field that differs between the rows x and y of a key."""
    pairs = [F.struct(F.lit(k).alias("pos"), F.lit(f).alias("field"), F.col(f"x.f{k}").alias("expected"), F.col(f"y.f{k}").alias("imported")) for k, f in enumerate(fields)]
    different = F.filter(F.array(*pairs), lambda p: p["expected"] != p["imported"])
    return rows.select("key", F.col("x.rid").alias("erid"), F.col("y.rid").alias("irid"), F.explode(different).alias("m"))


def _tallied(left: DataFrame, right: DataFrame, grouped: DataFrame, fields: list[str], blank: bool) -> dict:
    """All numbers of stats(), from one aggregate over keys and, where keys repeat, one over counts of their fields' values."""
    own = F.lit(True) if blank else F.col("key") != ""
    named = F.col("key") != ""
    once = [F.count_if(F.expr(ONCE) & own & (F.col(f"x.f{k}") != F.col(f"y.f{k}"))).alias(f"f{k}") for k in range(len(fields))]
    got = grouped.agg(
        F.sum("e").alias("e"), F.sum("i").alias("i"), F.count_if(named & (F.col("i") == 0)).alias("missing"), F.count_if(named & (F.col("e") == 0)).alias("unexpected"),
        F.count_if(F.expr(OFTEN) & own).alias("often"), *once,
    ).first()
    counts = [got[f"f{k}"] for k in range(len(fields))]
    if got["often"] and fields:
        # Of n and m rows with a key, those pairs differ in a field that aren't of one value: n * m less the sum over values.
        keys = grouped.filter(F.expr(OFTEN) & own).select("key")
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"row.f{k}").alias("v")) for k in range(len(fields))])).alias("f")
        values = None
        for df, e, i in ((left, 1, 0), (right, 0, 1)):
            part = df.join(keys, "key", "left_semi").select("key", each).select("key", "f.*", F.lit(e).cast("decimal(20,0)").alias("e"), F.lit(i).cast("decimal(20,0)").alias("i"))
            values = part if values is None else values.unionByName(part)
        alike = values.groupBy("key", "k", "v").agg(F.sum("e").cast("decimal(18,0)").alias("e"), F.sum("i").cast("decimal(18,0)").alias("i"))
        per_key = alike.groupBy("key", "k").agg(F.sum("e").cast("decimal(18,0)").alias("e"), F.sum("i").cast("decimal(18,0)").alias("i"), F.sum(F.col("e") * F.col("i")).cast("decimal(38,0)").alias("same"))
        for r in per_key.groupBy("k").agg(F.sum((F.col("e") * F.col("i")).cast("decimal(38,0)") - F.col("same")).alias("n")).collect():
            counts[r["k"]] += int(r["n"])
    return {
        "expected_records": got["e"] or 0, "imported_records": got["i"] or 0, "missing_records": got["missing"], "unexpected_records": got["unexpected"],
        "mismatches_by_field": dict(zip(fields, counts, strict=True)),
    }


def audit_import(expected: DataFrame, exported: DataFrame, key: str, fields: list[str] | None = None, match_blank_keys: bool = True) -> AuditResult:
    for df, name in ((expected, "expected"), (exported, "exported")):
        if key not in df.columns:
            raise KeyError(f"Key column '{key}' is missing from the {name} file")
    fields = [f for f in fields or expected.columns if f not in (key, RID) and f in expected.columns and f in exported.columns]
    left, right = side(expected, key, fields), side(exported, key, fields)
    grouped = by_key(left, right)
    if fields:
        rows = left.withColumnRenamed("row", "x").join(right.withColumnRenamed("row", "y"), "key")
        unlike = _unlike(rows if match_blank_keys else rows.filter("key <> ''"), fields)
        mismatches = unlike.orderBy("m.pos", "erid", "irid").select("key", "m.field", "m.expected", "m.imported")
    else:
        mismatches = expected.sparkSession.createDataFrame([], "key string, field string, expected string, imported string")
    keys = grouped.filter("key <> ''")
    return AuditResult(keys.filter("i = 0").select("key").orderBy("key"), keys.filter("e = 0").select("key").orderBy("key"), mismatches, fields, lambda: _tallied(left, right, grouped, fields, match_blank_keys))
