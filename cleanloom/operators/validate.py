"""Validation: completeness, uniqueness, validity and consistency as issue rows, and their summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.rows import RID, numbered, with_order

#: Spreadsheet rows: the header is row 1.
FIRST_ROW = 2
#: Names of checks and severities, and the wording of messages, here and below.
ISSUE = "struct<field:string,check:string,severity:string,message:string>"


def _issue(when: Column, field: str, check: str, severity: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")).cast(ISSUE))


def _said(before: str, value: str, after: str = "") -> Column:
    return F.concat(F.lit(f"{before}'"), F.col(f"`{value}`").cast("string"), F.lit(f"'{after}"))


def with_repeats(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with, for each field, whether its value, if not missing, occurs more than once.

    Counts are combined map-side and only repeated values are joined back: few rows as a rule, and if one value holds a third of
    all rows the join is one that adaptive execution splits, where a window over the value would be one task.
    """
    for k, f in enumerate(fields):
        seen = df.filter(~S.is_missing(f"`{f}`")).groupBy(F.col(f"`{f}`").alias(f"_v{k}")).count().filter("count > 1")
        df = df.join(seen.select(f"_v{k}"), F.col(f"`{f}`") == F.col(f"_v{k}"), "left").withColumn(f"_u{k}", F.col(f"_v{k}").isNotNull()).drop(f"_v{k}")
    return df


def issues_of(df: DataFrame, required: list[str], unique: list[str], date_format: str = "%Y-%m-%d", region: str = "US", strict_dates: bool = True) -> DataFrame:
    """row (as _rid), pos, field, check, severity, message: row by row, required and unique fields first, then column by column."""
    columns = [c for c in df.columns if c != RID]
    unique = [f for f in unique if f in columns]
    found = [_issue(S.is_missing(f"`{f}`"), f, "completeness", "error", F.lit(f"Required field '{f}' is empty")) for f in required if f in columns]
    found += [_issue(F.col(f"_u{k}"), f, "uniqueness", "error", _said("Value ", f, f" is not unique in field '{f}'")) for k, f in enumerate(unique)]
    for c in columns:
        there, name = ~S.is_missing(f"`{c}`"), c.lower()
        if "email" in name:
            found.append(_issue(there & ~S.is_valid_email(f"`{c}`"), c, "validity", "error", _said("Invalid email format: ", c)))
        if "phone" in name:
            found.append(_issue(there & ~S.is_valid_phone(f"`{c}`", region), c, "validity", "warning", _said("Invalid phone format: ", c)))
        if "date" in name and strict_dates:
            found.append(_issue(there & ~S.matches_date_format(f"`{c}`", date_format), c, "consistency", "warning", _said(f"Date format inconsistent with {date_format}: ", c)))
    each = F.array(*found) if found else F.array().cast(f"array<{ISSUE}>")
    rows = with_repeats(df, unique).select(F.col(RID).alias("row"), F.posexplode(each).alias("pos", "issue"))
    return rows.filter("issue is not null").select("row", "pos", "issue.*")


@dataclass
class ValidationReport:
    issues: DataFrame
    required_fields: list[str]
    unique_fields: list[str]
    date_format: str
    total_records: int

    def _totals(self):
        if not hasattr(self, "_seen"):
            self._seen = self.issues.agg(
                F.count_if(F.col("severity") == "error").alias("errors"),
                F.count_if(F.col("severity") == "warning").alias("warnings"),
                F.count_distinct("row").alias("flagged"),
            ).first()
        return self._seen

    @property
    def errors(self) -> int:
        return self._totals()["errors"]

    @property
    def warnings(self) -> int:
        return self._totals()["warnings"]

    @property
    def valid(self) -> bool:
        return not self.errors

    @property
    def flagged(self) -> int:
        return self._totals()["flagged"]

    def flagged_rows(self) -> DataFrame:
        return self.issues.select("row").distinct()

    @property
    def quality_score(self) -> float:
        total = max(self.total_records, 1)
        return round((total - self.flagged) / total * 100, 1) if self.flagged else 100.0

    def summary(self) -> dict:
        return {"total_records": max(self.total_records, 1), "quality_score": self.quality_score, "errors": self.errors, "warnings": self.warnings, "records_to_review": self.flagged}

    def checks(self) -> dict[str, dict[str, int]]:
        """Failed, and passed as records without that failure, by check in the order of first failure."""
        rows = self.issues.groupBy("check").agg(F.count(F.lit(1)).alias("failed"), F.count_distinct("row").alias("rows"), F.min(F.struct("row", "pos")).alias("first")).collect()
        return {r["check"]: {"failed": r["failed"], "passed": max(0, self.total_records - r["rows"])} for r in sorted(rows, key=lambda r: r["first"])}

    def issues_frame(self) -> DataFrame:
        """With spreadsheet row numbers, in order."""
        return self.issues.orderBy("row", "pos").select((F.col("row") + FIRST_ROW).alias("row"), "field", "check", "severity", "message")

    def passing(self, df: DataFrame, n: int = 10) -> DataFrame:
        """The first n rows of df without an issue."""
        return df.join(self.flagged_rows().withColumnRenamed("row", RID), RID, "left_anti").orderBy(RID).limit(n)


def validate_data(df: DataFrame, required_fields: list[str], unique_fields: list[str], date_format: str = "%Y-%m-%d", default_region: str = "US", strict_dates: bool = True) -> ValidationReport:
    if RID not in df.columns:
        df = numbered(with_order(df)).drop(RID).withColumnRenamed("_row", RID)
    return ValidationReport(issues_of(df, required_fields, unique_fields, date_format, default_region, strict_dates), required_fields, unique_fields, date_format, df.count())
