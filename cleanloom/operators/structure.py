"""Structure of a table: types of its columns, and the cells and records that don't fit.

Types form a lattice: an integer is a number; integers, numbers, dates and booleans are text. One aggregate over all columns counts for each type
how many cells fit it, and where the first one that doesn't is; such counts add up over tasks. A column's type is the narrowest that
SHARE of its cells fit, missing values apart, so the cells that break it are known in number without another pass. `cell_errors`
lists them, and `record_errors` the records of a file that are shorter or longer than its header.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, parsed_date, strip
from ..sources.delimited import header_of, lines_of, mangle
from ..sources.records import records
from ..sources.rows import RID, numbered, with_order
from .validate import FIRST_ROW

#: Share of a column's cells that must fit a type.
SHARE = 0.9
# Names of types, the narrowest first, and what cells of them look like.
INTEGER, NUMBER, DATE, BOOLEAN, TEXT = "integer", "number", "date", "boolean", "text"
_INTEGER = r"^[+-]?\d+$"
_NUMBER = r"(?i)^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"
_TRUTH = ("true", "false", "yes", "no")


def fits(cell: Column, kind: str) -> Column:
    """Whether a cell, which isn't missing, is of the type."""
    own = strip(cell)
    if kind == INTEGER:
        return own.rlike(_INTEGER)
    if kind == NUMBER:
        return own.rlike(_NUMBER)
    if kind == DATE:
        return F.when(own.rlike(r"\d") & ~own.rlike(_NUMBER), parsed_date(own).isNotNull()).otherwise(F.lit(False))
    if kind == BOOLEAN:
        return F.lower(own).isin(*_TRUTH)
    return F.lit(True)


@dataclass
class ColumnType:
    kind: str
    cells: int  # that aren't missing
    broken: int  # of these, how many don't fit
    first: int | None  # _rid of the first that doesn't


def column_types(df: DataFrame, columns: list[str] | None = None, share: float = SHARE) -> dict[str, ColumnType]:
    """The type of each column, from all cells in one pass."""
    return _measured(df, columns or [c for c in df.columns if c != RID], share)[0]


def _measured(df: DataFrame, columns: list[str], share: float) -> tuple[dict[str, ColumnType], int]:
    """Types, and the number of rows without any value."""
    rows, narrow = with_order(df), (INTEGER, NUMBER, DATE, BOOLEAN)
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    blank = F.lit(bool(columns))
    for cell in cells:
        blank &= F.coalesce(cell, F.lit("")) == ""
    flags = [F.struct((~is_missing(cell)).alias("some"), *(fits(cell, kind).alias(kind) for kind in narrow)) for cell in cells]
    flagged = rows.select(RID, blank.alias("blank"), *(flag.alias(f"f{k}") for k, flag in enumerate(flags)))
    totals = [F.count_if("blank").alias("blank")]
    for k in range(len(columns)):
        some = F.col(f"f{k}.some")
        totals.append(F.count_if(some).alias(f"n{k}"))
        for kind in narrow:
            own = F.coalesce(F.col(f"f{k}.{kind}"), F.lit(False))
            totals += [F.count_if(some & own).alias(f"{kind}{k}"), F.min(F.when(some & ~own, F.col(RID))).alias(f"{kind}_at{k}")]
    got = flagged.agg(*totals).first()
    out = {}
    for k, c in enumerate(columns):
        n = got[f"n{k}"]
        kind = next((t for t in narrow if n and got[f"{t}{k}"] >= share * n), TEXT)
        out[c] = ColumnType(kind, n, 0, None) if kind == TEXT else ColumnType(kind, n, n - got[f"{kind}{k}"], got[f"{kind}_at{k}"])
    return out, got["blank"]


def cell_errors(df: DataFrame, types: dict[str, ColumnType] | None = None) -> DataFrame:
    """row, field, error and message of each cell that breaks its column's type; row as in a spreadsheet, with the header as the first."""
    types = types or column_types(df)
    checked = [(c, t.kind) for c, t in types.items() if t.kind != TEXT and t.broken]
    found = [
        F.when(
            ~is_missing(f"`{c}`") & ~F.coalesce(fits(F.col(f"`{c}`").cast("string"), kind), F.lit(False)),
            F.struct(F.lit(c).alias("field"), F.lit("type-error").alias("error"), F.concat(F.lit("'"), F.col(f"`{c}`").cast("string"), F.lit(f"' is no {kind}")).alias("message")),
        )
        for c, kind in checked
    ]
    if not found:
        return df.sparkSession.createDataFrame([], "row long, field string, error string, message string")
    # Cells are judged where the rows are read; only what breaks a type is numbered with its row.
    judged = with_order(df).select(RID, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    return numbered(judged).select((F.col("_row") + FIRST_ROW).alias("row"), F.explode("found").alias("e")).select("row", "e.*")


def record_errors(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """row, field, error and message of the cells that records of a delimited file lack or have beyond its header."""
    lines = lines_of(spark, path, encoding)
    names = mangle(header_of(lines.rows))
    rows = records(lines.rows, lines.blocks).filter("not head").select(F.col("rid").alias(RID), "fields")
    rows = numbered(rows).filter(F.col("fields") != len(names)).withColumn("row", F.col("_row") + FIRST_ROW)
    places = F.when(F.col("fields") < len(names), F.sequence(F.col("fields") + 1, F.lit(len(names)))).otherwise(F.sequence(F.lit(len(names) + 1), "fields"))
    each = rows.select("row", F.explode(places).alias("at"))
    label = F.element_at(F.array(*map(F.lit, names)), F.when(F.col("at") <= len(names), F.col("at")).otherwise(F.lit(1)))
    lacks = F.col("at") <= len(names)
    return each.select(
        "row",
        F.when(lacks, label).otherwise(F.lit("")).alias("field"),
        F.when(lacks, F.lit("missing-cell")).otherwise(F.lit("extra-cell")).alias("error"),
        F.concat(F.lit("Cell "), F.col("at").cast("string"), F.when(lacks, F.lit(" is missing")).otherwise(F.lit(" is beyond the header"))).alias("message"),
    )


def structure_summary(df: DataFrame, share: float = SHARE) -> dict:
    """Labels that are blank or repeated, rows without any value, and columns with cells that break their type."""
    columns = [c for c in df.columns if c != RID]
    errors = [{"type": "blank-label", "message": f"Label in position {k + 1} is blank"} for k, c in enumerate(columns) if not c.strip()]
    errors += [{"type": "duplicate-label", "message": f"Label '{c}' occurs more than once"} for c in dict.fromkeys(columns) if columns.count(c) > 1]
    if columns and len(set(columns)) == len(columns):
        types, blank = _measured(df, columns, share)
        if blank:
            errors.append({"type": "blank-row", "message": f"{blank} rows are blank"})
        errors += [{"type": "type-error", "message": f"{t.broken} cells of '{c}' are no {t.kind}"} for c, t in types.items() if t.broken]
    return {"valid": not errors, "errors": errors}
