"""The scalar functions under SQL names: temporary functions of a session, whose bodies are the Column forms.

A body is SQL text, so Catalyst inlines it and `SELECT phone_e164(x)` has the plan of the Column form. The text is what a Column shows
of itself, with its operators, which it shows as function calls, in backticks, as SQL has them as functions under these names. Spark has no
Unicode normalisation, so `ascii_fold` is registered as the Arrow function that it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import scalars as S

#: A quoted text, which stays as it is, or an operator that is called like a function.
_CALL = re.compile(r"""('(?:[^'\\]|\\.|'')*')|(?<![\w`.'])((?:and|or|not|in|like|rlike|div)|[-+*/%<>=!&|^~]+)\(""", re.S)
_PARAMETER = "value"


def sql_text(made: Column) -> str:
    """SQL of an expression over columns."""
    shown = str(made)
    if not (shown.startswith("Column<'") and shown.endswith("'>")):
        raise ValueError(f"Not a Column: {shown[:80]}")
    return _CALL.sub(lambda m: m[1] or f"`{m[2]}`(", shown[8:-2])


def functions_of(region: str = "US", date_format: str = "%Y-%m-%d", day_first: bool = False, this_year: int | None = None) -> dict[str, tuple[str, Callable[[Column], Column]]]:
    """Type and Column form of each function, by SQL name."""
    text = {
        "trim_whitespace": S.trim_whitespace,
        "email_lowercase": S.email_lowercase,
        "upper_case": S.upper_case,
        "lower_case": S.lower_case,
        "title_case": S.title_case,
        "digits_only": S.digits_only,
        "expand_scientific_notation": S.expand_scientific_notation,
        "phone_e164": lambda c: S.phone_e164(c, region),
        "to_iso_date": lambda c: S.to_iso_date(c, date_format, day_first, this_year),
    }
    flags = {"is_missing": S.is_missing, "is_valid_email": S.is_valid_email, "is_valid_phone": lambda c: S.is_valid_phone(c, region)}
    return {n: ("STRING", f) for n, f in text.items()} | {n: ("BOOLEAN", f) for n, f in flags.items()}


def register_functions(spark: SparkSession, **options) -> list[str]:
    """Make the functions known to the session's SQL, with the options of functions_of() fixed; returns their names."""
    found = functions_of(**options)
    for name, (kind, fn) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({_PARAMETER} STRING) RETURNS {kind} RETURN {sql_text(fn(F.col(_PARAMETER)))}")
    spark.udf.register("ascii_fold", S.fold_udf())
    return [*found, "ascii_fold"]
