"""More of the engine's queries: what users see first (issues in order, checks, score, passing rows, audit statistics), options of
mapping, roles and cleaning. Importing this module adds them to `queries.QUERIES` and `queries.ORACLE`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, clean, mapping, structure, validate
from ..operators.roles import detect_column_roles
from ..sources.config import CleaningConfig, MappingConfig
from ..sources.rows import RID, numbered
from .queries import _ALL, _BAD_EMAIL, _ROWS, _VALID_PHONE, ORACLE, QUERIES, X, _add, _cleaned, _delivered, contacts, text_only


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, validate.ValidationReport]:
    """The mapped table, and what validation says of it."""
    mapped = numbered(mapping.map_data(_cleaned(spark, d), "hubspot").frame).drop(RID).withColumnRenamed("_row", RID)
    return mapped, validate.validate_data(mapped, ["firstname", "lastname", "email"], ["email"])


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Issues as they are delivered; nth is an issue's place among those of its row."""
    issues = _report(spark, d)[1].issues_frame().withColumn("at", F.monotonically_increasing_id())
    return issues.withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("at"))).drop("at")


def _checks(spark: SparkSession, d: str) -> DataFrame:
    found = _report(spark, d)[1].checks()
    return spark.createDataFrame([(k, v["failed"], v["passed"]) for k, v in found.items()], "check string, failed long, passed long")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    kinds = "total_records long, quality_score double, errors long, warnings long, records_to_review long"
    return spark.createDataFrame([tuple(_report(spark, d)[1].summary().values())], kinds)


def _passing(spark: SparkSession, d: str) -> DataFrame:
    mapped, report = _report(spark, d)
    return report.passing(mapped, 25).select(RID, "email")


#: Rows of the spreadsheet; k: how many rows have this e-mail.
_ROWED = f"""(SELECT row_number() OVER (ORDER BY again, n) + 1 AS row, n, again,
  count(*) OVER (PARTITION BY CASE WHEN n % 17 = 0 THEN -n - 2 ELSE n END) AS k FROM {_ALL})"""
_REPEATED = "n % 17 <> 0 AND k > 1"
_ORDERED = f"""(SELECT row, 1 AS nth, 'email' AS field, 'completeness' AS "check", 'error' AS severity, 'Required field ''email'' is empty' AS message
    FROM {_ROWED} WHERE n % 17 = 0
  UNION ALL SELECT row, 1, 'email', 'uniqueness', 'error', concat('Value ''', {X["email"]}, ''' is not unique in field ''email''') FROM {_ROWED} WHERE {_REPEATED}
  UNION ALL SELECT row, CASE WHEN k > 1 THEN 2 ELSE 1 END, 'email', 'validity', 'error', concat('Invalid email format: ''', {X["email"]}, '''')
    FROM {_ROWED} WHERE {_BAD_EMAIL}
  UNION ALL SELECT row, 1 + CAST(n % 17 = 0 AS INTEGER) + CAST({_REPEATED} AS INTEGER) + CAST({_BAD_EMAIL} AS INTEGER),
    'phone', 'validity', 'warning', concat('Invalid phone format: ''', {X["phone"]}, '''') FROM {_ROWED} WHERE NOT ({_VALID_PHONE}))"""
_add("issues_ordered", _ordered, f'SELECT row, field, "check", severity, message, CAST(nth AS INTEGER) AS nth FROM {_ORDERED}')
_add("checks_by_type", _checks, f'SELECT "check", count(*) AS failed, (SELECT count(*) FROM {_ALL}) - count(DISTINCT row) AS passed FROM {_ORDERED} GROUP BY 1')
_add(
    "quality_summary",
    _summary,
    f"""SELECT total AS total_records, CAST(round((total - flagged) * 100.0 / total, 1) AS DOUBLE) AS quality_score, errors, warnings, flagged AS records_to_review
    FROM (SELECT (SELECT count(*) FROM {_ALL}) AS total, count(*) FILTER (severity = 'error') AS errors,
                 count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT row) AS flagged FROM {_ORDERED})""",
)
_add("flagged_rows", lambda spark, d: _report(spark, d)[1].flagged_rows(), f"SELECT DISTINCT row - 2 AS row FROM {_ORDERED}")
_add("passing_sample", _passing, f"SELECT row - 2 AS _rid, {X['email']} AS email FROM {_ROWED} WHERE row NOT IN (SELECT row FROM {_ORDERED}) ORDER BY row LIMIT 25")

_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
_RAW_DATE = f"""CASE n % 4 WHEN 0 THEN concat(1 + n % 12, '/', 1 + n % 28, '/', 2020 + n % 5)
  WHEN 2 THEN concat(1 + n % 28, '-', {_MONTHS}[1 + n % 12], '-', 20 + n % 5) END"""
_add(
    "issues_date",
    lambda spark, d: validate.issues_of(text_only(spark, d).select(RID, "Created Date"), [], []).drop("pos"),
    f"""SELECT n + again * 4294967296 AS row, 'Created Date' AS field, 'consistency' AS "check", 'warning' AS severity,
        concat('Date format inconsistent with %Y-%m-%d: ''', {_RAW_DATE}, '''') AS message FROM {_ALL} WHERE n % 4 IN (0, 2)""",
)


def _audit_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = audit.audit_import(*_delivered(spark, d), "key").stats()
    return spark.createDataFrame([(k, v) for k, v in stats.items() if k != "mismatches_by_field"], "name string, value long")


_add(
    "audit_stats",
    _audit_stats,
    f"""SELECT 'expected_records' AS name, count(*) AS value FROM {_ROWS} UNION ALL SELECT 'imported_records', count(*) FROM {_ROWS}
        UNION ALL SELECT 'missing_records', count(*) FROM {_ROWS} WHERE n % 11 = 0
        UNION ALL SELECT 'unexpected_records', count(*) FROM {_ROWS} WHERE n % 11 = 0
        UNION ALL SELECT 'mismatched_values', count(*) FROM {_ROWS} WHERE n % 7 = 0 AND n % 11 <> 0""",
)


def _structure(spark: SparkSession, d: str) -> DataFrame:
    """Of all contacts, with a blank label and rows in which city and e-mail are blank."""
    rows = contacts(spark, d).select(F.when(F.col("n") % 4 != 0, F.col("City")).alias("City"), F.col("Email Address").alias(" "))
    return spark.createDataFrame([(e["type"], e["message"]) for e in structure.structure_summary(rows)["errors"]], "type string, message string")


_add(
    "structure",
    _structure,
    f"""SELECT 'blank-label' AS type, 'Label in position 2 is blank' AS message
        UNION ALL SELECT 'blank-row', concat(count(*), ' rows are blank') FROM {_ALL} WHERE n % 4 = 0 AND n % 17 = 0""",
)

_SOURCED = MappingConfig.from_dict(
    {
        "fields": [
            {"name": "family", "source": "Last Name"},
            {"name": "mail", "source": "No Such", "aliases": ["Email Address"]},
            {"name": "whole", "sources": ["First Name", "Nowhere", "City"], "separator": ", ", "transform": "upper_case"},
            {"name": "none", "sources": ["Nowhere"], "default": "x"},
            {"name": "Last Names"},
        ]
    }
)
_WHOLE = f"upper(concat({X['first']}, CASE WHEN n % 4 = 0 THEN '' ELSE concat(', City', n % 5) END))"
_add(
    "map_explicit",
    lambda spark, d: mapping.map_data(_cleaned(spark, d), _SOURCED).frame.drop(RID),
    f"""SELECT {X["last"]} AS family, {X["email"]} AS mail, {_WHOLE} AS whole, 'x' AS none, {X["last"]} AS "Last Names" FROM {_ALL}""",
)
_add("map_exclusive", lambda spark, d: mapping.map_data(_cleaned(spark, d), _SOURCED, exclusive=True).frame.select("family", "Last Names"), f"""SELECT {X["last"]} AS family, '' AS "Last Names" FROM {_ALL}""")


def _listed_roles(spark: SparkSession, d: str) -> DataFrame:
    """Listed columns, blank ones, and ones of nulls at first or throughout."""
    more = {"Fax": F.lit("N/A"), "Web": F.when(F.col("n") > 120, F.col("Email Address")), "Never": F.lit(None).cast("string")}
    config = CleaningConfig(id_columns=["City"], date_columns=["City", "SKU"])
    roles = detect_column_roles(contacts(spark, d).withColumns(more).drop("n"), config)
    return spark.createDataFrame(list(roles.items()), "column string, role string")


_add(
    "roles_listed",
    _listed_roles,
    """SELECT * FROM (VALUES ('First Name','text'),('Last Name','text'),('Email Address','email'),('Phone 1','phone'),('Created Date','date'),('SKU','date'),
       ('City','date'),('Balance','numeric'),('Fax','text'),('Web','email'),('Never','text')) AS t("column", role)""",
)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """Names with marks, folded as a step of cleaning, with the log's count."""
    name = F.when(F.col("n") % 3 == 0, F.concat(F.lit("Zoë Müller "), "n")).otherwise(F.concat(F.lit("Ann "), "n"))
    result = clean.clean_data(contacts(spark, d).select(RID, name.alias("Name")), CleaningConfig(normalize_unicode=True, remove_duplicates=False))
    changed = {action: records for _, action, records, _ in result.actions}["normalized_unicode"]
    return result.frame.select("Name", F.lit(changed).cast("long").alias("changed"))


_add(
    "clean_fold",
    _folded,
    f"""SELECT CASE WHEN n % 3 = 0 THEN concat('Zoe Muller ', n) ELSE concat('Ann ', n) END AS "Name",
        (SELECT count(*) FROM {_ALL} WHERE n % 3 = 0) AS changed FROM {_ALL}""",
)

__all__ = ["ORACLE", "QUERIES"]
