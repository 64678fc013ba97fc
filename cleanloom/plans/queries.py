"""The engine's queries over contacts derived from `customer`, and SQL that computes the expected rows from the keys alone.

The contacts are messy by arithmetic on c_custkey: padded names, e-mail addresses in either case, bad or blank, phone numbers and
dates in several layouts, identifiers in scientific notation, missing cities, every 20th row twice. The SQL doesn't clean them: it
says what each value ought to be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, clean, mapping, page_scan, validate
from ..operators.roles import detect_column_roles
from ..sources.config import CleaningConfig, MappingConfig
from ..sources.rows import RID, numbered, spread
from .pipeline import run_pipeline

COLUMNS = ["First Name", "Last Name", "Email Address", "Phone 1", "Created Date", "SKU", "City"]
_MONTH = "element_at(array('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'), cast(1 + n % 12 as int))"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with n, its key; _rid gives the order: by key, repeats last."""
    base = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"), "c_acctbal"), "n")
    a, b = "lpad(200 + n % 700, 3, '0')", "lpad(n % 10000, 4, '0')"
    made = base.selectExpr(
        "n",
        "concat('  ann', n, if(n % 3 = 0, '   lee ', ' ')) as `First Name`",
        "concat('O''Neil', n % 5) as `Last Name`",
        "case when n % 17 = 0 then '' when n % 13 = 0 then concat('bad-mail', n) when n % 2 = 0 then concat(' USER', n, '@Example.COM') else concat('user', n, '@example.com') end as `Email Address`",
        f"case n % 5 when 0 then concat('(212) ', {a}, '-', {b}) when 1 then concat('212.', {a}, '.', {b}) when 2 then concat('+1 212 ', {a}, ' ', {b}) when 3 then concat('212', {a}, {b}) else 'call me' end as `Phone 1`",
        f"case n % 4 when 0 then concat(1 + n % 12, '/', 1 + n % 28, '/', 2020 + n % 5) when 1 then concat(2020 + n % 5, '-', lpad(1 + n % 12, 2, '0'), '-', lpad(1 + n % 28, 2, '0')) when 2 then concat(1 + n % 28, '-', {_MONTH}, '-', 20 + n % 5) else '' end as `Created Date`",
        "if(n % 3 = 0, concat(1 + n % 9, '.05E+', 5 + n % 6), cast(n as string)) as SKU",
        "if(n % 4 = 0, 'N/A', concat('City', n % 5)) as City",
        "c_acctbal as Balance",
    )
    first = made.withColumn(RID, F.col("n").cast("long"))
    again = made.filter("n % 20 = 0").withColumn(RID, F.col("n") + (1 << 32))
    return first.unionByName(again)


def text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).select(RID, *COLUMNS)


# What values ought to be, in SQL on n.
_ROWS = "(SELECT c_custkey AS n, c_acctbal FROM customer)"
_ALL = f"(SELECT n, 0 AS again FROM {_ROWS} UNION ALL SELECT n, 1 FROM {_ROWS} WHERE n % 20 = 0)"
X = {
    "first": "concat('ann', n, CASE WHEN n % 3 = 0 THEN ' lee' ELSE '' END)",
    "last": "concat('O''Neil', n % 5)",
    "email": "CASE WHEN n % 17 = 0 THEN '' WHEN n % 13 = 0 THEN concat('bad-mail', n) ELSE concat('user', n, '@example.com') END",
    "phone": "CASE WHEN n % 5 = 4 THEN 'call me' ELSE concat('+1212', lpad(CAST(200 + n % 700 AS VARCHAR), 3, '0'), lpad(CAST(n % 10000 AS VARCHAR), 4, '0')) END",
    "date": "CASE WHEN n % 4 = 3 THEN '' ELSE concat(2020 + n % 5, '-', lpad(CAST(1 + n % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0')) END",
    "sku": "CASE WHEN n % 3 = 0 THEN CAST(CAST((1 + n % 9) * 100 + 5 AS BIGINT) * CAST(10 ** (3 + n % 6) AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END",
    "city": "CASE WHEN n % 4 = 0 THEN 'N/A' ELSE concat('City', n % 5) END",
}
#: Area 212 and exchanges from 200 to 899 are assignable.
_VALID_PHONE = "n % 5 <> 4"
_BAD_EMAIL = "n % 13 = 0 AND n % 17 <> 0"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _scalar(name: str, column: str, fn, sql: str) -> None:
    _add(name, lambda spark, d: contacts(spark, d).select("n", fn(F.col(f"`{column}`")).alias("value")), f"SELECT n, {sql} AS value FROM {_ALL}")


_scalar("trim_collapse", "First Name", S.trim_whitespace, X["first"])
_scalar("email_lower", "Email Address", S.email_lowercase, X["email"])
_scalar("email_valid", "Email Address", S.is_valid_email, "n % 17 <> 0 AND n % 13 <> 0")
_scalar("phone_e164", "Phone 1", S.phone_e164, X["phone"])
_scalar("phone_valid", "Phone 1", S.is_valid_phone, _VALID_PHONE)
_scalar("date_iso_mdy", "Created Date", lambda c: S.to_iso_date(c, this_year=2026), X["date"])
_scalar("date_iso_dmy", "Created Date", lambda c: S.to_iso_date(c, day_first=True, this_year=2026), "CASE WHEN n % 4 = 3 THEN '' WHEN n % 4 = 0 AND 1 + n % 28 <= 12 THEN concat(2020 + n % 5, '-', lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + n % 12 AS VARCHAR), 2, '0')) ELSE concat(2020 + n % 5, '-', lpad(CAST(1 + n % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0')) END")
_scalar("sci_expand", "SKU", S.expand_scientific_notation, X["sku"])
_scalar("is_missing", "City", S.is_missing, "n % 4 = 0")
_scalar("title_case", "Last Name", S.title_case, X["last"])
_scalar("upper_case", "Last Name", S.upper_case, "concat('O''NEIL', n % 5)")
_scalar("lower_case", "Last Name", S.lower_case, "concat('o''neil', n % 5)")
_scalar("digits_only", "Last Name", S.digits_only, "CAST(n % 5 AS VARCHAR)")
_scalar("ascii_fold", "Last Name", lambda c: S.ascii_fold(F.concat(c, F.lit(" Café"))), f"concat({X['last']}, ' Cafe')")
_add("documents_trim", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.trim_whitespace("text").alias("value")), r"SELECT doc_id, regexp_replace(trim(text, E' \t\n\r'), '\s+', ' ', 'g') AS value FROM documents")


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(detect_column_roles(contacts(spark, d).drop("n")).items()), "column string, role string")


_add("roles", _roles, "SELECT * FROM (VALUES ('First Name','text'),('Last Name','text'),('Email Address','email'),('Phone 1','phone'),('Created Date','date'),('SKU','identifier'),('City','text'),('Balance','numeric')) AS t(\"column\", role)")


def _log(spark: SparkSession, d: str) -> DataFrame:
    source = text_only(spark, d)
    return spark.createDataFrame(clean.change_counts(source, detect_column_roles(source), CleaningConfig()), clean.LOG).select("column", "action", "records")


_add(
    "clean_change_counts",
    _log,
    f"""SELECT * FROM (
      SELECT 'First Name' AS "column", 'trimmed_whitespace' AS action, count(*) AS records FROM {_ALL}
      UNION ALL SELECT 'Email Address', 'trimmed_whitespace', count(*) FROM {_ALL} WHERE n % 17 <> 0 AND n % 13 <> 0 AND n % 2 = 0
      UNION ALL SELECT 'Email Address', 'lowercased_email', count(*) FROM {_ALL} WHERE n % 17 <> 0 AND n % 13 <> 0 AND n % 2 = 0
      UNION ALL SELECT 'Phone 1', 'standardized_phone', count(*) FROM {_ALL} WHERE n % 5 <> 4
      UNION ALL SELECT 'Created Date', 'standardized_date', count(*) FROM {_ALL} WHERE n % 4 IN (0, 2)
      UNION ALL SELECT 'SKU', 'expanded_scientific_notation', count(*) FROM {_ALL} WHERE n % 3 = 0) WHERE records > 0""",
)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    source = text_only(spark, d)
    return clean.cleaned(source, detect_column_roles(source), CleaningConfig())


_NAMED = {"First Name": "first", "Last Name": "last", "Email Address": "email", "Phone 1": "phone", "Created Date": "date", "SKU": "sku", "City": "city"}
_CLEAN = ", ".join(f'{X[k]} AS "{c}"' for c, k in _NAMED.items())
_add("clean_values", lambda spark, d: _cleaned(spark, d).select(*COLUMNS), f"SELECT {_CLEAN} FROM {_ALL}")
_add("fill_mode", lambda spark, d: clean.fill_missing(t := contacts(spark, d).select(RID, "n", "City"), clean.fills(t, {"City": "text"})).select("n", "City"), f"SELECT n, CASE WHEN n % 4 = 0 THEN (SELECT c FROM (SELECT concat('City', n % 5) AS c, count(*) AS k FROM {_ALL} WHERE n % 4 <> 0 GROUP BY 1) ORDER BY k DESC, c LIMIT 1) ELSE concat('City', n % 5) END AS \"City\" FROM {_ALL}")
_add("fill_median", lambda spark, d: clean.fill_missing(t := contacts(spark, d).select(RID, "n", F.when(F.col("n") % 6 != 0, F.col("Balance")).alias("Balance")), clean.fills(t, {"Balance": "numeric"})).select("n", "Balance"), f'SELECT n, CASE WHEN n % 6 <> 0 THEN c_acctbal ELSE (SELECT median(c_acctbal) FROM {_ROWS} JOIN {_ALL} USING (n) WHERE n % 6 <> 0) END AS "Balance" FROM {_ROWS} JOIN {_ALL} USING (n)')
_add("drop_empty_rows", lambda spark, d: clean.drop_empty_rows(contacts(spark, d), ["City", "Email Address"]).select("n"), f"SELECT n FROM {_ALL} WHERE NOT (n % 4 = 0 AND n % 17 = 0)")
_add("dedupe_all", lambda spark, d: clean.first_of_each(_cleaned(spark, d), COLUMNS).select("First Name", "SKU"), f'SELECT {X["first"]} AS "First Name", {X["sku"]} AS "SKU" FROM {_ROWS}')
_add("dedupe_subset", lambda spark, d: clean.first_of_each(contacts(spark, d), ["Last Name", "City"]).select("n", "Last Name", "City"), f"SELECT min(n) AS n, {X['last']} AS \"Last Name\", {X['city']} AS \"City\" FROM {_ROWS} GROUP BY 2, 3")
_add("row_number", lambda spark, d: numbered(contacts(spark, d)).select("n", F.col("_row").alias("row")), f"SELECT n, row_number() OVER (ORDER BY again, n) - 1 AS row FROM {_ALL}")
_add("combine_sources", lambda spark, d: contacts(spark, d).select("n", mapping.combine(["Last Name", "City"], " ").alias("value")), f"SELECT n, CASE WHEN n % 4 = 0 THEN {X['last']} ELSE concat({X['last']}, ' City', n % 5) END AS value FROM {_ALL}")
_add("default_fill", lambda spark, d: mapping.map_data(contacts(spark, d).select("n", "City"), MappingConfig.from_dict({"fields": [{"name": "n"}, {"name": "city", "default": "none given"}]})).frame, f"SELECT n, CASE WHEN n % 4 = 0 THEN 'none given' ELSE concat('City', n % 5) END AS city FROM {_ALL}")
_MAPPED = f"{X['first']} AS firstname, {X['last']} AS lastname, {X['email']} AS email, {X['phone']} AS phone, '' AS company, '' AS jobtitle, '' AS website, '' AS address, {X['city']} AS city, '' AS state, '' AS zip, '' AS country, 'lead' AS lifecyclestage, '' AS hs_lead_status, {X['date']} AS createdate"
_add("map_projection", lambda spark, d: mapping.map_data(_cleaned(spark, d), "hubspot").frame.drop(RID), f"SELECT {_MAPPED} FROM {_ALL}")
_add("mapping_log", lambda spark, d: mapping.map_data(text_only(spark, d), "pipedrive").mapping_log(), "SELECT * FROM (VALUES ('Name','First Name + Last Name','explicit','1.0',''),('Email','Email Address','auto','1.0','email_lowercase'),('Phone','Phone 1','auto','1.0','phone_e164'),('Organization','','missing','0.63',''),('Job title','','missing','0.44',''),('Address','','missing','0.74',''),('Label','','missing','0.5',''),('Owner','','missing','0.55',''),('','Created Date','dropped','',''),('','SKU','dropped','',''),('','City','dropped','','')) AS t(target_field, source_column, match, confidence, transform)")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    mapped = mapping.map_data(_cleaned(spark, d), "hubspot").frame
    return validate.issues_of(mapped, ["firstname", "lastname", "email"], ["email"])


def _issue_sql(check: str) -> str:
    rows = f"(SELECT n + again * 4294967296 AS row, n, count(*) OVER (PARTITION BY CASE WHEN n % 17 = 0 THEN NULL ELSE {X['email']} END) AS k FROM {_ALL})"
    parts = {
        "completeness": f"SELECT row, 'email' AS field, 'completeness' AS \"check\", 'error' AS severity, 'Required field ''email'' is empty' AS message FROM {rows} WHERE n % 17 = 0",
        "uniqueness": f"SELECT row, 'email', 'uniqueness', 'error', concat('Value ''', {X['email']}, ''' is not unique in field ''email''') FROM {rows} WHERE n % 17 <> 0 AND k > 1",
        "email": f"SELECT row, 'email', 'validity', 'error', concat('Invalid email format: ''', {X['email']}, '''') FROM {rows} WHERE {_BAD_EMAIL}",
        "phone": f"SELECT row, 'phone', 'validity', 'warning', concat('Invalid phone format: ''', {X['phone']}, '''') FROM {rows} WHERE NOT ({_VALID_PHONE})",
    }
    names = 'row, field, "check", severity, message'
    return " UNION ALL ".join(f"SELECT * FROM ({p}) AS t({names})" for k, p in parts.items() if check in ("all", k))


for _name, _field, _check in (("completeness", "email", "completeness"), ("uniqueness", "email", "uniqueness"), ("email", "email", "validity"), ("phone", "phone", "validity")):
    _add(f"issues_{_name}", lambda spark, d, f=_field, c=_check: _issues(spark, d).filter((F.col("field") == f) & (F.col("check") == c)).drop("pos"), _issue_sql(_name))
_add("issues_all", lambda spark, d: _issues(spark, d).drop("pos"), _issue_sql("all"))
_add("severity_counts", lambda spark, d: _issues(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("row").alias("rows")), f'SELECT severity, count(*) AS issues, count(DISTINCT row) AS rows FROM ({_issue_sql("all")}) GROUP BY 1')
_add("passing_rows", lambda spark, d: contacts(spark, d).join(_issues(spark, d).select(F.col("row").alias(RID)).distinct(), RID, "left_anti").select("n"), f"SELECT n FROM {_ALL} WHERE n % 17 <> 0 AND n % 13 <> 0 AND ({_VALID_PHONE}) AND n % 20 <> 0")


def _delivered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned contacts with a key, and an export of them in which some are missing, new or changed."""
    want = contacts(spark, d).filter("_rid < 4294967296").select(RID, F.concat(F.lit("k"), "n").alias("key"), S.trim_whitespace("First Name").alias("name"), S.email_lowercase("Email Address").alias("email"), "n")
    key = F.when(F.col("n") % 11 == 0, F.concat(F.lit("new"), "n")).otherwise(F.concat(F.lit(" k"), "n"))
    have = want.select(RID, key.alias("key"), F.when(F.col("n") % 7 == 0, F.lit("changed")).otherwise(F.col("name")).alias("name"), F.concat("email", F.lit(" ")).alias("email"), "n")
    return want.drop("n"), have.drop("n")


def _audit(part: str) -> Query:
    return lambda spark, d: getattr(audit.audit_import(*_delivered(spark, d), "key"), part)


_add("audit_missing_keys", _audit("missing_keys"), f"SELECT concat('k', n) AS key FROM {_ROWS} WHERE n % 11 = 0")
_add("audit_unexpected_keys", _audit("unexpected_keys"), f"SELECT concat('new', n) AS key FROM {_ROWS} WHERE n % 11 = 0")
_add("audit_mismatches", _audit("mismatches"), f"SELECT concat('k', n) AS key, 'name' AS field, {X['first']} AS expected, 'changed' AS imported FROM {_ROWS} WHERE n % 7 = 0 AND n % 11 <> 0")
_add("audit_by_field", lambda spark, d: spark.createDataFrame(list(audit.audit_import(*_delivered(spark, d), "key").mismatches_by_field().items()), "field string, mismatches long"), f"SELECT 'name' AS field, count(*) AS mismatches FROM {_ROWS} WHERE n % 7 = 0 AND n % 11 <> 0 UNION ALL SELECT 'email', 0")


def _end_to_end(spark: SparkSession, d: str) -> DataFrame:
    result = run_pipeline(text_only(spark, d), "hubspot", report=False)
    s = result.summary()
    out = spark.createDataFrame([tuple(s[k] for k in ("rows_in", "rows_out", "duplicates_removed", "errors", "warnings", "records_to_review"))], "rows_in long, rows_out long, duplicates_removed long, errors long, warnings long, records_to_review long")
    result.release()
    return out


_add(
    "e2e_pipeline",
    _end_to_end,
    f"""SELECT (SELECT count(*) FROM {_ALL}) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM {_ROWS} WHERE n % 20 = 0) AS duplicates_removed,
        count(*) FILTER (n % 17 = 0 OR n % 13 = 0) AS errors, count(*) FILTER (NOT ({_VALID_PHONE})) AS warnings,
        count(*) FILTER (n % 17 = 0 OR n % 13 = 0 OR NOT ({_VALID_PHONE})) AS records_to_review FROM {_ROWS}""",
)
_add("e2e_mapped", lambda spark, d: mapping.map_data(clean.first_of_each(_cleaned(spark, d), COLUMNS), "hubspot").frame.drop(RID), f"SELECT {_MAPPED} FROM {_ROWS}")

_add("valid_url", lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", page_scan.is_valid_url(F.col("url")).alias("valid")), "SELECT page_id, regexp_matches(url, '^(https?://)?([^.\\s]+\\.[^\\s]{2,}|localhost)(/[^\"]*)?$', 'i') AS valid FROM pages")


#: What is counted in a page's text as findings of three severities, and whose addresses are their targets.
_MARKS = (("critical", "<b>"), ("serious", "<br>"), ("minor", "<a href="))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings to add up, from the pages' own texts: how often each mark occurs; each mark's targets are the page's links."""
    pages = spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id as page", "coalesce(html, '') as html")
    made = [F.struct(F.lit(mark).alias("id"), F.lit(impact).alias("impact"), F.regexp_count("html", F.lit(mark)).alias("nodes")) for impact, mark in _MARKS]
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    none = F.lit(None).cast("string")
    return pages.select("page", F.explode(F.array(*made)).alias("f"), links.alias("targets")).select("page", "f.id", none.alias("help"), "f.impact", none.alias("description"), "f.nodes", "targets", F.array(F.lit("wcag2a"), F.lit("best")).alias("tags"))


_TOTALS = """SELECT page, total, critical, pages_affected, greatest(0, CAST(floor(100 - total * 1.5 + 0.5) AS BIGINT)) AS score FROM (
  SELECT page_id AS page, greatest(1, b) + greatest(1, br) + greatest(1, a) AS total, greatest(1, b) + greatest(1, br) AS critical,
         least(50, greatest(1, len(list_distinct(links)))) AS pages_affected
  FROM (SELECT page_id, len(regexp_extract_all(html, '<b>')) AS b, len(regexp_extract_all(html, '<br>')) AS br,
               len(regexp_extract_all(html, '<a href=')) AS a, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links
        FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))"""
_add("page_totals", lambda spark, d: page_scan.page_totals(_findings(spark, d)), _TOTALS)
_add(
    "page_exposure",
    lambda spark, d: page_scan.exposure(page_scan.page_totals(_findings(spark, d))).select("page", "risk", "initial_demand", "settlement_low", "settlement_high", "fix_min", "fix_max"),
    f"""WITH t AS (SELECT *, CASE WHEN critical >= 10 THEN 1250 WHEN critical >= 4 THEN 750 ELSE 500 END * critical AS demand,
                      CASE WHEN critical >= 10 THEN 1.5 WHEN critical >= 4 THEN 1.2 ELSE 0.9 END AS times,
                      1200 + critical * 180 + pages_affected * 85 AS fix FROM ({_TOTALS})),
         u AS (SELECT *, CASE WHEN pages_affected > 10 THEN demand * 0.3 ELSE 0 END AS more FROM t)
        SELECT page, CASE WHEN critical >= 10 THEN 'CRITICAL' WHEN critical >= 4 THEN 'HIGH' ELSE 'MODERATE' END AS risk,
               CAST(floor(demand + more + 0.5) AS BIGINT) AS initial_demand, CAST(floor(floor(demand * 0.8 + 0.5) + more + 0.5) AS BIGINT) AS settlement_low,
               CAST(floor(floor(demand * times * 1.8 + 0.5) + more + 0.5) AS BIGINT) AS settlement_high, fix AS fix_min, CAST(floor(fix * 1.25 + 0.5) AS BIGINT) AS fix_max FROM u""",
)
