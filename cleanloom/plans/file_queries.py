"""Queries over delimited files that are first written from whole tables, over types and structure, and over SQL functions, with their SQL.
Importing this module adds them to `queries.QUERIES` and `queries.ORACLE`."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.sql import register_functions
from ..operators import structure
from ..sources.delimited import read_delimited
from ..sources.files import write_single
from ..sources.rows import RID, numbered, spread, with_order
from ..sources.shared import shared_path
from .queries import _ALL, _MONTH, _ROWS, X, _add, contacts, text_only

_CSV = {"header": "true", "escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def _documents_file(spark: SparkSession, d: str) -> str:
    """documents as files in the order of doc_id, with line breaks and quotes in fields."""
    path = shared_path(spark, "documents")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs.select("doc_id", "lang", "text", "source").orderBy("doc_id").write.csv(path, **_CSV)
    return path


_add("read_delimited_documents", lambda spark, d: read_delimited(spark, _documents_file(spark, d)).drop(RID), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents")
_add("row_cap", lambda spark, d: read_delimited(spark, _documents_file(spark, d), max_rows=100).select("doc_id", "text"), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents ORDER BY documents.doc_id LIMIT 100")

_SAYS = "concat('“', c_name, '” – it’s ', c_acctbal, ' €…')"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """customer with signs that Windows-1252 has and Latin-1 lacks, written in that encoding: as Latin-1's signs at the same places."""
    path = shared_path(spark, "windows")
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", f"{_SAYS} as says", "concat('Zoë ', c_mktsegment) as name")
    rows.withColumn("says", F.translate("says", "€…’“”–", "\x80\x85\x92\x93\x94\x96")).write.csv(path, encoding="ISO-8859-1", **_CSV)
    return read_delimited(spark, path).drop(RID)


_add("read_windows_1252", _windows, f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_SAYS} AS says, concat('Zoë ', c_mktsegment) AS name FROM customer")


def _ragged(spark: SparkSession, d: str) -> DataFrame:
    """Errors of records of customers: every seventh lacks its last two cells, every eleventh has one too many, some have line breaks."""
    path = shared_path(spark, "ragged")
    cells = "concat_ws(',', cast(n as string), '\"a\\nb\"', if(n % 7 = 0, null, 'x'), if(n % 7 = 0, null, ''), if(n % 11 = 0, '', null))"
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as n").orderBy("n").selectExpr(f"{cells} as value")
    spark.range(1, numPartitions=1).selectExpr("'key,says,third,fourth' as value").unionByName(rows.coalesce(1)).coalesce(1).write.text(path)
    return structure.record_errors(spark, path)


_NUMBERED = f"(SELECT n, row_number() OVER (ORDER BY n) + 1 AS row FROM {_ROWS})"
_add(
    "record_errors",
    _ragged,
    f"""SELECT row, 'third' AS field, 'missing-cell' AS error, 'Cell 3 is missing' AS message FROM {_NUMBERED} WHERE n % 7 = 0 AND n % 11 <> 0
        UNION ALL SELECT row, 'fourth', 'missing-cell', 'Cell 4 is missing' FROM {_NUMBERED} WHERE n % 7 = 0
        UNION ALL SELECT row, '', 'extra-cell', 'Cell 5 is beyond the header' FROM {_NUMBERED} WHERE n % 11 = 0 AND n % 7 <> 0""",
)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each type, some cells of which break it."""
    return contacts(spark, d).selectExpr(
        RID, "if(n % 50 = 1, concat('no ', n), cast(n as string)) as whole", "if(n % 40 = 2, 'n/a', concat(n, '.25')) as price",
        f"if(n % 60 = 3, concat('day ', n), concat(1 + n % 28, '-', {_MONTH}, '-', 2020 + n % 5)) as day", "if(n % 30 = 4, 'perhaps', if(n % 2 = 0, 'Yes', 'no')) as agreed", "concat('City', n % 5) as city",
    )


def _types(spark: SparkSession, d: str) -> DataFrame:
    found = structure.column_types(_typed(spark, d))
    return spark.createDataFrame([(c, t.kind, t.cells, t.broken) for c, t in found.items()], "column string, type string, cells long, broken long")


_add(
    "column_types",
    _types,
    f"""SELECT 'whole' AS "column", 'integer' AS type, count(*) AS cells, count(*) FILTER (n % 50 = 1) AS broken FROM {_ALL}
        UNION ALL SELECT 'price', 'number', count(*), 0 FROM {_ALL} WHERE n % 40 <> 2
        UNION ALL SELECT 'day', 'date', count(*), count(*) FILTER (n % 60 = 3) FROM {_ALL}
        UNION ALL SELECT 'agreed', 'boolean', count(*), count(*) FILTER (n % 30 = 4) FROM {_ALL}
        UNION ALL SELECT 'city', 'text', count(*), 0 FROM {_ALL}""",
)
_BY_ROW = f"(SELECT n, row_number() OVER (ORDER BY again, n) + 1 AS row FROM {_ALL})"
_add(
    "cell_errors",
    lambda spark, d: structure.cell_errors(_typed(spark, d)),
    f"""SELECT row, 'whole' AS field, 'type-error' AS error, concat('''no ', n, ''' is no integer') AS message FROM {_BY_ROW} WHERE n % 50 = 1
        UNION ALL SELECT row, 'day', 'type-error', concat('''day ', n, ''' is no date') FROM {_BY_ROW} WHERE n % 60 = 3
        UNION ALL SELECT row, 'agreed', 'type-error', '''perhaps'' is no boolean' FROM {_BY_ROW} WHERE n % 30 = 4""",
)


def _by_name(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark, this_year=2026)
    text_only(spark, d).createOrReplaceTempView("cleanloom_contacts")
    return spark.sql(
        "SELECT trim_whitespace(`First Name`) AS first, email_lowercase(`Email Address`) AS email, is_valid_email(`Email Address`) AS mail, phone_e164(`Phone 1`) AS phone, "
        "is_valid_phone(`Phone 1`) AS dials, to_iso_date(`Created Date`) AS day, expand_scientific_notation(SKU) AS sku, is_missing(City) AS nowhere FROM cleanloom_contacts"
    )


_add("sql_functions", _by_name, f"SELECT {X['first']} AS first, {X['email']} AS email, n % 17 <> 0 AND n % 13 <> 0 AS mail, {X['phone']} AS phone, n % 5 <> 4 AS dials, {X['date']} AS day, {X['sku']} AS sku, n % 4 = 0 AS nowhere FROM {_ALL}")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    url = "url"
    made = {"upper": S.upper_case(url), "lower": S.lower_case(url), "title": S.title_case(url), "digits": S.digits_only(url)}
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", *[v.alias(k) for k, v in made.items()])


_TITLE = "list_aggregate(list_transform(regexp_extract_all(lower(url), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '')"
_add("case_of_urls", _cases, f"SELECT page_id, upper(url) AS upper, lower(url) AS lower, {_TITLE} AS title, regexp_replace(url, '[^0-9]', '', 'g') AS digits FROM pages")
_add("fold_documents", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.ascii_fold("text").alias("folded")), "SELECT doc_id, strip_accents(text) AS folded FROM documents")
_add(
    "sci_small",
    lambda spark, d: contacts(spark, d).select("n", S.expand_scientific_notation(F.expr("concat(if(n % 2 = 0, '-', ''), 1 + n % 9, '.05e-', n % 7)")).alias("value")),
    f"""SELECT n, CASE WHEN n % 2 = 0 THEN '-' ELSE '' END || CASE WHEN n % 7 = 0 THEN concat(1 + n % 9, '.05')
        ELSE concat('0.', repeat('0', CAST(n % 7 - 1 AS INTEGER)), 1 + n % 9, '05') END AS value FROM {_ALL}""",
)


#: Region, what a number looks like there (d: eight digits made of n), what E.164 makes of it, and whether it is in use.
_PHONES = [
    ("FR", "concat('01 ', d)", "concat('+331', d)", "true"), ("DE", "concat('(030) ', d)", "concat('+4930', d)", "true"), ("GB", "concat('020 ', substr(d, 1, 4), ' ', substr(d, 5))", "concat('+4420', d)", "true"),
    ("ES", "concat('9', d)", "concat('+349', d)", "true"), ("IT", "concat('06-', d)", "concat('+3906', d)", "true"), ("BR", "concat('(11) 9', substr(d, 1, 4), '-', substr(d, 5))", "concat('+55119', d)", "true"),
    ("IN", "concat('0', '98', d)", "concat('+9198', d)", "true"), ("AU", "concat('(02) ', d, ' ext. 7')", "concat('+612', d)", "true"), ("JP", "concat('03-', d)", "concat('+813', d)", "true"),
    ("SG", "concat('+65 1', substr(d, 2))", "concat('+651', substr(d, 2))", "false"), ("RU", "concat('8 912 ', substr(d, 2))", "concat('+7912', substr(d, 2))", "true"), ("HU", "concat('06 1 ', substr(d, 2))", "concat('+361', substr(d, 2))", "true"),
]
_DIGITS = "lpad(cast(n * 7919 % 90000000 + 10000000 as varchar(8)), 8, '0')"


def _phones(spark: SparkSession, d: str) -> DataFrame:
    """A number of each region for all customers, in one row each."""
    rows = spread(spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as n"), "n").withColumn("d", F.expr(_DIGITS))
    made = rows.select("n", *[F.expr(shape).alias(region) for region, shape, _, _ in _PHONES])
    return made.select("n", *[f(region, region).alias(f"{region}_{name}") for region, *_ in _PHONES for name, f in (("e164", S.phone_e164), ("valid", S.is_valid_phone))])


_add("phones_of_regions", _phones, "SELECT n, " + ", ".join(f'{want} AS "{r}_e164", {valid} AS "{r}_valid"' for r, _, want, valid in _PHONES) + f" FROM (SELECT c_custkey AS n, {_DIGITS} AS d FROM (SELECT c_custkey, c_custkey AS n FROM customer))")


#: Dates of free form made of n, and what they are; those of the last two lack parts, which come from 15 June 2026.
_DATES = [("concat('10:30 ', 1 + n % 28, ' ', M, ' ', 2000 + n % 30)", "make_date(2000 + n % 30, 1 + n % 12, 1 + n % 28)"), ("concat(2000 + n % 30, ' ', M, ' ', 1 + n % 28, ' at 3 pm')", "make_date(2000 + n % 30, 1 + n % 12, 1 + n % 28)"),
          ("concat('Fri, ', M, ' ', 1 + n % 28, 'th ', 2000 + n % 30, ' 08:15 UTC')", "make_date(2000 + n % 30, 1 + n % 12, 1 + n % 28)"), ("concat(M, ' ', 2000 + n % 30)", "make_date(2000 + n % 30, 1 + n % 12, 15)"),
          ("concat(1 + n % 28, '. ', M)", "make_date(2026, 1 + n % 12, 1 + n % 28)")]


def _dates(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{d}/customer.parquet").selectExpr("cast(c_custkey as int) as n"), "n")
    made = F.element_at(F.array(*[F.expr(shape.replace("M", _MONTH)) for shape, _ in _DATES]), F.expr("1 + n % 5"))
    return rows.select("n", S.to_iso_date(made, this_year=2026, default=date(2026, 6, 15)).alias("day"))


_WANT = " ".join(f"WHEN {k} THEN {want}" for k, (_, want) in enumerate(_DATES))
_add("dates_free_form", _dates, f"SELECT n, CAST(CASE n % 5 {_WANT} END AS VARCHAR) AS day FROM (SELECT CAST(c_custkey AS INTEGER) AS n FROM customer)")


def _written(spark: SparkSession, d: str) -> DataFrame:
    """A single file in the order of the rows, read back by Spark's own reader, which cuts a large one into several tasks."""
    path = shared_path(spark, "single") + ".csv"
    write_single(text_only(spark, d), path, RID)
    rows = numbered(with_order(spark.read.csv(path, header=True, escape='"')), "at")
    return rows.select("at", "SKU", F.coalesce("Email Address", F.lit("")).alias("email"))


_SKU = "CASE WHEN n % 3 = 0 THEN concat(1 + n % 9, '.05E+', 5 + n % 6) ELSE CAST(n AS VARCHAR) END"
_EMAIL = "CASE WHEN n % 17 = 0 THEN '' WHEN n % 13 = 0 THEN concat('bad-mail', n) WHEN n % 2 = 0 THEN concat(' USER', n, '@Example.COM') ELSE concat('user', n, '@example.com') END"
_add("write_single", _written, f'SELECT row_number() OVER (ORDER BY again, n) - 1 AS at, {_SKU} AS "SKU", {_EMAIL} AS email FROM {_ALL}')
