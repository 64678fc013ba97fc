"""The reference's own cases and edge cases beside them."""

import pytest
from cleanloom.functions import scalars as S
from cleanloom.operators.audit import audit_import
from cleanloom.operators.clean import clean_data
from cleanloom.operators.mapping import map_data
from cleanloom.operators.roles import detect_column_roles
from cleanloom.operators.structure import structure_summary
from cleanloom.operators.validate import validate_data
from cleanloom.plans import cli
from cleanloom.plans.pipeline import run_pipeline
from cleanloom.sources.config import CleaningConfig, TargetField, available_crms, load_mapping_config
from cleanloom.sources.delimited import read_delimited
from cleanloom.streaming.live import clean_stream
from pyspark.sql import functions as F

# A messy sample of seven contacts.
SAMPLE = """First Name,Last Name,Email Address,Phone 1,Company,Title,Created Date,SKU,City,Country
 John ,Smith,JOHN@Email.com,(555) 123-4567,Acme Inc,CEO,12/31/24,4.05E+14,Boston,USA
Jane,Doe,jane.doe@example.com,555.987.6543,Globex,CTO,2024-11-05,4.05E+14,Austin,USA
Jane,Doe,jane.doe@example.com,555.987.6543,Globex,CTO,2024-11-05,4.05E+14,Austin,USA
Émile,Müller,emile@ex-ample.fr,+33 1 42 68 53 00,Initech,Analyst,31-Dec-24,123456789012345,Paris,France
Bob,Jones,not-an-email,555-000,Umbrella,Manager,03/04/2024,987654321098765,Denver,USA
Alice,Brown,,+1 (415) 555-2671,Hooli,VP Sales,2024/02/17,4.06E+14,San Francisco,USA
Carlos,Diaz,carlos@example.com,4155550137,Vehement Capital,Director,,555000111222333,Miami,USA
"""


@pytest.fixture(scope="session")
def sample(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "contacts.csv"
    path.write_text(SAMPLE, "utf-8")
    return path


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["o"] for r in df.select("i", fn(F.col("c")).alias("o")).orderBy("i").collect()]


CASES = [
    (S.phone_e164, {"(555) 123-4567": "+15551234567", "555.123.4567": "+15551234567", "5551234567": "+15551234567", "+33 1 42 68 53 00": "+33142685300", "call me": "call me", "5551234567.0": "+15551234567", " 555-000 ": "555-000", "n/a": "n/a"}),
    (S.is_valid_phone, {"+14155552671": True, "555-000": False, "+15551234567": False, "": False, "+33142685300": True}),
    (S.to_iso_date, {"12/31/24": "2024-12-31", "2024-12-31": "2024-12-31", "31-Dec-24": "2024-12-31", "31/12/2024": "2024-12-31", "04/03/2026": "2026-04-03", "Monday": "Monday", "Feb 30 2024": "Feb 30 2024", "March 5th, 2021": "2021-03-05"}),
    (lambda c: S.to_iso_date(c, day_first=True), {"04/03/2026": "2026-03-04", "31/12/2024": "2024-12-31", "2024-11-05": "2024-11-05"}),
    (S.expand_scientific_notation, {"4.05E+14": "405000000000000", "ABC123": "ABC123", "1E-7": "0.0000001", "00012E2": "1200", "-0E+5": "-0", "12E3": "12000", " x ": " x ", "1E999": "1E999"}),
    (S.trim_whitespace, {"  John   Smith ": "John Smith", "\xa0a\t\x1cb ": "a b"}),
    (S.ascii_fold, {"Café Müller": "Cafe Muller", "ﬁ ß ø": "fi ß ø"}),
    (S.title_case, {"o'brien vp-sales 3rd": "O'Brien Vp-Sales 3Rd"}),
    (S.digits_only, {"(1) 2-3": "123", "-": "-"}),
    (S.is_missing, {"N/A": True, " Unknown ": True, "#n/a": True, "x": False, "": True}),
    (S.is_valid_email, {"john@email.com": True, "not-an-email": False, "a@b": False, "a@b..c": False}),
]


@pytest.mark.parametrize("fn,cases", CASES)
def test_scalars(spark, fn, cases):
    assert apply(spark, fn, list(cases)) == list(cases.values())


def test_registry():
    with pytest.raises(ValueError, match="Available: ascii"):
        S.get_transform("nothing")
    with pytest.raises(ValueError, match="directive"):
        S.java_format("%Q")


def test_sample_end_to_end(spark, sample):
    result = run_pipeline(read_delimited(spark, sample), "hubspot")
    rows = [r.asDict() for r in result.clean_frame.orderBy("_rid").collect()]
    assert [r["_rid"] for r in rows] == list(range(6))
    assert [(r["firstname"], r["email"], r["phone"], r["createdate"]) for r in rows] == [
        ("John", "john@email.com", "+15551234567", "2024-12-31"), ("Jane", "jane.doe@example.com", "+15559876543", "2024-11-05"), ("Émile", "emile@ex-ample.fr", "+33142685300", "2024-12-31"),
        ("Bob", "not-an-email", "555-000", "2024-03-04"), ("Alice", "", "+14155552671", "2024-02-17"), ("Carlos", "carlos@example.com", "+14155550137", ""),
    ]
    assert [(r["state"], r["lifecyclestage"]) for r in rows][0] == ("USA", "lead")
    assert result.summary() == {"rows_in": 7, "rows_out": 6, "duplicates_removed": 1, "total_records": 6, "quality_score": 33.3, "errors": 2, "warnings": 3, "records_to_review": 4}
    assert [tuple(r)[:3] for r in result.cleaning_log().collect()] == [("First Name", "trimmed_whitespace", 1), ("Email Address", "lowercased_email", 1), ("Phone 1", "standardized_phone", 6), ("Created Date", "standardized_date", 4), ("SKU", "expanded_scientific_notation", 4), ("*", "removed_duplicates", 1)]
    assert result.cleaning.column_roles == {"First Name": "text", "Last Name": "text", "Email Address": "email", "Phone 1": "phone", "Company": "text", "Title": "text", "Created Date": "date", "SKU": "identifier", "City": "text", "Country": "text"}
    assert [(r["row"], r["check"], r["severity"]) for r in result.validation.issues_frame().collect()] == [(2, "validity", "warning"), (3, "validity", "warning"), (5, "validity", "error"), (5, "validity", "warning"), (6, "completeness", "error")]
    assert {k: v["failed"] for k, v in result.validation.checks().items()} == {"validity": 4, "completeness": 1}
    log = {r[0] or r[1]: r for r in result.mapping.log_rows()}
    assert log["state"][1:4] == ("Country", "auto", "0.92") and log["SKU"][2:4] == ("dropped", "") and log["website"][2:4] == ("missing", "0.67")
    assert [r["firstname"] for r in result.validation.passing(result.clean_frame).collect()] == ["Émile", "Carlos"]
    assert "Quality score 33.3%" in result.qa_report_html
    result.release()


def test_cli(spark, sample, tmp_path):
    assert cli.main(["-i", str(sample), "-c", "hubspot", "-o", str(tmp_path), "--zip"]) == 1
    made = {p.name for p in tmp_path.iterdir()}
    assert {"clean_data.csv", "mapping_log.csv", "cleaning_log.csv", "issues.csv", "qa_report.html"} <= made and any(n.endswith(".zip") for n in made)
    lines = (tmp_path / "clean_data.csv").read_text("utf-8").splitlines()
    assert len(lines) == 7 and lines[5].startswith("Alice,Brown,,+14155552671")
    assert cli.main(["-i", str(sample), "-c", "pipedrive", "-o", str(tmp_path), "--audit-export", str(sample)]) == 2


def test_fill_drop_and_subset(spark):
    city = spark.createDataFrame([("Boston",), ("",), ("Boston",)], "City string")
    auto = clean_data(city, CleaningConfig(missing_value_strategy="auto", remove_duplicates=False))
    assert [r["City"] for r in auto.frame.collect()] == ["Boston"] * 3 and ("City", "filled_missing", 1, "filled with 'Boston'") in auto.actions
    tie = clean_data(spark.createDataFrame([("b", 1.0), ("a", 4.0), (None, None), ("-", 2.0)], "x string, n double"), CleaningConfig(missing_value_strategy="auto", remove_duplicates=False))
    assert [tuple(r)[:2] for r in tie.frame.orderBy("_rid").select("x", "n").collect()] == [("b", 1.0), ("a", 4.0), ("a", 2.0), ("a", 2.0)]
    drop = clean_data(spark.createDataFrame([("", "N/A"), ("x", "")], "a string, b string"), CleaningConfig(missing_value_strategy="drop"))
    assert drop.rows_out == 1 and ("*", "dropped_empty_rows", 1, "") in drop.actions
    subset = clean_data(spark.createDataFrame([("k", "1"), ("k", "2"), (None, "3"), (None, "4")], "a string, b string"), CleaningConfig(duplicate_subset=["a", "none"]))
    assert [r["b"] for r in subset.frame.orderBy("_rid").collect()] == ["1", "3"]
    empty = clean_data(spark.createDataFrame([], "a string"))
    assert (empty.rows_in, empty.rows_out, empty.actions) == (0, 0, [])


def test_day_first(spark):
    dates = spark.createDataFrame([("04/03/2026",), ("31/12/2024",)], "Date string")
    assert [r["Date"] for r in clean_data(dates, CleaningConfig(date_first=True)).frame.orderBy("_rid").collect()] == ["2026-03-04", "2024-12-31"]


def test_roles(spark):
    df = spark.createDataFrame([("a@b.co", "1", "", "", "x", 1)] * 5, "contact string, customer_id string, Phone string, Hotel string, `Account Number` string, n int").withColumn("Hotel", F.lit("5"))
    assert detect_column_roles(df) == {"contact": "email", "customer_id": "text", "Phone": "text", "Hotel": "phone", "Account Number": "identifier", "n": "numeric"}
    share = lambda k: spark.createDataFrame([("a@b.co" if i < k else "x",) for i in range(100)], "c string")
    assert detect_column_roles(share(60))["c"] == "text" and detect_column_roles(share(61))["c"] == "email"
    assert detect_column_roles(df, CleaningConfig(id_columns=["contact"]))["contact"] == "identifier"


def test_mapping(spark):
    df = spark.createDataFrame([("John", "Smith", "5551234567", "JOHN@email.com", "Acme Inc", "n")], "`First Name` string, `Last Name` string, `Phone 1` string, `Email Address` string, Company string, `Internal Notes` string")
    out = map_data(df, "hubspot")
    row = out.frame.first()
    assert (row["firstname"], row["email"], row["phone"], row["company"], row["lifecyclestage"]) == ("John", "john@email.com", "+15551234567", "Acme Inc", "lead")
    assert "Internal Notes" in out.unmapped_sources
    assert map_data(df, "pipedrive").frame.first()["Name"] == "John Smith"
    assert available_crms() == ["hubspot", "pipedrive", "salesforce"] and [len(load_mapping_config(c).fields) for c in available_crms()] == [15, 8, 14]
    with pytest.raises(FileNotFoundError, match="hubspot"):
        load_mapping_config("nothing")
    with pytest.raises(ValueError):
        TargetField.from_dict({"name": "x", "other": 1})
    sales = {m.target.name: m for m in map_data(df, "salesforce").mappings}
    assert sales["MobilePhone"].sources == ["Phone 1"] and round(sales["MobilePhone"].confidence, 4) == 0.8333


def test_validation(spark):
    rows = [("", "A", "a@b.co", "555-000", "31/12/2024"), ("B", "B", "bad", "+14155552671", "2024-12-31"), ("C", "C", "a@b.co", "", "")]
    report = validate_data(spark.createDataFrame(rows, "firstname string, lastname string, email string, phone string, createdate string").coalesce(1), ["firstname"], ["email"])
    got = {(r["check"], r["field"]) for r in report.issues_frame().collect()}
    assert got == {("completeness", "firstname"), ("validity", "email"), ("uniqueness", "email"), ("validity", "phone"), ("consistency", "createdate")}
    assert not report.valid and report.flagged == 3 and report.quality_score == 0.0
    fine = validate_data(spark.createDataFrame([("A", "a@b.co")], "firstname string, email string"), ["firstname"], ["email"])
    assert fine.valid and fine.quality_score == 100.0 and fine.summary()["total_records"] == 1
    assert validate_data(spark.createDataFrame([], "a string"), ["a"], []).summary()["total_records"] == 1
    assert structure_summary(spark.createDataFrame([("", "")], "a string, b string"))["errors"][0]["type"] == "blank-row"


def test_audit(spark):
    kinds = "email string, firstname string, phone string"
    want = spark.createDataFrame([("a", "Ann", "1"), ("b", "Bob", "2"), ("c", "Cy", "3")], kinds).coalesce(1)
    have = spark.createDataFrame([("a", "Ann", "1"), (" b", "Robert", "2 "), ("d", "Di", "4")], kinds).coalesce(1)
    audit = audit_import(want, have, "email")
    assert audit.stats() == {"expected_records": 3, "imported_records": 3, "missing_records": 1, "unexpected_records": 1, "mismatched_values": 1, "mismatches_by_field": {"firstname": 1, "phone": 0}}
    assert [tuple(r) for r in audit.mismatches.collect()] == [("b", "firstname", "Bob", "Robert")]
    with pytest.raises(KeyError, match="exported"):
        audit_import(want, have.drop("email"), "email")
    blank = spark.createDataFrame([("", "x", "1"), ("N/A", "y", "1")], kinds)
    assert audit_import(blank, blank, "email").stats()["mismatched_values"] == 2
    assert audit_import(blank, blank, "email", match_blank_keys=False).stats()["mismatched_values"] == 0


def test_reading(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_bytes('a,b,b,\n1,"x ""q"" \n y",NA\n\n2,é,3,4\n'.encode("latin-1"))
    df = read_delimited(spark, path)
    assert df.columns == ["a", "b", "b.1", "Unnamed: 3", "_rid"]
    assert [tuple(r)[:4] for r in df.collect()] == [("1", 'x "q" \n y', "NA", ""), ("2", "é", "3", "4")]
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="has 3 fields, the header 2"):
        read_delimited(spark, path).collect()
    with pytest.raises(ValueError, match="at most 3"):
        read_delimited(spark, path, max_bytes=3)
    path.write_text("a,b\n1\n2,3\n")
    assert [tuple(r)[:2] for r in read_delimited(spark, path, max_rows=1).collect()] == [("1", "")]


def test_partitions_do_not_matter(spark, sample):
    source = read_delimited(spark, sample)
    one = [tuple(r) for r in clean_data(source).frame.orderBy("_rid").collect()]
    many = spark.createDataFrame(source.drop("_rid").collect(), source.drop("_rid").schema)
    assert [tuple(r) for r in clean_data(many).frame.orderBy("_rid").collect()] == one


def test_stream(spark, sample, tmp_path):
    source = read_delimited(spark, sample).drop("_rid")
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    out = clean_stream(stream, detect_column_roles(source), "hubspot")
    job = out.writeStream.format("memory").queryName("mapped").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    job.awaitTermination()
    assert spark.table("mapped").count() == 7 and spark.table("mapped").filter("phone = '+33142685300'").count() == 1


def test_encoding_is_judged_by_all_bytes(spark, tmp_path):
    row = b"plain,text of a row\n"
    many = (1 << 20) // len(row) + 10
    for name, last, want in (("latin", "Zoë,Müller".encode("latin-1"), "Müller"), ("utf", "Zoë,Müller".encode(), "Müller"), ("end", b"Zo\xeb,Andr\xe9", "André")):
        for n in (1, many):
            path = tmp_path / f"{name}-{n}.csv"
            path.write_bytes(b"First,Last\n" + row * n + last)
            got = read_delimited(spark, path).filter("First not like 'plain'").collect()
            assert [(r["First"], r["Last"]) for r in got] == [("Zoë", want)]
