from datetime import date, datetime

import pytest

from cleanloom.functions import scalars as S

DEFAULT = date(2026, 3, 31)
WHOLE = {
    "10:30 5 March 2024": "2024-03-05", "5 March 2024 at 10:30 pm": "2024-03-05", "10:30:05.25Z, Tue 5 Mar 2024": "2024-03-05", "5th of March, 2024": "2024-03-05", "2024 March 5": "2024-03-05", "March 2024 5": "2024-03-05",
    "3pm on March 5 24": "2024-03-05", "5 March '24": "5 March '24", "31 April 2024": "31 April 2024", "May 5, 2024 08:15 UTC": "2024-05-05", "99 Jan 5": "1999-01-05", "24 5 Jan": "2024-01-05", "soon": "soon", "March march 5 2024": "March march 5 2024",
    "2024-W05-3": "2024-W05-3", "5 March 2024 extra": "5 March 2024 extra", "12:30": "12:30", "Monday": "Monday",
}
LACKING = {
    "Feb 2024": "2024-02-29", "February": "2026-02-28", "5 March": "2026-03-05", "March 5": "2026-03-05", "Jun 99": "1999-06-30", "04/2023": "2023-04-30", "2023-04": "2023-04-30", "4/5": "2026-04-05", "13/5": "13/5", "2019": "2019-03-31",
    "10:30 March 5": "2026-03-05", "Feb 30": "Feb 30",
}


def iso(spark, values, **options):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").repartition(1)
    return [r[0] for r in rows.orderBy("k").select(S.to_iso_date("x", this_year=2026, **options)).collect()]


def test_dates_of_free_form(spark):
    assert dict(zip(WHOLE, iso(spark, WHOLE), strict=True)) == WHOLE
    assert dict(zip(WHOLE, iso(spark, WHOLE, default=DEFAULT), strict=True)) == WHOLE
    assert iso(spark, LACKING) == list(LACKING)  # without a default they stay


def test_missing_parts_come_from_the_default(spark):
    assert dict(zip(LACKING, iso(spark, LACKING, default=DEFAULT), strict=True)) == LACKING
    assert iso(spark, ["4/5", "4/15"], default=DEFAULT, day_first=True) == ["2026-05-04", "2026-04-15"]


def test_as_the_public_parser_has_it(spark):
    parser = pytest.importorskip("dateutil.parser")
    values = [v for v in [*WHOLE, *LACKING] if v not in ("2024-W05-3", "soon", "Monday", "12:30", "5 March '24", "March march 5 2024", "5 March 2024 extra")]
    want = []
    for v in values:
        try:
            want.append(parser.parse(v, default=datetime(2026, 3, 31)).date().isoformat())
        except (ValueError, OverflowError):
            want.append(v)
    got = dict(zip(values, iso(spark, values, default=DEFAULT), strict=True))
    assert got == dict(zip(values, want, strict=True))
