import re

import pytest

from cleanloom.functions import scalars as S

CASES = [
    ("US", "(212) 736-5000", "+12127365000", True), ("US", "212-555-0123", "+12125550123", True), ("US", "555-736-5000", "+15557365000", False), ("US", "12345", "12345", False),
    ("US", "+442079460018", "+442079460018", True), ("US", "+44 7000 12345", "+44700012345", False), ("US", "011 33 1 42 68 53 00", "+33142685300", True), ("FR", "0142685300", "+33142685300", True),
    ("US", "+999 1234 5678", "+999 1234 5678", False), ("US", "+210 1234 5678", "+210 1234 5678", False), ("US", "+850 1912345678", "+8501912345678", True), ("US", "+1 212 736 50000", "+1 212 736 50000", False),
    ("RU", "8 (912) 345-67-89", "+79123456789", True), ("HU", "06 1 234 5678", "+3612345678", True), ("IT", "06 69", "06 69", False), ("IT", "06 698 12345", "+390669812345", True), ("DE", "030/901820", "+4930901820", True),
    ("SG", "1123 4567", "+6511234567", False), ("HK", "2123 4567", "+85221234567", True), ("BR", "(11) 91234-5678", "+5511912345678", True), ("ZZ", "(212) 736-5000", "+12127365000", True), ("US", "", "", False), ("US", None, None, False),
]


def test_possible_and_valid_are_kept_apart(spark):
    for region in {c[0] for c in CASES}:
        own = [c for c in CASES if c[0] == region]
        rows = spark.createDataFrame([(k, c[1]) for k, c in enumerate(own)], "k int, x string")
        got = rows.select("k", S.phone_e164("x", region), S.is_valid_phone("x", region)).orderBy("k").collect()
        assert [tuple(r)[1:] for r in got] == [c[2:] for c in own]


def test_calling_codes_are_a_tree():
    """Every three digits begin with one calling code at most, and all codes of regions are among them."""
    short, long_ = re.compile(S._SHORT_CODES), re.compile(S._LONG_CODES)
    for n in range(1000):
        digits = f"{n:03}"
        assert not (short.match(digits) and long_.fullmatch(digits)), digits
    assert all(short.fullmatch(code) or long_.fullmatch(code) for code, *_ in S.REGIONS.values())
    assert all(least <= most and len(code) + most <= 15 for code, _, least, most in S.REGIONS.values())
    assert set(S.IN_USE) <= {code for code, *_ in S.REGIONS.values()}


@pytest.mark.parametrize("region", ["US", "DE", "IT", "LU"])
def test_e164_stays_as_it_is(spark, region):
    numbers = ["+12127365000", "+390669812345", "+491701234567", "+3524711"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(numbers)], "k int, x string")
    assert [r[0] for r in rows.orderBy("k").select(S.phone_e164("x", region)).collect()] == numbers
