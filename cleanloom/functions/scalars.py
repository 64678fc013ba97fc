"""Scalar functions as Column expressions: missing values, white space, e-mail, phone, date, number and case.

All are built-in expressions but for `ascii_fold`, for which Spark has none. Those that use `let`, a lambda over an array of one value,
are evaluated without whole-stage codegen. Inputs may be of any type; text
functions work on their string form. A gap, stated in the README: phone rules follow public numbering plans rather than a full
metadata library (G1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a missing value, in lower case.
MISSING = ("", "-", "n/a", "na", "null", "none", "nan", "#n/a", "unknown")
# Patterns of valid e-mail addresses and of numbers in scientific notation.
EMAIL = r"(?U)^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"
SCIENTIFIC = r"(?U)^[+-]?\d+(\.\d+)?[eE][+-]?\d+$"
#: White space as Python's str.strip() and \s have it: Unicode's, and U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"
#: Numbers with a greater exponent are left as text, since their digits would take that much room.
MAX_EXPONENT = 400

# Calling code, trunk prefix, and least and greatest length of national numbers, by region.
REGIONS = {
    "US": ("1", "1", 10, 10), "CA": ("1", "1", 10, 10), "GB": ("44", "0", 9, 10), "IE": ("353", "0", 7, 9), "FR": ("33", "0", 9, 9),
    "DE": ("49", "0", 6, 11), "ES": ("34", "", 9, 9), "IT": ("39", "", 6, 11), "NL": ("31", "0", 9, 9), "BE": ("32", "0", 8, 9),
    "CH": ("41", "0", 9, 9), "AT": ("43", "0", 6, 13), "PT": ("351", "", 9, 9), "SE": ("46", "0", 7, 9), "NO": ("47", "", 8, 8),
    "DK": ("45", "", 8, 8), "PL": ("48", "", 9, 9), "AU": ("61", "0", 9, 9), "NZ": ("64", "0", 8, 10), "IN": ("91", "0", 10, 10),
    "JP": ("81", "0", 9, 10), "CN": ("86", "0", 10, 11), "BR": ("55", "0", 10, 11), "MX": ("52", "", 10, 10), "ZA": ("27", "0", 9, 9),
    "AE": ("971", "0", 8, 9), "AR": ("54", "0", 10, 11), "BD": ("880", "0", 8, 10), "BG": ("359", "0", 7, 9), "BO": ("591", "0", 8, 8), "CL": ("56", "", 9, 9),
    "CO": ("57", "", 8, 10), "CR": ("506", "", 8, 8), "CU": ("53", "0", 6, 8), "CY": ("357", "", 8, 8), "CZ": ("420", "", 9, 9), "DO": ("1", "1", 10, 10),
    "DZ": ("213", "0", 8, 9), "EC": ("593", "0", 8, 9), "EE": ("372", "", 7, 8), "EG": ("20", "0", 8, 10), "ET": ("251", "0", 9, 9), "FI": ("358", "0", 5, 12),
    "GH": ("233", "0", 9, 9), "GR": ("30", "", 10, 10), "GT": ("502", "", 8, 8), "HK": ("852", "", 8, 8), "HR": ("385", "0", 8, 9), "HU": ("36", "06", 8, 9),
    "ID": ("62", "0", 8, 12), "IL": ("972", "0", 8, 9), "IQ": ("964", "0", 8, 10), "IR": ("98", "0", 10, 10), "IS": ("354", "", 7, 9), "JM": ("1", "1", 10, 10),
    "JO": ("962", "0", 8, 9), "KE": ("254", "0", 9, 9), "KR": ("82", "0", 8, 10), "KW": ("965", "", 8, 8), "KZ": ("7", "8", 10, 10), "LB": ("961", "0", 7, 8),
    "LK": ("94", "0", 9, 9), "LT": ("370", "0", 8, 8), "LU": ("352", "", 4, 11), "LV": ("371", "", 8, 8), "MA": ("212", "0", 9, 9), "MT": ("356", "", 8, 8),
    "MY": ("60", "0", 8, 10), "NG": ("234", "0", 8, 10), "NP": ("977", "0", 8, 10), "PA": ("507", "", 7, 8), "PE": ("51", "0", 8, 9), "PH": ("63", "0", 8, 10),
    "PK": ("92", "0", 9, 10), "PY": ("595", "0", 8, 9), "QA": ("974", "", 7, 8), "RO": ("40", "0", 9, 9), "RS": ("381", "0", 8, 9), "RU": ("7", "8", 10, 10),
    "SA": ("966", "0", 9, 9), "SG": ("65", "", 8, 8), "SI": ("386", "0", 8, 8), "SK": ("421", "0", 9, 9), "TH": ("66", "0", 8, 9), "TN": ("216", "", 8, 8),
    "TR": ("90", "0", 10, 10), "TW": ("886", "0", 8, 9), "TZ": ("255", "0", 9, 9), "UA": ("380", "0", 9, 9), "UG": ("256", "0", 9, 9), "UY": ("598", "0", 8, 8),
    "VE": ("58", "0", 10, 10), "VN": ("84", "0", 9, 10),
}
# The tree of calling codes by the world's numbering zones. Those of one and of two digits; and those of three that are assigned.
_SHORT_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_LONG_CODES = "21[12368]|2[2-46]\\d|25[0-8]|29[0179]|3[57]\\d|38[0-35-79]|42[013]|50\\d|59\\d|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[08]|88[0136]|96[0-8]|97[0-79]|99[2-68]"
# National numbers that are in use, by calling code: what they begin with, and their lengths, by public plans.
IN_USE = {
    "1": r"(?!555)[2-9](?!11)[0-8]\d[2-9]\d{6}", "7": r"[34689]\d{9}", "27": r"[1-8]\d{8}", "30": r"[26-9]\d{9}", "31": r"[1-9]\d{8}", "32": r"[1-9]\d{7}|4\d{8}", "33": r"[1-9]\d{8}",
    "34": r"[5-9]\d{8}", "36": r"[1-9]\d{7,8}", "39": r"0\d{5,10}|[13]\d{8,9}|[58]\d{5,9}", "40": r"[237-9]\d{8}", "41": r"[2-9]\d{8}", "43": r"[1-9]\d{5,12}", "44": r"[12]\d{8,9}|[389]\d{9}|5[56]\d{8}|7[1-57-9]\d{8}",
    "45": r"[2-9]\d{7}", "46": r"[1-9]\d{6,8}", "47": r"[2-9]\d{7}", "48": r"[1-9]\d{8}", "49": r"[1-9]\d{5,10}", "52": r"[2-9]\d{9}", "55": r"[1-9]{2}(?:[2-5]\d{7}|9\d{8})",
    "61": r"[23478]\d{8}|1[38]\d{7,8}", "64": r"[34679]\d{7}|2\d{7,9}|[58]\d{7,9}", "65": r"[3689]\d{7}", "81": r"[1-9]\d{8,9}", "86": r"1[3-9]\d{9}|10\d{8}|[2-9]\d{9,10}", "90": r"[2-58]\d{9}", "91": r"[2-9]\d{9}",
    "351": r"[236-9]\d{8}", "353": r"[1-9]\d{6,8}", "852": r"[2-9]\d{7}",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once a row; without it, expressions that use a value n times at each of k levels grow as n**k."""
    return F.get(F.transform(F.array(value), body), 0)


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text(c), rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def is_missing(c: Column | str, tokens: Iterable[str] = MISSING) -> Column:
    """True for null and for text that, stripped and in lower case, is one of the tokens. NaN's string form is a token."""
    return text(c).isNull() | F.lower(strip(c)).isin(*tokens)


def _unless_missing(c: Column | str, out: Callable[[Column], Column]) -> Column:
    """out of the stripped text, or the text as it is if missing."""
    return let(strip(c), lambda own: F.when(own.isNull() | F.lower(own).isin(*MISSING), text(c)).otherwise(out(own)))


def trim_whitespace(c: Column | str, collapse: bool = True) -> Column:
    out = strip(c)
    return F.regexp_replace(out, rf"(?U){_SPACE}+", " ") if collapse else out


def email_lowercase(c: Column | str) -> Column:
    return F.lower(strip(c))


def is_valid_email(c: Column | str) -> Column:
    return F.coalesce(strip(c).rlike(EMAIL), F.lit(False))


def upper_case(c: Column | str) -> Column:
    return F.upper(text(c))


def lower_case(c: Column | str) -> Column:
    return F.lower(text(c))


def title_case(c: Column | str) -> Column:
    """A capital after everything that isn't a letter, as Python's str.title() has it."""
    runs = F.regexp_extract_all(F.lower(text(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000_000))), "")


def digits_only(c: Column | str) -> Column:
    return _unless_missing(c, lambda own: F.regexp_replace(own, r"(?U)\D", ""))


def fold_udf():
    """Compatibility decomposition without combining marks; an Arrow UDF, as Spark has no normalisation."""

    def fold(values: pd.Series) -> pd.Series:
        import unicodedata

        def one(x: str | None) -> str | None:
            if x is None or x.isascii():
                return x
            return "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))

        return values.map(one, na_action="ignore")

    return F.pandas_udf(fold, "string")


def ascii_fold(c: Column | str) -> Column:
    return fold_udf()(text(c))


def expand_scientific_notation(c: Column | str) -> Column:
    """4.05E+14 as 405000000000000, exactly, by moving the point in the string; other text stays, unstripped."""
    pattern = r"(?U)^([+-]?)(\d+)(?:\.(\d+))?[eE]([+-]?\d{1,9})$"

    def plain(own: Column) -> Column:
        part = lambda k: F.regexp_extract(own, pattern, k)
        made = F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("digits"), part(4).try_cast("int").alias("exponent"), F.length(part(2)).alias("size"))
        return let(made, spread)

    def spread(p: Column) -> Column:
        digits, point = p["digits"], p["size"] + p["exponent"]
        padded = F.concat(F.repeat(F.lit("0"), 1 - point), digits, F.repeat(F.lit("0"), point - F.length(digits)))
        at = F.greatest(point, F.lit(1))
        whole = F.regexp_replace(F.substring(padded, F.lit(1), at), r"^0+(?=\d)", "")
        rest = F.regexp_replace(F.substring(padded, at + 1, F.lit(1_000_000)), r"0+$", "")
        number = F.concat(F.when(p["sign"] == "-", F.lit("-")).otherwise(F.lit("")), whole, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)))
        return F.when(F.abs(p["exponent"]) <= MAX_EXPONENT, number)

    return F.when(F.coalesce(strip(c).rlike(SCIENTIFIC), F.lit(False)), F.coalesce(let(strip(c), plain), text(c))).otherwise(text(c))


# Phones


def _parsed_phone(own: Column, region: str) -> Column:
    """Stripped text's number as + and digits where it is possible, else null."""
    code, trunk, least, most = REGIONS.get(region.upper(), REGIONS["US"])
    abroad = "011" if code == "1" else "00"

    def whole(bare: Column) -> Column:
        digits = bare["digits"]
        national = F.regexp_replace(digits, f"^{trunk}", "") if trunk and code != "1" else F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits) if code == "1" else digits
        inland = F.when(F.length(national).between(least, most), F.concat(F.lit(code), national)).when(digits.startswith(code) & F.length(digits).between(least + len(code), most + len(code)), digits)
        return F.when(bare["plus"], digits).when(digits.startswith(abroad), F.substring(digits, len(abroad) + 1, 99)).otherwise(inland)

    clean = F.regexp_replace(F.regexp_replace(own, r"^(\d+)\.0$", "$1"), r"(?i)[\s,;]*(ext(ension)?\.?|x|#)\s*\d{1,7}$", "")

    def number(own: Column) -> Column:
        shaped = own.rlike(r"^\+?[\d\s().\-/\u00a0\u2010-\u2015]+$")
        bare = F.struct(own.startswith("+").alias("plus"), F.regexp_replace(own, r"\D", "").alias("digits"))
        return F.when(shaped, let(bare, lambda b: let(whole(b), lambda w: F.when(_possible(w), F.concat(F.lit("+"), w)))))

    return let(clean, number)


def _possible_pattern() -> str:
    """Digits of an international number: of a calling code with lengths stated above, or of another assigned one, with 15 digits at most.

    The longest prefix decides, as in a tree: no calling code is the beginning of another one.
    """
    lengths: dict[str, tuple[int, int]] = {}
    for code, _, least, most in REGIONS.values():
        low, high = lengths.get(code, (least, most))
        lengths[code] = (min(low, least), max(high, most))
    known = "|".join(rf"{code}\d{{{least},{most}}}" for code, (least, most) in lengths.items())
    return rf"^(?:{known}|(?!{'|'.join(lengths)})(?:(?:{_SHORT_CODES})\d{{6,13}}|(?:{_LONG_CODES})\d{{5,12}}))$"


def _valid_pattern() -> str:
    """E.164 numbers in use: as IN_USE has them, or any possible one of a calling code that it lacks."""
    return rf"^\+(?:{'|'.join(f'{code}(?:{own})' for code, own in IN_USE.items())}|(?!{'|'.join(IN_USE)})\d+)$"


def _possible(whole: Column) -> Column:
    return F.coalesce(whole.rlike(_possible_pattern()), F.lit(False))


def phone_e164(c: Column | str, region: str = "US") -> Column:
    return _unless_missing(c, lambda own: F.coalesce(_parsed_phone(own, region), own))


def is_valid_phone(c: Column | str, region: str = "US") -> Column:
    """Stricter than possible: the national number must be one in use, as far as IN_USE says which are."""
    return F.coalesce(_parsed_phone(strip(c), region).rlike(_valid_pattern()), F.lit(False))


# Dates

# Strftime directives and the pattern letters that Spark has for them.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "y": "yy", "b": "MMM", "B": "MMMM", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "%": "%"}
_TIME = r"(?:[T\s,]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[aApP]\.?[mM]\.?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")


def java_format(fmt: str) -> str:
    """The pattern for date_format() of a strftime format."""
    out, k = [], 0
    while k < len(fmt):
        if fmt[k] == "%" and k + 1 < len(fmt):
            if fmt[k + 1] not in DIRECTIVES:
                raise ValueError(f"Unsupported date format directive '%{fmt[k + 1]}'")
            out.append(DIRECTIVES[fmt[k + 1]])
            k += 2
        else:
            out.append(f"'{fmt[k]}'" if fmt[k].isalpha() else "''" if fmt[k] == "'" else fmt[k])
            k += 1
    return "".join(out)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), month, day), "yyyy-M-d")


def _groups(own: Column, pattern: str, names: tuple[str, str, str]) -> Column:
    """year, month and day as matched, null where the pattern doesn't match; names: what its groups are."""
    parts = {n: F.regexp_extract(own, pattern, k + 1) for k, n in enumerate(names)}
    return F.struct(*[F.when(parts[n] != "", parts[n]).alias(n) for n in ("year", "month", "day")])


#: What may stand anywhere in a date of free form: a time with its zone, weekdays, fillers and endings of ordinal numbers.
_CLOCK = r"\bt?\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]\.?m\b\.?)?(?:\s*(?:z\b|utc\b|gmt\b|[+-]\d{2}:?\d{2}))?|\b\d{1,2}\s*[ap]\.?m\b\.?"
_FILLERS = r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b|\b(?:of|at|on|and)\b|(?<=\d)(?:st|nd|rd|th)\b"


def free_form(own: Column, resolved: Callable[[Column], Column], day_first: bool, default: date | None) -> Column:
    """The date of text in free form, by its tokens: one month's name at most, and numbers, of which those over 31 or of more than two
    digits are years. With a name and two numbers the year is the large one, else the first if both stand before the name, else the second.

    Parts that are lacking come from the default (its day cut to the month's last); without a default such text has no date.
    """
    names = "|".join(_MONTHS)

    def tokens(words: Column) -> Column:
        head = F.regexp_extract(words, rf"^(.*?)\b(?:{names})\b", 1)
        name = F.regexp_extract(words, rf"\b({names})\b", 1)
        numbers = F.regexp_extract_all(words, F.lit(r"(\d+)"), F.lit(1))
        known = words.rlike(rf"^[\s,./-]*(?:(?:\d{{1,4}}|(?:{names})\.?)(?:[\s,./-]+|$))+$") & (F.regexp_count(words, F.lit(rf"\b(?:{names})\b")) <= 1)
        return F.when(known, F.struct(F.nullif(name, F.lit("")).alias("name"), numbers.alias("numbers"), F.size(numbers).alias("n"), F.regexp_count(head, F.lit(r"\d+")).alias("before")))

    def large(x: Column) -> Column:
        return (F.length(x) > 2) | (x.try_cast("int") > 31)

    def read(t: Column) -> Column:
        a, b, name = F.get(t["numbers"], 0), F.get(t["numbers"], 1), t["name"]

        def parts(y: Column, m: Column, d: Column, own_day: bool = True) -> Column:
            return F.struct(y.alias("year"), m.alias("month"), d.alias("day"), F.lit(own_day).alias("own_day"))

        first_is_year = large(a) | (~large(b) & (t["before"] == 2))
        out = F.when(name.isNotNull() & (t["n"] == 2), parts(F.when(first_is_year, a).otherwise(b), name, F.when(first_is_year, b).otherwise(a)))
        if default is None:
            return out
        year, month, day = (F.lit(str(x)) for x in (default.year, default.month, default.day))
        swap = F.lit(day_first) & (b.try_cast("int") <= 12)
        out = out.when(name.isNotNull() & (t["n"] == 1), F.when(large(a), parts(a, name, day, False)).otherwise(parts(year, name, a)))
        out = out.when(name.isNotNull() & (t["n"] == 0), parts(year, name, day, False))
        out = out.when(name.isNull() & (t["n"] == 2), F.when(large(a), parts(a, b, day, False)).when(large(b), parts(b, a, day, False)).when(swap, parts(year, b, a)).otherwise(parts(year, a, b)))
        return out.when(name.isNull() & (t["n"] == 1) & (F.length(a) == 4), parts(a, month, day, False))

    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(own), _CLOCK, " "), _FILLERS, " "))
    return let(words, lambda w: let(tokens(w), lambda t: let(read(t), resolved)))


def parsed_date(own: Column, day_first: bool = False, this_year: int | None = None, default: date | None = None) -> Column:
    """The date that stripped text has, or null. Year-first numbers are year, month, day; others in the preferred order, or in the
    other order where that is the only one possible. Two-digit years lie within 50 years of this_year. What none of these shapes
    fits is read in free form; default: what parts that it lacks are taken from."""
    now = this_year or date.today().year
    months = F.expr(f"map({', '.join(f"'{m[:3]}', '{k + 1}'" for k, m in enumerate(_MONTHS))})")

    def full(year: Column) -> Column:
        near = year.try_cast("int") + (now // 100) * 100
        return F.when(F.length(year) == 2, let(near, lambda y: F.when(y >= now + 50, y - 100).when(y < now - 50, y + 100).otherwise(y)).cast("string")).otherwise(year)

    def day(p: Column) -> Column:
        return _day(full(p["year"]), _number(p["month"]), p["day"])

    def numbers(p: Column) -> Column:
        swap = p["month"].try_cast("int") > 12
        return let(F.struct(p["year"].alias("year"), F.when(swap, p["day"]).otherwise(p["month"]).alias("month"), F.when(swap, p["month"]).otherwise(p["day"]).alias("day")), day)

    def free(p: Column) -> Column:
        """Of a date in free form; a day that came from the default is cut to the month's last."""
        if default is None:
            return day(p)
        last = F.dayofmonth(F.last_day(_day(full(p["year"]), _number(p["month"]), F.lit("1"))))
        own = F.when(p["own_day"], p["day"]).otherwise(F.least(p["day"].try_cast("int"), last).cast("string"))
        return _day(full(p["year"]), _number(p["month"]), own)

    def _number(month: Column) -> Column:
        return F.when(month.rlike(r"^\d+$"), month).otherwise(F.element_at(months, F.lower(F.substring(month, 1, 3))))

    name = rf"({'|'.join(_MONTHS)})\.?"
    ways = [
        let(_groups(own, rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$", ("year", "month", "day")), day),
        let(_groups(own, rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}$", ("year", "month", "day")), day),
        let(_groups(own, rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}$", ("day", "month", "year") if day_first else ("month", "day", "year")), numbers),
        let(_groups(own, rf"(?i)^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[-\s/.]+(?:of\s+)?{name}[-\s/.,]+(\d{{4}}|\d{{2}}){_TIME}$", ("day", "month", "year")), day),
        let(_groups(own, rf"(?i)^{_WEEKDAY}{name}[-\s/.]+(\d{{1,2}})(?:st|nd|rd|th)?[-\s/.,]+(\d{{4}}|\d{{2}}){_TIME}$", ("month", "day", "year")), day),
        let(_groups(own, rf"(?i)^(\d{{4}})[-\s/.]+{name}[-\s/.]+(\d{{1,2}}){_TIME}$", ("year", "month", "day")), day),
        free_form(own, free, day_first, default),
    ]
    return F.coalesce(*ways)


def to_iso_date(c: Column | str, fmt: str = "%Y-%m-%d", day_first: bool = False, this_year: int | None = None, default: date | None = None) -> Column:
    """Dates in the format; other text stays. default: what parts that a date lacks are taken from; without it, such text stays too."""
    return _unless_missing(c, lambda own: F.coalesce(F.date_format(parsed_date(own, day_first, this_year, default), java_format(fmt)), own))


def matches_date_format(c: Column | str, fmt: str = "%Y-%m-%d") -> Column:
    """Whether text is a date exactly in the format."""
    day = F.try_to_timestamp(strip(c), F.lit(java_format(fmt)))
    return F.coalesce(F.date_format(day, java_format(fmt)) == strip(c), F.lit(False))


#: The registry of transforms that mapping templates may name.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "ascii": ascii_fold,
    "date_iso": to_iso_date,
    "digits_only": digits_only,
    "email_lowercase": email_lowercase,
    "expand_scientific_notation": expand_scientific_notation,
    "lower_case": lower_case,
    "phone_e164": phone_e164,
    "title_case": title_case,
    "trim": trim_whitespace,
    "upper_case": upper_case,
}


def register_transform(name: str, fn: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = fn


def get_transform(name: str) -> Callable[[Column], Column]:
    if name not in TRANSFORMS:
        raise ValueError(f"Unknown transform '{name}'. Available: {', '.join(sorted(TRANSFORMS))}")
    return TRANSFORMS[name]
