"""What a file's bytes say about its encoding, in counts that add up over blocks of the file.

The text source cuts a file at line feeds and decodes nothing, so lines are the raw bytes. Each block of a file gives a row of
counts; their sums judge the file. UTF-16 is told by its mark, or without one by where zero bytes stand in the first line, which
begins at an even place. Single-byte files are Windows-1252 if they have the signs that it alone has, and Latin-1 otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of encodings, and byte order marks.
UTF8, UTF16, UTF16LE, UTF16BE, LATIN1, WINDOWS = "UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "ISO-8859-1", "windows-1252"
MARKS = ((b"\xef\xbb\xbf", UTF8), (b"\xff\xfe", UTF16), (b"\xfe\xff", UTF16))
#: The places of Windows-1252 that Latin-1 has control signs at, and the five that it leaves open.
_PLACES = bytes(range(0x80, 0xA0))
_OPEN = "".join(chr(b) for b in _PLACES if not bytes([b]).decode("cp1252", "ignore"))
_CONTROLS = "".join(chr(b) for b in _PLACES if chr(b) not in _OPEN)
_SIGNS = _CONTROLS.encode("latin-1").decode("cp1252")
_ALIASES = {"utf8": UTF8, "utf-8-sig": UTF8, "latin-1": LATIN1, "latin1": LATIN1, "iso8859-1": LATIN1, "cp1252": WINDOWS, "windows1252": WINDOWS}


def known(name: str) -> str:
    """The encoding's name as it is written here."""
    names = {e.lower(): e for e in (UTF8, UTF16, UTF16LE, UTF16BE, LATIN1, WINDOWS)} | _ALIASES
    if name.lower() not in names:
        raise ValueError(f"Unknown encoding '{name}'. Known: {', '.join(sorted(names))}")
    return names[name.lower()]


def decoded(raw: Column, encoding: str) -> Column:
    """Text of bytes. Windows-1252 is Latin-1 with other signs at 27 places, which Spark's own decoders don't have."""
    if encoding == UTF8:
        return raw.cast("string")
    text = F.decode(raw, LATIN1 if encoding == WINDOWS else encoding)
    return F.translate(text, _CONTROLS, _SIGNS) if encoding == WINDOWS else text


def of_first_line(line: bytes) -> str | None:
    """The encoding, where a file's first line (without its line feed) settles it."""
    for mark, name in MARKS:
        if line.startswith(mark):
            return name
    even, odd = line[::2].count(0), line[1::2].count(0)
    if max(even, odd) * 4 > len(line):
        return UTF16BE if even > odd else UTF16LE
    return None


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block (where the part of the file that a task reads begins) and raw bytes of each line, in order within a block."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))


def profile(lines: DataFrame) -> DataFrame:
    """Of each block of each file: lines, whether they are UTF-8, and counts of quotes, of signs that Windows-1252 alone has (and of
    those among them that stand by a letter, as apostrophes and quotes do) and of places that it leaves open."""
    text = F.decode("raw", LATIN1)

    def count(pattern: str) -> Column:
        return F.sum(F.regexp_count("text", F.lit(pattern)).cast("long"))

    letter = "[A-Za-z\\xc0-\\xff]"
    return (
        lines.select("path", "block", F.is_valid_utf8(F.col("raw").cast("string")).alias("fine"), text.alias("text"))
        .groupBy("path", "block")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.bool_and("fine").alias("utf8"),
            count('"').alias("quotes"),
            count(f"[{_CONTROLS}]").alias("signs"),
            count(f"{letter}[{_CONTROLS}]|[{_CONTROLS}]{letter}").alias("by_letters"),
            count(f"[{_OPEN}]").alias("open"),
        )
    )


def judged(utf8: bool, signs: int, by_letters: int, open_places: int) -> str:
    """By a file's counts: UTF-8 if all lines are; Windows-1252 if its own signs, mostly at words, outnumber places that it leaves open."""
    if utf8:
        return UTF8
    return WINDOWS if signs and signs + by_letters > 4 * open_places else LATIN1
