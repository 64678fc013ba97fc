"""Delimited files read as strings, blanks as empty text."""

from __future__ import annotations

import csv
import io
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encodings import UTF8, UTF16, UTF16BE, UTF16LE, decoded, judged, known, of_first_line, profile, raw_lines
from .files import put
from .records import after, held, records
from .rows import RID


def mangle(names: list[str]) -> list[str]:
    """Names that differ in more than case: repeated ones, and the engine's own column, get .1, .2 and so on; blank ones are named by their place."""
    named = [n if n.strip() else f"Unnamed: {k}" for k, n in enumerate(names)]
    taken = {n.lower() for n in named}
    seen, out = {RID}, []
    for name in named:
        free, n = name, 0
        while free.lower() in seen or n and free.lower() in taken:
            n += 1
            free = f"{name}.{n}"
        seen.add(free.lower())
        out.append(free)
    return out


def size_of(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


@dataclass
class Lines:
    """A file's (or a folder's files') lines as text: path, block, value; and path, block and quotes of each block."""

    rows: DataFrame
    blocks: DataFrame
    encoding: str


def lines_of(spark: SparkSession, path: str, encoding: str | None = None) -> Lines:
    """The encoding is what is given, else what the first line says, else what the counts of all blocks say."""
    raw = raw_lines(spark, path)
    first = raw.filter("block = 0").select("raw").take(1)
    encoding = known(encoding) if encoding else of_first_line(bytes(first[0].raw)) if first else UTF8
    if encoding in (UTF16, UTF16LE, UTF16BE):  # line feeds are no bytes of their own, so a file is one block
        whole = spark.read.format("binaryFile").load(path).select("path", F.lit(0).cast("long").alias("block"), F.decode("content", encoding).alias("text"))
        rows = whole.select("path", "block", F.explode(F.split(F.ltrim("text", F.lit("\ufeff")), "\n")).alias("value"))
        blocks = rows.groupBy("path", "block").agg(F.sum(F.regexp_count("value", F.lit('"')).cast("long")).alias("quotes"))
        return Lines(rows, held(blocks), encoding)
    blocks = held(profile(raw))
    if encoding is None:
        told = blocks.agg(F.bool_and("utf8").alias("utf8"), *(F.sum(c).alias(c) for c in ("signs", "by_letters", "open"))).first()
        encoding = judged(told.utf8 is not False, told.signs or 0, told.by_letters or 0, told.open or 0)
    return Lines(raw.select("path", "block", decoded(F.col("raw"), encoding).alias("value")), blocks.select("path", "block", "quotes"), encoding)


def header_of(lines: DataFrame) -> list[str]:
    """The fields of the first record that isn't blank, however long it is."""
    first, most = lines.filter("block = 0").select("value"), 16
    while True:
        got = [r.value for r in first.take(most)]
        record, inside = [], False
        for line in got:
            inside = after(line, inside)[0]
            record.append(line)
            if not inside and "\n".join(record).strip(" \t\r"):
                text = "\n".join(record).removeprefix("\ufeff")
                limit = csv.field_size_limit(max(csv.field_size_limit(), len(text)))
                try:
                    return next(csv.reader(io.StringIO(text, newline="")))
                finally:
                    csv.field_size_limit(limit)
            record = record if inside else []
        if len(got) < most:
            raise ValueError("The file has no header")
        most *= 16


def read_delimited(spark: SparkSession, path: str | Path, encoding: str | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """All columns as strings, blanks as empty text, with _rid; each file's first record is its header.

    Records are cut in many tasks, also where fields hold line breaks. Those shorter than the header are filled up; longer ones
    raise with their place when they are read.
    """
    path = str(path)
    if max_bytes is not None and (size := size_of(spark, path)) > max_bytes:
        raise ValueError(f"The file has {size} bytes; at most {max_bytes} are taken")
    lines = lines_of(spark, path, encoding)
    names = mangle(header_of(lines.rows))
    out = parsed(records(lines.rows, lines.blocks).filter("not head"), names)
    out = out.select(*[F.coalesce(F.col(f"c{k}"), F.lit("")).alias(n) for k, n in enumerate(names)], F.col("rid").alias(RID))
    return out.orderBy(RID).limit(max_rows) if max_rows is not None else out


def parsed(rows: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """path, rid, fields and c0, c1 and so on, the fields under the names; strict: records with more fields raise."""
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "maxColumns": str(max(20480, len(names) + 1))}
    if strict:
        said = F.concat(F.lit("A record of "), "path", F.lit(" (number "), F.expr("rid & 8589934591").cast("string"), F.lit(" of block "), F.shiftright("rid", 33).cast("string"), F.lit(") has "), F.col("fields").cast("string"), F.lit(f" fields, the header {len(names)}"))
        rows = rows.filter(F.when(F.col("fields") > len(names), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    return rows.select("path", "rid", "fields", F.from_csv("record", schema, options).alias("own")).select("path", "rid", "fields", "own.*")


def read_bytes(spark: SparkSession, data: bytes, folder: str, **options) -> DataFrame:
    """read_delimited of an upload's bytes, which are first written as a file to a folder that all executors share."""
    return read_delimited(spark, put(spark, f"{folder}/upload-{uuid.uuid4().hex}.csv", data), **options)
