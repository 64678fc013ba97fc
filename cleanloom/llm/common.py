"""What the operators of this subpackage share: shared-folder tables, word splitting, prefix sums over ordered tables."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space between words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

ROWS_A_TASK = 100_000
#: Characters that a task handles at once.
CHUNK = 250_000
#: Rows and bytes of an Arrow batch.
ARROW_ROWS, ARROW_BYTES = 1000, "8m"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where spark.checkpoint.dir is unset, in local mode alone, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "cleanloom-checkpoints")
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cleanloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from the files, whichever executors are lost.

    rows: a bound of its rows, where known; small tables are then written by few tasks, ROWS_A_TASK rows or so each.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_TASK)
    path = new_folder(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that operators of this subpackage have written; call it when no result of theirs is needed any more."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/cleanloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> None:
    """Let this session hand texts to Python in small batches, so that a worker's memory doesn't follow the length of 10,000 texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def chunks(texts, most: int = CHUNK) -> Iterator[list[str]]:
    """Parts of a column (or list) of texts, of about `most` characters or one text each; null is empty.

    Only some rows at a time become Python strings, and what is made of a part goes before the next one comes.
    """
    slices = [texts] if isinstance(texts, list) else (texts.slice(k, 256).to_pylist() for k in range(0, len(texts), 256))
    part: list[str] = []
    size = 0
    for t in itertools.chain.from_iterable(slices):
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


#: Words of 64 bits of a key filter: 2 MB of bits, 262,144 rows at most, whatever the input's size.
FILTER_WORDS = 1 << 18


def _word(key: str):
    return F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS)).cast("int")


def _bit(key: str):
    return F.shiftright(F.xxhash64(F.col(key), F.lit(7)), 40).bitwiseAND(F.lit(63)).cast("int")


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A one-hash Bloom filter over a column: (word, bits), FILTER_WORDS rows at most."""
    at = keys.select(_word(key).alias("word"), _bit(key).alias("bit"))
    return at.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def give_back() -> None:
    """Hand what this worker has freed back to the system: workers go on to other stages, and their allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def quoted(name: str):
    """The column of that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has, in either case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def may_contain(df: DataFrame, bloom: DataFrame, key: str, found: bool = True) -> DataFrame:
    """The rows of df whose key may be in the filter: all that are, and few others while the filter is sparse; or the other rows.

    The filter has FILTER_WORDS rows at most, so that broadcasting it is bounded.
    """
    at, bit, word, bits = fresh(df.columns, "at", "bit", "word", "bits")
    probe = df.withColumns({at: _word(key), bit: _bit(key)})
    words = bloom.select(F.col("word").alias(word), F.col("bits").alias(bits))
    joined = probe.join(F.broadcast(words), F.col(at) == F.col(word), "inner" if found else "left")
    is_set = F.expr(f"coalesce(shiftright({bits}, {bit}) & 1, 0)") == 1
    return joined.filter(is_set if found else ~is_set).select(*map(quoted, df.columns))


def without_keys(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key isn't in dropped (key); a null key never is. Only rows that may be dropped are shuffled."""
    bloom = cut(key_filter(dropped, key), "dropped-filter")
    safe = may_contain(docs, bloom, key, found=False)
    return safe.unionByName(may_contain(docs, bloom, key).join(dropped, key, "left_anti").select(*map(quoted, docs.columns)))


def keyed_rows(docs: DataFrame, key: str) -> DataFrame:
    """docs with a column `key` that tells rows of different texts apart: doc_id where it has one text only, as nearly all have.

    Of a doc_id with several texts the first (by hash) keeps it, the others get values that no row has: numbers after the greatest
    doc_id, or a doc_id that is text with the hash appended. Rows that repeat both share a key; a null doc_id has none. Only rows
    whose doc_id may have several texts are shuffled, by doc_id and hash.
    """
    number = not isinstance(docs.schema["doc_id"].dataType, StringType)
    own = F.col("doc_id").cast("long") if number else F.col("doc_id")
    mark, id_, to = fresh([*docs.columns, key], "mark", "id", "to")
    marked = docs.withColumn(key, own).withColumn(mark, F.xxhash64(text_or_empty()))
    several = marked.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(mark).alias("first"), F.max(mark).alias("last")).filter("first <> last").select(key, "first")
    several = cut(several, "several-texts")
    if several.isEmpty():
        return marked.drop(mark)
    bloom = cut(key_filter(several, key), "several-filter")
    may = may_contain(marked, bloom, key)
    others = may.select(key, mark).join(several, key).filter(F.col(mark) != F.col("first")).select(key, mark).distinct()
    if number:
        most = docs.agg(F.max(own)).first()[0]
        others = others.repartitionByRange(key, mark).sortWithinPartitions(key, mark).withColumn(to, F.monotonically_increasing_id() + F.lit(most + 1))
    else:
        others = others.withColumn(to, F.concat(F.col(key), F.lit("\x00"), F.hex(mark)))
    others = cut(others, "further-texts").select(F.col(key).alias(id_), F.col(mark).alias(f"{mark}_"), to)
    moved = may.join(others, (F.col(key) == F.col(id_)) & (F.col(mark) == F.col(f"{mark}_")), "left").withColumn(key, F.coalesce(to, key))
    names = [*map(quoted, docs.columns), F.col(key)]
    return may_contain(marked, bloom, key, found=False).select(*names).unionByName(moved.select(*names))
