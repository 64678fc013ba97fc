"""Files on any file system that Spark reaches: written, copied and packed by the JVM, without passing through Python."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def child(folder: str, name: str) -> str:
    return f"{str(folder).rstrip('/')}/{name}"


def _at(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    own = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> None:
    own, files = _at(spark, path)
    files.mkdirs(own)


def put(spark: SparkSession, path: str, data: bytes | str) -> str:
    """Write a small file; returns its path."""
    own, files = _at(spark, path)
    out = files.create(own, True)
    try:
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
    finally:
        out.close()
    return str(path)


def write_single(df: DataFrame, path: str, order: str | None = None) -> str:
    """One CSV file with a header, in the order of a column that isn't written; blanks and nulls are bare, white space stays."""
    # One task sorts and writes: after a global sort, coalesce(1) may begin with any partition whose place is known.
    rows, spark = df.repartition(1).sortWithinPartitions(order).drop(order) if order else df.coalesce(1), df.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"  # beside the target, on its file system, which all executors share
    rows.write.csv(folder, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    target, files = _at(spark, path)
    parts, _ = _at(spark, folder)
    made = files.globStatus(_at(spark, f"{folder}/part-*")[0])
    if len(made) != 1:
        raise RuntimeError(f"{folder} holds {len(made)} files where one was written; the driver and the executors don't share it")
    files.delete(target, False)
    if not files.rename(made[0].getPath(), target):
        raise RuntimeError(f"{folder} can't be renamed to {path}")
    files.delete(parts, True)
    return str(path)


def package(spark: SparkSession, paths: list[str], target: str) -> str:
    """A ZIP archive of files under their last names, streamed from file system to file system."""
    own, files = _at(spark, target)
    archive = spark._jvm.java.util.zip.ZipOutputStream(files.create(own, True))
    try:
        for path in paths:
            source, there = _at(spark, path)
            archive.putNextEntry(spark._jvm.java.util.zip.ZipEntry(source.getName()))
            stream = there.open(source)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, archive, 1 << 16, False)
            finally:
                stream.close()
            archive.closeEntry()
    finally:
        archive.close()
    return str(target)
