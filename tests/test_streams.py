from datetime import datetime, timedelta

from cleanloom.streaming.unique import uniqueness_stream

KINDS = "n long, at timestamp, email string, code string"


def run(spark, folder):
    """All that is there, to the sink; a new query each time, from the checkpoint."""
    stream = spark.readStream.schema(KINDS).parquet(f"{folder}/in")
    out = uniqueness_stream(stream, ["email", "code"], "n", "at", within="2 hours", delay="10 minutes")
    job = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    job.awaitTermination()
    return sorted((r.field, r.row, r.message) for r in spark.read.parquet(f"{folder}/out").collect())


def add(spark, folder, rows):
    spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_issues_come_as_values_repeat_and_over_restarts(spark, tmp_path):
    at = lambda minutes: datetime(2026, 1, 1) + timedelta(minutes=minutes)
    said = lambda field, value, rows: [(field, n, f"Value '{value}' is not unique in field '{field}'") for n in rows]
    add(spark, tmp_path, [(1, at(0), "a@x", "N/A"), (2, at(1), "b@x", "N/A"), (3, at(2), "c@x", "7"), (4, at(3), "c@x", "8")])
    assert run(spark, tmp_path) == said("email", "c@x", [3, 4])
    add(spark, tmp_path, [(5, at(5), "a@x", "8"), (6, at(6), "c@x", None)])  # another query finds the values in the checkpoint
    assert run(spark, tmp_path) == sorted(said("email", "c@x", [3, 4, 6]) + said("email", "a@x", [1, 5]) + said("code", "8", [4, 5]))
    before = run(spark, tmp_path)
    add(spark, tmp_path, [(7, at(600), "z@x", "")])
    add(spark, tmp_path, [(8, at(601), "y@x", "")])
    run(spark, tmp_path)  # the watermark passes
    add(spark, tmp_path, [(9, at(602), "b@x", "7"), (10, at(603), "b@x", "-")])
    assert run(spark, tmp_path) == sorted(before + said("email", "b@x", [9, 10]))  # rows 2 and 3 were held no longer
