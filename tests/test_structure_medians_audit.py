import random
import statistics

import pytest
from pyspark.sql import functions as F

from cleanloom.operators import medians as M
from cleanloom.operators.audit import audit_import
from cleanloom.operators.clean import change_counts, clean_data
from cleanloom.operators.medians import medians
from cleanloom.operators.structure import cell_errors, column_types, record_errors, structure_summary
from cleanloom.sources.config import CleaningConfig


def test_types_and_cells(spark):
    rows = [(str(k), f"{k}.5", "2024-01-05" if k % 2 else "3 May 2021", "Yes" if k % 3 else "false", f"t{k}", "") for k in range(40)]
    rows[7] = ("x7", "1e3", "soon", "maybe", "", "N/A")
    rows[20] = ("n/a", "", None, "unknown", "7", "")
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "_rid long, i string, n string, d string, b string, t string, e string")
    types = column_types(df)
    assert {c: t.kind for c, t in types.items()} == {"i": "integer", "n": "number", "d": "date", "b": "boolean", "t": "text", "e": "text"}
    assert [(types[c].cells, types[c].broken, types[c].first) for c in "indb"] == [(39, 1, 7), (39, 0, None), (39, 1, 7), (39, 1, 7)]
    found = sorted(tuple(r) for r in cell_errors(df).collect())
    assert found == [(9, "b", "type-error", "'maybe' is no boolean"), (9, "d", "type-error", "'soon' is no date"), (9, "i", "type-error", "'x7' is no integer")]
    assert structure_summary(df)["errors"] == [{"type": "type-error", "message": m} for m in ("1 cells of 'i' are no integer", "1 cells of 'd' are no date", "1 cells of 'b' are no boolean")]
    assert column_types(df.limit(0))["i"].kind == "text" and cell_errors(df.limit(0)).collect() == []
    assert column_types(df, ["i"], share=1.0)["i"].kind == "text"


def test_records_of_another_length(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('a,b,c\n1,2,3\n4\n"x\ny",5\n\n6,7,8,,9\n')
    found = sorted(tuple(r) for r in record_errors(spark, str(path)).collect())
    assert found == [
        (3, "b", "missing-cell", "Cell 2 is missing"), (3, "c", "missing-cell", "Cell 3 is missing"), (4, "c", "missing-cell", "Cell 3 is missing"),
        (5, "", "extra-cell", "Cell 4 is beyond the header"), (5, "", "extra-cell", "Cell 5 is beyond the header"),
    ]


@pytest.mark.parametrize("few", [1, 5, 4096])
def test_medians_equal_the_exact_ones(spark, few):
    rng = random.Random(few)
    columns = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3001)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(3000)],
        "two": [5.0] * 1500 + [6.0] * 1500,
        "one": [4.0] * 2999,
        "nulls": [None] * 10,
        "some": [None if k % 3 else float(k % 7) for k in range(3000)],
        "pair": [1.0, 2.0],
        "zero": [0.0, -0.0, 1.0],
    }
    rows = [tuple((v + [None] * 3001)[k] for v in columns.values()) for k in range(3001)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    want = {c: statistics.median(x for x in v if x is not None) for c, v in columns.items() if any(x is not None for x in v)}
    assert medians(df, {c: F.col(c) for c in columns}, few) == want
    assert medians(df, {}) == {}


def test_median_search_looks_elsewhere_if_a_sketch_misses():
    search = M._Search(F.lit(0), 100, ranks=(49, 50))
    search.narrow(90.0, 95.0, {"below": 90, "at_low": 1, "between": 4, "at_high": 1, "least": 91.0, "most": 94.0})
    assert (search.low, search.high, search.n, search.ranks) == (None, 90.0, 90, (49, 50))
    search.narrow(1.0, 3.0, {"below": 1, "at_low": 1, "between": 1, "at_high": 1, "least": 2.0, "most": 2.0})
    assert (search.low, search.high, search.n, search.ranks) == (3.0, 90.0, 86, (45, 46))


def brute(left, right, fields, blank=True):
    """Mismatches of all pairs of rows with a key, and their number by field."""
    out = []
    for k, f in enumerate(fields):
        out += [(a[0], f, a[1 + k], b[1 + k]) for a in left for b in right if a[0] == b[0] and (a[0] or blank) and a[1 + k] != b[1 + k]]
    return out, {f: sum(x[1] == f for x in out) for f in fields}


@pytest.mark.parametrize("blank", [True, False])
def test_audit_by_counts_equals_all_pairs(spark, blank):
    rng = random.Random(3)
    rows = lambda n: [(rng.choice(["", "k1", "k2", *(f"k{k}" for k in range(3, 40))]), rng.choice("xyz"), rng.choice(["p", "q"])) for _ in range(n)]
    left, right = rows(60), rows(60)
    kinds = "key string, a string, b string"
    got = audit_import(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), "key", match_blank_keys=blank)
    mismatches, by_field = brute(left, right, ["a", "b"], blank)
    assert got.mismatches_by_field() == by_field and got.expected_records == got.imported_records == 60
    assert sorted(tuple(r) for r in got.mismatches.collect()) == sorted(mismatches)
    missing, more = ({a[0] for a in x} - {b[0] for b in y} - {""} for x, y in ((left, right), (right, left)))
    assert [r.key for r in got.missing_keys.collect()] == sorted(missing) and [r.key for r in got.unexpected_keys.collect()] == sorted(more)
    stats = got.stats()
    assert (stats["missing_records"], stats["unexpected_records"], stats["mismatched_values"]) == (len(missing), len(more), len(mismatches))


def test_audit_of_many_blank_keys_makes_no_pairs(spark):
    many = spark.range(200_000).selectExpr("'' as key", "cast(id % 10 as string) as v")
    assert audit_import(many, many, "key").mismatches_by_field() == {"v": 200_000 * 200_000 * 9 // 10}
    none = spark.createDataFrame([], "key string, v string")
    assert audit_import(none, none, "key").stats() == {"expected_records": 0, "imported_records": 0, "missing_records": 0, "unexpected_records": 0, "mismatched_values": 0, "mismatches_by_field": {"v": 0}}
    assert audit_import(none.select("key"), none, "key").mismatches.collect() == []


def test_cleaning_reads_the_source_once_for_values_and_counts(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    kinds = "First string, Phone string, Amount string"
    rows = [(f" a{k} ", f"(212) 736-{k:04}", "" if k % 4 else f"{k}E+2") for k in range(300)]
    source = spark.createDataFrame(rows, kinds).repartition(3).mapInArrow(count, kinds)
    for strategy in ("flag", "auto", "drop"):
        before = read.value
        result = clean_data(source, CleaningConfig(missing_value_strategy=strategy))
        result.frame.count()
        assert read.value - before <= 300 + 300  # the roles' look at it, and the values
        assert ("First", "trimmed_whitespace", 300, "") in result.actions and result.rows_in == result.rows_out == 300
        result.release()
    many = spark.createDataFrame([tuple(f" {k} " for k in range(70))], ", ".join(f"c{k} string" for k in range(70)))
    counts = change_counts(many, dict.fromkeys(many.columns, "text"), CleaningConfig())  # more steps than a flag column has bits
    assert counts == [(f"c{k}", "trimmed_whitespace", 1, "") for k in range(70)]
