"""Cleaning: standardised values with a count of what changed, missing values, duplicates.

All steps of all columns are one projection, which also flags what each step changed; it is held, so the source is read once for values
and counts. Filling takes a few more aggregates of what is held.
Duplicates are found by a window whose first row is picked before the shuffle too, so a row that is repeated a million times
moves once for each task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import scalars as S
from ..sources.config import CleaningConfig
from ..sources.rows import RID, numbered, with_order
from .medians import medians
from .roles import detect_column_roles

LOG = "column string, action string, records long, detail string"


@dataclass
class CleaningResult:
    frame: DataFrame  # with _rid, contiguous from 0
    actions: list[tuple[str, str, int, str]]
    column_roles: dict[str, str]
    duplicates_removed: int
    rows_in: int
    rows_out: int
    held: DataFrame  # persisted until release()

    def release(self) -> None:
        self.held.unpersist()

    def actions_frame(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(self.actions, LOG)


def steps(role: str, config: CleaningConfig) -> list[tuple[str, str, Callable[[Column], Column]]]:
    """(action, detail, function) of a column of that role, in order."""
    out: list[tuple[str, str, Callable[[Column], Column]]] = []
    if config.trim_whitespace:
        out.append(("trimmed_whitespace", "", lambda c: S.trim_whitespace(c, config.collapse_internal_whitespace)))
    if config.fix_scientific_notation and role in ("identifier", "text", "numeric"):
        out.append(("expanded_scientific_notation", "", S.expand_scientific_notation))
    if config.normalize_unicode and role in ("text", "email"):
        out.append(("normalized_unicode", "", S.ascii_fold))
    if config.lowercase_emails and role == "email":
        out.append(("lowercased_email", "", S.email_lowercase))
    if config.standardize_phones and role == "phone":
        out.append(("standardized_phone", "E.164", lambda c: S.phone_e164(c, config.default_region)))
    if config.standardize_dates and role == "date":
        out.append(("standardized_date", config.date_format, lambda c: S.to_iso_date(c, config.date_format, config.date_first)))
    return out


def stages(df: DataFrame, roles: dict[str, str], config: CleaningConfig) -> tuple[DataFrame, list[tuple[str, str, str, str, str]]]:
    """df with a column for the value after each step, and (column, action, detail, before, after) of each step."""
    made, changes = df, []
    for k, (name, role) in enumerate(roles.items()):
        kind = df.schema[name].dataType
        before = name
        if isinstance(kind, NumericType):
            continue  # only text changes form; numbers are their own
        for n, (action, detail, fn) in enumerate(steps(role, config)):
            if kind.simpleString() in ("date", "timestamp", "timestamp_ntz") and action != "standardized_date":
                continue
            after = f"_c{k}_{n}"
            own = F.col(f"`{before}`")
            value = F.date_format(own, S.java_format(config.date_format)) if kind.simpleString() in ("date", "timestamp", "timestamp_ntz") else fn(own)
            made = made.withColumn(after, value)
            changes.append((name, action, detail, before, after))
            before = after
    return made, changes


def cleaned(df: DataFrame, roles: dict[str, str], config: CleaningConfig) -> DataFrame:
    """The columns of df after all value steps; stateless, so it serves streams too."""
    made, changes = stages(df, roles, config)
    last = {c[0]: c[4] for c in changes}
    return made.select(*[F.col(f"`{last.get(c, c)}`").alias(c) for c in df.columns])


def change_counts(df: DataFrame, roles: dict[str, str], config: CleaningConfig) -> list[tuple[str, str, int, str]]:
    """(column, action, records, detail) of the steps that changed a value; null on either side is no change."""
    return counted(*flagged(df, roles, config))[1]


#: Steps that a flag column holds, a bit each.
FLAGS = 62


def flagged(df: DataFrame, roles: dict[str, str], config: CleaningConfig) -> tuple[DataFrame, list[tuple[str, str, str, str, str]]]:
    """What cleaned() gives, with _changed0, _changed1 and so on, whose bits say which steps changed the row; and the steps."""
    made, changes = stages(df, roles, config)
    last = {c[0]: c[4] for c in changes}
    text = lambda c: F.col(f"`{c}`").cast("string")
    bits = [F.when(text(b) != text(a), F.lit(1 << k % FLAGS).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, _, _, b, a) in enumerate(changes)]
    words = [reduce(Column.bitwiseOR, bits[k : k + FLAGS]).alias(f"_changed{k // FLAGS}") for k in range(0, len(bits), FLAGS)]
    return made.select(*[F.col(f"`{last.get(c, c)}`").alias(c) for c in df.columns], *words), changes


def counted(rows: DataFrame, changes: list[tuple[str, str, str, str, str]]) -> tuple[int, list[tuple[str, str, int, str]]]:
    """The number of rows and what change_counts() says, from flags."""
    flags = [F.count_if(F.col(f"_changed{k // FLAGS}").bitwiseAND(1 << k % FLAGS) != 0).alias(f"n{k}") for k in range(len(changes))]
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *flags).first()
    return counts["rows"], [(c, action, counts[f"n{k}"], detail) for k, (c, action, detail, _, _) in enumerate(changes) if counts[f"n{k}"]]


def fills(df: DataFrame, roles: dict[str, str], tokens: tuple[str, ...] = S.MISSING) -> dict[str, tuple[object, int]]:
    """For each column with missing values what fills them (median of numeric columns, else the smallest mode) and how many there are."""
    names = list(roles)
    if not names:
        return {}
    missing = [S.is_missing(f"`{c}`", tokens) for c in names]
    lacking = df.agg(*[F.count_if(m).alias(f"n{k}") for k, m in enumerate(missing)]).first()
    open_ = [k for k in range(len(names)) if lacking[f"n{k}"]]
    text = [k for k in open_ if roles[names[k]] != "numeric"]
    found: dict[int, object] = {}
    if text:
        # Counts of (column, value) are combined map-side and spread by both; a row for each column remains.
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.when(~missing[k], F.col(f"`{names[k]}`").cast("string")).alias("v")) for k in text])
        counts = df.select(F.explode(each).alias("e")).select("e.*").filter("v is not null").groupBy("k", "v").count()
        found |= {r["k"]: r["best"]["v"] for r in counts.groupBy("k").agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("best")).collect()}
    if numbers := [k for k in open_ if k not in text]:
        values = {names[k]: F.when(~missing[k], F.col(f"`{names[k]}`")).cast("string").try_cast("double") for k in numbers}
        middle = medians(df, values)
        found |= {k: middle.get(names[k]) for k in numbers}
    return {names[k]: (found[k], lacking[f"n{k}"]) for k in open_ if found.get(k) is not None}


def fill_missing(df: DataFrame, values: dict[str, tuple[object, int]], tokens: tuple[str, ...] = S.MISSING) -> DataFrame:
    return df.withColumns({c: F.when(S.is_missing(f"`{c}`", tokens), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c, (v, _) in values.items()})


def drop_empty_rows(df: DataFrame, columns: list[str], tokens: tuple[str, ...] = S.MISSING) -> DataFrame:
    return df.filter(~reduce(lambda a, b: a & b, [S.is_missing(f"`{c}`", tokens) for c in columns])) if columns else df


def first_of_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first row, by _rid, of each combination of columns; nulls are equal."""
    turn = F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in columns]).orderBy(RID))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def clean_data(source: DataFrame, config: CleaningConfig | None = None) -> CleaningResult:
    config = config or CleaningConfig()
    df = source.toDF(*[c.strip() for c in source.columns])
    df = with_order(df)
    roles = detect_column_roles(df, config)
    columns, tokens = list(roles), tuple(config.missing_value_tokens)
    # Values and flags of what changed are computed once; the counts, and all that follows, read what is held. (Observed metrics
    # would count the rows of a task that runs again twice.)
    rows, changes = flagged(df, roles, config)
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows_in, actions = counted(held, changes)
    out, rows = held.select(*[F.col(f"`{c}`") for c in df.columns]), rows_in
    if config.missing_value_strategy == "auto":
        values = fills(out, roles, tokens)
        actions += [(c, "filled_missing", n, f"filled with {v!r}") for c, (v, n) in values.items()]
        out = fill_missing(out, values, tokens)
    elif config.missing_value_strategy == "drop":
        out = drop_empty_rows(out, columns, tokens)
        rows = out.count()
        if rows < rows_in:
            actions.append(("*", "dropped_empty_rows", rows_in - rows, ""))
    removed = 0
    if config.remove_duplicates and columns:
        out = first_of_each(out, [c for c in config.duplicate_subset if c in columns] or columns)
        left = out.count()
        removed, rows = rows - left, left
        if removed:
            actions.append(("*", "removed_duplicates", removed, ""))
    frame = numbered(out).drop(RID).withColumnRenamed("_row", RID)
    return CleaningResult(frame, actions, roles, removed, rows_in, rows, held)
