"""What each column is: email, phone, date, identifier, numeric or text, from its name and a sample of its values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalars import is_missing, is_valid_email
from ..sources.config import CleaningConfig
from ..sources.rows import RID, with_order

# Names that tell a role, in the order in which they are tried; a share of valid e-mail addresses that does.
NAMES = {
    "email": r"e-?mail",
    "identifier": r"\b(id|sku|zip|postcode|postal|account number)\b",
    "phone": r"phone|mobile|cell|tel|fax",
    "date": r"date|dob|birth|created|updated|closed|renewal",
}
EMAIL_SHARE, SAMPLE = 0.6, 200


def detect_column_roles(df: DataFrame, config: CleaningConfig | None = None) -> dict[str, str]:
    """Listed columns first; then by the first 200 values that aren't null: none that isn't missing makes the column text."""
    config = config or CleaningConfig()
    roles: dict[str, str] = {}
    for role, listed in (("email", config.email_columns), ("phone", config.phone_columns), ("date", config.date_columns), ("identifier", config.id_columns)):
        for c in listed:
            roles.setdefault(c, role)
    open_columns = [c for c in df.columns if c != RID and c not in roles]
    found: dict[str, tuple[int, float]] = {}
    if open_columns:
        head = df.orderBy(RID) if RID in df.columns else df
        # One job for the columns without nulls among the first rows; one more for all that need a look further on.
        stats = lambda c: F.struct(F.count(c).alias("n"), F.count_if(~is_missing(c)).alias("some"), F.count_if(~is_missing(c) & is_valid_email(c)).alias("mails"))
        first = head.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(open_columns)]).limit(SAMPLE)
        row = first.agg(F.count(F.lit(1)).alias("rows"), *[stats(f"c{k}").alias(f"c{k}") for k in range(len(open_columns))]).first()
        for k, c in enumerate(open_columns):
            got = row[f"c{k}"]
            found[c] = (got["some"], got["mails"] / got["some"] if got["some"] else 0.0)
        if holes := [k for k, c in enumerate(open_columns) if row[f"c{k}"]["n"] < row["rows"]]:
            each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{open_columns[k]}`").cast("string").alias("v")) for k in holes])
            long = with_order(df).select(RID, F.explode(each).alias("e")).select(RID, "e.*").filter("v is not null")
            # The first SAMPLE values of each column are picked in every task before they are shuffled.
            turn = F.row_number().over(Window.partitionBy("k").orderBy(RID))
            rows = long.withColumn("n", turn).filter(F.col("n") <= SAMPLE).groupBy("k").agg(stats("v").alias("c")).collect()
            seen = {r["k"]: r["c"] for r in rows}
            found |= {open_columns[k]: (seen[k]["some"], seen[k]["mails"] / seen[k]["some"] if seen[k]["some"] else 0.0) if k in seen else (0, 0.0) for k in holes}
    for c in open_columns:
        some, share = found[c]
        named = next((role for role, pattern in NAMES.items() if re.search(pattern, c, re.I) or role == "email" and share > EMAIL_SHARE), None)
        numeric = isinstance(df.schema[c].dataType, NumericType)
        roles[c] = "text" if not some else named or ("numeric" if numeric else "text")
    return {c: roles[c] for c in df.columns if c != RID}
