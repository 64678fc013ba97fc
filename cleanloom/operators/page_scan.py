"""Arithmetic on the findings of a page scan: addresses, totals a page, cost tiers. The findings come from elsewhere; none are made up.

Findings: page, id, help, impact, description, nodes (long), targets (array of strings), tags (array of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an address looks like; severities from worst; tiers from the count of grave findings.
URL = r'(?i)^(https?://)?([^.\s]+\.[^\s]{2,}|localhost)(/[^"]*)?$'
SEVERITY = ("critical", "serious", "moderate", "minor")
CRITICAL_FROM, HIGH_FROM = 10, 4
DEMAND = {"CRITICAL": 1250, "HIGH": 750, "MODERATE": 500}
SETTLEMENT = {"CRITICAL": 1.5, "HIGH": 1.2, "MODERATE": 0.9}
FIX_BASE, FIX_CRITICAL, FIX_PAGE, MANY_PAGES = 1200, 180, 85, 10


def is_valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(URL), F.lit(False))


def _round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def findings(df: DataFrame) -> DataFrame:
    """Normalised findings with the rank of their severity, worst first; an unknown severity comes last."""
    impact = F.coalesce("impact", F.lit("serious"))
    criteria = F.array_join(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("wcag")), ", ")
    return df.select(
        "page",
        "id",
        F.coalesce("help", "id").alias("label"),
        impact.alias("impact"),
        F.greatest(F.coalesce("nodes", F.lit(0)), F.lit(1)).cast("long").alias("count"),
        F.coalesce("description", "help", F.lit("")).alias("description"),
        F.when(criteria == "", F.lit("WCAG 2.1 AA")).otherwise(criteria).alias("criteria"),
        F.coalesce("targets", F.array().cast("array<string>")).alias("targets"),
        F.coalesce(F.nullif(F.array_position(F.lit(list(SEVERITY)), impact), F.lit(0)), F.lit(9)).cast("int").alias("rank"),
    )


def page_totals(df: DataFrame) -> DataFrame:
    """page, total, critical, pages_affected (1 to 50) and score of each page with findings."""
    own = findings(df)
    grave = F.sum(F.when(F.col("impact").isin("critical", "serious"), F.col("count")).otherwise(0))
    sums = own.groupBy("page").agg(F.sum("count").alias("total"), grave.alias("critical"))
    places = own.select("page", F.explode("targets").alias("target")).groupBy("page").agg(F.count_distinct("target").alias("places"))
    out = sums.join(places, "page", "left")
    return out.select(
        "page",
        "total",
        "critical",
        F.least(F.greatest(F.coalesce("places", F.lit(1)), F.lit(1)), F.lit(50)).cast("long").alias("pages_affected"),
        F.greatest(F.lit(0), _round(100 - F.col("total") * 1.5)).cast("long").alias("score"),
    )


def risk_level(critical: Column) -> Column:
    return F.when(critical >= CRITICAL_FROM, "CRITICAL").when(critical >= HIGH_FROM, "HIGH").otherwise("MODERATE")


def exposure(totals: DataFrame) -> DataFrame:
    """totals with initial_demand, settlement_low, settlement_high, fix_min, fix_max and risk."""
    tier = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("risk"))
    out = totals.withColumn("risk", risk_level(F.col("critical")))
    out = out.withColumn("_demand", F.col("critical") * tier(DEMAND)).withColumn("_more", F.when(F.col("pages_affected") > MANY_PAGES, F.col("_demand") * 0.3).otherwise(0.0))
    out = out.withColumn("fix_min", (FIX_BASE + F.col("critical") * FIX_CRITICAL + F.col("pages_affected") * FIX_PAGE).cast("long"))
    return out.select(
        *totals.columns,
        "risk",
        _round(F.col("_demand") + F.col("_more")).cast("long").alias("initial_demand"),
        _round(_round(F.col("_demand") * 0.8) + F.col("_more")).cast("long").alias("settlement_low"),
        _round(_round(F.col("_demand") * tier(SETTLEMENT) * 1.8) + F.col("_more")).cast("long").alias("settlement_high"),
        "fix_min",
        _round(F.col("fix_min") * 1.25).cast("long").alias("fix_max"),
    )
