"""Reports as standalone HTML pages."""

from __future__ import annotations

import html
import os
from datetime import datetime, timezone

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..sources.rows import RID

if TYPE_CHECKING:
    from .pipeline import PipelineResult

# How many rows a table shows; the names of environment variables; what is said of empty and of longer tables.
SHOWN = 200
BRAND = {"brand_name": ("BRAND_NAME", "Data preparation"), "tool_name": ("TOOL_NAME", "Import report"), "logo_url": ("LOGO_URL", "")}
NOTHING, MORE = "Nothing to report.", "Showing first {} of {} rows."


def branding() -> dict[str, str]:
    """From the environment, at the time of the report; neutral where it says nothing."""
    return {name: os.getenv(*where) for name, where in BRAND.items()}


def table(df: DataFrame, limit: int = SHOWN) -> str:
    columns = [c for c in df.columns if c != RID]
    rows = df.select(*[f"`{c}`" for c in columns]).limit(limit + 1).collect() if columns else []
    if not rows:
        return f"<p>{NOTHING}</p>"
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    body = "".join(f"<tr>{''.join(cell('td', x) for x in r)}</tr>" for r in rows[:limit])
    more = f"<p>{MORE.format(limit, df.count())}</p>" if len(rows) > limit else ""
    return f"<table><tr>{''.join(cell('th', c) for c in columns)}</tr>{body}</table>{more}"


def score_class(score: float) -> str:
    return "ok" if score >= 95 else "warn" if score >= 80 else "bad"


def _pairs(rows: dict, head: tuple[str, ...]) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in cells) + "</tr>"
    return "<table>" + line("th", head) + "".join(line("td", (k, *v) if isinstance(v, tuple) else (k, v)) for k, v in rows.items()) + "</table>"


def page(title: str, parts: list[tuple[str, str]], brand: dict[str, str] | None = None) -> str:
    brand = {k: html.escape(v) for k, v in (brand or branding()).items()}
    logo = f'<img src="{brand["logo_url"]}" alt="">' if brand["logo_url"] else ""
    made = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")
    body = "".join(f"<h2>{html.escape(name)}</h2>{part}" for name, part in parts)
    style = "body{font-family:sans-serif;margin:2em}td,th{padding:.2em .6em;border-bottom:1px solid #ddd;text-align:left}.ok{color:#080}.warn{color:#a60}.bad{color:#b00}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body>{logo}<p>{brand['brand_name']} · {brand['tool_name']} · {made}</p><h1>{html.escape(title)}</h1>{body}</body></html>"


def render_qa_report(result: PipelineResult, title: str = "", source: str = "", structural: dict | None = None, brand: dict[str, str] | None = None) -> str:
    """Of a pipeline's result; title: the project's, source: the file's name, structural: as structure_summary() gives it."""
    report = result.validation
    figures = report.summary()
    score = figures["quality_score"]
    named = " · ".join(html.escape(x) for x in (title, source, result.mapping_config.crm))
    shown = {"Summary": f"<p>{named}</p><p class='{score_class(score)}'>Quality score {score}%</p>" + _pairs(figures, ("Figure", "Value"))}
    shown["Checks"] = _pairs({k: (v["passed"], v["failed"]) for k, v in report.checks().items()}, ("Check", "Passed", "Failed"))
    if structural is not None:
        said = "".join(f"<li>{html.escape(e['type'])}: {html.escape(e['message'])}</li>" for e in structural["errors"])
        shown["File structure"] = f"<ul>{said}</ul>" if said else "<p class='ok'>No fault of structure.</p>"
    tables = {"Issues": report.issues_frame(), "Field mapping": result.mapping_log(), "Cleaning actions": result.cleaning_log(), "Sample of passing records": report.passing(result.clean_frame)}
    return page("Quality report", [*shown.items(), *((name, table(df)) for name, df in tables.items())], brand)


def render_audit_report(stats: dict, mismatches: DataFrame, project_name: str = "", brand: dict[str, str] | None = None) -> str:
    cards = {k: v for k, v in stats.items() if k != "mismatches_by_field"}
    return page("Audit after import", [(project_name or "Summary", _pairs(cards, ("Figure", "Value"))), ("Mismatches by field", _pairs(stats["mismatches_by_field"], ("Field", "Mismatches"))), ("Records to review", table(mismatches))], brand)
