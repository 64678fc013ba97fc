"""Cleaning and mapping of streams: the value steps are stateless, and duplicates are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.clean import cleaned
from ..operators.mapping import map_data
from ..sources.config import CleaningConfig, MappingConfig


def clean_stream(stream: DataFrame, roles: dict[str, str], crm: str | MappingConfig, config: CleaningConfig | None = None, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The mapped table as a stream. roles: as detect_column_roles finds them on a sample. With event_time, repeats that come within the delay go."""
    config = config or CleaningConfig()
    df = stream.withWatermark(event_time, delay) if event_time else stream
    out = cleaned(df, roles, config)
    if event_time and config.remove_duplicates:
        out = out.dropDuplicatesWithinWatermark([c for c in config.duplicate_subset if c in roles] or list(roles))
    return map_data(out, crm).frame
