"""From a source table to a cleaned, mapped and validated one, with its logs and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators.clean import CleaningResult, clean_data
from ..operators.mapping import MappingResult, map_data
from ..operators.structure import structure_summary
from ..operators.validate import ValidationReport, validate_data
from ..sources.config import CleaningConfig, MappingConfig
from ..sources.rows import RID
from .reports import render_qa_report


@dataclass
class PipelineResult:
    cleaning: CleaningResult
    mapping: MappingResult
    validation: ValidationReport
    qa_report_html: str

    @property
    def mapping_config(self) -> MappingConfig:
        return self.mapping.config

    @property
    def clean_frame(self) -> DataFrame:
        """The mapped table, with _rid for its order."""
        return self.mapping.frame

    def mapping_log(self) -> DataFrame:
        return self.mapping.mapping_log()

    def cleaning_log(self) -> DataFrame:
        return self.cleaning.actions_frame()

    def summary(self) -> dict:
        c = self.cleaning
        return {"rows_in": c.rows_in, "rows_out": c.rows_out, "duplicates_removed": c.duplicates_removed, **self.validation.summary()}

    def release(self) -> None:
        self.mapping.frame.unpersist()
        self.cleaning.release()


def run_pipeline(source: DataFrame, crm: str | MappingConfig = "hubspot", cleaning_config: CleaningConfig | None = None, project_name: str = "Data migration", source_filename: str = "", strict_dates: bool = True, report: bool = True) -> PipelineResult:
    config = cleaning_config or CleaningConfig()
    cleaning = clean_data(source, config)
    mapping = map_data(cleaning.frame, crm)
    # Validation, report and sinks all read the mapped table.
    mapping.frame = mapping.frame.persist(StorageLevel.MEMORY_AND_DISK)
    target = mapping.config
    validation = validate_data(mapping.frame, target.marked("required"), target.marked("unique"), config.date_format, config.default_region, strict_dates)
    result = PipelineResult(cleaning, mapping, validation, "")
    if report:
        result.qa_report_html = render_qa_report(result, project_name, source_filename, structure_summary(mapping.frame.drop(RID)))
    return result
