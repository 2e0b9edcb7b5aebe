"""Report specifications and the plans that run them."""

from .job import RunReport, run_job
from .registry import REPORTS, get_report
from .reports import ReportResult, run_report
from .spec import FilterChoice, ReportSpec

__all__ = [
    "FilterChoice",
    "REPORTS",
    "ReportResult",
    "ReportSpec",
    "RunReport",
    "get_report",
    "run_job",
    "run_report",
]
