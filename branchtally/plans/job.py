"""A whole run from files to files, with one place where failures become a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import ReportValidationError
from ..functions import ORD, unique_headers
from ..operators.columns import ACCOUNT_ALIASES, BALANCE_ALIASES, ID_ALIASES, key_aliases
from ..operators.columns import LOOKUP_KEY, MAIN_CODE, resolve_alias
from ..operators.diagnostics import key_sample, miss_message
from ..sources import Delivery, Extract, read_extract, read_reference_csv
from ..sources.extract import header_note
from .registry import get_report
from .reports import ReportResult, Table, run_report
from .spec import FilterChoice


@dataclass(frozen=True)
class RunReport:
    """What a run tells its caller. Columns are checked before anything is written."""

    success: bool
    output_path: str
    processed_rows: int = 0
    unmapped_rows: int = 0
    malformed_rows: int = 0
    error: str | None = None
    miss_diagnostic: str | None = None
    note: str | None = None


def load_table(spark: SparkSession, source: str | Table | None) -> Table | None:
    """A reference or master: a CSV path, a parquet folder, or frames as they are."""
    if source is None or not isinstance(source, str):
        return source
    if source.lower().rstrip("/").endswith((".csv", ".txt")):
        return read_reference_csv(spark, source)
    df = spark.read.parquet(source)
    if ORD in df.columns:
        return df
    return df.toDF(*unique_headers(df.columns))


def run_job(
    spark: SparkSession,
    report_id: str,
    raw: str | list[str],
    output_path: str,
    *,
    reference: str | Table | None = None,
    master: str | Table | None = None,
    choice: FilterChoice | None = None,
    delimiter: str | None = None,
    key: str = LOOKUP_KEY,
    encoding: str | None = None,
    fmt: str = "parquet",
    staging_path: str | None = None,
) -> RunReport:
    """Run one report from text files and write summary, detail and metadata.

    Without a ``delimiter`` the report's own is used: a comma for balances, else a bar. The text
    is read twice: to find the titles, and to parse it into a stage, from which every output
    reads the columns it needs. The stage goes when the run ends, or is kept at
    ``staging_path``. Outputs are written beside ``output_path`` and appear there together, with
    a manifest, when all are done; a run that fails leaves nothing.
    """
    try:
        return _run(
            spark, report_id, raw, output_path, reference, master, choice, delimiter, key,
            encoding, fmt, staging_path,
        )
    except Exception as exc:  # the boundary: a run ends in a report, never in a trace
        return RunReport(False, output_path, error=f"{type(exc).__name__}: {exc}")


def _run(spark, report_id, raw, output_path, reference, master, choice, delimiter, key,
         encoding, fmt, staging_path) -> RunReport:
    spec = get_report(report_id)
    balances = spec.kind == "balances"
    hints: Sequence[str] = (
        (*ACCOUNT_ALIASES, *BALANCE_ALIASES) if balances else spec.required_columns
    )
    extract: Extract = read_extract(
        spark,
        raw,
        delimiter=delimiter or ("," if balances else "|"),
        numeric_columns=spec.numeric_columns,
        title_hints=hints,
        encoding=encoding,
    )
    references, masters = load_table(spark, reference), load_table(spark, master)

    def report(rows: DataFrame) -> ReportResult:
        return run_report(spec, rows, references, masters, choice, key=key)

    with Delivery(spark, output_path) as delivery:
        if not balances:  # columns and tables are refused before the text is parsed
            try:
                report(extract.data)
            except ReportValidationError:
                extract.require_rows()  # that a file is empty says more
                raise
        extract = extract.stored(delivery.scratch("stage")).require_rows()
        malformed, header_row = extract.ingest()
        result = report(extract.data)
        measured = result.metrics.first().asDict()
        unmapped = measured.get("unmapped_rows", measured.get("unmapped_ids", 0))
        delivery.write("summary", result.summary, fmt)
        if not balances:
            delivery.write("detail", result.detail, fmt)
            delivery.write("metadata", result.metadata, fmt)
        done = RunReport(
            success=True,
            output_path=output_path,
            processed_rows=measured["processed_rows"],
            unmapped_rows=unmapped,
            malformed_rows=malformed,
            miss_diagnostic=_diagnostic(spec, result, measured, unmapped, key),
            note=header_note(header_row),
        )
        delivery.commit(
            {"report": spec.report_id, "processed_rows": done.processed_rows, "unmapped_rows": unmapped, "malformed_rows": malformed}
        )
        if staging_path:
            delivery.keep("stage", staging_path)
    return done


def _diagnostic(spec, result, measured, unmapped, key) -> str | None:
    """Advice from the rows that were looked up and the table that was picked for them."""
    total = measured.get("ids", measured.get("kept_rows", 0))
    if spec.kind == "balances" or miss_message("", unmapped, total, (), (), ()) is None:
        return None
    if spec.kind == "activity":
        aliases, context = ID_ALIASES, f"id lookup of {MAIN_CODE}"
    else:
        aliases, context = key_aliases(key), f"reference lookup on {key}"
    return miss_message(
        context,
        unmapped,
        total,
        _sample(result.kept, aliases),
        _sample(result.side() if result.side else None, aliases),
        aliases,
    )


def _sample(df: DataFrame | None, aliases: Sequence[str]) -> list[str]:
    if df is None:
        return []
    name = resolve_alias(df.columns, aliases)
    if name is None or ORD not in df.columns:
        return []
    return [r["key"] for r in key_sample(df, name).orderBy("position").collect()]
