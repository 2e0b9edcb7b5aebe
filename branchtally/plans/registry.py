"""The seven reports, by id, in the order they are run each day."""

from __future__ import annotations

from ..errors import ReportValidationError
from .spec import ReportSpec

# Report ids, titles, required headers, default lists and known values.
_SEGMENTS = ("KONSUMER", "MIKRO", "SME")
_SOURCES = ("CMS", "QCASH", "QIB")
_KW = (
    "Bandung", "Banjarmasin", "Denpasar", "DKI", "DKI2", "KANWIL BANDAR LAMPUNG",
    "KANWIL JAKARTA 3", "KANWIL JAYAPURA", "KANWIL MALANG", "KANWIL PEKANBARU", "Makassar",
    "Manado", "Medan", "Padang", "Palembang", "Semarang", "Surabaya", "Yogyakarta",
)

_ALL = (
    ReportSpec(
        report_id="akumulasi",
        label="Report Summary Akumulasi",
        title="Financial Summary Report",
        group_columns=("MAIN_CODE", "MAIN_BRANCH"),
        value_columns=("FBI", "VOLUME_IN_IDR"),
        primary_value="VOLUME_IN_IDR",
        numeric_columns=("FBI", "VOLUME_IN_IDR"),
        required_columns=("FBI", "VOLUME_IN_IDR"),
        display=(("FBI", "Sum of FBI"),),
        needs_reference=True,
        segment_live=True,
        source_live=True,
        segment_options=_SEGMENTS,
        source_options=_SOURCES,
    ),
    ReportSpec(
        report_id="timeseries-active-user-qlola",
        label="Time Series Active User Qlola",
        title="Time Series Active User Qlola Report",
        kind="activity",
        group_columns=("MAIN_CODE",),
        value_columns=("FREKUENSI",),
        numeric_columns=("FREKUENSI",),
        required_columns=("SOURCE", "ID", "FREKUENSI"),
        needs_reference=True,
        needs_master=True,
        segment_live=True,
        source_live=True,
        source_drop=("CMS",),
        segment_options=_SEGMENTS,
        source_options=_SOURCES,
    ),
    ReportSpec(
        report_id="report-data-statis",
        label="Report Data Statis",
        title="Report Data Statis",
        group_columns=("MAIN_CODE", "MAIN_BRANCH"),
        value_columns=("ID_PRODUCT",),
        how="count",
        required_columns=("SEGMEN", "KW", "ID_PRODUCT"),
        display=(("ID_PRODUCT", "Count of ID_PRODUCT"),),
        needs_reference=True,
        segment_live=True,
        source_live=True,
        kw_live=True,
        segment_drop=("KORPORASI",),
        kw_keep=("KANWIL MALANG",),
        segment_options=("KONSUMER", "KORPORASI", "MIKRO", "SME"),
        source_options=_SOURCES,
        kw_options=_KW,
    ),
    ReportSpec(
        report_id="rincian-vol-tf",
        label="Rincian Vol TF",
        title="Rincian Vol TF Report",
        group_columns=("MAINBR", "MBDESC"),
        value_columns=("AMOUNT_IN_IDR",),
        numeric_columns=("AMOUNT_IN_IDR",),
        required_columns=("SEGMEN", "MAINBR", "MBDESC", "AMOUNT_IN_IDR"),
        segment_live=True,
        segment_drop=("Wholesale",),
        segment_options=("Kecil", "Wholesale"),
    ),
    ReportSpec(
        report_id="rincian-portal-bg",
        label="Rincian Portal BG",
        title="Rincian Portal BG Report",
        group_columns=("MAINBR", "MBNAME"),
        value_columns=("AMOUNT_IN_IDR",),
        numeric_columns=("AMOUNT_IN_IDR",),
        required_columns=("MAINBR", "MBNAME", "AMOUNT_IN_IDR"),
    ),
    ReportSpec(
        report_id="timeseries-fbi-briva",
        label="Report Vol Briva",
        title="Report Vol Briva",
        group_columns=("MAIN_CODE", "MAIN_BRANCH"),
        value_columns=("VOLUME_IDR",),
        rounding="ceil",
        numeric_columns=("VOLUME_IDR",),
        required_columns=("SEGMEN", "VOLUME_IDR"),
        display=(("VOLUME_IDR", "Sum of VOLUME_IDR"),),
        needs_reference=True,
        segment_live=True,
        segment_keep=("NONWHOLESALE",),
        segment_options=("NONWHOLESALE",),
    ),
    ReportSpec(
        report_id="report-giro",
        label="Report Giro",
        title="Report Giro",
        kind="balances",
        value_columns=("SALDO UPDATE",),
        needs_master=True,
    ),
)

REPORTS: dict[str, ReportSpec] = {spec.report_id: spec for spec in _ALL}


def get_report(report_id: str) -> ReportSpec:
    """The specification of a report; an unknown id lists the valid ones."""
    try:
        return REPORTS[report_id]
    except KeyError:
        raise ReportValidationError(
            f"unknown report {report_id!r}. Valid ids: {list(REPORTS)}"
        ) from None
