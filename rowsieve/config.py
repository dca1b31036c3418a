"""Run settings and the fixed vocabulary shared by all operators."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
STATUSES = (
    "IDLE",
    "INGESTING",
    "RUNNING",
    "VALIDATING",
    "WAITING_FOR_USER",
    "TRANSFORMING",
    "PACKAGING",
    "COMPLETED",
    "FAILED",
)
TERMINAL_STATUSES = ("COMPLETED", "FAILED")
OUTPUT_COLUMNS = ("error_reason", "amount_usd", "cost_center", "approval_required")
EXPENSE_COLUMNS = (
    "employee_id",
    "dept",
    "amount",
    "currency",
    "spend_date",
    "vendor",
    "fx_rate",
)
COST_CENTERS = {"FIN": "100", "HR": "200", "ENG": "300", "OPS": "400"}
UNMAPPED = "UNMAPPED"
REVIEW_BATCH_ROWS = 5
REVIEW_TIMEOUT_SECONDS = 300
ACCEPTED_SUFFIXES = ("csv", "xlsx", "xls")
# Cell texts read as null on ingest.
NA_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# --- end of fixed values ----------------------------------------------------

# Statuses a run can begin with, those that may follow any other (a new upload, a file read
# from disk or a taken fix), and what else may directly follow which.
FIRST_STATUSES = ("IDLE", "INGESTING", "RUNNING")
RESTART_STATUSES = ("INGESTING", "RUNNING")
NEXT_STATUSES = {
    "IDLE": ("FAILED",),
    "INGESTING": ("FAILED",),
    "RUNNING": ("VALIDATING", "WAITING_FOR_USER", "TRANSFORMING", "PACKAGING", "FAILED"),
    "VALIDATING": ("VALIDATING", "WAITING_FOR_USER", "TRANSFORMING", "PACKAGING", "FAILED"),
    "WAITING_FOR_USER": ("WAITING_FOR_USER", "VALIDATING", "FAILED"),
    "TRANSFORMING": ("TRANSFORMING", "PACKAGING", "FAILED"),
    "PACKAGING": ("COMPLETED", "FAILED"),
    "COMPLETED": ("IDLE",),
    "FAILED": ("IDLE",),
}


def resolve_as_of(text: str | None) -> dt.date:
    """The cut-off day for future-date checks; a bad or missing text means today."""
    try:
        return dt.datetime.strptime(text or "", "%Y-%m-%d").date()
    except ValueError:
        return dt.date.today()


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run."""

    as_of: str | None = None
    usd_rounding: str = "cents"
    cost_center_map: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.usd_rounding not in ("cents", "whole"):
            raise ValueError(f"usd_rounding must be 'cents' or 'whole', not {self.usd_rounding!r}")

    @property
    def cutoff(self) -> dt.date:
        return resolve_as_of(self.as_of)

    @property
    def settings(self) -> dict[str, str]:
        """The settings as text, for a run's summary."""
        centers = ",".join(f"{k}={v}" for k, v in sorted(self.cost_centers.items()))
        return {
            "as_of": str(self.cutoff),
            "usd_rounding": self.usd_rounding,
            "cost_center_map": centers,
        }

    @property
    def usd_places(self) -> int:
        return 2 if self.usd_rounding == "cents" else 0

    @property
    def cost_centers(self) -> dict[str, str]:
        return {**COST_CENTERS, **self.cost_center_map}
