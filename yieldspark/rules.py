"""Yield rules: display rows, stage texts and labels.

The rules are configuration data.  They become a tiny DataFrame that is joined
to facts by ``stage_code``; the table has one row per configured stage and
does not grow with the data, so it is always safe to broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from yieldspark import schemas

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference configuration for results to
# match; they are stated plainly and in their natural order.
# ---------------------------------------------------------------------------

# (section, stage_code, label, order)
DEFAULT_DISPLAY_ROWS = [
    ("Wafer Process", "WAFER_INSPECTION", "Incoming Wafer Inspection", 10),
    ("Wafer Process", "SURFACE_PREPARATION", "Surface Preparation", 20),
    ("Wafer Process", "PATTERN_SEPARATION", "Pattern Separation", 30),
    ("Wafer Process", "PROTECTIVE_FINISH", "Protective Finish", 40),
    ("Wafer Process", "AUTO_OUTLIER", "Automated Outlier", 50),
    ("Wafer Process", "WAFER_TOTAL", "Wafer Total", 60),
    ("Chip Process", "CHIP_INSPECTION", "Chip Inspection", 70),
    ("Chip Process", "DEVICE_FORMATION", "Device Formation", 80),
    ("Performance / Sorting", "SORTING", "Sorting Yield: Channel A", 90),
    ("Qualification", "QUALIFICATION", "Qualification", 100),
    ("Chip Total", "FINAL_CHIP_YIELD", "Chip Yield: Channel A", 110),
]

# Population / assumption text shown next to each matrix row.
ASSUMPTIONS = {
    "WAFER_INSPECTION": "Good inspected sites / inspected sites",
    "SURFACE_PREPARATION": "Completed physical wafers passing the stage",
    "PATTERN_SEPARATION": "Completed physical wafers passing the stage",
    "PROTECTIVE_FINISH": "Completed physical wafers passing the stage",
    "AUTO_OUTLIER": "Prepared chip population after automated screening",
    "WAFER_TOTAL": "Product of complete wafer-stage component yields",
    "CHIP_INSPECTION": "Latest-revision good chips / inspected chips",
    "DEVICE_FORMATION": "Process result applied to eligible chip quantity",
    "SORTING": "Good sorted chips / inspected chips; process completion date",
    "QUALIFICATION": "Qualified physical wafers / evaluated physical wafers",
    "FINAL_CHIP_YIELD": "Complete qualification cohort; component product",
}
DEFAULT_ASSUMPTION = "Prepared engineering population"

# Transformation rule text recorded in lineage, per stage.
RULE_TEXT = {
    "WAFER_INSPECTION": "Latest inspection revision; site-weighted yield.",
    "PROCESS": "Completed process record classified at physical-wafer grain.",
    "CHIP_INSPECTION": "Latest chip-inspection revision; quantity-weighted chip population.",
    "AUTO_OUTLIER": "Fictional automated rule applied to the prepared chip population.",
    "SORTING": "Use process completion date, not later source-generation timestamp.",
    "QUALIFICATION": "Qualification defines the physical-wafer final-yield cohort.",
    "WAFER_TOTAL": "Product of complete wafer-stage component yields.",
    "DEVICE_FORMATION": "Process completion classified against the chip population.",
    "FINAL_CHIP_YIELD": (
        "Qualification-cohort component product with complete physical-wafer "
        "membership and quantity-weighted aggregation."
    ),
}

# Failure-family labels assigned by rules rather than read from sources.
AUTO_OUTLIER_FAMILY = "Automated Rule Flag"
QUALIFICATION_HOLD = "Qualification Hold"
WAFER_TOTAL_LOSS = "Combined Wafer Loss"
FINAL_COMPONENT_LOSS = "Final Component Loss"
UNCLASSIFIED_LOSS = "Unclassified Loss"

# Identity statuses and methods.
RESOLVED, AMBIGUOUS, UNRESOLVED = "RESOLVED", "AMBIGUOUS", "UNRESOLVED"
EXACT_METHOD = "exact alias"
NORMALIZED_METHOD = "normalized alias"
NO_MATCH_METHOD = "no alias match"
WAFER_COHORT_METHOD = "physical-wafer cohort"
FINAL_COHORT_METHOD = "resolved physical-wafer cohort"

# Source kinds.
MES, INSPECTION, CHIP, SORTING, QUALIFICATION = (
    "MES",
    "INSPECTION",
    "CHIP",
    "SORTING",
    "QUALIFICATION",
)
PREPARED = "PREPARED"

# Stage groups.
WAFER_STAGE_CODES = (
    "WAFER_INSPECTION",
    "SURFACE_PREPARATION",
    "PATTERN_SEPARATION",
    "PROTECTIVE_FINISH",
)
FORMATION_STAGE = "DEVICE_FORMATION"
# Chips lost by a failed device-formation step, and the outlier modulus.
FORMATION_LOSS_CHIPS = 9
OUTLIER_MODULUS = 11

# Dashboard defaults.
PERIOD_MODES = ("Day", "Week", "Month", "Quarter", "Year")
DEFAULT_MAX_PERIODS = 12
DEFAULT_TOP_N = 8
DETAIL_ROW_LIMIT = 500
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class DisplayRow:
    section: str
    stage_code: str
    label: str
    order: int


def load_display_rows(path: str | Path | None = None) -> list[DisplayRow]:
    """Display rows from a JSON rules file (``display_rows`` list) or the defaults."""
    if path is None:
        return [DisplayRow(*row) for row in DEFAULT_DISPLAY_ROWS]
    payload = json.loads(Path(path).read_text(encoding="utf-8"))
    return [
        DisplayRow(str(r["section"]), str(r["stage_code"]), str(r["label"]), int(r["order"]))
        for r in payload.get("display_rows", [])
    ]


def rules_frame(spark: SparkSession, rows: list[DisplayRow] | None = None) -> DataFrame:
    """The display rules as a DataFrame, with the assumption text column."""
    rows = rows if rows is not None else load_display_rows()
    data = [
        (r.section, r.stage_code, r.label, r.order, ASSUMPTIONS.get(r.stage_code, DEFAULT_ASSUMPTION))
        for r in rows
    ]
    return spark.createDataFrame(data, schema=schemas.RULES)


def required_stage_codes() -> set[str]:
    """Stages whose facts are always emitted and therefore must be configured."""
    return {
        "WAFER_INSPECTION",
        "CHIP_INSPECTION",
        "AUTO_OUTLIER",
        "SORTING",
        "QUALIFICATION",
        "WAFER_TOTAL",
        "DEVICE_FORMATION",
        "FINAL_CHIP_YIELD",
    }


def check_rules(rows: list[DisplayRow]) -> None:
    """Fail while building the plan when a stage that always emits facts is missing."""
    missing = required_stage_codes() - {r.stage_code for r in rows}
    if missing:
        raise KeyError(f"Display rules miss stage codes: {sorted(missing)}")
