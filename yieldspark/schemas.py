"""Declared schemas of the source-shaped and the published datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, I, D, B, TS = (
    T.StringType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# --- source-shaped tables --------------------------------------------------
IDENTITY_ALIASES = _struct(
    ("source_kind", S),
    ("source_alias", S),
    ("normalized_alias", S),
    ("physical_wafer_id", S),
    ("work_order", S),
    ("lot_id", S),
    ("wafer_number", I),
    ("product_family", S),
    ("wafer_size", S),
)
WAFER_INVENTORY = _struct(
    ("mes_wafer_ref", S),
    ("work_order_ref", S),
    ("lot_ref", S),
    ("wafer_number", I),
    ("product_family", S),
    ("wafer_size", S),
    ("completed_at", TS),
)
WAFER_INSPECTION = _struct(
    ("inspection_wafer_ref", S),
    ("record_id", S),
    ("inspection_at", TS),
    ("sites_inspected", I),
    ("sites_good", I),
    ("failure_family", S),
    ("revision", I),
)
PROCESS_RESULTS = _struct(
    ("mes_wafer_ref", S),
    ("record_id", S),
    ("stage_code", S),
    ("completed_at", TS),
    ("tool_family", S),
    ("passed", B),
    ("failure_family", S),
)
CHIP_INSPECTION_SUMMARY = _struct(
    ("chip_wafer_ref", S),
    ("record_id", S),
    ("tested_at", TS),
    ("total_chips", I),
    ("good_chips", I),
    ("dominant_failure", S),
    ("revision", I),
)
SORTING_SUMMARY = _struct(
    ("sorting_wafer_ref", S),
    ("record_id", S),
    ("channel", S),
    ("process_completed_at", TS),
    ("record_generated_at", TS),
    ("total_chips", I),
    ("good_chips", I),
    ("failure_family", S),
)
QUALIFICATION_RESULTS = _struct(
    ("qualification_wafer_ref", S),
    ("record_id", S),
    ("channel", S),
    ("qualified_at", TS),
    ("passed", B),
    ("revision", I),
)
CHIP_DETAIL = _struct(
    ("chip_record_id", S),
    ("chip_wafer_ref", S),
    ("chip_number", I),
    ("x", I),
    ("y", I),
    ("passed", B),
    ("failure_family", S),
    ("tested_at", TS),
    ("revision", I),
)
SORTING_PARAMETER_DETAIL = _struct(
    ("parameter_record_id", S),
    ("sorting_wafer_ref", S),
    ("chip_number", I),
    ("parameter", S),
    ("value", D),
    ("lower_limit", D),
    ("upper_limit", D),
    ("passed", B),
    ("measured_at", TS),
)

SOURCE_SCHEMAS = {
    "identity_aliases": IDENTITY_ALIASES,
    "wafer_inventory": WAFER_INVENTORY,
    "wafer_inspection": WAFER_INSPECTION,
    "process_results": PROCESS_RESULTS,
    "chip_inspection_summary": CHIP_INSPECTION_SUMMARY,
    "sorting_summary": SORTING_SUMMARY,
    "qualification_results": QUALIFICATION_RESULTS,
    "chip_detail": CHIP_DETAIL,
    "sorting_parameter_detail": SORTING_PARAMETER_DETAIL,
}
COMMON_SOURCES = (
    "identity_aliases",
    "wafer_inventory",
    "wafer_inspection",
    "process_results",
    "chip_inspection_summary",
    "sorting_summary",
    "qualification_results",
)
DETAIL_SOURCES = ("chip_detail", "sorting_parameter_detail")

RULES = _struct(
    ("section", S),
    ("stage_code", S),
    ("stage_label", S),
    ("display_order", I),
    ("assumption", S),
)

# --- published datasets ------------------------------------------------------
MASTER_COLUMNS = (
    "physical_wafer_id",
    "work_order",
    "lot_id",
    "wafer_number",
    "product_family",
    "wafer_size",
)
YIELD_FACT = _struct(
    ("yield_record_id", S),
    ("section", S),
    ("stage_code", S),
    ("stage_label", S),
    ("display_order", I),
    ("physical_wafer_id", S),
    ("work_order", S),
    ("lot_id", S),
    ("wafer_number", I),
    ("product_family", S),
    ("wafer_size", S),
    ("event_time", TS),
    ("numerator", D),
    ("denominator", D),
    ("yield_rate", D),
    ("failure_family", S),
)
FAILURE_FACT = _struct(
    ("yield_record_id", S),
    ("stage_code", S),
    ("stage_label", S),
    ("physical_wafer_id", S),
    ("work_order", S),
    ("product_family", S),
    ("event_time", TS),
    ("failure_family", S),
    ("failure_quantity", D),
)
LINEAGE = _struct(
    ("yield_record_id", S),
    ("source_kind", S),
    ("source_record_id", S),
    ("identity_method", S),
    ("transformation_rule", S),
)
# Lineage as published: with what places its fact.
PLACED_LINEAGE = T.StructType([*LINEAGE.fields, T.StructField("stage_code", S, True), T.StructField("event_time", TS, True)])
IDENTITY_AUDIT = _struct(
    ("source_kind", S),
    ("source_record_id", S),
    ("source_alias", S),
    ("identity_status", S),
    ("physical_wafer_id", S),
    ("identity_method", S),
)
FINAL_COMPONENT_FACT = _struct(
    ("physical_wafer_id", S),
    ("work_order", S),
    ("product_family", S),
    ("event_time", TS),
    ("total_chips", D),
    ("chip_inspection", D),
    ("device_formation", D),
    ("sorting", D),
    ("qualification", D),
    ("final_chip_yield", D),
)
FILTER_DOMAINS = _struct(("domain", S), ("values_json", S))
PREBUILT_TREND = _struct(
    ("stage_code", S),
    ("stage_label", S),
    ("period", S),
    ("numerator", D),
    ("denominator", D),
    ("yield_rate", D),
)
PREBUILT_PARETO = _struct(
    ("stage_code", S),
    ("stage_label", S),
    ("failure_family", S),
    ("failure_quantity", D),
)

COMMON_DATASETS = (
    "yield_fact",
    "failure_fact",
    "wafer_summary",
    "final_component_fact",
    "lineage",
    "identity_audit",
    "filter_domains",
    "prebuilt_trend",
    "prebuilt_pareto",
)
TARGETED_DATASETS = ("targeted_chip_detail", "targeted_sorting_parameter_detail")
# The record id column of each.
TARGETED_RECORD_COLUMNS = {
    "targeted_chip_detail": "chip_record_id",
    "targeted_sorting_parameter_detail": "parameter_record_id",
}
REQUIRED_DATASETS = COMMON_DATASETS + TARGETED_DATASETS

# Declared columns of each published dataset (wafer_summary: master columns
# followed by one column per configured stage, added at build time).
DECLARED_COLUMNS = {
    "yield_fact": YIELD_FACT.fieldNames(),
    "failure_fact": FAILURE_FACT.fieldNames(),
    "lineage": PLACED_LINEAGE.fieldNames(),
    "identity_audit": IDENTITY_AUDIT.fieldNames(),
    "final_component_fact": FINAL_COMPONENT_FACT.fieldNames(),
    "filter_domains": FILTER_DOMAINS.fieldNames(),
    "prebuilt_trend": PREBUILT_TREND.fieldNames(),
    "prebuilt_pareto": PREBUILT_PARETO.fieldNames(),
    "wafer_summary": list(MASTER_COLUMNS),
    "targeted_chip_detail": CHIP_DETAIL.fieldNames() + ["physical_wafer_id", "identity_status"],
    "targeted_sorting_parameter_detail": SORTING_PARAMETER_DETAIL.fieldNames()
    + ["physical_wafer_id", "identity_status"],
}


def conform(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns in order, cast to the declared types.

    Fails fast (AnalysisException at plan time) when a column is missing.
    """
    return frame.select(*[frame[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
