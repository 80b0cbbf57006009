"""Keep-latest operators (latest revision per alias, last record per wafer).

"Latest" is the greatest row by an explicit descending order list with a
unique tiebreak, so the result does not depend on input order or partitioning.
It is computed as ``max(struct(order..., payload...))`` per key: an aggregate,
partial-aggregated inside every task before the shuffle.  A key that owns a
third of all rows therefore sends one partial row per task, where a
``row_number()`` window would sort all of that key's rows in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(frame: DataFrame, keys: Sequence[str], order_desc: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order_desc`` tuple."""
    keys = list(keys)
    payload = [c for c in frame.columns if c not in keys and c not in order_desc]
    picked = frame.groupBy(*keys).agg(F.max(F.struct(*order_desc, *payload)).alias("_latest"))
    return picked.select(*[c if c in keys else f"_latest.{c}" for c in frame.columns])


def latest_inspection(resolved: DataFrame) -> DataFrame:
    """Latest revision per raw inspection alias (revision, then record id)."""
    return latest_per_key(resolved, ["inspection_wafer_ref"], ["revision", "record_id"])


def latest_chip_summary(resolved: DataFrame) -> DataFrame:
    """Latest revision per raw chip alias."""
    return latest_per_key(resolved, ["chip_wafer_ref"], ["revision", "record_id"])


def latest_qualification(resolved: DataFrame) -> DataFrame:
    """Latest revision per (raw qualification alias, channel)."""
    return latest_per_key(resolved, ["qualification_wafer_ref", "channel"], ["revision", "record_id"])


def chip_per_wafer(latest_chips: DataFrame) -> DataFrame:
    """One chip summary per wafer: revision, test time, record id (all descending)."""
    return latest_per_key(latest_chips, ["physical_wafer_id"], ["revision", "tested_at", "record_id"])


def qualification_per_wafer(latest_quals: DataFrame) -> DataFrame:
    """One qualification per wafer: revision, time, record id (all descending)."""
    return latest_per_key(latest_quals, ["physical_wafer_id"], ["revision", "qualified_at", "record_id"])


def sorting_per_wafer(resolved_sorting: DataFrame) -> DataFrame:
    """One sorting summary per wafer: process completion time, record id."""
    return latest_per_key(resolved_sorting, ["physical_wafer_id"], ["process_completed_at", "record_id"])


def process_per_wafer_stage(resolved_process: DataFrame, stage_code: str) -> DataFrame:
    """One process row per wafer for one stage: completion time, record id."""
    return latest_per_key(
        resolved_process.where(F.col("stage_code") == stage_code),
        ["physical_wafer_id"],
        ["completed_at", "record_id"],
    )
