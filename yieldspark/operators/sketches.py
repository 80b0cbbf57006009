"""Approximate distinct wafers by mergeable sketches (A11, opt-in).

An exact distinct count moves every wafer id of a group.  A sketch has a fixed
size, is built map-side, and those of finer groups merge into those of coarser
ones, so counts by stage, period or both come from one small table.  The exact
count stays the default (``views.cell_kpis``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldspark.functions.periods import check_mode, period_start

#: Log2 of a sketch's registers; the relative standard error is about 1.04 / sqrt(2**LOG_K), 0.8 percent.
LOG_K = 14
#: Stated bound of the relative error: four standard errors, and one wafer for small counts.
RELATIVE_BOUND, ABSOLUTE_BOUND = 0.0325, 1


def wafer_sketches(facts: DataFrame, mode: str) -> DataFrame:
    """``(stage_code, period_start, wafers)``: a sketch of the wafers of each stage and period."""
    keyed = facts.withColumn("period_start", period_start(F.col("event_time"), check_mode(mode)))
    return keyed.groupBy("stage_code", "period_start").agg(F.hll_sketch_agg("physical_wafer_id", LOG_K).alias("wafers"))


def approximate_wafers(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Approximate distinct wafers of the groups ``by`` (some of a sketch table's keys), by merging its sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("wafers")).alias("approximate_wafers"))


def within_bound(approximate, exact):
    """Whether an approximate count keeps the stated bound."""
    return F.abs(approximate - exact) <= F.greatest(F.lit(float(ABSOLUTE_BOUND)), F.lit(RELATIVE_BOUND) * exact)
