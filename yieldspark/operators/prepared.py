"""Published tables derived from the facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldspark import rules, schemas
from yieldspark.functions.numeric import ratio
from yieldspark.functions.periods import label_of_start, period_start


def summary_stage_codes(display_rows: list[rules.DisplayRow] | None = None) -> list[str]:
    """Pivot columns of the wafer summary: every configured stage, sorted."""
    display_rows = display_rows if display_rows is not None else rules.load_display_rows()
    return sorted({r.stage_code for r in display_rows})


def wafer_summary(master: DataFrame, facts: DataFrame, stage_codes: list[str]) -> DataFrame:
    """Wafer master plus one yield column per stage (first fact by time, then id).

    A conditional ``min_by`` per stage is one aggregate keyed by wafer
    (partial-aggregated), equivalent to a pivot over an explicit value list.
    Wafers without facts are kept (left join).

    The aggregate sorts its rows, as texts are compared: by a hash of the wafer
    first, since ids begin alike and a number is compared without its row.
    """
    order_key = F.struct("event_time", "yield_record_id")
    wafer = ["_hash", "physical_wafer_id"]
    pivot = facts.withColumn("_hash", F.xxhash64("physical_wafer_id")).groupBy(*wafer).agg(
        *[
            F.min_by(
                F.col("yield_rate"), F.when(F.col("stage_code") == code, order_key)
            ).alias(code)
            for code in stage_codes
        ]
    )
    summary = master.select(*schemas.MASTER_COLUMNS).withColumn("_hash", F.xxhash64("physical_wafer_id")).join(pivot, wafer, "left")
    return summary.select(*schemas.MASTER_COLUMNS, *stage_codes)


def prebuilt_trend(facts: DataFrame) -> DataFrame:
    """Weekly Σnumerator, Σdenominator and their ratio per stage.

    Grouped on the Monday timestamp; the week label is formatted afterwards.
    """
    keyed = facts.withColumn("week_start", period_start(F.col("event_time"), "Week")).where(
        F.col("week_start").isNotNull()
    )
    grouped = keyed.groupBy("stage_code", "stage_label", "week_start").agg(
        F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator")
    )
    return schemas.conform(
        grouped.withColumn("period", label_of_start(F.col("week_start"), "Week")).withColumn(
            "yield_rate", ratio(F.col("numerator"), F.col("denominator"))
        ),
        schemas.PREBUILT_TREND,
    )


def prebuilt_pareto(failures: DataFrame) -> DataFrame:
    """Σ failure quantity per (stage, label, family); typed empty when no failures."""
    grouped = (
        failures.where(F.col("failure_family").isNotNull())
        .groupBy("stage_code", "stage_label", "failure_family")
        .agg(F.sum("failure_quantity").alias("failure_quantity"))
    )
    return schemas.conform(grouped, schemas.PREBUILT_PARETO)


def sort_pareto(pareto: DataFrame) -> DataFrame:
    """O2: stage ascending, quantity descending, family as the tiebreak."""
    return pareto.orderBy("stage_code", F.desc("failure_quantity"), "failure_family")


FILTER_DOMAIN_COLUMNS = ("product_family", "wafer_size")


def filter_domains(master: DataFrame) -> DataFrame:
    """Sorted JSON array of distinct values per filter domain.

    Values are deduplicated (partial-aggregated) before being gathered, so each
    domain row holds only its distinct values.
    """
    long = reduce(
        DataFrame.unionByName,
        [
            master.select(F.lit(c).alias("domain"), F.col(c).cast("string").alias("value"))
            for c in FILTER_DOMAIN_COLUMNS
        ],
    )
    distinct = long.where(F.col("value").isNotNull()).distinct()
    return schemas.conform(
        distinct.groupBy("domain").agg(
            F.to_json(F.sort_array(F.collect_list("value"))).alias("values_json")
        ),
        schemas.FILTER_DOMAINS,
    )


def refresh_statistics(master: DataFrame, facts: DataFrame, components: DataFrame, audit: DataFrame) -> DataFrame:
    """D12 in long form: (statistic, value).

    Each statistic is an independent global aggregate; a union keeps them as
    rows instead of joining single-row frames.
    """
    parts = [
        master.agg(F.count_distinct("physical_wafer_id").alias("value")).select(
            F.lit("physical_wafers").alias("statistic"), "value"
        ),
        facts.agg(F.count(F.lit(1)).alias("value")).select(F.lit("yield_rows").alias("statistic"), "value"),
        components.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit("final_cohort_wafers").alias("statistic"), "value"
        ),
        audit.agg(F.count_if(F.col("identity_status") == rules.AMBIGUOUS).alias("value")).select(
            F.lit("ambiguous_records").alias("statistic"), "value"
        ),
        audit.agg(F.count_if(F.col("identity_status") == rules.UNRESOLVED).alias("value")).select(
            F.lit("unresolved_records").alias("statistic"), "value"
        ),
    ]
    return reduce(DataFrame.unionByName, parts).select("statistic", F.col("value").cast("bigint"))
