"""Detail tables limited to a wafer scope.

The scope is a DataFrame of wafer ids, never a driver-side list.  It is turned
into the exact source aliases of that kind, and those mark the rows of the
resolution table (one per distinct alias) that are in scope.  Scope and
resolution are then one join of the detail rows on their raw alias, so the
detail table is exchanged once, salted for its hot aliases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldspark import rules
from yieldspark.operators import identity

DETAIL_DATASETS = {
    "chip_detail": (rules.CHIP, "chip_wafer_ref"),
    "sorting_parameter_detail": (rules.SORTING, "sorting_wafer_ref"),
}
DETAIL_RECORD_COLUMNS = {"chip_detail": "chip_record_id", "sorting_parameter_detail": "parameter_record_id"}


def detail_identity(dataset: str) -> tuple[str, str]:
    try:
        return DETAIL_DATASETS[dataset]
    except KeyError:
        raise ValueError(f"Unsupported targeted dataset: {dataset}") from None


def scope_aliases(aliases: DataFrame, wafer_ids: DataFrame, source_kind: str) -> DataFrame:
    """Exact source aliases of one kind owned by the wafers in scope."""
    return (
        aliases.where(F.col("source_kind") == source_kind)
        .join(wafer_ids.select("physical_wafer_id"), "physical_wafer_id", "left_semi")
        .select(F.col("source_alias").alias("_scope_alias"))
        .distinct()
    )


def extract_targeted(detail: DataFrame, aliases: DataFrame, wafer_ids: DataFrame, dataset: str) -> DataFrame:
    """Detail rows whose raw alias is an exact alias of a wafer in scope.

    Rows spelled only in a normalized form are not fetched, as in the source
    contract this reproduces.
    """
    kind, alias_column = detail_identity(dataset)
    scope = scope_aliases(aliases, wafer_ids, kind)
    return detail.join(scope, detail[alias_column] == scope["_scope_alias"], "left_semi")


def transform_targeted(
    detail: DataFrame,
    aliases: DataFrame,
    dataset: str,
    resolution: DataFrame | None = None,
    hot_keys: identity.HotKeyPolicy | None = None,
) -> DataFrame:
    """Resolve detail rows and keep the RESOLVED ones (no audit rows)."""
    kind, alias_column = detail_identity(dataset)
    if resolution is None:
        annotated = identity.resolve_records(detail, aliases, kind, alias_column)
    else:
        annotated = identity.annotate(
            detail, kind, alias_column, resolution, source=dataset,
            record_column=DETAIL_RECORD_COLUMNS[dataset], hot_keys=hot_keys,
        )
    return identity.resolved_only(annotated).drop("identity_method", *identity.WAFER_ATTRIBUTES)


def scoped_resolution(resolution: DataFrame, aliases: DataFrame, wafer_ids: DataFrame, dataset: str) -> DataFrame:
    """The RESOLVED rows of the detail table's aliases that are exact aliases of a wafer in scope."""
    kind, _ = detail_identity(dataset)
    scope = scope_aliases(aliases, wafer_ids, kind)
    mine = resolution.where((F.col("source") == dataset) & (F.col("identity_status") == rules.RESOLVED))
    return mine.join(scope, mine["raw_alias"] == scope["_scope_alias"], "left_semi")


def targeted_detail_table(
    detail: DataFrame,
    aliases: DataFrame,
    wafer_ids: DataFrame,
    dataset: str,
    resolution: DataFrame | None = None,
    hot_keys: identity.HotKeyPolicy | None = identity.HotKeyPolicy(),
) -> DataFrame:
    """The resolved detail rows in scope, by one join on the raw alias."""
    kind, alias_column = detail_identity(dataset)
    if resolution is None:
        resolution = identity.resolve_keys(aliases, identity.lookup_keys(detail, kind, alias_column, dataset))
    # A null alias is no exact alias of any wafer; the join key folds it into empty text.
    annotated = identity.annotate(
        detail.where(F.col(alias_column).isNotNull()), kind, alias_column, scoped_resolution(resolution, aliases, wafer_ids, dataset),
        source=dataset, record_column=DETAIL_RECORD_COLUMNS[dataset], hot_keys=hot_keys, how="inner",
        # By the resolution's own counts, so the scope is joined once only.
        hot=None if hot_keys is None else identity.hot_aliases(resolution, dataset, hot_keys),
    )
    return annotated.drop("identity_method", *identity.WAFER_ATTRIBUTES)


def parameter_yield_summary(parameter_detail: DataFrame) -> DataFrame:
    """Per parameter, rows, passing rows and their ratio."""
    grouped = parameter_detail.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("passed").cast("int")).cast("bigint").alias("good"),
    )
    return grouped.withColumn("yield_rate", F.col("good") / F.col("total"))


CHIP_VIEW_COLUMNS = ("physical_wafer_id", "chip_number", "x", "y", "passed", "failure_family", "tested_at")
PARAMETER_VIEW_COLUMNS = (
    "physical_wafer_id",
    "chip_number",
    "parameter",
    "value",
    "lower_limit",
    "upper_limit",
    "passed",
)


def detail_view(stage_code: str, chip_detail: DataFrame, parameter_detail: DataFrame) -> tuple[DataFrame, str]:
    """SORTING drills into parameter rows, every other stage into chip rows."""
    if stage_code == "SORTING":
        return parameter_detail.select(*PARAMETER_VIEW_COLUMNS), "Targeted Sorting parameter retrieval"
    return chip_detail.select(*CHIP_VIEW_COLUMNS), "Targeted chip-detail retrieval"
