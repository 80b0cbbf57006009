"""

``queries()`` maps a name to a Spark plan over the driver tables of one scale
factor; ``oracle_sql()`` gives the same result as DuckDB SQL over the same
tables.  Both sides round double columns to 6 decimals (float sums depend on
summation order) and return timestamps as UTC wall-clock values.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

import duckdb_oracle as O  # noqa: E402
from yieldspark import rules  # noqa: E402
from yieldspark.operators import detail, facts, identity, prepared, revisions  # noqa: E402
from yieldspark.plans import views  # noqa: E402
from yieldspark.plans.views import Cell, Scope  # noqa: E402
from yieldspark.sources import driver_tables as dt  # noqa: E402

# The training-data operators and their pipeline, where that subpackage is installed.
try:
    import corpus_pipeline
    from yieldspark.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "yieldspark.llm"):
        raise
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"

# --- fixed query parameters ----------------------------------------------------
CELL = Cell("CHIP_INSPECTION", "Month", "1995-06")
PARETO_CELL = Cell("WAFER_INSPECTION", "Month", "1995-06")
FILTERED = Scope({"product_family": "BUILDING", "wafer_size": "EUROPE"}, "1994-01-01", "1996-12-31")
FILTERED_MODE = "Quarter"
WIDE_YEAR = Scope(start="1995-01-01", end="1995-12-31")
WIDE_PERIODS = [f"1995-{m:02d}" for m in range(1, 13)]
DETAIL_WAFER = "PHY-0000007"
RANGE_START, RANGE_END = "1995-01-01 00:00:00", "1995-07-01 00:00:00"
# ---------------------------------------------------------------------------------


def compare_ready(frame: DataFrame) -> DataFrame:
    """Doubles rounded to 6 dp, timestamps as UTC wall-clock (``timestamp_ntz``)."""
    cols = []
    for field in frame.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(field.name))
    return frame.select(*cols)


def _sources(spark: SparkSession, sf: str, names=None) -> dict[str, DataFrame]:
    return dt.source_tables(spark, sf, names)


_BUILDS: dict[tuple[str, str], object] = {}


def staged_build(spark: SparkSession, sf: str):
    """One staged fact build per session and scale factor, shared by the queries.

    The build resolves every source once and writes its reused intermediates
    (alias table, master, annotated sources, latest revisions, cohort, enriched
    facts) under ``spark.checkpoint.dir``, each when a query first needs it; the
    queries are lazy plans over those tables, so no query re-derives the lineage.
    """
    from yieldspark.plans.refresh import Stager, stage_fact_build
    from yieldspark.session import scratch_path

    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILDS:
        details = _sources(spark, sf, list(dt.schemas.DETAIL_SOURCES))
        _BUILDS[key] = stage_fact_build(
            spark, _sources(spark, sf), details, stager=Stager(spark, scratch_path(spark, "query-staging"))
        )
    return _BUILDS[key]


def _plan(spark: SparkSession, sf: str) -> facts.FactPlan:
    return staged_build(spark, sf).plan


def _facts(spark, sf):
    return facts.yield_fact(_plan(spark, sf).enriched)


def _failures(spark, sf):
    return facts.failure_fact(_plan(spark, sf).enriched)


def _resolved(spark, sf, name):
    src = _sources(spark, sf, ["identity_aliases", name])
    kind, alias_column, _ = identity.SOURCE_IDENTITY[name]
    return identity.resolved_only(
        identity.resolve_records(src[name], src["identity_aliases"], kind, alias_column)
    )


def _stage(part: str):
    def run(spark, sf):
        return _plan(spark, sf).parts[part].select(*facts.STAGE_ROW_COLUMNS)

    return run


# --- Spark side -------------------------------------------------------------------
def q_alias_index(key_column):
    def run(spark, sf):
        aliases = dt.identity_aliases(spark, sf)
        return identity.alias_index(aliases, key_column).withColumn(
            "is_ambiguous", F.col("min_id") != F.col("max_id")
        )

    return run


def q_identity_audit(spark, sf):
    return identity.identity_audit(_plan(spark, sf).annotated)


def q_identity_status_counts(spark, sf):
    return identity.status_counts(q_identity_audit(spark, sf))


def q_wafer_master(spark, sf):
    return identity.wafer_master(dt.identity_aliases(spark, sf))


def q_latest(name, fn):
    def run(spark, sf):
        return fn(_resolved(spark, sf, name))

    return run


def q_stage_wafer_total(spark, sf):
    return _plan(spark, sf).parts["WAFER_TOTAL"].select(*facts.STAGE_ROW_COLUMNS)


def q_wafer_summary(spark, sf):
    plan = _plan(spark, sf)
    return prepared.wafer_summary(plan.master, facts.yield_fact(plan.enriched), prepared.summary_stage_codes())


def q_filter_domains(spark, sf):
    return prepared.filter_domains(_plan(spark, sf).master)


def q_refresh_statistics(spark, sf):
    plan = _plan(spark, sf)
    return prepared.refresh_statistics(
        plan.master, plan.enriched, plan.components, identity.identity_audit(plan.annotated)
    )


def q_matrix(mode):
    def run(spark, sf):
        return views.matrix_long(_facts(spark, sf), mode)

    return run


def q_matrix_filtered(spark, sf):
    return views.matrix_long(_facts(spark, sf), FILTERED_MODE, FILTERED)


def q_matrix_wide_month(spark, sf):
    fact_df = _facts(spark, sf)
    periods = views.displayed_periods(fact_df, "Month", WIDE_YEAR, rules.DEFAULT_MAX_PERIODS)
    long = views.matrix_long(fact_df, "Month", WIDE_YEAR)
    return views.matrix_wide(long, rules.rules_frame(spark), periods)


def q_cell_population(spark, sf):
    return views.cell_population(published(spark, sf, "yield_fact"), CELL).select(*dt.schemas.YIELD_FACT.fieldNames())


def q_cell_kpis(spark, sf):
    return views.cell_kpis(published(spark, sf, "yield_fact"), CELL)


def q_cell_pareto(top_n):
    def run(spark, sf):
        return views.cell_pareto(published(spark, sf, "failure_fact"), PARETO_CELL, top_n=top_n)

    return run


def q_cell_trend(spark, sf):
    return views.cell_trend(published(spark, sf, "yield_fact"), CELL.mode, CELL.stage_code)


def q_cell_scatter(spark, sf):
    return views.cell_scatter(published(spark, sf, "yield_fact"), CELL)


def q_cell_lineage(spark, sf):
    return views.population_records(published(spark, sf, "yield_fact"), published(spark, sf, "lineage"), CELL)


def q_filter_options(spark, sf):
    return views.filter_options(_facts(spark, sf))


def q_date_bounds(spark, sf):
    return views.date_bounds(_facts(spark, sf))


def _targeted(spark, sf, dataset):
    build = staged_build(spark, sf)
    wafers = build.master.select("physical_wafer_id")
    resolution = build.resolution[dataset]
    policy = identity.policy_for(resolution, dataset, identity.HotKeyPolicy())
    return detail.targeted_detail_table(build.detail_sources[dataset], build.aliases, wafers, dataset, resolution, policy)


def q_targeted_chip_detail(spark, sf):
    return _targeted(spark, sf, "chip_detail")


def q_targeted_sorting_detail(spark, sf):
    return _targeted(spark, sf, "sorting_parameter_detail")


def q_detail_first_500(spark, sf):
    from yieldspark.plans.refresh import wafer_detail

    frame, _ = wafer_detail(spark, published_root(spark, sf), "CHIP_INSPECTION", DETAIL_WAFER)
    return frame.orderBy(*detail.CHIP_VIEW_COLUMNS).limit(rules.DETAIL_ROW_LIMIT)


def q_wafer_sorting_detail(spark, sf):
    from yieldspark.plans.refresh import wafer_detail

    return wafer_detail(spark, published_root(spark, sf), "SORTING", DETAIL_WAFER)[0]


def q_parameter_yield_summary(spark, sf):
    return detail.parameter_yield_summary(published(spark, sf, "targeted_sorting_parameter_detail"))


# --- stored sources, publication, export and streaming ------------------------------------
def _once(make):
    """A folder that a query set-up fills, made once per session and scale factor."""
    made: dict[tuple[str, str], str] = {}

    def get(spark: SparkSession, sf: str) -> str:
        key = (spark.sparkContext.applicationId, sf)
        if key not in made:
            made[key] = make(spark, sf)
        return made[key]

    return get


@_once
def stored_sources(spark: SparkSession, sf: str) -> str:
    """The source tables written as a user would keep them."""
    from yieldspark.session import scratch_path
    from yieldspark.sources import stored

    root = scratch_path(spark, "sources")
    stored.write_sources(_sources(spark, sf), root)
    return root


@_once
def published_root(spark: SparkSession, sf: str) -> str:
    """One publication of a full refresh of ``sf``."""
    from yieldspark.plans.refresh import publish_build
    from yieldspark.session import scratch_path

    root = scratch_path(spark, "published") + "/version=1"
    publish_build(spark, staged_build(spark, sf), root)
    return root


def published(spark: SparkSession, sf: str, name: str) -> DataFrame:
    from yieldspark.plans.publish import read

    return read(spark, published_root(spark, sf), name)


_DELTAS: dict[tuple[str, str], object] = {}


def delta_store(spark: SparkSession, sf: str):
    """A delta store that was started with the first revisions; the later ones landed as files in the R1 stream."""
    from yieldspark.plans import delta
    from yieldspark.session import scratch_path
    from yieldspark.streaming.incremental import start_delta_refresh

    key = (spark.sparkContext.applicationId, sf)
    if key not in _DELTAS:
        work = scratch_path(spark, "delta")
        store = delta.DeltaStore(f"{work}/store", buckets=4)
        sources = _sources(spark, sf)
        revised = [name for name, frame in sources.items() if "revision" in frame.columns]
        delta.start(spark, store, sources | {name: sources[name].where("revision = 1") for name in revised})
        for name in revised:
            sources[name].where("revision > 1").write.parquet(f"{work}/landing/{name}")
            start_delta_refresh(spark, store, name, f"{work}/landing/{name}", f"{work}/checkpoint/{name}").awaitTermination()
        _DELTAS[key] = store
    return _DELTAS[key]


def q_incremental(project):
    def run(spark, sf):
        from yieldspark.plans import delta

        return project(delta.enriched(spark, delta_store(spark, sf)))

    return run


def q_stored_sources_yield_fact(spark, sf):
    from yieldspark.plans.refresh import stage_fact_build
    from yieldspark.sources import stored

    read = stored.read_sources(spark, stored_sources(spark, sf))
    return facts.yield_fact(stage_fact_build(spark, read, {}).plan.enriched)


def q_time_range_scan(spark, sf):
    from yieldspark.sources import database, stored

    rows = stored.read_source(spark, f"{stored_sources(spark, sf)}/process_results", "process_results")
    return database.time_range_scan(rows, "completed_at", RANGE_START, RANGE_END)


def q_work_order_scoped_scan(spark, sf):
    from yieldspark.session import scratch_path
    from yieldspark.sources import database

    src = _sources(spark, sf, ["identity_aliases", "sorting_parameter_detail"])
    aliases = src["identity_aliases"]
    path = scratch_path(spark, "by-work-order")
    database.store_by_work_order(src["sorting_parameter_detail"], aliases, rules.SORTING, "sorting_wafer_ref", path)
    # Work orders and SORTING references of the wafers of one product family.
    keys = aliases.where(
        (F.col("source_kind") == rules.SORTING) & (F.col("product_family") == "MACHINERY")
    ).select("work_order", F.col("source_alias").alias("sorting_wafer_ref"))
    return database.work_order_scan(spark.read.parquet(path), keys, "sorting_wafer_ref")


def q_published_yield_fact(spark, sf):
    return published(spark, sf, "yield_fact").select(*dt.schemas.YIELD_FACT.fieldNames())


def q_published_targeted_read(spark, sf):
    from yieldspark.plans.publish import read_wafers

    return read_wafers(spark, published_root(spark, sf), "targeted_chip_detail", [DETAIL_WAFER])


def q_validate_version(spark, sf):
    """B3 on the publication, then the rows of each dataset."""
    from yieldspark.plans import publish

    root = published_root(spark, sf)
    publish.check(spark, root, publish.counts(spark, root))
    rows = spark.read.option("basePath", root.rsplit("/", 1)[0]).parquet(f"{root}/{publish.SUMMARY}").where("entry = 'rows'")
    targeted = F.col("name").isin(list(dt.schemas.TARGETED_DATASETS))
    return rows.select(
        F.col("version").cast("long").alias("version"),
        F.col("name").alias("dataset"),
        F.col("value").alias("rows"),
        F.when(targeted, "targeted").otherwise("common").alias("load_policy"),
        F.lit("VALIDATED").alias("status"),
    )


def q_published_statistics(spark, sf):
    """The statistics that were counted while the datasets were written."""
    from yieldspark.plans import publish

    found = publish.summary(spark, published_root(spark, sf)).where("entry = 'statistic'")
    return found.select(F.col("name").alias("statistic"), "value")


def q_csv_export_roundtrip(spark, sf):
    from yieldspark.plans.refresh import export_csv, read_csv_export
    from yieldspark.session import scratch_path

    records = q_cell_lineage(spark, sf)
    path = export_csv(records, scratch_path(spark, "export") + "/" + views.export_file_name(CELL))
    return read_csv_export(spark, path, records.schema)


def q_stream_weekly_yield(spark, sf):
    from yieldspark.session import scratch_path
    from yieldspark.streaming.incremental import run_weekly_yield

    # Files hold facts of all times, one file a batch, so most weeks get late facts.
    return run_weekly_yield(
        spark, _facts(spark, sf), scratch_path(spark, "stream-weekly"), files=5, max_files_per_trigger=1, fold_every=3
    )


def q_facts_in_display_order(spark, sf):
    """O1: every fact's position by (display order, event time, wafer, id)."""
    from yieldspark.operators.ordered import with_position

    rows = _facts(spark, sf).select("yield_record_id", "stage_code", "display_order", "event_time", "physical_wafer_id")
    return with_position(rows, [F.asc("display_order"), F.asc("event_time"), F.asc("physical_wafer_id"), F.asc("yield_record_id")])


def q_pareto_in_order(spark, sf):
    """O2: stage ascending, quantity descending, family as the tiebreak."""
    from yieldspark.operators.ordered import with_position

    rows = published(spark, sf, "prebuilt_pareto").withColumn("failure_quantity", F.round("failure_quantity", 6))
    return with_position(rows, [F.asc("stage_code"), F.desc("failure_quantity"), F.asc("failure_family")])


def q_parameters_in_order(spark, sf):
    """Parameters, the worst first."""
    from yieldspark.operators.ordered import with_position

    return with_position(q_parameter_yield_summary(spark, sf), [F.asc("yield_rate"), F.asc("parameter")])


def q_population_in_order(spark, sf):
    """A cell's records, the worst first, as its listing shows them."""
    from yieldspark.operators.ordered import with_position

    order = [F.asc("yield_rate"), F.asc("source_kind"), F.asc("source_record_id")]
    return with_position(q_cell_lineage(spark, sf), order)


def q_matrix_by_settings(spark, sf):
    """The matrix of settings that differ from the defaults."""
    from yieldspark.settings import matrix, settings

    return matrix(_facts(spark, sf), settings(spark, period_mode="Quarter", max_periods=4, product_family="BUILDING"))


def q_approximate_wafers(spark, sf):
    """Distinct wafers by stage from merged weekly sketches: the exact count, and whether the sketch keeps its bound."""
    from yieldspark.operators import sketches

    rows = published(spark, sf, "yield_fact")
    near = sketches.approximate_wafers(sketches.wafer_sketches(rows, "Week"), ["stage_code"])
    exact = rows.groupBy("stage_code").agg(F.count_distinct("physical_wafer_id").alias("wafers"))
    return near.join(exact, "stage_code").select(
        "stage_code", "wafers", sketches.within_bound(F.col("approximate_wafers"), F.col("wafers")).alias("within_bound")
    )


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "flagship_chip_weekly_yield": q_flagship_chip_weekly_yield,
        "alias_index_exact": q_alias_index("source_alias"),
        "alias_index_normalized": q_alias_index("normalized_alias"),
        "identity_resolution_audit": q_identity_audit,
        "identity_status_counts": q_identity_status_counts,
        "wafer_master": q_wafer_master,
        "latest_inspection_revision": q_latest("wafer_inspection", revisions.latest_inspection),
        "latest_chip_revision": q_latest("chip_inspection_summary", revisions.latest_chip_summary),
        "latest_qualification_revision": q_latest("qualification_results", revisions.latest_qualification),
        "stage_wafer_inspection": _stage("WAFER_INSPECTION"),
        "stage_process": _stage("PROCESS"),
        "stage_chip_inspection": _stage("CHIP_INSPECTION"),
        "stage_auto_outlier": _stage("AUTO_OUTLIER"),
        "stage_sorting": _stage("SORTING"),
        "stage_qualification": _stage("QUALIFICATION"),
        "stage_wafer_total": q_stage_wafer_total,
        "stage_device_formation": _stage("DEVICE_FORMATION"),
        "stage_final_chip_yield": _stage("FINAL_CHIP_YIELD"),
        "final_component_fact": lambda s, sf: _plan(s, sf).components,
        "yield_fact": _facts,
        "failure_fact": _failures,
        "lineage": lambda s, sf: facts.lineage(_plan(s, sf).enriched),
        "wafer_summary": q_wafer_summary,
        "prebuilt_trend": lambda s, sf: prepared.prebuilt_trend(_facts(s, sf)),
        "prebuilt_pareto": lambda s, sf: prepared.prebuilt_pareto(_failures(s, sf)),
        "filter_domains": q_filter_domains,
        "refresh_statistics": q_refresh_statistics,
        "matrix_day": q_matrix("Day"),
        "matrix_week": q_matrix("Week"),
        "matrix_month": q_matrix("Month"),
        "matrix_quarter": q_matrix("Quarter"),
        "matrix_year": q_matrix("Year"),
        "matrix_filtered": q_matrix_filtered,
        "matrix_wide_month": q_matrix_wide_month,
        "matrix_by_settings": q_matrix_by_settings,
        "cell_population": q_cell_population,
        "cell_kpis": q_cell_kpis,
        "cell_pareto": q_cell_pareto(rules.DEFAULT_TOP_N),
        "cell_pareto_top3": q_cell_pareto(3),
        "cell_trend": q_cell_trend,
        "cell_scatter": q_cell_scatter,
        "cell_lineage": q_cell_lineage,
        "filter_options": q_filter_options,
        "date_bounds": q_date_bounds,
        "targeted_chip_detail": q_targeted_chip_detail,
        "targeted_sorting_detail": q_targeted_sorting_detail,
        "detail_first_500": q_detail_first_500,
        "wafer_sorting_detail": q_wafer_sorting_detail,
        "parameter_yield_summary": q_parameter_yield_summary,
        "jdbc_style_time_range_scan": q_time_range_scan,
        "work_order_scoped_scan": q_work_order_scoped_scan,
        "published_yield_fact": q_published_yield_fact,
        "published_targeted_read": q_published_targeted_read,
        "validate_version": q_validate_version,
        "published_statistics": q_published_statistics,
        "facts_in_display_order": q_facts_in_display_order,
        "pareto_in_order": q_pareto_in_order,
        "parameters_in_order": q_parameters_in_order,
        "population_in_order": q_population_in_order,
        "approximate_wafers": q_approximate_wafers,
        "incremental_yield_fact": q_incremental(facts.yield_fact),
        "incremental_failure_fact": q_incremental(facts.failure_fact),
        "incremental_lineage": q_incremental(facts.lineage),
        "stored_sources_yield_fact": q_stored_sources_yield_fact,
        "csv_export_roundtrip": q_csv_export_roundtrip,
        "stream_weekly_yield": q_stream_weekly_yield,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:

    from yieldspark.session import prepare_session

    def wrap(fn):
        return lambda spark, sf_dir: compare_ready(fn(prepare_session(spark), sf_dir))

    found = {name: wrap(fn) for name, fn in _queries().items()}
    if llm_queries is not None:
        found |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def q_flagship_chip_weekly_yield(spark, sf):
    """Identity resolution → latest revision → chip-inspection facts → weekly ratio of sums."""
    src = _sources(spark, sf, ["identity_aliases", "chip_inspection_summary"])
    aliases = src["identity_aliases"]
    annotated = identity.resolve_records(src["chip_inspection_summary"], aliases, rules.CHIP, "chip_wafer_ref")
    chips = revisions.latest_chip_summary(identity.resolved_only(annotated))
    enriched = facts.enrich(facts.chip_inspection_rows(chips), identity.wafer_master(aliases), rules.rules_frame(spark))
    return prepared.prebuilt_trend(facts.yield_fact(enriched))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship on sf0.001: weekly chip-inspection yield from raw aliased sources."""
    return queries()["flagship_chip_weekly_yield"](spark, SMOKE_DIR)


# --- DuckDB side --------------------------------------------------------------------
def _stage_sql(cte: str) -> str:
    """Stage rows as built (before the fact guard)."""
    return O.with_ctes(
        "SELECT stage_code, physical_wafer_id, event_time, round(numerator, 6) AS numerator, "
        "round(denominator, 6) AS denominator, failure_family, source_kind, source_record_id, "
        f"transformation_rule, identity_method FROM {cte}"
    )


def _matrix_sql(mode: str, where: str = "TRUE", max_periods: int = rules.DEFAULT_MAX_PERIODS) -> str:
    return O.with_ctes(
        f"""SELECT section, stage_code, stage_label, display_order, period,
       round(sum(numerator), 6) AS numerator, round(sum(denominator), 6) AS denominator,
       round(sum(numerator) / sum(denominator), 6) AS yield_rate
FROM lab WHERE period IN (SELECT period FROM per)
GROUP BY section, stage_code, stage_label, display_order, period""",
        extra=f"""lab AS (SELECT *, {O.period_sql('event_time', mode)} AS period FROM yield_fact WHERE {where}),
per AS (SELECT DISTINCT period FROM lab WHERE period IS NOT NULL ORDER BY period DESC LIMIT {max_periods})""",
    )


def _cell_where(mode: str, stage: str, period: str) -> str:
    return f"stage_code = {O._q(stage)} AND {O.period_sql('event_time', mode)} = {O._q(period)}"


def _pareto_sql(top_n: int) -> str:
    where = _cell_where("Month", PARETO_CELL.stage_code, PARETO_CELL.period)
    return O.with_ctes(
        f"""SELECT failure_family, round(failure_quantity, 6) AS failure_quantity,
       round(sum(failure_quantity) OVER (ORDER BY failure_quantity DESC, failure_family ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(failure_quantity) OVER (), 6) AS cumulative_share
FROM g""",
        extra=f"""g AS (
  SELECT failure_family, sum(failure_quantity) AS failure_quantity FROM failure_fact
  WHERE {where} AND failure_family IS NOT NULL
  GROUP BY failure_family ORDER BY failure_quantity DESC, failure_family LIMIT {top_n})""",
    )


YF_COLS = (
    "yield_record_id, section, stage_code, stage_label, display_order, physical_wafer_id, work_order, lot_id, "
    "wafer_number, product_family, wafer_size, event_time, round(numerator, 6) AS numerator, "
    "round(denominator, 6) AS denominator, round(yield_rate, 6) AS yield_rate, failure_family"
)


def oracle_sql() -> dict[str, str]:
    cell_where = _cell_where("Month", CELL.stage_code, CELL.period)
    summary_codes = prepared.summary_stage_codes()
    pivot_cols = ", ".join(
        f"round(arg_min(yield_rate, row(event_time, yield_record_id)) FILTER (WHERE stage_code = '{c}'), 6) AS {c}"
        for c in summary_codes
    )
    wide_cols = ", ".join(
        f"coalesce(max(cell_text) FILTER (WHERE period = '{p}'), '—') AS \"{p}\"" for p in WIDE_PERIODS
    )
    wide_where = O.filter_sql(start=WIDE_YEAR.start, end=WIDE_YEAR.end)
    filtered_where = O.filter_sql(
        product=FILTERED.values["product_family"], wafer_size=FILTERED.values["wafer_size"],
        start=FILTERED.start, end=FILTERED.end,
    )
    sql = {
        "alias_index_exact": O.with_ctes(
            "SELECT source_kind, lookup_alias, e_min AS min_id, e_max AS max_id, e_min <> e_max AS is_ambiguous FROM exact_idx"
        ),
        "alias_index_normalized": O.with_ctes(
            "SELECT source_kind, lookup_alias, n_min AS min_id, n_max AS max_id, n_min <> n_max AS is_ambiguous FROM norm_idx"
        ),
        "identity_resolution_audit": O.with_ctes("SELECT * FROM identity_audit"),
        "identity_status_counts": O.with_ctes(
            "SELECT source_kind, identity_status, identity_method, count(*) AS records FROM identity_audit "
            "GROUP BY source_kind, identity_status, identity_method"
        ),
        "wafer_master": O.with_ctes("SELECT * FROM master"),
        "latest_inspection_revision": O.with_ctes("SELECT * FROM insp_latest"),
        "latest_chip_revision": O.with_ctes("SELECT * FROM chip_latest"),
        "latest_qualification_revision": O.with_ctes("SELECT * FROM qual_latest"),
        "stage_wafer_inspection": _stage_sql("s_wafer_inspection"),
        "stage_process": _stage_sql("s_process"),
        "stage_chip_inspection": _stage_sql("s_chip_inspection"),
        "stage_auto_outlier": _stage_sql("s_auto_outlier"),
        "stage_sorting": _stage_sql("s_sorting"),
        "stage_qualification": _stage_sql("s_qualification"),
        "stage_wafer_total": _stage_sql("s_wafer_total"),
        "stage_device_formation": _stage_sql("s_device_formation"),
        "stage_final_chip_yield": _stage_sql("s_final_chip_yield"),
        "final_component_fact": O.with_ctes(
            "SELECT physical_wafer_id, work_order, product_family, event_time, round(total_chips, 6) AS total_chips, "
            "round(chip_inspection, 6) AS chip_inspection, round(device_formation, 6) AS device_formation, "
            "round(sorting, 6) AS sorting, round(qualification, 6) AS qualification, "
            "round(final_chip_yield, 6) AS final_chip_yield FROM final_component_fact"
        ),
        "yield_fact": O.with_ctes(f"SELECT {YF_COLS} FROM yield_fact"),
        "failure_fact": O.with_ctes(
            "SELECT yield_record_id, stage_code, stage_label, physical_wafer_id, work_order, product_family, "
            "event_time, failure_family, round(failure_quantity, 6) AS failure_quantity FROM failure_fact"
        ),
        "lineage": O.with_ctes("SELECT * FROM lineage"),
        "wafer_summary": O.with_ctes(
            "SELECT m.*, " + ", ".join(f"piv.{c}" for c in summary_codes)
            + " FROM master m LEFT JOIN piv ON m.physical_wafer_id = piv.physical_wafer_id",
            extra=f"piv AS (SELECT physical_wafer_id, {pivot_cols} FROM yield_fact GROUP BY physical_wafer_id)",
        ),
        "prebuilt_trend": O.with_ctes(
            f"SELECT stage_code, stage_label, {O.week_label('event_time')} AS period, "
            "round(sum(numerator), 6) AS numerator, round(sum(denominator), 6) AS denominator, "
            "round(sum(numerator) / sum(denominator), 6) AS yield_rate FROM yield_fact "
            "WHERE event_time IS NOT NULL GROUP BY ALL"
        ),
        "prebuilt_pareto": O.with_ctes(
            "SELECT stage_code, stage_label, failure_family, round(sum(failure_quantity), 6) AS failure_quantity "
            "FROM failure_fact WHERE failure_family IS NOT NULL GROUP BY ALL"
        ),
        "filter_domains": O.with_ctes(
            "SELECT 'product_family' AS domain, CAST(to_json(list_sort(list(DISTINCT product_family))) AS VARCHAR) AS values_json "
            "FROM master WHERE product_family IS NOT NULL "
            "UNION ALL SELECT 'wafer_size', CAST(to_json(list_sort(list(DISTINCT wafer_size))) AS VARCHAR) "
            "FROM master WHERE wafer_size IS NOT NULL"
        ),
        "refresh_statistics": O.with_ctes(
            "SELECT 'physical_wafers' AS statistic, CAST(count(DISTINCT physical_wafer_id) AS BIGINT) AS value FROM master "
            "UNION ALL SELECT 'yield_rows', count(*) FROM enriched "
            "UNION ALL SELECT 'final_cohort_wafers', count(*) FROM final_component_fact "
            "UNION ALL SELECT 'ambiguous_records', count(*) FILTER (WHERE identity_status = 'AMBIGUOUS') FROM identity_audit "
            "UNION ALL SELECT 'unresolved_records', count(*) FILTER (WHERE identity_status = 'UNRESOLVED') FROM identity_audit"
        ),
        "matrix_day": _matrix_sql("Day"),
        "matrix_week": _matrix_sql("Week"),
        "matrix_month": _matrix_sql("Month"),
        "matrix_quarter": _matrix_sql("Quarter"),
        "matrix_year": _matrix_sql("Year"),
        "matrix_filtered": _matrix_sql("Quarter", filtered_where),
        "matrix_wide_month": O.with_ctes(
            f"SELECT c.section, c.stage_code, c.stage_label, c.display_order, r.assumption, {wide_cols} "
            "FROM cells c JOIN rules_t r ON c.stage_code = r.stage_code "
            "GROUP BY c.section, c.stage_code, c.stage_label, c.display_order, r.assumption",
            extra=f"cells AS (SELECT section, stage_code, stage_label, display_order, {O.period_sql('event_time', 'Month')} AS period, "
            "printf('%.1f%%', round(100.0 * sum(numerator) / sum(denominator), 9)) AS cell_text "
            f"FROM yield_fact WHERE {wide_where} GROUP BY ALL)",
        ),
        "cell_population": O.with_ctes(f"SELECT {YF_COLS} FROM yield_fact WHERE {cell_where}"),
        "cell_kpis": O.with_ctes(
            "SELECT round(coalesce(sum(numerator), 0), 6) AS numerator, round(coalesce(sum(denominator), 0), 6) AS denominator, "
            "round(coalesce(CASE WHEN sum(denominator) <> 0 THEN 100.0 * sum(numerator) / sum(denominator) END, 0.0), 6) AS yield_pct, "
            f"count(DISTINCT physical_wafer_id) AS physical_wafers FROM yield_fact WHERE {cell_where}"
        ),
        "cell_pareto": _pareto_sql(rules.DEFAULT_TOP_N),
        "cell_pareto_top3": _pareto_sql(3),
        "cell_trend": O.with_ctes(
            f"SELECT {O.period_sql('event_time', 'Month')} AS period, round(sum(numerator), 6) AS numerator, "
            "round(sum(denominator), 6) AS denominator, round(100.0 * sum(numerator) / sum(denominator), 6) AS yield_pct "
            f"FROM yield_fact WHERE stage_code = {O._q(CELL.stage_code)} AND event_time IS NOT NULL GROUP BY ALL"
        ),
        "cell_scatter": O.with_ctes(
            "SELECT physical_wafer_id, round(yield_pct, 6) AS yield_pct, work_order, lot_id, event_time, "
            "round(greatest(0.0, min(yield_pct) OVER () - 1.0), 6) AS color_floor FROM pop",
            extra=f"pop AS (SELECT *, 100.0 * yield_rate AS yield_pct FROM yield_fact WHERE {cell_where})",
        ),
        "cell_lineage": O.with_ctes(
            "SELECT f.physical_wafer_id, f.work_order, f.lot_id, f.product_family, round(f.numerator, 6) AS numerator, "
            "round(f.denominator, 6) AS denominator, round(round_even((100.0 * f.yield_rate) * 100.0, 0) / 100.0, 6) AS yield_rate, "
            "f.failure_family, l.source_kind, l.source_record_id, l.transformation_rule "
            f"FROM yield_fact f LEFT JOIN lineage l ON f.yield_record_id = l.yield_record_id WHERE {cell_where.replace('stage_code', 'f.stage_code').replace('event_time', 'f.event_time')}"
        ),
        "filter_options": O.with_ctes(
            "SELECT DISTINCT 'product_family' AS domain, product_family AS value FROM yield_fact WHERE product_family IS NOT NULL "
            "UNION SELECT DISTINCT 'work_order', work_order FROM yield_fact WHERE work_order IS NOT NULL "
            "UNION SELECT DISTINCT 'wafer_size', wafer_size FROM yield_fact WHERE wafer_size IS NOT NULL"
        ),
        "date_bounds": O.with_ctes(
            "SELECT CAST(min(event_time) AS DATE) AS min_date, CAST(max(event_time) AS DATE) AS max_date FROM yield_fact"
        ),
        "targeted_chip_detail": O.with_ctes("SELECT * FROM targeted_chip_detail"),
        "targeted_sorting_detail": O.with_ctes(
            "SELECT parameter_record_id, sorting_wafer_ref, chip_number, parameter, round(value, 6) AS value, "
            "round(lower_limit, 6) AS lower_limit, round(upper_limit, 6) AS upper_limit, passed, measured_at, "
            "identity_status, physical_wafer_id FROM targeted_sorting_detail"
        ),
        "detail_first_500": O.with_ctes(
            "SELECT physical_wafer_id, chip_number, x, y, passed, failure_family, tested_at FROM targeted_chip_detail "
            f"WHERE physical_wafer_id = {O._q(DETAIL_WAFER)} "
            "ORDER BY physical_wafer_id, chip_number, x, y, passed, failure_family, tested_at LIMIT 500"
        ),
        "wafer_sorting_detail": O.with_ctes(
            "SELECT physical_wafer_id, chip_number, parameter, round(value, 6) AS value, round(lower_limit, 6) AS lower_limit, "
            "round(upper_limit, 6) AS upper_limit, passed FROM targeted_sorting_detail "
            f"WHERE physical_wafer_id = {O._q(DETAIL_WAFER)}"
        ),
        "parameter_yield_summary": O.with_ctes(
            "SELECT parameter, count(*) AS total, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS good, "
            "round(CAST(sum(CAST(passed AS INTEGER)) AS DOUBLE) / count(*), 6) AS yield_rate "
            "FROM targeted_sorting_detail GROUP BY parameter"
        ),
        "jdbc_style_time_range_scan": O.with_ctes(
            "SELECT * FROM process_results "
            f"WHERE completed_at >= TIMESTAMP '{RANGE_START}' AND completed_at < TIMESTAMP '{RANGE_END}'"
        ),
        "work_order_scoped_scan": O.with_ctes(
            "SELECT d.*, k.work_order FROM sorting_parameter_detail d JOIN "
            "(SELECT DISTINCT work_order, source_alias FROM identity_aliases WHERE source_kind = 'SORTING' AND product_family = 'MACHINERY') k "
            "ON d.sorting_wafer_ref = k.source_alias"
        ).replace("SELECT d.*,", "SELECT d.parameter_record_id, d.sorting_wafer_ref, d.chip_number, d.parameter, round(d.value, 6) AS value, round(d.lower_limit, 6) AS lower_limit, round(d.upper_limit, 6) AS upper_limit, d.passed, d.measured_at,"),
    }
    sql["published_yield_fact"] = sql["yield_fact"]
    sql["published_targeted_read"] = O.with_ctes(
        f"SELECT * FROM targeted_chip_detail WHERE physical_wafer_id = {O._q(DETAIL_WAFER)}"
    )
    sql["csv_export_roundtrip"] = sql["cell_lineage"]
    sql["published_statistics"] = sql["refresh_statistics"]
    sql["facts_in_display_order"] = O.with_ctes(
        "SELECT yield_record_id, stage_code, display_order, event_time, physical_wafer_id, row_number() OVER "
        "(ORDER BY display_order, event_time NULLS FIRST, physical_wafer_id, yield_record_id) AS position FROM yield_fact"
    )
    sql["pareto_in_order"] = (
        f"SELECT *, row_number() OVER (ORDER BY stage_code, failure_quantity DESC, failure_family) AS position FROM ({sql['prebuilt_pareto']})"
    )
    sql["parameters_in_order"] = f"SELECT *, row_number() OVER (ORDER BY yield_rate, parameter) AS position FROM ({sql['parameter_yield_summary']})"
    sql["population_in_order"] = (
        f"SELECT *, row_number() OVER (ORDER BY yield_rate, source_kind, source_record_id) AS position FROM ({sql['cell_lineage']})"
    )
    sql["matrix_by_settings"] = _matrix_sql("Quarter", "product_family = 'BUILDING'", 4)
    sql["approximate_wafers"] = O.with_ctes(
        "SELECT stage_code, count(DISTINCT physical_wafer_id) AS wafers, true AS within_bound FROM yield_fact GROUP BY stage_code"
    )
    sql["incremental_yield_fact"] = sql["stored_sources_yield_fact"] = sql["yield_fact"]
    sql["incremental_failure_fact"] = sql["failure_fact"]
    sql["incremental_lineage"] = sql["lineage"]
    sql["stream_weekly_yield"] = sql["prebuilt_trend"]
    counted = {
        "yield_fact": "SELECT count(*) FROM yield_fact",
        "failure_fact": "SELECT count(*) FROM failure_fact",
        "lineage": "SELECT count(*) FROM lineage",
        "identity_audit": "SELECT count(*) FROM identity_audit",
        "wafer_summary": "SELECT count(*) FROM master",
        "final_component_fact": "SELECT count(*) FROM final_component_fact",
        "filter_domains": "SELECT count(DISTINCT CASE WHEN product_family IS NOT NULL THEN 'p' END) "
        "+ count(DISTINCT CASE WHEN wafer_size IS NOT NULL THEN 's' END) FROM master",
        "prebuilt_trend": f"SELECT count(*) FROM (SELECT DISTINCT stage_code, stage_label, {O.week_label('event_time')} "
        "FROM yield_fact WHERE event_time IS NOT NULL)",
        "prebuilt_pareto": "SELECT count(*) FROM (SELECT DISTINCT stage_code, stage_label, failure_family "
        "FROM failure_fact WHERE failure_family IS NOT NULL)",
        "targeted_chip_detail": "SELECT count(*) FROM targeted_chip_detail",
        "targeted_sorting_parameter_detail": "SELECT count(*) FROM targeted_sorting_detail",
    }
    policy = {"targeted_chip_detail": "targeted", "targeted_sorting_parameter_detail": "targeted"}
    sql["validate_version"] = O.with_ctes(
        " UNION ALL ".join(
            f"SELECT CAST(1 AS BIGINT) AS version, '{name}' AS dataset, CAST(({query}) AS BIGINT) AS rows, "
            f"'{policy.get(name, 'common')}' AS load_policy, 'VALIDATED' AS status"
            for name, query in counted.items()
        )
    )
    sql["flagship_chip_weekly_yield"] = O.with_ctes(
        f"SELECT stage_code, stage_label, {O.week_label('event_time')} AS period, "
        "round(sum(numerator), 6) AS numerator, round(sum(denominator), 6) AS denominator, "
        "round(sum(numerator) / sum(denominator), 6) AS yield_rate FROM yield_fact "
        "WHERE event_time IS NOT NULL AND stage_code = 'CHIP_INSPECTION' GROUP BY ALL"
    )
    if llm_queries is not None:
        sql |= llm_queries.oracle_sql()
    return sql
