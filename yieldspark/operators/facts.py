"""Stage facts: numerator/denominator rows for the eleven yield stages.

Each stage builder returns *stage rows* with one schema (``STAGE_ROW``); they
are unioned, guarded (denominator > 0), joined to the wafer master and the
display rules, and projected into ``yield_fact``, ``failure_fact`` and
``lineage``.  The derived stages (wafer total, device formation, final chip
yield) are aggregates and joins keyed by ``physical_wafer_id``, so they share
one hash partitioning of the wafer key.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark import rules, schemas
from yieldspark.functions.numeric import clamp_zero, flag_to_double, round_half_even
from yieldspark.functions.text import default_text, numeric_suffix
from yieldspark.operators import identity, revisions

STAGE_ROW_COLUMNS = (
    "stage_code",
    "physical_wafer_id",
    "event_time",
    "numerator",
    "denominator",
    "failure_family",
    "source_kind",
    "source_record_id",
    "transformation_rule",
    "identity_method",
)
FACT_KEY = "yield_record_id"
LINEAGE_EXTRA = ("source_kind", "source_record_id", "identity_method", "transformation_rule")


def fact_key(stage: Column, *parts: Column) -> Column:
    """Deterministic fact id: the stage and what identifies its record within the source.

    A record id may come with several spellings of the alias, channels or
    revisions, so these are parts of the key where the source has them.  ``%``
    and ``:`` inside a part are percent-encoded, so different parts never give
    the same id; null is an empty part.
    """
    def part(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))

    return F.concat_ws(":", F.lit("YF"), stage, *map(part, parts))


def stage_rows(
    frame: DataFrame,
    *,
    stage: Column | str,
    event_time: str | Column,
    numerator: Column,
    denominator: Column,
    failure_family: Column,
    source_kind: str,
    record: Column,
    rule: str,
    method: Column,
    key: Sequence[str] = (),
) -> DataFrame:
    stage_col = F.lit(stage) if isinstance(stage, str) else stage
    time_col = F.col(event_time) if isinstance(event_time, str) else event_time
    # Wafer attributes ride along when the records already carry them.
    attributes = [F.col(c) for c in identity.WAFER_ATTRIBUTES] if identity.carries_attributes(frame) else []
    return frame.select(
        stage_col.alias("stage_code"),
        F.col("physical_wafer_id"),
        time_col.cast("timestamp").alias("event_time"),
        numerator.cast("double").alias("numerator"),
        denominator.cast("double").alias("denominator"),
        failure_family.cast("string").alias("failure_family"),
        F.lit(source_kind).alias("source_kind"),
        record.cast("string").alias("source_record_id"),
        F.lit(rule).alias("transformation_rule"),
        method.alias("identity_method"),
        fact_key(stage_col, F.lit(source_kind), record, *map(F.col, key)).alias(FACT_KEY),
        *attributes,
    )


# --- Q1-Q8: single-source stages ---------------------------------------------
def wafer_inspection_rows(latest_inspection: DataFrame) -> DataFrame:
    """Q1: latest inspection revision per alias; good sites / inspected sites."""
    return stage_rows(
        latest_inspection,
        stage="WAFER_INSPECTION",
        event_time="inspection_at",
        numerator=F.col("sites_good"),
        denominator=F.col("sites_inspected"),
        failure_family=F.col("failure_family"),
        source_kind=rules.INSPECTION,
        record=F.col("record_id"),
        rule=rules.RULE_TEXT["WAFER_INSPECTION"],
        method=F.col("identity_method"),
        key=("inspection_wafer_ref", "revision"),
    )


def process_rows(resolved_process: DataFrame, configured_stages) -> DataFrame:
    """Q2-Q4: every resolved process row of a configured stage except formation; passed / 1."""
    eligible = [s for s in configured_stages if s != rules.FORMATION_STAGE]
    return stage_rows(
        resolved_process.where(F.col("stage_code").isin(eligible)),
        stage=F.col("stage_code"),
        event_time="completed_at",
        numerator=flag_to_double(F.col("passed")),
        denominator=F.lit(1.0),
        failure_family=F.col("failure_family"),
        source_kind=rules.MES,
        record=F.col("record_id"),
        rule=rules.RULE_TEXT["PROCESS"],
        method=F.col("identity_method"),
        key=("mes_wafer_ref", "completed_at"),
    )


def chip_inspection_rows(latest_chips: DataFrame) -> DataFrame:
    """Q5: latest chip-summary revision per alias; good chips / total chips."""
    return stage_rows(
        latest_chips,
        stage="CHIP_INSPECTION",
        event_time="tested_at",
        numerator=F.col("good_chips"),
        denominator=F.col("total_chips"),
        failure_family=F.col("dominant_failure"),
        source_kind=rules.CHIP,
        record=F.col("record_id"),
        rule=rules.RULE_TEXT["CHIP_INSPECTION"],
        method=F.col("identity_method"),
        key=("chip_wafer_ref", "revision"),
    )


def outlier_loss(wafer_id: Column) -> Column:
    """One chip flagged when the wafer id's numeric suffix is a multiple of 11."""
    return F.when((numeric_suffix(wafer_id) % rules.OUTLIER_MODULUS) == 0, F.lit(1)).otherwise(F.lit(0))


def auto_outlier_rows(latest_chips: DataFrame) -> DataFrame:
    """Q6: the chip population after the automated outlier rule."""
    loss = outlier_loss(F.col("physical_wafer_id"))
    return stage_rows(
        latest_chips,
        stage="AUTO_OUTLIER",
        event_time="tested_at",
        numerator=F.col("total_chips") - loss,
        denominator=F.col("total_chips"),
        failure_family=F.when(loss > 0, F.lit(rules.AUTO_OUTLIER_FAMILY)).otherwise(F.lit("")),
        source_kind=rules.CHIP,
        record=F.col("record_id"),
        rule=rules.RULE_TEXT["AUTO_OUTLIER"],
        method=F.col("identity_method"),
        key=("chip_wafer_ref", "revision"),
    )


def sorting_rows(resolved_sorting: DataFrame) -> DataFrame:
    """Q7: every resolved sorting row; event time is the process completion."""
    return stage_rows(
        resolved_sorting,
        stage="SORTING",
        event_time="process_completed_at",
        numerator=F.col("good_chips"),
        denominator=F.col("total_chips"),
        failure_family=F.col("failure_family"),
        source_kind=rules.SORTING,
        record=F.col("record_id"),
        rule=rules.RULE_TEXT["SORTING"],
        method=F.col("identity_method"),
        key=("sorting_wafer_ref", "channel"),
    )


def qualification_rows(latest_quals: DataFrame) -> DataFrame:
    """Q8: latest revision per (alias, channel); passed / 1."""
    return stage_rows(
        latest_quals,
        stage="QUALIFICATION",
        event_time="qualified_at",
        numerator=flag_to_double(F.col("passed")),
        denominator=F.lit(1.0),
        failure_family=F.when(F.coalesce(F.col("passed"), F.lit(False)), F.lit("")).otherwise(
            F.lit(rules.QUALIFICATION_HOLD)
        ),
        source_kind=rules.QUALIFICATION,
        record=F.col("record_id"),
        rule=rules.RULE_TEXT["QUALIFICATION"],
        method=F.col("identity_method"),
        key=("qualification_wafer_ref", "channel", "revision"),
    )


# --- Q9-Q11: derived stages ----------------------------------------------------
def guard(rows: DataFrame) -> DataFrame:
    """The fact guard: a missing or non-positive denominator emits no fact."""
    return rows.where(F.col("denominator") > 0)


def wafer_total_rows(wafer_stage_rows: DataFrame) -> DataFrame:
    """Q9: product of all wafer-stage yields of wafers that have all four stages.

    Completeness is a bit mask (``bit_or``) rather than a distinct count, so
    the whole stage is one hash aggregate with map-side partial aggregation.
    """
    bit = reduce(
        lambda acc, item: acc.when(F.col("stage_code") == item[1], F.lit(1 << item[0])),
        list(enumerate(rules.WAFER_STAGE_CODES))[1:],
        F.when(F.col("stage_code") == rules.WAFER_STAGE_CODES[0], F.lit(1)),
    ).otherwise(F.lit(0))
    full_mask = (1 << len(rules.WAFER_STAGE_CODES)) - 1
    # Attributes are a function of the wafer; as group keys they leave a plain hash aggregate.
    attributes = identity.WAFER_ATTRIBUTES if identity.carries_attributes(wafer_stage_rows) else ()
    per_wafer = (
        wafer_stage_rows.where(F.col("stage_code").isin(list(rules.WAFER_STAGE_CODES)))
        .groupBy("physical_wafer_id", *attributes)
        .agg(
            F.product(F.col("numerator") / F.col("denominator")).alias("wafer_yield"),
            F.max("event_time").alias("last_time"),
            F.bit_or(bit).alias("stage_mask"),
        )
        .where(F.col("stage_mask") == full_mask)
    )
    return stage_rows(
        per_wafer,
        stage="WAFER_TOTAL",
        event_time="last_time",
        numerator=F.col("wafer_yield"),
        denominator=F.lit(1.0),
        failure_family=F.when(F.col("wafer_yield") < 1, F.lit(rules.WAFER_TOTAL_LOSS)).otherwise(F.lit("")),
        source_kind=rules.PREPARED,
        record=F.concat(F.lit("WAFER-TOTAL-"), F.col("physical_wafer_id")),
        rule=rules.RULE_TEXT["WAFER_TOTAL"],
        method=F.lit(rules.WAFER_COHORT_METHOD),
    )


def device_formation_rows(formation_per_wafer: DataFrame, chip_per_wafer: DataFrame) -> DataFrame:
    """Q10: the formation result applied to the wafer's chip population."""
    chips = chip_per_wafer.select("physical_wafer_id", F.col("total_chips").cast("double").alias("_total"))
    joined = formation_per_wafer.join(chips, "physical_wafer_id")
    total = F.col("_total")
    good = F.when(F.coalesce(F.col("passed"), F.lit(False)), total).otherwise(
        clamp_zero(total - rules.FORMATION_LOSS_CHIPS)
    )
    return stage_rows(
        joined,
        stage=rules.FORMATION_STAGE,
        event_time="completed_at",
        numerator=good,
        denominator=total,
        failure_family=F.col("failure_family"),
        source_kind=rules.MES,
        record=F.col("record_id"),
        rule=rules.RULE_TEXT["DEVICE_FORMATION"],
        method=F.col("identity_method"),
    )


def final_cohort(
    qualification_per_wafer: DataFrame,
    chip_per_wafer: DataFrame,
    sorting_per_wafer: DataFrame,
    formation_per_wafer: DataFrame,
) -> DataFrame:
    """Qualification cohort with every component present, and the component yields.

    Four inner joins on one key; every input is already aggregated by
    ``physical_wafer_id``.  Wafers whose chip or sorting total is zero are
    dropped before dividing.
    """
    attributes = list(identity.WAFER_ATTRIBUTES) if identity.carries_attributes(qualification_per_wafer) else []
    q = qualification_per_wafer.select(
        "physical_wafer_id", "qualified_at", F.col("passed").alias("q_passed"), *attributes
    )
    c = chip_per_wafer.select(
        "physical_wafer_id",
        F.col("total_chips").cast("double").alias("c_total"),
        F.col("good_chips").cast("double").alias("c_good"),
    )
    s = sorting_per_wafer.select(
        "physical_wafer_id",
        F.col("total_chips").cast("double").alias("s_total"),
        F.col("good_chips").cast("double").alias("s_good"),
    )
    f = formation_per_wafer.select("physical_wafer_id", F.col("passed").alias("f_passed"))
    joined = (
        q.join(c, "physical_wafer_id")
        .join(s, "physical_wafer_id")
        .join(f, "physical_wafer_id")
        .where((F.col("c_total") > 0) & (F.col("s_total") > 0))
    )
    total = F.col("c_total")
    components = joined.select(
        "physical_wafer_id",
        *attributes,
        F.col("qualified_at").alias("event_time"),
        total.alias("total_chips"),
        (F.col("c_good") / total).alias("chip_inspection"),
        F.when(F.coalesce(F.col("f_passed"), F.lit(False)), F.lit(1.0))
        .otherwise((total - rules.FORMATION_LOSS_CHIPS) / total)
        .alias("device_formation"),
        (F.col("s_good") / F.col("s_total")).alias("sorting"),
        flag_to_double(F.col("q_passed")).alias("qualification"),
    )
    product = (
        ((F.lit(1.0) * F.col("chip_inspection")) * F.col("device_formation")) * F.col("sorting")
    ) * F.col("qualification")
    return components.withColumn("final_good", round_half_even(F.col("total_chips") * product))


def final_chip_rows(cohort: DataFrame) -> DataFrame:
    """Q11: rounded good chips of the component product over the chip total."""
    return stage_rows(
        cohort,
        stage="FINAL_CHIP_YIELD",
        event_time="event_time",
        numerator=F.col("final_good"),
        denominator=F.col("total_chips"),
        failure_family=F.when(F.col("final_good") < F.col("total_chips"), F.lit(rules.FINAL_COMPONENT_LOSS)).otherwise(
            F.lit("")
        ),
        source_kind=rules.PREPARED,
        record=F.concat(F.lit("FINAL-"), F.col("physical_wafer_id")),
        rule=rules.RULE_TEXT["FINAL_CHIP_YIELD"],
        method=F.lit(rules.FINAL_COHORT_METHOD),
    )


def final_component_fact(cohort: DataFrame, master: DataFrame) -> DataFrame:
    """Per-wafer components of the final chip yield."""
    if identity.carries_attributes(cohort):
        joined = cohort
    else:
        joined = cohort.join(master.select("physical_wafer_id", "work_order", "product_family"), "physical_wafer_id")
    return schemas.conform(
        joined.withColumn("final_chip_yield", F.col("final_good") / F.col("total_chips")),
        schemas.FINAL_COMPONENT_FACT,
    )


# --- enrichment and projections --------------------------------------------------
def enrich(rows: DataFrame, master: DataFrame, rules_df: DataFrame) -> DataFrame:
    """Guard, then attach wafer attributes and display rules.

    The rules table has one row per configured stage (fixed, tiny), so it is
    broadcast.  When the rows already carry the wafer attributes (a staged
    resolution joined with the master) there is no master join; otherwise it
    is a wafer-keyed equi-join left to the planner.
    """
    guarded = guard(rows)
    if not identity.carries_attributes(guarded):
        guarded = guarded.join(master, "physical_wafer_id")
    joined = guarded.join(
        F.broadcast(rules_df.select("stage_code", "section", "stage_label", "display_order")), "stage_code"
    )
    return joined.select(
        FACT_KEY,
        "section",
        "stage_code",
        "stage_label",
        "display_order",
        "physical_wafer_id",
        "work_order",
        "lot_id",
        "wafer_number",
        "product_family",
        "wafer_size",
        "event_time",
        "numerator",
        "denominator",
        (F.col("numerator") / F.col("denominator")).alias("yield_rate"),
        F.coalesce(F.col("failure_family"), F.lit("")).alias("failure_family"),
        *LINEAGE_EXTRA,
    )


def yield_fact(enriched: DataFrame) -> DataFrame:
    return schemas.conform(enriched, schemas.YIELD_FACT)


def failure_fact(enriched: DataFrame) -> DataFrame:
    """One row per fact with a positive loss; empty family → 'Unclassified Loss'."""
    loss = clamp_zero(F.col("denominator") - F.col("numerator"))
    return schemas.conform(
        enriched.withColumn("failure_quantity", loss)
        .where(F.col("failure_quantity") > 0)
        .withColumn("failure_family", default_text(F.col("failure_family"), rules.UNCLASSIFIED_LOSS)),
        schemas.FAILURE_FACT,
    )


def lineage(enriched: DataFrame) -> DataFrame:
    return schemas.conform(enriched, schemas.LINEAGE)


def placed_lineage(enriched: DataFrame) -> DataFrame:
    """Lineage with the stage and time of its fact, by which it is stored and pruned."""
    return schemas.conform(enriched, schemas.PLACED_LINEAGE)


# --- assembly --------------------------------------------------------------------
class Deferred(Mapping):
    """Frames by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}
        self._locks = {name: threading.Lock() for name in makers}

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def together(self, names: Sequence[str], parallelism: int = 4) -> list[DataFrame]:
        """Several frames; where making one runs Spark jobs, they run side by side."""
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            return list(pool.map(self.__getitem__, names))


# Columns that the final cohort needs of each component's records; their order breaks ties.
COHORT_COLUMNS = {
    "qualification": ("qualification_wafer_ref", "record_id", "channel", "qualified_at", "passed", "revision", "physical_wafer_id"),
    "chips": ("chip_wafer_ref", "record_id", "tested_at", "total_chips", "good_chips", "revision", "physical_wafer_id"),
    "sorting": (
        "sorting_wafer_ref", "record_id", "channel", "process_completed_at", "record_generated_at", "total_chips", "good_chips", "physical_wafer_id",
    ),
    "process": ("mes_wafer_ref", "record_id", "stage_code", "completed_at", "tool_family", "passed", "physical_wafer_id"),
}


class FactPlan:
    """DataFrames of one transformation run.

    Each is made when it is first asked for, with the ones it needs and no
    others: with a ``keep`` that writes what several outputs reuse, a single
    stage writes its own sources' records only.
    """

    def __init__(
        self,
        annotated: Deferred,
        master: Callable[[], DataFrame],
        rules_df: DataFrame,
        configured: list[str],
        keep: Callable[[str, DataFrame], DataFrame],
    ) -> None:
        self.annotated, self._master, self._rules, self._configured, self._keep = annotated, master, rules_df, configured, keep
        self.parts = Deferred(
            {
                "WAFER_INSPECTION": lambda: wafer_inspection_rows(revisions.latest_inspection(self.resolved("wafer_inspection"))),
                "PROCESS": lambda: process_rows(self.resolved("process_results"), configured),
                "CHIP_INSPECTION": lambda: chip_inspection_rows(self.latest_chips),
                "AUTO_OUTLIER": lambda: auto_outlier_rows(self.latest_chips),
                "SORTING": lambda: sorting_rows(self.resolved("sorting_summary")),
                "QUALIFICATION": lambda: qualification_rows(self.latest_qualifications),
                "WAFER_TOTAL": lambda: wafer_total_rows(guard(self.parts["WAFER_INSPECTION"].unionByName(self.parts["PROCESS"]))),
                "DEVICE_FORMATION": lambda: device_formation_rows(
                    revisions.process_per_wafer_stage(self.resolved("process_results"), rules.FORMATION_STAGE), self.chip_per_wafer
                ),
                "FINAL_CHIP_YIELD": lambda: final_chip_rows(self.cohort),
            }
        )

    def resolved(self, source: str) -> DataFrame:
        return identity.resolved_only(self.annotated[source])

    @cached_property
    def master(self) -> DataFrame:
        return self._master()

    @cached_property
    def latest_chips(self) -> DataFrame:
        return self._keep("latest_chips", revisions.latest_chip_summary(self.resolved("chip_inspection_summary")))

    @cached_property
    def latest_qualifications(self) -> DataFrame:
        return self._keep("latest_qualifications", revisions.latest_qualification(self.resolved("qualification_results")))

    @cached_property
    def chip_per_wafer(self) -> DataFrame:
        return revisions.chip_per_wafer(self.latest_chips.select(*COHORT_COLUMNS["chips"]))

    @cached_property
    def cohort(self) -> DataFrame:
        names = ("qualification_results", "chip_inspection_summary", "sorting_summary", "process_results")
        quals, _, sorting, process = map(identity.resolved_only, self.annotated.together(names))
        attributes = identity.WAFER_ATTRIBUTES if identity.carries_attributes(quals) else ()
        return self._keep(
            "cohort",
            final_cohort(
                revisions.qualification_per_wafer(self.latest_qualifications.select(*COHORT_COLUMNS["qualification"], *attributes)),
                self.chip_per_wafer,
                revisions.sorting_per_wafer(sorting.select(*COHORT_COLUMNS["sorting"])),
                revisions.process_per_wafer_stage(process.select(*COHORT_COLUMNS["process"]), rules.FORMATION_STAGE),
            ),
        )

    @cached_property
    def components(self) -> DataFrame:
        return final_component_fact(self.cohort, self.master)

    @cached_property
    def stage_rows(self) -> DataFrame:
        self.annotated.together(list(self.annotated))
        return reduce(DataFrame.unionByName, self.parts.values())

    def _enrich(self) -> DataFrame:
        return enrich(self.stage_rows, self.master, self._rules)

    @cached_property
    def enriched(self) -> DataFrame:
        return self._keep("enriched", self._enrich())

    def keep_enriched(self, write: Callable[[DataFrame], DataFrame]) -> bool:
        """Have ``write`` keep the enriched facts in a place of its own, unless they are kept already; whether it did."""
        if "enriched" in vars(self):
            return False
        self.enriched = write(self._enrich())
        return True


def build(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    display_rows: list[rules.DisplayRow] | None = None,
    resolution: DataFrame | None = None,
    master: DataFrame | Callable[[], DataFrame] | None = None,
    materialize=None,
    hot_keys: identity.HotKeyPolicy | None = None,
    annotated: dict[str, Callable[[], DataFrame]] | None = None,
) -> FactPlan:
    """Plan the full fact build from source-shaped tables.

    ``resolution`` may be a materialized resolution table (see
    ``identity.resolve_keys``); without it each source resolves its own keys.
    ``hot_keys`` salts aliases that hold a large share of a source's records
    (needs a resolution table with ``key_rows``).
    ``materialize(name, frame) -> frame`` is called on the intermediates that
    several outputs reuse (annotated sources, latest revisions, per-wafer
    cohort, enriched facts) when they are first asked for; a refresh job passes
    a function that writes them to the shared checkpoint folder and reads them
    back, cutting the lineage there.  ``annotated`` makes the annotated sources
    by steps of its own, in place of a resolution table.
    """
    keep = materialize or (lambda _name, frame: frame)
    display_rows = display_rows if display_rows is not None else rules.load_display_rows()
    rules.check_rules(display_rows)
    aliases = sources["identity_aliases"]

    def annotate(name: str) -> DataFrame:
        kind, alias_column, record_column = identity.SOURCE_IDENTITY[name]
        if resolution is None:
            frame = identity.resolve_records(sources[name], aliases, kind, alias_column)
        else:
            frame = identity.annotate(
                sources[name], kind, alias_column, resolution, source=name, record_column=record_column, hot_keys=hot_keys
            )
        return keep(f"annotated_{name}", frame)

    makers = annotated or {name: partial(annotate, name) for name in identity.SOURCE_IDENTITY}
    make_master = master if callable(master) else lambda: master if master is not None else identity.wafer_master(aliases)
    return FactPlan(Deferred(makers), make_master, rules.rules_frame(spark, display_rows), [r.stage_code for r in display_rows], keep)
