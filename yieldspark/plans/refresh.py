"""The refresh job (B1): source tables → one checked publication.

Execution plan:

1. **Resolve once.**  The alias table and the wafer master are staged; each
   source joins the claims of its kind's aliases, and the detail tables'
   distinct raw aliases are resolved into a table each.
2. **Build facts** with lineage cuts at the reused intermediates: annotated
   sources (audit + facts), latest chip and qualification revisions, the
   final-yield cohort (facts + components) and the enriched facts (yield_fact,
   failure_fact, lineage, summary, trend).  Each is staged when an output first
   needs it; a publication that needs the facts first writes them in their published place.  Each cut is a Parquet table in a fresh folder under ``spark.checkpoint.dir``
   (shared storage on a cluster), so a lost executor recomputes at most one
   step and no step re-runs the whole lineage.
3. **Publish** every dataset below a new folder; it is complete only with the
   summary that follows the checks.  A failure anywhere touches no other folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from yieldspark import rules, schemas
from yieldspark.operators import detail, facts, identity, prepared
from yieldspark.plans import publish
from yieldspark.session import scratch_path, shuffles_dropped, small_reads


class Stager:
    """Write intermediates to a staging folder and read them back (lineage cut)."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = root or scratch_path(spark, "refresh-staging")

    def __call__(self, name: str, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffles_dropped(self.spark):
            frame.write.mode("overwrite").options(**publish.STORED_AS).parquet(path)
        return self.spark.read.parquet(path)


@dataclass
class StagedBuild:
    """Fact plan over staged intermediates, with the tables it was built from; each is staged when first asked for."""

    plan: facts.FactPlan
    aliases: DataFrame
    #: Resolution of the detail tables' raw aliases, by table.
    resolution: facts.Deferred
    detail_sources: dict[str, DataFrame]

    @property
    def master(self) -> DataFrame:
        return self.plan.master


def stage_fact_build(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    detail_sources: dict[str, DataFrame],
    display_rows: list[rules.DisplayRow] | None = None,
    stager: Stager | None = None,
    hot_keys: identity.HotKeyPolicy | None = identity.HotKeyPolicy(),
) -> StagedBuild:
    """Resolve each source once and build the facts with lineage cuts at every reused step.

    Steps run when an output that needs them is first asked for.  ``hot_keys``
    salts aliases holding a large share of a source's records in the joins with
    the alias claims and the detail resolution.
    """
    stage = stager or Stager(spark)
    # The alias table feeds the claims of every kind, the master and both
    # detail scopes, so it is staged once.
    aliases = stage("source_identity_aliases", sources["identity_aliases"])

    def attributed() -> DataFrame:
        mixed = stage("mixed_master", wafers["checked"].where("mixed"))
        return identity.with_master_attributes(aliases, mixed)

    def resolve(name: str) -> DataFrame:
        keys = identity.all_lookup_keys(detail_sources, [name])
        return stage(f"resolution_{name}", identity.resolve_keys(aliases, keys))

    wafers = facts.Deferred(
        {
            "checked": lambda: identity.checked_master(aliases, stage),
            "master": lambda: stage("master", wafers["checked"].drop("mixed")),
            "aliases": attributed,
        }
    )
    plan = facts.build(
        spark,
        dict(sources, identity_aliases=aliases),
        display_rows,
        master=lambda: wafers["master"],
        materialize=stage,
        annotated={
            name: lambda n=name: identity.annotate_in_steps(sources[n], wafers["aliases"], n, stage, hot_keys)
            for name in identity.SOURCE_IDENTITY
        },
    )
    return StagedBuild(plan, aliases, facts.Deferred({name: partial(resolve, name) for name in detail_sources}), detail_sources)


def datasets_of(build: StagedBuild, display_rows: list[rules.DisplayRow] | None = None,
                hot_keys: identity.HotKeyPolicy | None = identity.HotKeyPolicy()) -> dict[str, DataFrame]:
    """The eleven published datasets (lazy over the staged build)."""
    plan, master = build.plan, build.master
    build.resolution.together(list(build.detail_sources))
    enriched = plan.enriched
    yield_fact = facts.yield_fact(enriched)
    failure_fact = facts.failure_fact(enriched)
    audit = identity.identity_audit(plan.annotated)
    return {
        "yield_fact": yield_fact,
        "failure_fact": failure_fact,
        "lineage": facts.placed_lineage(enriched),
        "identity_audit": audit,
        "wafer_summary": prepared.wafer_summary(master, yield_fact, prepared.summary_stage_codes(display_rows)),
        "final_component_fact": plan.components,
        "filter_domains": prepared.filter_domains(master),
        "prebuilt_trend": prepared.prebuilt_trend(yield_fact),
        "prebuilt_pareto": prepared.prebuilt_pareto(failure_fact),
        **{name: _targeted(build, name, hot_keys) for name in schemas.TARGETED_DATASETS},
    }


def _targeted(build: StagedBuild, name: str, hot_keys: identity.HotKeyPolicy | None) -> DataFrame:
    """A detail dataset, of the wafers that the master holds."""
    source = name.removeprefix("targeted_")
    resolution, wafers = build.resolution[source], build.master.select("physical_wafer_id")
    policy = identity.policy_for(resolution, source, hot_keys)
    return detail.targeted_detail_table(build.detail_sources[source], build.aliases, wafers, source, resolution, policy)


def publish_build(
    spark: SparkSession,
    build: StagedBuild,
    root: str,
    display_rows: list[rules.DisplayRow] | None = None,
    hot_keys: identity.HotKeyPolicy | None = identity.HotKeyPolicy(),
) -> dict[str, int]:
    """Publish the datasets of a build below ``root``; returns the rows of each.

    Facts that nothing has staged yet are written once, with their lineage, as
    the published ``yield_fact``; what derives from them reads them there.  The
    detail tables need no facts, so their steps run beside those of the facts.
    """
    written: dict[str, dict[str, int]] = {}

    def put(name: str, frame: DataFrame) -> None:
        written[name] = publish.write_dataset(frame, f"{root}/{name}", publish.LAYOUTS[name])

    def put_facts(frame: DataFrame) -> DataFrame:
        put("yield_fact", frame)
        return publish.read_facts(spark, root)

    with small_reads(spark), shuffles_dropped(spark), ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(build.plan.keep_enriched, put_facts)]
        jobs += [pool.submit(lambda n=name: put(n, _targeted(build, n, hot_keys))) for name in schemas.TARGETED_DATASETS]
        for job in jobs:
            job.result()
    return publish.publish(spark, datasets_of(build, display_rows, hot_keys), root, written=written)


def build_datasets(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    detail_sources: dict[str, DataFrame],
    display_rows: list[rules.DisplayRow] | None = None,
    stager: Stager | None = None,
    hot_keys: identity.HotKeyPolicy | None = identity.HotKeyPolicy(),
) -> dict[str, DataFrame]:
    """All eleven published datasets (lazy over staged intermediates)."""
    build = stage_fact_build(spark, sources, detail_sources, display_rows, stager, hot_keys)
    return datasets_of(build, display_rows, hot_keys)


def refresh(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    detail_sources: dict[str, DataFrame],
    root: str,
    display_rows: list[rules.DisplayRow] | None = None,
) -> dict[str, int]:
    """B1: extract → transform → detail → publish below ``root``; returns the rows of each dataset."""
    # wafer_inventory is part of the common extract but no stage reads it.
    needed = [n for n in schemas.COMMON_SOURCES if n != "wafer_inventory"]
    missing = [n for n in needed if n not in sources]
    if missing:
        raise ValueError(f"Missing source tables: {missing}")
    return publish_build(spark, stage_fact_build(spark, sources, detail_sources, display_rows), root, display_rows)


def parameter_summary_table(spark: SparkSession, root: str) -> DataFrame:
    """V14 on a publication: parameter yield from the targeted sorting detail."""
    rows = publish.read(spark, root, "targeted_sorting_parameter_detail")
    return detail.parameter_yield_summary(rows).orderBy("yield_rate", "parameter")


def wafer_detail(spark: SparkSession, root: str, stage_code: str, wafer_id: str) -> tuple[DataFrame, str]:
    """The published detail rows behind a stage's fact of one wafer, with the text that names them."""
    rows = {name: publish.read_wafers(spark, root, name, [wafer_id]) for name in schemas.TARGETED_DATASETS}
    return detail.detail_view(stage_code, rows["targeted_chip_detail"], rows["targeted_sorting_parameter_detail"])


def export_csv(frame: DataFrame, path: str) -> str:
    """Write a population as CSV with a header.

    The export is written by the executors in parallel (one file per
    partition); nothing is gathered on the driver.  Nulls are written as
    ``\\N`` so that they stay distinct from empty text.
    """
    frame.write.mode("overwrite").option("header", True).option("nullValue", NULL_MARKER).csv(path)
    return path


NULL_MARKER = "\\N"


def read_csv_export(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", NULL_MARKER).csv(path)


def titled_columns(frame: DataFrame) -> list[str]:
    """display titles of the columns (``source_kind`` → ``Source Kind``)."""
    return [c.replace("_", " ").title() for c in frame.columns]


__all__ = ["refresh", "build_datasets", "stage_fact_build", "datasets_of", "publish_build", "Stager", "wafer_detail", "export_csv"]
