"""Writing, checking and reading the prepared datasets.

:func:`publish` writes every dataset below a folder that the caller names (any
Hadoop-compatible URI), checks the written files, and only then writes the
``summary`` table with the row counts and statistics.  A folder with a summary
is a complete publication; a failure before leaves it without one.  Folders
are never overwritten, so a caller publishes each time into a new one.

Facts, failures and lineage are partitioned by stage and year and sorted by
event time within files, so a cell or a date range reads only its partitions,
and of these the row groups and pages of its time.  Detail rows and the wafer
summary are sorted by wafer within files.  Rows are written where they lie: no
dataset is exchanged once more for its order.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldspark import rules, schemas
from yieldspark.session import shuffles_dropped, small_reads

YEAR = "event_year"
#: Columns that differ in (nearly) every row: Parquet would build a dictionary of each first and throw it away.
ROW_IDS = ("yield_record_id", "source_record_id", "record_id", *schemas.TARGETED_RECORD_COLUMNS.values())
#: How tables are written; rows of these tables take no less space at zstd's higher levels.
STORED_AS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"} | {f"parquet.enable.dictionary#{c}": "false" for c in ROW_IDS}
SUMMARY = "summary"


@dataclass(frozen=True)
class Layout:
    """How a dataset lies on storage: partition folders, then the order of rows within files."""

    partition_by: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


_BY_CELL = Layout(("stage_code", YEAR), ("event_time",))
LAYOUTS = {
    "yield_fact": _BY_CELL,
    "failure_fact": _BY_CELL,
    "lineage": _BY_CELL,
    "identity_audit": Layout(order=("source_kind", "source_record_id")),
    "wafer_summary": Layout(order=("physical_wafer_id",)),
} | {name: Layout(order=("physical_wafer_id",)) for name in schemas.TARGETED_DATASETS}


#: Facts with their lineage as one table, in the order of its columns.
FACTS = T.StructType([*schemas.YIELD_FACT.fields, *[f for f in schemas.LINEAGE.fields if f.name != "yield_record_id"], T.StructField(YEAR, T.IntegerType())])


class CheckFailed(ValueError):
    """A written dataset is not what it must be."""


def audit_counts() -> dict[str, dict]:
    """Counts taken while a dataset is written, besides its rows."""
    status = F.col("identity_status")
    return {
        "identity_audit": {
            "ambiguous_records": F.count_if(status == rules.AMBIGUOUS),
            "unresolved_records": F.count_if(status == rules.UNRESOLVED),
        }
    }


def year_of(time: str = "event_time") -> Column:
    return F.year(time)


def laid_out(frame: DataFrame, layout: Layout) -> DataFrame:
    """The rows of each task in the layout's order."""
    if YEAR in layout.partition_by:
        frame = frame.withColumn(YEAR, year_of())
    keys = [*layout.partition_by, *layout.order]
    return frame.sortWithinPartitions(*keys) if keys else frame


def write_dataset(frame: DataFrame, path: str, layout: Layout = Layout(), extra: dict | None = None) -> dict[str, int]:
    """Write one dataset; the rows, and what ``extra`` counts, come from the same pass."""
    seen = Observation()
    out = laid_out(frame, layout).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (extra or {}).items()])
    writer = out.write.mode("errorifexists").options(**STORED_AS)
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    writer.parquet(path)
    return {name: int(value) for name, value in seen.get.items()}


def publish(spark: SparkSession, datasets: dict[str, DataFrame], root: str, parallelism: int = 4,
            written: dict[str, dict[str, int]] | None = None) -> dict[str, int]:
    """B2: write all datasets below ``root``, check them, and write the summary; returns the rows of each.

    ``written`` has the counts of the datasets that :func:`write_dataset` has written there already.
    """
    counted = dict(written or {})
    datasets = {name: frame for name, frame in datasets.items() if name not in counted}
    absent = sorted(set(schemas.REQUIRED_DATASETS) - set(datasets) - set(counted))
    if absent:
        raise ValueError(f"datasets to publish are missing: {absent}")
    extra = audit_counts()
    with small_reads(spark), shuffles_dropped(spark), ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        jobs = {
            name: pool.submit(write_dataset, frame, f"{root}/{name}", LAYOUTS.get(name, Layout()), extra.get(name))
            for name, frame in datasets.items()
        }
        counted |= {name: job.result() for name, job in jobs.items()}
    rows = {name: c["rows"] for name, c in counted.items()}
    with shuffles_dropped(spark):
        check(spark, root, rows)
    statistics = {
        "physical_wafers": rows["wafer_summary"],
        "yield_rows": rows["yield_fact"],
        "final_cohort_wafers": rows["final_component_fact"],
        **{name: value for c in counted.values() for name, value in c.items() if name != "rows"},
    }
    at = datetime.now(timezone.utc).replace(tzinfo=None)
    lines = [("rows", name, n, at) for name, n in rows.items()] + [("statistic", name, n, at) for name, n in statistics.items()]
    summary = spark.createDataFrame(lines, "entry string, name string, value long, published_at timestamp_ntz")
    summary.coalesce(1).write.mode("errorifexists").parquet(f"{root}/{SUMMARY}")
    return rows


def summary(spark: SparkSession, root: str) -> DataFrame:
    """``(entry, name, value, published_at)``, the rows of every dataset and the statistics; missing where a publication failed."""
    return spark.read.parquet(f"{root}/{SUMMARY}")


def counts(spark: SparkSession, root: str) -> dict[str, int]:
    """Rows of each dataset as the summary states them (one row per dataset)."""
    return {r["name"]: r["value"] for r in summary(spark, root).where("entry = 'rows'").collect()}


def check(spark: SparkSession, root: str, rows: dict[str, int]) -> None:
    """Declared columns, row counts, facts with an id and a positive denominator, and ids that match lineage one to one."""
    for name in schemas.REQUIRED_DATASETS:
        if not rows[name] and LAYOUTS.get(name, Layout()).partition_by:
            continue  # partition folders without rows are no files
        stored = set(spark.read.parquet(f"{root}/{name}").columns)
        lacking = [c for c in schemas.DECLARED_COLUMNS[name] if c not in stored]
        if lacking:
            raise CheckFailed(f"{name}: no columns {lacking}")
    if not rows["yield_fact"]:
        raise CheckFailed("yield_fact: no rows")
    # Row counts of Parquet come from the footers.
    tallies = [read(spark, root, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name in schemas.REQUIRED_DATASETS]
    found = {r["name"]: r["n"] for r in reduce(DataFrame.unionByName, tallies).collect()}
    wrong = {name: (rows[name], n) for name, n in found.items() if n != rows[name]}
    if wrong:
        raise CheckFailed(f"rows counted while writing, and found: {wrong}")
    facts = read(spark, root, "yield_fact")
    odd = facts.where(F.col("yield_record_id").isNull() | ~F.coalesce(F.col("denominator") > 0, F.lit(False)))
    if not odd.isEmpty():
        raise CheckFailed("yield_fact: a row without an id or a positive denominator")
    # One shuffle proves fact ids unique, lineage ids unique and the 1:1 match.
    sides = facts.select("yield_record_id", F.lit(1).alias("fact")).unionByName(
        read(spark, root, "lineage").select("yield_record_id", F.lit(1 << 32).alias("fact"))
    )
    unmatched = sides.groupBy("yield_record_id").agg(F.sum("fact").alias("seen")).where(F.col("seen") != (1 << 32) + 1)
    if not unmatched.isEmpty():
        raise CheckFailed("yield_fact and lineage: an id that is not once in both")


def stored_schema(name: str) -> T.StructType | None:
    """The declared columns and those of the layout, where folder names would else be given a type by their look."""
    declared = {"yield_fact": schemas.YIELD_FACT, "failure_fact": schemas.FAILURE_FACT, "lineage": schemas.PLACED_LINEAGE}.get(name)
    return T.StructType([*declared.fields, T.StructField(YEAR, T.IntegerType())]) if declared else None


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One dataset; facts, failures and lineage also have the year of their folders."""
    schema = stored_schema(name)
    reader = spark.read.schema(schema) if schema else spark.read
    frame = reader.parquet(f"{root}/{name}")
    return frame.select(*schema.fieldNames()) if schema else frame


def read_facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts that were written with their lineage, as they were before they were laid out."""
    return spark.read.schema(FACTS).parquet(f"{root}/yield_fact").select(*[c for c in FACTS.fieldNames() if c != YEAR])


def load(spark: SparkSession, root: str, names: Iterable[str] = schemas.COMMON_DATASETS) -> dict[str, DataFrame]:
    """Lazy frames of a complete publication, the detail tables only by name."""
    summary(spark, root)
    return {name: read(spark, root, name) for name in names}


def read_wafers(spark: SparkSession, root: str, name: str, wafer_ids: DataFrame | Iterable[str]) -> DataFrame:
    """The detail rows of some wafers.

    ``wafer_ids`` is a short list (an IN filter that reaches Parquet) or a
    DataFrame with ``physical_wafer_id`` (a left-semi join).  An empty list
    gives an empty, typed frame.
    """
    if name not in schemas.TARGETED_DATASETS:
        raise ValueError(f"{name} is not read by wafer; one of {schemas.TARGETED_DATASETS} is")
    frame = read(spark, root, name)
    if isinstance(wafer_ids, DataFrame):
        return frame.join(wafer_ids.select("physical_wafer_id").distinct(), "physical_wafer_id", "left_semi")
    return frame.where(F.col("physical_wafer_id").isin(sorted(set(wafer_ids))))
