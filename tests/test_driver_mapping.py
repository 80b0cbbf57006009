"""Acceptance counts of the driver-table mapping at sf0.001 (FIXTURES.md §4)."""

from __future__ import annotations

import re

import pytest
from factory_support import SF0001
from pyspark.sql import functions as F

import __spark_entry__ as E
from yieldspark.operators import facts, identity
from yieldspark.sources import driver_tables as dt


@pytest.fixture(scope="module")
def plan(spark):
    return facts.build(spark, dt.source_tables(spark, SF0001))


def test_alias_rows(spark):
    aliases = dt.identity_aliases(spark, SF0001)
    assert aliases.count() == 7516
    assert aliases.select("physical_wafer_id").distinct().count() == 1500


def test_identity_audit_counts(plan):
    audit = identity.identity_audit(plan.annotated)
    counts = {
        (r["source_kind"], r["identity_status"], r["identity_method"]): r["records"]
        for r in identity.status_counts(audit).collect()
    }
    assert audit.count() == 11571
    assert counts[("INSPECTION", "RESOLVED", "exact alias")] == 1360
    assert counts[("INSPECTION", "RESOLVED", "normalized alias")] == 155
    assert counts[("INSPECTION", "AMBIGUOUS", "exact alias")] == 15
    assert counts[("INSPECTION", "AMBIGUOUS", "normalized alias")] == 1
    assert counts[("INSPECTION", "UNRESOLVED", "no alias match")] == 15
    assert counts[("CHIP", "RESOLVED", "normalized alias")] == 80
    assert counts[("SORTING", "RESOLVED", "normalized alias")] == 74


def test_stage_fact_counts(plan):
    fact_df = facts.yield_fact(plan.enriched)
    by_stage = {
        r["stage_code"]: (r["n"], r["failed"], r["num"], r["den"])
        for r in fact_df.groupBy("stage_code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("yield_rate") < 1).alias("failed"),
            F.sum("numerator").alias("num"),
            F.sum("denominator").alias("den"),
        )
        .collect()
    }
    assert by_stage["WAFER_INSPECTION"][0] == 1478
    assert by_stage["SURFACE_PREPARATION"][:2] == (1510, 56)
    assert by_stage["PATTERN_SEPARATION"][:2] == (1500, 46)
    assert by_stage["PROTECTIVE_FINISH"][:2] == (1500, 38)
    assert by_stage["CHIP_INSPECTION"][0] == by_stage["AUTO_OUTLIER"][0] == 1479
    assert by_stage["SORTING"][0] == 1473
    assert by_stage["QUALIFICATION"][0] == 1012
    assert by_stage["WAFER_TOTAL"][:2] == (1471, 1130)
    assert by_stage["DEVICE_FORMATION"][:2] == (1473, 37)
    assert by_stage["FINAL_CHIP_YIELD"][0] == 991
    assert by_stage["FINAL_CHIP_YIELD"][2:] == (63494.0, 102828.0)
    assert fact_df.count() == 15366


def test_detail_counts(spark):
    chips = dt.chip_detail(spark, SF0001)
    assert chips.count() == 6000 and chips.where("passed").count() == 4032
    params = {r["parameter"]: r["n"] for r in dt.sorting_parameter_detail(spark, SF0001)
              .where("passed").groupBy("parameter").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert params == {"DISC": 5696, "QTY": 5410, "TAX": 5638}


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.columns == ["stage_code", "stage_label", "period", "numerator", "denominator", "yield_rate"]
    assert out.count() > 0


def test_every_query_has_an_oracle_or_is_rows_only():
    factory = {q for q in E.queries() if not re.match(r"op\d+_|pipeline$", q)}  # the others have tests of their own
    assert factory <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())
