from __future__ import annotations

import json
import random

import pytest
from factory_support import ts
from pyspark.sql import functions as F

from yieldspark import rules, schemas
from yieldspark.operators import ordered, sketches
from yieldspark.settings import PREFIX, Settings, matrix, settings


def test_arguments_override_the_session_and_that_the_defaults(spark, tmp_path):
    assert settings(spark) == Settings()
    spark.conf.set(f"{PREFIX}period_mode", "Quarter")
    spark.conf.set(f"{PREFIX}top_n", "3")
    try:
        assert settings(spark, top_n=5) == Settings(period_mode="Quarter", top_n=5)
        spark.conf.set(f"{PREFIX}colour", "red")
        with pytest.raises(ValueError, match="colour"):
            settings(spark)
    finally:
        for name in ("period_mode", "top_n", "colour"):
            spark.conf.unset(f"{PREFIX}{name}")
    for bad in ({"period_mode": "Fortnight"}, {"max_periods": 0}, {"weeks": 1}):
        with pytest.raises(ValueError):
            settings(spark, **bad)


def test_a_rules_file_replaces_the_built_in_rows(spark, tmp_path):
    path = tmp_path / "rules.json"
    rows = [{"section": s, "stage_code": c, "label": f"My {n}", "order": o} for s, c, n, o in rules.DEFAULT_DISPLAY_ROWS]
    path.write_text(json.dumps({"display_rows": rows}))
    read = settings(spark, rules_file=str(path)).display_rows()
    assert [r.label for r in read] == [r["label"] for r in rows]
    rules.check_rules(read)
    with pytest.raises(KeyError):
        rules.check_rules(read[:2])
    assert settings(spark).display_rows() == rules.load_display_rows()


def facts_of(spark, rows):
    return spark.createDataFrame(
        [(f"Y{i}", "S", stage, "L", 90, wafer, "WO", "L", 1, family, "F", ts(at), 1.0, 2.0, 0.5, "") for i, (stage, wafer, family, at) in enumerate(rows)],
        schemas.YIELD_FACT,
    )


def test_the_matrix_follows_the_settings(spark):
    rows = facts_of(spark, [("SORTING", "W", "A", "2026-01-05 00:00:00"), ("SORTING", "W", "B", "2026-05-05 00:00:00"), ("SORTING", "W", "A", "2026-08-05 00:00:00")])
    got = matrix(rows, settings(spark, period_mode="Quarter", max_periods=1, product_family="A")).collect()
    assert [(r["period"], r["denominator"]) for r in got] == [("2026Q3", 2.0)]


def test_positions_follow_the_order_over_all_partitions(spark):
    random.seed(1)
    values = [(random.choice([None, *range(50)]), i) for i in range(3000)]
    frame = spark.createDataFrame(values, "v int, i int").repartition(7)
    got = ordered.with_position(frame, [F.desc_nulls_last("v"), F.asc("i")]).collect()
    want = sorted(values, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(r["v"], r["i"]) for r in sorted(got, key=lambda r: r["position"])] == want
    assert [r["position"] for r in sorted(got, key=lambda r: r["position"])] == list(range(1, 3001))
    assert ordered.with_position(frame.limit(0), [F.asc("i")]).collect() == []


def test_merged_sketches_keep_their_bound(spark):
    base = spark.range(60_000).select(
        F.concat(F.lit("W"), (F.col("id") % 20_000).cast("string")).alias("physical_wafer_id"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("stage_code"),
        (F.timestamp_seconds(F.lit(1_767_571_200) + F.col("id") * 600)).alias("event_time"),
    )
    weekly = sketches.wafer_sketches(base, "Week")
    for by in ([], ["stage_code"], ["stage_code", "period_start"]):
        near = sketches.approximate_wafers(weekly, by)
        if by == ["stage_code"]:
            exact = base.groupBy("stage_code").agg(F.count_distinct("physical_wafer_id").alias("n"))
            rows = near.join(exact, "stage_code").select(sketches.within_bound(F.col("approximate_wafers"), F.col("n")).alias("ok")).collect()
            assert len(rows) == 2 and all(r["ok"] for r in rows)
        if not by:
            assert abs(near.first()[0] - 20_000) <= sketches.RELATIVE_BOUND * 20_000
