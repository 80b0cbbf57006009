"""Source tables at a user's path, scans of them, and the one join of scoped detail."""

from __future__ import annotations

import pytest
from factory_support import alias_rows, plan_of, scan_of, ts
from test_facts_and_views import tiny_sources
from test_publish_and_stream import tiny_details

from yieldspark import rules, schemas
from yieldspark.operators import detail, facts, identity
from yieldspark.session import scratch_path
from yieldspark.sources import database, stored


def test_stored_sources_give_the_same_facts(spark):
    sources = tiny_sources(spark)
    root = scratch_path(spark, "sources")
    stored.write_sources(sources, root)
    read = stored.read_sources(spark, root, list(sources))
    assert all(frame.schema == sources[name].schema for name, frame in read.items())
    rows = lambda s: sorted(map(repr, facts.yield_fact(facts.build(spark, s).enriched).collect()))
    assert rows(read) == rows(sources)


def test_columns_are_checked_others_are_left_and_misfits_rejected(spark):
    root = scratch_path(spark, "odd-sources")
    lines = [
        ("x", "REF", "R1", "2026-01-05 08:00:00", "10", "9", "", "1"),
        ("x", "REF", "R2", "yesterday", "ten", "9", "", "1"),
        ("x", "REF", None, None, "10", "9", None, "2"),
    ]
    names = ["extra", "CHIP_WAFER_REF", "record_id", "tested_at", "total_chips", "good_chips", "dominant_failure", "revision"]
    frame = spark.createDataFrame(lines, ", ".join(f"{n} string" for n in names))
    name = "chip_inspection_summary"
    for fmt in ("csv", "json", "parquet"):
        frame.write.format(fmt).option("header", True).save(f"{root}/{fmt}")
        good = stored.read_source(spark, f"{root}/{fmt}", name, fmt)
        assert good.schema == schemas.CHIP_INSPECTION_SUMMARY
        assert [(r["record_id"], r["total_chips"], r["tested_at"]) for r in good.orderBy("revision").collect()] == [("R1", 10, ts("2026-01-05 08:00:00")), (None, 10, None)]
        bad = stored.rejected_rows(spark, f"{root}/{fmt}", name, fmt).collect()
        assert [r["reasons"] for r in bad] == [["tested_at is no timestamp", "total_chips is no int"]] and '"yesterday"' in bad[0]["row"]
    with pytest.raises(stored.MissingColumns, match="inspection_wafer_ref"):
        stored.read_source(spark, f"{root}/parquet", "wafer_inspection")
    fits = scratch_path(spark, "fitting")
    stored.write_source(spark.createDataFrame([], schemas.CHIP_INSPECTION_SUMMARY), fits, name)
    assert stored.rejected_rows(spark, fits, name).count() == 0 and stored.read_source(spark, fits, name).count() == 0


def test_a_time_range_reaches_the_files(spark):
    root = scratch_path(spark, "timed")
    stored.write_source(tiny_sources(spark)["process_results"], root, "process_results")
    rows = database.time_range_scan(stored.read_source(spark, root, "process_results"), "completed_at", "2026-01-05 08:00:00", "2026-01-06")
    pushed = scan_of(rows)["PushedFilters"]
    assert "GreaterThanOrEqual(completed_at" in pushed and "LessThan(completed_at" in pushed
    assert rows.count() == 12
    assert scan_of(rows.select("record_id"))["ReadSchema"].count(":") == 3  # the label's, record_id's and completed_at's


def test_a_work_order_scan_prunes_folders_at_run_time(spark):
    aliases = spark.createDataFrame(alias_rows(("SORTING", "SORT_W1", "W1"), ("SORTING", "SORT_W2", "W2"), ("SORTING", "SORT_W2", "W1")), schemas.IDENTITY_ALIASES)
    from pyspark.sql import functions as F

    aliases = aliases.withColumn("work_order", F.concat(F.lit("WO-"), "physical_wafer_id"))
    params = tiny_details(spark)["sorting_parameter_detail"]
    lost = params.limit(1).withColumn("sorting_wafer_ref", F.lit("NOBODY"))
    path = scratch_path(spark, "by-work-order")
    database.store_by_work_order(params.unionByName(lost), aliases, rules.SORTING, "sorting_wafer_ref", path)
    table = spark.read.parquet(path)
    assert table.count() == 2 + 2 * 2 + 1  # W2's reference belongs to two work orders
    keys = aliases.where("work_order = 'WO-W2'").select("work_order", F.col("source_alias").alias("sorting_wafer_ref"))
    found = database.work_order_scan(table, keys, "sorting_wafer_ref")
    assert [(r["work_order"], r["sorting_wafer_ref"]) for r in found.collect()] == [("WO-W2", "SORT_W2")] * 2
    # Keys of the same reference in another work order are not found.
    other = keys.withColumn("work_order", F.lit("WO-W9"))
    assert database.work_order_scan(table, other, "sorting_wafer_ref").count() == 0
    stored_keys = scratch_path(spark, "keys")
    aliases.write.parquet(stored_keys)
    selected = spark.read.parquet(stored_keys).where("work_order = 'WO-W2'").select("work_order", F.col("source_alias").alias("sorting_wafer_ref"))
    assert "dynamicpruning" in plan_of(database.work_order_scan(table, selected, "sorting_wafer_ref")).lower()


def test_scoped_detail_is_exchanged_once(spark):
    aliases = tiny_sources(spark)["identity_aliases"]
    params = tiny_details(spark)["sorting_parameter_detail"]
    path = scratch_path(spark, "params")
    params.write.parquet(path)
    staged = scratch_path(spark, "resolution")
    keys = identity.lookup_keys(params, rules.SORTING, "sorting_wafer_ref", "sorting_parameter_detail")
    identity.resolve_keys(aliases, keys).write.parquet(staged)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wafers = spark.createDataFrame([("W1",), ("W3",)], "physical_wafer_id string")
        table = detail.targeted_detail_table(spark.read.parquet(path), aliases, wafers, "sorting_parameter_detail", spark.read.parquet(staged))
        # The branch from the detail scan up to the join holds one exchange that is no broadcast.
        plan = table._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(plan) if "FileScan" in line and "parameter_record_id" in line)
        depth = plan[at].index("FileScan")
        above = []
        for line in reversed(plan[:at]):
            start = len(line) - len(line.lstrip(" :+-"))
            if start < depth:
                depth = start
                above.append(line)
        assert sum("Exchange hashpartitioning" in line for line in above) == 1, "\n".join(above)
        assert {r["physical_wafer_id"] for r in table.collect()} == {"W1"} and table.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scoped_detail_takes_exact_aliases_only(spark):
    aliases = spark.createDataFrame(alias_rows(("CHIP", "SUB W1", "W1"), ("CHIP", "SUB W2", "W2"), ("CHIP", "SUB W2", "W1")), schemas.IDENTITY_ALIASES)
    t0 = ts("2026-01-06 08:00:00")
    rows = [(f"C{i}", ref, 1, 0, 0, True, "", t0, 1) for i, ref in enumerate(["SUB W1", "sub w1", "SUB W2", None, "X"])]
    chips = spark.createDataFrame(rows, schemas.CHIP_DETAIL)
    wafers = spark.createDataFrame([("W1",)], "physical_wafer_id string")
    got = detail.targeted_detail_table(chips, aliases, wafers, "chip_detail").collect()
    assert [(r["chip_record_id"], r["physical_wafer_id"]) for r in got] == [("C0", "W1")]
    old = detail.transform_targeted(detail.extract_targeted(chips, aliases, wafers, "chip_detail"), aliases, "chip_detail").collect()
    assert [r["chip_record_id"] for r in old] == ["C0"]


def test_a_table_is_stored_by_work_order_without_a_sample(spark, monkeypatch):
    from yieldspark.sources.database import BUCKET_SHARES

    refs = [f"SORT_{n}" for n in range(60)]
    aliases = spark.createDataFrame(alias_rows(*[("SORTING", r, f"W{n}") for n, r in enumerate(refs)]), schemas.IDENTITY_ALIASES)
    t0 = ts("2026-01-06 08:00:00")
    params = spark.createDataFrame([(f"P{n}", r, 1, "QTY", 1.0, 0.0, 2.0, True, t0) for n, r in enumerate(refs * 2)], schemas.SORTING_PARAMETER_DETAIL)

    def dealt(*_):
        raise AssertionError("ranges join the rows once more to sample them")

    monkeypatch.setattr(type(params), "repartitionByRange", dealt)
    path = scratch_path(spark, "by-work-order")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        database.store_by_work_order(params, aliases, rules.SORTING, "sorting_wafer_ref", path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    from pyspark.sql import functions as F

    table = spark.read.parquet(path)
    assert sorted(r[0] for r in table.select("parameter_record_id").collect()) == sorted(f"P{n}" for n in range(120))
    # One work order: one folder, in more than one file and no more than it has shares, each sorted.
    files = table.groupBy("work_order_bucket", F.input_file_name().alias("file")).agg(F.collect_list("sorting_wafer_ref").alias("refs")).collect()
    assert len({f["work_order_bucket"] for f in files}) == 1 and 1 < len(files) <= BUCKET_SHARES
    assert all(f["refs"] == sorted(f["refs"]) for f in files)
