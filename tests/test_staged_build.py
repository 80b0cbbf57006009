"""The staged build: each step when an output needs it, records and alias rows exchanged once, no exchange for a layout."""

from __future__ import annotations

import gc
import time
from concurrent.futures import ThreadPoolExecutor

from factory_support import alias_rows, plan_of, ts
from pyspark.sql import functions as F
from test_facts_and_views import tiny_sources
from test_publish_and_stream import tiny_details

from yieldspark import schemas
from yieldspark.operators import facts, identity, prepared, revisions
from yieldspark.plans import publish
from yieldspark.plans import refresh as R
from yieldspark.session import SHUFFLE_CLEANUP, scratch_path, shuffles_dropped


class Recorder(R.Stager):
    def __init__(self, spark):
        super().__init__(spark)
        self.names = []

    def __call__(self, name, frame):
        self.names.append(name)
        return super().__call__(name, frame)


def rows(frame, columns=None):
    return sorted(map(repr, frame.select(*(columns or sorted(frame.columns))).collect()))


def test_a_stage_writes_the_records_of_its_own_sources_only(spark):
    stager = Recorder(spark)
    build = R.stage_fact_build(spark, tiny_sources(spark), tiny_details(spark), stager=stager)
    assert build.plan.parts["SORTING"].count() == 3
    assert "exact_sorting_summary" in stager.names
    assert not [n for n in stager.names if "inspection" in n or "process" in n or "qualification" in n or "resolution" in n or n == "enriched"]
    whole = facts.build(spark, tiny_sources(spark))
    assert rows(build.plan.enriched) == rows(whole.enriched) and rows(build.plan.components) == rows(whole.components)
    assert not [n for n in stager.names if n.startswith("resolution")]
    assert len(stager.names) == len(set(stager.names))  # nothing twice


def test_annotation_in_steps_is_that_of_a_resolution_table(spark):
    aliases = alias_rows(
        ("INSPECTION", "INSP-1", "W1"), ("INSPECTION", "INSP-2", "W2"), ("INSPECTION", "INSP-2", "W1"), ("INSPECTION", "insp_3", "W3"),
        ("INSPECTION", "INSP 4", "W4"), ("INSPECTION", "INSP_4", "W5"), ("INSPECTION", " INSP-6", "W1"), ("CHIP", "C-1", "W1"), ("MES", "INSP-9", "W9"),
    )
    aliases += [("INSPECTION", "INSP-7", None, "W7", "WO-7", "LOT-7", 7, None, "S7"), ("INSPECTION", "INSP-8", "INSP-8", None, "WO-8", "L", 1, "F", "S")]
    # W1's alias rows differ: the master takes those of its first one.
    aliases += [("CHIP", "A-0", "A-0", "W1", "WO-MASTER", "LOT-M", 4, None, "SIZE-M"), (None, "INSP-1", "INSP-1", "W8", "WO-0", "L", 1, "F", "S")]
    aliases = spark.createDataFrame(aliases, schemas.IDENTITY_ALIASES)
    refs = ["INSP-1"] * 20 + [" insp_1 ", "INSP-2", "INSP-3", "insp_3", "INSP-4", "INSP 4", "INSP-6", " INSP-6", "INSP-7", "insp-7", "INSP-8", "INSP-9", "", None, "NOBODY"]
    t0 = ts("2026-01-05 07:00:00")
    records = spark.createDataFrame([(r, f"R{n}", t0, 25, 24, "", 1) for n, r in enumerate(refs)], schemas.WAFER_INSPECTION)
    resolution = identity.with_wafer_attributes(
        identity.resolve_keys(aliases, identity.lookup_keys(records, "INSPECTION", "inspection_wafer_ref")), identity.wafer_master(aliases)
    )
    want = identity.annotate(records, "INSPECTION", "inspection_wafer_ref", resolution)
    master = identity.checked_master(aliases)
    assert [r[0] for r in master.where("mixed").select("physical_wafer_id").collect()] == ["W1"]
    mastered = identity.with_master_attributes(aliases, master.where("mixed"))
    for hot in (None, identity.HotKeyPolicy(fraction=0.1, buckets=8)):
        got = identity.annotate_in_steps(records, mastered, "wafer_inspection", R.Stager(spark), hot)
        assert got.columns == want.columns and rows(got) == rows(want)


def test_the_latest_row_is_shipped_without_its_order_twice(spark):
    frame = spark.createDataFrame([("a", 1, "r1", 5), ("a", 2, "r0", 6), ("b", 1, "r1", 7)], "k string, revision int, record_id string, v int")
    latest = revisions.latest_per_key(frame, ["k"], ["revision", "record_id"])
    assert latest.columns == frame.columns and sorted(map(tuple, latest.collect())) == [("a", 2, "r0", 6), ("b", 1, "r1", 7)]
    assert "_o0" not in plan_of(latest)


def test_a_layout_needs_no_exchange(spark):
    frame = spark.createDataFrame([(f"W{n % 3}", f"C{n}", "SORTING", ts("2026-01-05 07:00:00")) for n in range(9)], "physical_wafer_id string, yield_record_id string, stage_code string, event_time timestamp")
    for layout in (publish.LAYOUTS["yield_fact"], publish.LAYOUTS["wafer_summary"]):
        out = publish.laid_out(frame, layout)
        assert "Exchange" not in plan_of(out) and "Sort" in plan_of(out)
        sort = [*layout.partition_by, *layout.order]
        for part in out.withColumn("_p", F.spark_partition_id()).groupBy("_p").agg(F.collect_list(F.struct(*sort)).alias("rows")).collect():
            assert part["rows"] == sorted(part["rows"])


def test_stored_sources_are_built_in_steps(spark, monkeypatch):
    import __spark_entry__ as entry
    from yieldspark.session import scratch_path
    from yieldspark.sources import stored

    sources = tiny_sources(spark)
    root = scratch_path(spark, "stored-steps")
    stored.write_sources(sources | {"wafer_inventory": spark.createDataFrame([], schemas.WAFER_INVENTORY)}, root)
    monkeypatch.setattr(entry, "stored_sources", lambda *_: root)
    found = entry.q_stored_sources_yield_fact(spark, "unused")
    assert "Join" not in plan_of(found)  # the plan that the driver holds is a read of the staged facts
    assert rows(found) == rows(facts.yield_fact(facts.build(spark, sources).enriched))


def test_stored_facts_are_replaced_without_an_exchange(spark, monkeypatch):
    from yieldspark.plans import delta
    from yieldspark.session import scratch_path

    frame = spark.createDataFrame([(n, ts(f"2026-01-0{n} 07:00:00"), "SORTING", 2026) for n in (3, 1, 2)], f"yield_record_id int, event_time timestamp, stage_code string, {publish.YEAR} int")
    path = scratch_path(spark, "replaced")

    def dealt(*_):
        raise AssertionError("exchanged")

    monkeypatch.setattr(type(frame), "repartitionByRange", dealt)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    delta._replace_partitions(frame.coalesce(1), path, ["stage_code", publish.YEAR], ["event_time", "yield_record_id"])
    assert [r["yield_record_id"] for r in spark.read.parquet(path).collect()] == [1, 2, 3]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == size


def test_records_without_a_hot_alias_are_joined_without_a_salt(spark, monkeypatch):
    aliases = spark.createDataFrame(alias_rows(*[("INSPECTION", f"INSP-{n}", f"W{n}") for n in range(40)]), schemas.IDENTITY_ALIASES)
    t0 = ts("2026-01-05 07:00:00")
    salted, plain = [], identity._salted_join
    monkeypatch.setattr(identity, "_salted_join", lambda *a: salted.append(a) or plain(*a))

    def annotated(refs):
        records = spark.createDataFrame([(r, f"R{n}", t0, 25, 24, "", 1) for n, r in enumerate(refs)], schemas.WAFER_INSPECTION)
        stager = Recorder(spark)
        got = identity.annotate_in_steps(records, aliases, "wafer_inspection", stager, identity.HotKeyPolicy(fraction=0.1, buckets=4))
        hot = spark.read.parquet(f"{stager.root}/hot_wafer_inspection")
        return sorted(map(tuple, got.select("record_id", "physical_wafer_id").collect())), sorted(r["_ref"] for r in hot.collect())

    spread = [f"INSP-{n}" for n in range(40)]
    rows_, hot = annotated(spread)
    assert rows_ == sorted((f"R{n}", f"W{n}") for n in range(40)) and not hot and not salted
    # An alias that holds its share is in the list, whatever its partition; so is one of rows without a text.
    rows_, hot = annotated(spread + ["INSP-7"] * 10 + [None] * 10)
    assert hot == ["", "INSP-7"] and salted
    assert rows_ == sorted([(f"R{n}", f"W{n}") for n in range(40)] + [(f"R{n}", "W7") for n in range(40, 50)] + [(f"R{n}", None) for n in range(50, 60)], key=lambda r: r[0])


def test_the_master_is_found_without_a_sort_of_the_alias_rows(spark):
    aliases = alias_rows(("CHIP", "C-1", "W1"), ("MES", "M-1", "W1"), ("CHIP", "C-2", "W2"), ("MES", "M-3", None))
    aliases += [("CHIP", "A-2", "A-2", "W2", "WO-FIRST", "L", 1, None, "S"), ("CHIP", "A-3", "A-3", None, "WO-FIRST", "L", 1, None, "S")]
    aliases = spark.createDataFrame(aliases, schemas.IDENTITY_ALIASES)
    stager = Recorder(spark)
    master = identity.checked_master(aliases, stager)
    assert rows(master.drop("mixed")) == rows(identity.wafer_master(aliases))
    # A wafer without an id is one like any other.
    assert rows(master.where("mixed"), ["physical_wafer_id", "work_order"]) == rows(spark.createDataFrame([("W2", "WO-FIRST"), (None, "WO-FIRST")], "physical_wafer_id string, work_order string"))
    assert "SortAggregate" not in plan_of(master.where("not mixed"))


def test_details_without_a_hot_alias_are_joined_without_a_salt(spark):
    sources, details = tiny_sources(spark), tiny_details(spark)
    build = R.stage_fact_build(spark, sources, details)
    name = "sorting_parameter_detail"
    many, few = identity.HotKeyPolicy(fraction=0.01), identity.HotKeyPolicy(fraction=1.1)
    assert identity.policy_for(build.resolution[name], name, many) == many and identity.policy_for(build.resolution[name], name, few) is None
    salted, plain = (R.datasets_of(build, hot_keys=p)["targeted_sorting_parameter_detail"] for p in (many, few))
    assert rows(salted) == rows(plain) and "_salt" in plan_of(salted) and "_salt" not in plan_of(plain)


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f}


def left_after(spark, work, wait=20.0) -> set[str]:
    """Shuffle files that ``work`` added and that don't go while its frames are held."""
    gc.disable()
    try:
        before = shuffle_files(spark)
        held = work()
        until = time.monotonic() + wait
        while (left := shuffle_files(spark) - before) and time.monotonic() < until:
            time.sleep(0.2)
        assert held is not None
        return left
    finally:
        gc.enable()


def test_staged_tables_and_a_publication_leave_no_shuffle_files(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert left_after(spark, lambda: (counted, counted.write.format("noop").mode("overwrite").save()), 1.0)  # as Spark does it
    stager = R.Stager(spark)
    assert not left_after(spark, lambda: (counted, stager("counted", counted)))
    assert stager("again", counted).count() == 7  # the frame can still be used
    datasets = R.build_datasets(spark, tiny_sources(spark), tiny_details(spark))
    assert not left_after(spark, lambda: (datasets, publish.publish(spark, datasets, scratch_path(spark, "dropped"))))


def test_shuffle_cleanup_is_set_back_by_the_last_of_several_threads(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")

    def inside(n):
        with shuffles_dropped(spark):
            time.sleep(0.02 * n)
            return spark.conf.get(SHUFFLE_CLEANUP)

    with ThreadPoolExecutor(max_workers=4) as pool:
        assert set(pool.map(inside, range(4))) == {"true"}
    try:
        with shuffles_dropped(spark):
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == before


def test_unstaged_facts_are_written_once_as_the_published_ones(spark):
    def published(prepare):
        stager = Recorder(spark)
        build = R.stage_fact_build(spark, tiny_sources(spark), tiny_details(spark), stager=stager)
        prepare(build)
        path = scratch_path(spark, "once")
        counted = R.publish_build(spark, build, path)
        return stager.names, counted, {name: rows(publish.read(spark, path, name)) for name in schemas.REQUIRED_DATASETS}, build, path

    names, counted, found, build, path = published(lambda build: None)
    assert "enriched" not in names and len(names) == len(set(names))
    assert counted == publish.counts(spark, path)
    staged_names, staged_counted, staged, _, _ = published(lambda build: build.plan.enriched)
    assert "enriched" in staged_names and staged_counted == counted and staged == found
    # Later queries read the facts where they were published, with their lineage.
    assert rows(build.plan.enriched) == rows(facts.build(spark, tiny_sources(spark)).enriched)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert size != "32m"


def test_the_wafer_summary_sorts_numbers_not_ids(spark):
    t0, t1 = ts("2026-01-05 07:00:00"), ts("2026-01-06 07:00:00")
    made = [("Y3", "W1", "SORTING", t1, 0.1), ("Y2", "W1", "SORTING", t0, 0.2), ("Y1", "W1", "SORTING", t0, 0.3), ("Y4", "W1", "OTHER", None, 0.4),
            ("Y5", "W2", "SORTING", None, None), ("Y6", "W2", "SORTING", t0, 0.6), ("Y7", None, "SORTING", t0, 0.7)]
    found = spark.createDataFrame(made, "yield_record_id string, physical_wafer_id string, stage_code string, event_time timestamp, yield_rate double")
    master = spark.createDataFrame([("W1", "WO", "L", 1, "F", "S"), ("W2", "WO", "L", 1, "F", "S"), ("W3", "WO", "L", 1, "F", "S")], "physical_wafer_id string, work_order string, lot_id string, wafer_number int, product_family string, wafer_size string")
    summary = prepared.wafer_summary(master, found, ["OTHER", "SORTING"])
    assert summary.columns == [*schemas.MASTER_COLUMNS, "OTHER", "SORTING"]
    got = {r["physical_wafer_id"]: (r["OTHER"], r["SORTING"]) for r in summary.collect()}
    assert got == {"W1": (0.4, 0.3), "W2": (None, None), "W3": (None, None)}
    sorts = [line for line in plan_of(summary).splitlines() if line.startswith("Arguments: [") and " ASC " in line]
    assert sorts and all(line.startswith("Arguments: [_hash") for line in sorts)
