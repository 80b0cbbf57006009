from __future__ import annotations

import pytest
from factory_support import alias_rows, plan_of, scan_of, ts
from pyspark.sql import functions as F
from test_facts_and_views import tiny_sources

from yieldspark import schemas
from yieldspark.operators import facts, prepared
from yieldspark.plans import delta, publish, views
from yieldspark.plans import refresh as R
from yieldspark.plans.views import Cell, Scope
from yieldspark.session import scratch_path
from yieldspark.streaming.incremental import read_late, read_weekly_yield, run_weekly_yield, start_delta_refresh, start_weekly_yield


def tiny_details(spark):
    t0 = ts("2026-01-06 08:00:00")
    chips = [(f"CH-{w}-{n}", f"SUB {w}", n, 0, 0, n % 2 == 0, "" if n % 2 == 0 else "Return F", t0, 1)
             for w in ("W1", "W2", "W3") for n in range(1, 4)]
    params = [(f"SP-{w}-{p}", f"SORT_{w}", 1, p, v, 0.0, 1.0, 0.0 <= v <= 1.0, t0)
              for w in ("W1", "W2") for p, v in (("QTY", 0.5), ("DISC", 2.0))]
    return {
        "chip_detail": spark.createDataFrame(chips, schemas.CHIP_DETAIL),
        "sorting_parameter_detail": spark.createDataFrame(params, schemas.SORTING_PARAMETER_DETAIL),
    }


@pytest.fixture(scope="module")
def root(spark):
    path = scratch_path(spark, "test-publication")
    R.refresh(spark, tiny_sources(spark), tiny_details(spark), path)
    return path


# --- publication -------------------------------------------------------------------
def test_publication_is_checked_and_detail_is_read_by_name_only(spark, root):
    frames = publish.load(spark, root)
    assert set(frames) == set(schemas.COMMON_DATASETS)
    assert publish.counts(spark, root)["yield_fact"] == frames["yield_fact"].count()
    known = {r["name"]: r["value"] for r in publish.summary(spark, root).where("entry = 'statistic'").collect()}
    plan = facts.build(spark, tiny_sources(spark))
    from yieldspark.operators import identity

    want = prepared.refresh_statistics(plan.master, plan.enriched, plan.components, identity.identity_audit(plan.annotated))
    assert known == {r["statistic"]: r["value"] for r in want.collect()}


def test_a_failed_check_leaves_no_complete_publication(spark, monkeypatch):
    def broken(*_):
        raise publish.CheckFailed("x")

    path = scratch_path(spark, "failed")
    monkeypatch.setattr(publish, "check", broken)
    with pytest.raises(publish.CheckFailed):
        R.refresh(spark, tiny_sources(spark), tiny_details(spark), path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        publish.load(spark, path)


def test_a_publication_without_failures_is_complete(spark, root):
    datasets = publish.load(spark, root, schemas.REQUIRED_DATASETS)
    datasets = {name: frame.drop(publish.YEAR) for name, frame in datasets.items()}
    path = scratch_path(spark, "no-failures")
    rows = publish.publish(spark, datasets | {"failure_fact": datasets["failure_fact"].limit(0)}, path)
    assert rows["failure_fact"] == 0
    empty = publish.load(spark, path)["failure_fact"]
    assert empty.count() == 0 and views.cell_pareto(empty, Cell("SORTING", "Month", "2026-01")).count() == 0


def test_a_folder_is_never_overwritten(spark, root):
    before = publish.counts(spark, root)
    with pytest.raises(Exception, match="(?i)exists"):
        R.refresh(spark, tiny_sources(spark), tiny_details(spark), root)
    assert publish.counts(spark, root) == before


def test_missing_dataset_is_rejected(spark):
    with pytest.raises(ValueError):
        publish.publish(spark, {"yield_fact": spark.createDataFrame([], schemas.YIELD_FACT)}, scratch_path(spark, "none"))


def test_check_finds_lost_lineage_repeated_ids_and_lost_rows(spark, root):
    rows = publish.counts(spark, root)

    def with_changed(name, change):
        path = scratch_path(spark, "changed")
        for other in schemas.REQUIRED_DATASETS:
            frame = publish.read(spark, root, other)
            frame = change(frame) if other == name else frame
            by = publish.LAYOUTS.get(other, publish.Layout()).partition_by
            (frame.write.partitionBy(*by) if by else frame.write).parquet(f"{path}/{other}")
        return path

    first_id = publish.read(spark, root, "yield_fact").orderBy("yield_record_id").first()["yield_record_id"]
    lost = with_changed("lineage", lambda f: f.where(F.col("yield_record_id") != first_id))
    with pytest.raises(publish.CheckFailed, match="rows counted"):
        publish.check(spark, lost, rows)
    with pytest.raises(publish.CheckFailed, match="once in both"):
        publish.check(spark, lost, rows | {"lineage": rows["lineage"] - 1})
    twice = with_changed("yield_fact", lambda f: f.unionByName(f.limit(1)))
    with pytest.raises(publish.CheckFailed, match="once in both"):
        publish.check(spark, twice, rows | {"yield_fact": rows["yield_fact"] + 1})
    publish.check(spark, root, rows)


def test_targeted_read_takes_lists_and_frames(spark, root):
    chips = publish.read_wafers(spark, root, "targeted_chip_detail", ["W2", "W2"]).collect()
    assert {r["physical_wafer_id"] for r in chips} == {"W2"} and len(chips) == 3
    assert publish.read_wafers(spark, root, "targeted_chip_detail", []).count() == 0
    with pytest.raises(ValueError):
        publish.read_wafers(spark, root, "yield_fact", ["W2"])
    scope = spark.createDataFrame([("W1",), ("W1",)], "physical_wafer_id string")
    assert publish.read_wafers(spark, root, "targeted_sorting_parameter_detail", scope).count() == 2
    rows, text = R.wafer_detail(spark, root, "SORTING", "W1")
    assert rows.count() == 2 and "parameter" in text
    assert R.wafer_detail(spark, root, "CHIP_INSPECTION", "W1")[0].count() == 3


def test_parameter_summary(spark, root):
    summary = {r["parameter"]: r for r in R.parameter_summary_table(spark, root).collect()}
    assert summary["DISC"]["good"] == 0 and summary["QTY"]["yield_rate"] == 1.0


def test_a_cell_reads_only_its_partitions(spark, root):
    cell = Cell("SORTING", "Month", "2026-01")
    for frame in (
        views.cell_population(publish.read(spark, root, "yield_fact"), cell),
        views.cell_pareto(publish.read(spark, root, "failure_fact"), cell),
        views.cell_trend(publish.read(spark, root, "yield_fact"), "Month", "SORTING", Scope(start="2026-01-01", end="2026-02-01")),
    ):
        scan = scan_of(frame)
        assert "stage_code" in scan["PartitionFilters"] and "event_year" in scan["PartitionFilters"]
        assert "event_time" in scan["PushedFilters"]
    records = views.population_records(publish.read(spark, root, "yield_fact"), publish.read(spark, root, "lineage"), cell)
    pruned = [line for line in plan_of(records).splitlines() if line.startswith("PartitionFilters")]
    assert len(pruned) == 2 and all("event_year" in line and "stage_code" in line for line in pruned)
    assert records.count() == 3


def test_csv_export_round_trip_keeps_empty_and_null(spark):
    frame = spark.createDataFrame([("a", ""), ("b", None)], "k string, v string")
    path = R.export_csv(frame, scratch_path(spark, "csv") + "/x.csv")
    back = {r["k"]: r["v"] for r in R.read_csv_export(spark, path, frame.schema).collect()}
    assert back == {"a": "", "b": None}


# --- weekly stream -----------------------------------------------------------------
def fact(n, at, good, stage="SORTING"):
    return (f"Y{n}", "S", stage, "Sorting", 90, "W", "WO", "L", 1, "F", "S", at and ts(at), good, 1.0, good, "")


def trend(frame):
    return {(r["stage_code"], r["period"]): (r["numerator"], r["denominator"]) for r in frame.collect()}


def test_a_new_checkpoint_is_a_run_of_its_own(spark):
    work = scratch_path(spark, "two-checkpoints")

    def put(n, good):
        spark.createDataFrame([fact(n, "2026-01-06 10:00:00", good)], schemas.YIELD_FACT).coalesce(1).write.mode("append").parquet(f"{work}/facts")

    def run(checkpoint):
        start_weekly_yield(spark, f"{work}/facts", f"{work}/sink", f"{work}/{checkpoint}", max_files_per_trigger=1).awaitTermination()
        return list(trend(read_weekly_yield(spark, f"{work}/sink")).values())

    put(0, 1.0)
    put(1, 1.0)
    assert run("one") == [(2.0, 2.0)]
    put(2, 0.0)
    assert run("two") == [(2.0, 3.0)]  # its batch ids begin at 0 again
    put(3, 0.0)
    assert run("two") == [(2.0, 4.0)]


def test_files_out_of_time_order_give_the_batch_trend(spark):
    times = ["2026-03-02 10:00:00", "2026-01-05 10:00:00", "2026-03-03 10:00:00", "2025-11-05 00:00:00", None, "2026-01-06 01:00:00", "2026-03-20 10:00:00"]
    work = scratch_path(spark, "late")
    every = spark.createDataFrame([fact(n, t, float(n % 2)) for n, t in enumerate(times)], schemas.YIELD_FACT)
    for n in range(len(times)):
        every.where(F.col("yield_record_id") == f"Y{n}").coalesce(1).write.mode("append").parquet(f"{work}/facts")
        start_weekly_yield(spark, f"{work}/facts", f"{work}/sink", f"{work}/ckpt", fold_every=3).awaitTermination()
    assert trend(read_weekly_yield(spark, f"{work}/sink")) == trend(prepared.prebuilt_trend(every))
    # The facts of January and November came after the watermark (March - 14 days) had passed their weeks.
    assert read_late(spark, f"{work}/sink").agg(F.sum("denominator")).first()[0] == 3.0


def test_stream_weekly_yield_equals_batch_trend(spark, root):
    rows = publish.read(spark, root, "yield_fact")
    streamed = run_weekly_yield(spark, rows, scratch_path(spark, "stream"), files=4, max_files_per_trigger=1)
    assert trend(streamed) == trend(prepared.prebuilt_trend(rows))


# --- delta refresh -----------------------------------------------------------------
def stored_facts(spark, store):
    return sorted(map(repr, delta.enriched(spark, store).drop(publish.YEAR).collect()))


def full_facts(spark, sources):
    columns = [f.name for f in delta.FACTS.fields if f.name != publish.YEAR]
    return sorted(map(repr, facts.build(spark, sources).enriched.select(*columns).collect()))


def landings(spark):
    """Changed rows of read sources: a revision, a new process record, a fixed alias claim, a moved year, a new wafer."""
    t1 = ts("2026-01-07 08:00:00")
    other_year = ts("2027-02-07 08:00:00")
    make = lambda rows, name: (name, spark.createDataFrame(rows, schemas.SOURCE_SCHEMAS[name]))
    return [
        make([(" sub w1", "CIS-W1-B", t1, 10, 9, "", 3)], "chip_inspection_summary"),
        make([("INSP-W2", "WI-W2-R2", other_year, 25, 25, "", 2)], "wafer_inspection"),  # its facts leave 2026
        make([("NOBODY", "PR-X", "SURFACE_PREPARATION", t1, "CELL-1", True, "")], "process_results"),
        make(alias_rows(("CHIP", "SUB W1", "W2")), "identity_aliases"),  # W1's alias becomes ambiguous
        make(alias_rows(("MES", "MES/W4", "W4"), ("MES", "NOBODY", "W4")), "identity_aliases"),  # a record that waited is resolved
    ]


def test_landed_rows_change_the_facts_as_a_full_refresh_does(spark):
    sources = tiny_sources(spark)
    store = delta.DeltaStore(scratch_path(spark, "delta-test"), buckets=2)
    delta.start(spark, store, sources)
    for n, (name, rows) in enumerate(landings(spark)):
        touched = delta.refresh_delta(spark, store, name, rows, f"L{n}")
        sources[name] = sources[name].unionByName(rows)
        if n in (1, 4):
            assert stored_facts(spark, store) == full_facts(spark, sources), name
        if n == 2:
            assert touched == []  # nobody owns the alias: no partition is read or written
    # Landing again what has landed, also after others, changes nothing.
    before = stored_facts(spark, store)
    name, rows = landings(spark)[0]
    delta.refresh_delta(spark, store, name, rows, "L0")
    assert stored_facts(spark, store) == before
    scan = scan_of(delta.enriched(spark, store).where(delta._in_partitions([("SORTING", 2026), ("SORTING", None)])))
    assert "SORTING" in scan["PartitionFilters"] and "2026" in scan["PartitionFilters"]


def test_a_store_may_start_empty(spark):
    store = delta.DeltaStore(scratch_path(spark, "delta-empty"), buckets=2)
    sources = tiny_sources(spark)
    delta.start(spark, store, {name: frame.limit(0) for name, frame in sources.items()})
    assert stored_facts(spark, store) == []
    for name in ("identity_aliases", "sorting_summary"):
        delta.refresh_delta(spark, store, name, sources[name], "first")
    found = delta.enriched(spark, store).select("stage_code", "physical_wafer_id").collect()
    assert sorted(map(tuple, found)) == [("SORTING", "W1"), ("SORTING", "W2"), ("SORTING", "W3")]


def test_an_interrupted_landing_is_completed_by_running_it_again(spark, monkeypatch):
    sources = tiny_sources(spark)
    store = delta.DeltaStore(scratch_path(spark, "delta-broken"), buckets=2)
    delta.start(spark, store, sources)
    name, rows = landings(spark)[0]
    whole = delta._replace_partitions

    def broken(frame, path, by, order):
        if path.endswith("/places"):
            raise RuntimeError("lost")
        whole(frame, path, by, order)

    monkeypatch.setattr(delta, "_replace_partitions", broken)
    with pytest.raises(RuntimeError):
        delta.refresh_delta(spark, store, name, rows, "L0")
    monkeypatch.undo()
    delta.refresh_delta(spark, store, name, rows, "L0")
    sources[name] = sources[name].unionByName(rows)
    assert stored_facts(spark, store) == full_facts(spark, sources)


def test_files_that_land_are_refreshed_once(spark):
    sources = tiny_sources(spark)
    work = scratch_path(spark, "r1")
    store = delta.DeltaStore(f"{work}/store", buckets=2)
    delta.start(spark, store, sources)
    name, rows = landings(spark)[0]

    def run():
        start_delta_refresh(spark, store, name, f"{work}/landing", f"{work}/ckpt").awaitTermination()

    rows.write.parquet(f"{work}/landing")
    run()
    sources[name] = sources[name].unionByName(rows)
    assert stored_facts(spark, store) == full_facts(spark, sources)
    run()  # nothing new landed
    assert delta._changes_applied(spark, store) == 1


def test_a_landing_moves_its_staged_facts_and_goes_on_where_it_stopped(spark, monkeypatch):
    sources = tiny_sources(spark)
    store = delta.DeltaStore(scratch_path(spark, "delta-moved"), buckets=2)
    written, whole, move = [], delta._write_partitions, delta._move_partitions
    monkeypatch.setattr(delta, "_write_partitions", lambda frame, path, *a, **k: written.append(path) or whole(frame, path, *a, **k))
    delta.start(spark, store, sources)
    name, rows = landings(spark)[1]  # its facts leave 2026

    def broken(spark_, staged, path, parts):
        move(spark_, staged, path, parts[:2])
        raise RuntimeError("lost")

    written.clear()
    monkeypatch.setattr(delta, "_move_partitions", broken)
    with pytest.raises(RuntimeError):
        delta.refresh_delta(spark, store, name, rows, "L0")
    monkeypatch.setattr(delta, "_move_partitions", move)
    touched = delta.refresh_delta(spark, store, name, rows, "L0")
    sources[name] = sources[name].unionByName(rows)
    assert stored_facts(spark, store) == full_facts(spark, sources)
    assert {year for _, year in touched} == {2026, 2027} and ("WAFER_INSPECTION", 2027) in touched
    # The facts are written once, where they are staged, and nothing of them stays there.
    assert [p for p in written if p.endswith("/facts")] == [store.path(f"changes/{name}/L0/facts")]
    assert not list(delta._partitions(spark.read.schema(delta.FACTS).parquet(store.path(f"changes/{name}/L0/facts"))))


def test_buckets_are_written_without_a_sample(spark, monkeypatch):
    frame = spark.createDataFrame([(n % 2, f"W{n:02d}") for n in range(40)], "wafer_bucket int, physical_wafer_id string")
    path = scratch_path(spark, "buckets")

    def sampled(*_):
        raise AssertionError("made twice")

    monkeypatch.setattr(type(frame), "repartitionByRange", sampled)
    delta._replace_partitions(frame, path, ["wafer_bucket"], ["physical_wafer_id"])
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("wafer_bucket", "physical_wafer_id").collect())) == sorted(map(tuple, frame.collect()))
    for part in back.groupBy(F.input_file_name()).agg(F.collect_list("physical_wafer_id").alias("ids")).collect():
        assert part["ids"] == sorted(part["ids"])
