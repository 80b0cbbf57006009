from __future__ import annotations

from factory_support import alias_rows, ts
from pyspark.sql import functions as F

from yieldspark import rules, schemas
from yieldspark.functions.numeric import percent_text, round_half_even
from yieldspark.functions.periods import period_label
from yieldspark.operators import facts, prepared
from yieldspark.plans import views
from yieldspark.plans.views import Cell, Scope


def tiny_sources(spark, *, sorting_for_w2=True, zero_total_w3=False):
    """Three wafers with every source; W2 optionally lacks sorting, W3 may have zero chips."""
    aliases = []
    for w in ("W1", "W2", "W3"):
        aliases += alias_rows(
            ("MES", f"MES/{w}", w), ("INSPECTION", f"INSP-{w}", w), ("CHIP", f"SUB {w}", w),
            ("SORTING", f"SORT_{w}", w), ("QUALIFICATION", f"QUAL-{w}", w),
        )
    t0 = ts("2026-01-05 08:00:00")
    insp = [(f"INSP-{w}", f"WI-{w}", t0, 25, 20, "", 1) for w in ("W1", "W2", "W3")]
    process = []
    for w in ("W1", "W2", "W3"):
        for s, stage in enumerate(("SURFACE_PREPARATION", "PATTERN_SEPARATION", "PROTECTIVE_FINISH", "DEVICE_FORMATION"), 1):
            process.append((f"MES/{w}", f"PR-{w}-{s}", stage, t0, "CELL-1", w != "W1" or s != 4, "" if w != "W1" or s != 4 else "Short"))
    total3 = 0 if zero_total_w3 else 10
    chips = [("SUB W1", "CIS-W1", t0, 10, 8, "Return F", 1), ("SUB W2", "CIS-W2", t0, 10, 10, "", 1),
             ("SUB W3", "CIS-W3", t0, total3, total3, "", 1)]
    sorting = [(f"SORT_{w}", f"SORT-{w}", "A", t0, t0, 10, 9, "Parameter Drift") for w in ("W1", "W2", "W3")
               if sorting_for_w2 or w != "W2"]
    quals = [(f"QUAL-{w}", f"QUAL-{w}", "A", t0, w != "W3", 1) for w in ("W1", "W2", "W3")]
    frames = {
        "identity_aliases": (aliases, schemas.IDENTITY_ALIASES),
        "wafer_inspection": (insp, schemas.WAFER_INSPECTION),
        "process_results": (process, schemas.PROCESS_RESULTS),
        "chip_inspection_summary": (chips, schemas.CHIP_INSPECTION_SUMMARY),
        "sorting_summary": (sorting, schemas.SORTING_SUMMARY),
        "qualification_results": (quals, schemas.QUALIFICATION_RESULTS),
    }
    return {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in frames.items()}


def fact_rows(spark, **kw):
    plan = facts.build(spark, tiny_sources(spark, **kw))
    return plan, {(r["stage_code"], r["physical_wafer_id"]): r for r in facts.yield_fact(plan.enriched).collect()}


def test_eleven_stages_and_lineage_one_to_one(spark):
    plan, rows = fact_rows(spark)
    assert {k[0] for k in rows} == {r[1] for r in rules.DEFAULT_DISPLAY_ROWS}
    assert facts.lineage(plan.enriched).count() == len(rows)


def test_final_chip_yield_product_and_failed_formation(spark):
    _, rows = fact_rows(spark)
    # Chips 8/10, formation failed → (10-9)/10, sorting 9/10, qualified → round(10*0.8*0.1*0.9) = 1.
    assert rows[("FINAL_CHIP_YIELD", "W1")]["numerator"] == 1.0
    assert rows[("DEVICE_FORMATION", "W1")]["numerator"] == 1.0  # max(0, 10 - 9)
    # W3 failed qualification → 0 good chips.
    assert rows[("FINAL_CHIP_YIELD", "W3")]["numerator"] == 0.0
    assert rows[("FINAL_CHIP_YIELD", "W3")]["failure_family"] == rules.FINAL_COMPONENT_LOSS


def test_incomplete_cohort_has_no_final_fact(spark):
    _, rows = fact_rows(spark, sorting_for_w2=False)
    assert ("FINAL_CHIP_YIELD", "W2") not in rows
    assert ("FINAL_CHIP_YIELD", "W1") in rows


def test_zero_denominator_emits_no_fact(spark):
    _, rows = fact_rows(spark, zero_total_w3=True)
    assert ("CHIP_INSPECTION", "W3") not in rows
    assert ("FINAL_CHIP_YIELD", "W3") not in rows


def test_wafer_total_is_product_of_four_stages(spark):
    _, rows = fact_rows(spark)
    assert abs(rows[("WAFER_TOTAL", "W1")]["numerator"] - 0.8) < 1e-12
    assert rows[("WAFER_TOTAL", "W1")]["failure_family"] == rules.WAFER_TOTAL_LOSS


def test_empty_failure_family_becomes_unclassified(spark):
    plan, _ = fact_rows(spark)
    fails = {(r["stage_code"], r["physical_wafer_id"]): r for r in facts.failure_fact(plan.enriched).collect()}
    assert fails[("WAFER_INSPECTION", "W1")]["failure_family"] == rules.UNCLASSIFIED_LOSS
    assert fails[("WAFER_INSPECTION", "W1")]["failure_quantity"] == 5.0


def test_half_even_rounding(spark):
    out = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double").select(round_half_even(F.col("x")).alias("r"))
    assert [r["r"] for r in out.collect()] == [2.0, 4.0, -2.0]


def test_percent_text_matches_python_printing(spark):
    pairs = [(12.25, 100.0), (0.45, 1.0), (0.35, 1.0), (87.35, 100.0), (2.0, 3.0)]
    frame = spark.createDataFrame(pairs, "n double, d double")
    got = [r["t"] for r in frame.select(percent_text(F.col("n"), F.col("d")).alias("t")).collect()]
    assert got == [f"{100 * n / d:.1f}%" for n, d in pairs]


def test_week_edges_and_period_modes(spark):
    frame = spark.createDataFrame([(ts("2026-01-11 23:59:59"),), (ts("2026-01-12 00:00:00"),)], "t timestamp")
    labels = {m: [r["p"] for r in frame.select(period_label(F.col("t"), m).alias("p")).collect()] for m in rules.PERIOD_MODES}
    assert labels["Week"] == ["2026-01-05/2026-01-11", "2026-01-12/2026-01-18"]
    assert labels["Day"] == ["2026-01-11", "2026-01-12"]
    assert labels["Month"] == ["2026-01", "2026-01"]
    assert labels["Quarter"] == ["2026Q1", "2026Q1"]
    assert labels["Year"] == ["2026", "2026"]


def test_end_date_is_inclusive_of_the_whole_day(spark):
    frame = spark.createDataFrame([(ts("2026-01-11 23:59:59"),), (ts("2026-01-12 00:00:00"),)], "event_time timestamp")
    kept = views.filtered(frame, Scope(start="2026-01-11", end="2026-01-11")).count()
    assert kept == 1


def test_unknown_period_mode_is_rejected(spark):
    import pytest

    with pytest.raises(ValueError):
        period_label(F.col("t"), "Fortnight")


def _failures(spark, rows):
    return spark.createDataFrame(
        [("YF", "SORTING", "S", "W", "WO", "F", ts("2026-01-05 08:00:00"), fam, q) for fam, q in rows],
        schemas.FAILURE_FACT,
    )


def test_top_n_share_is_within_top_n_and_nulls_excluded(spark):
    fails = _failures(spark, [("A", 5.0), ("B", 3.0), ("C", 2.0), (None, 100.0)])
    out = views.cell_pareto(fails, Cell("SORTING", "Month", "2026-01"), top_n=2)
    rows = out.collect()
    assert [r["failure_family"] for r in rows] == ["A", "B"]
    assert rows[-1]["cumulative_share"] == 1.0


def test_size_filter_does_not_narrow_failures(spark):
    fails = _failures(spark, [("A", 5.0)])
    out = views.cell_pareto(fails, Cell("SORTING", "Month", "2026-01"), Scope({"wafer_size": "150 mm"}))
    assert out.count() == 1


def test_matrix_keeps_last_n_periods_and_ratio_of_sums(spark):
    rows = []
    for day in range(1, 6):
        rows.append((f"Y{day}", "Wafer Process", "SORTING", "S", 90, "W", "WO", "L", 1, "F", "S",
                     ts(f"2026-01-0{day} 10:00:00"), float(day), 10.0, day / 10.0, ""))
    frame = spark.createDataFrame(rows, schemas.YIELD_FACT)
    out = views.matrix_long(frame, "Day", max_periods=2).orderBy("period").collect()
    assert [r["period"] for r in out] == ["2026-01-04", "2026-01-05"]
    total = views.matrix_long(frame, "Year").collect()[0]
    assert total["yield_rate"] == 15.0 / 50.0


def test_empty_inputs_give_typed_empty_outputs(spark):
    empty_facts = spark.createDataFrame([], schemas.YIELD_FACT)
    empty_fail = spark.createDataFrame([], schemas.FAILURE_FACT)
    assert views.matrix_long(empty_facts, "Week").count() == 0
    assert prepared.prebuilt_pareto(empty_fail).columns == schemas.PREBUILT_PARETO.fieldNames()
    kpis = views.cell_kpis(empty_facts, Cell("SORTING", "Week", "x")).collect()[0]
    assert (kpis["numerator"], kpis["denominator"], kpis["yield_pct"], kpis["physical_wafers"]) == (0.0, 0.0, 0.0, 0)


def test_select_cell_takes_only_cells_of_the_matrix(spark):
    long = spark.createDataFrame([("SORTING", "2026-01", 0.9), ("SORTING", "2026-02", 0.8)], "stage_code string, period string, yield_rate double")
    assert [r["yield_rate"] for r in views.select_cell(long, "SORTING", "2026-01").collect()] == [0.9]
    assert views.select_cell(long, "SORTING", "stage_label").count() == 0
    assert views.select_cell(long, "CHIP_INSPECTION", "2026-01").count() == 0


def test_cell_rejects_unknown_mode_and_matches_label_range(spark):
    import pytest

    rows = [("Y1", "S", "SORTING", "L", 90, "W", "WO", "L", 1, "F", "S", ts("2026-01-11 23:59:59"), 1.0, 1.0, 1.0, ""),
            ("Y2", "S", "SORTING", "L", 90, "W", "WO", "L", 1, "F", "S", ts("2026-01-12 00:00:00"), 1.0, 1.0, 1.0, "")]
    facts_df = spark.createDataFrame(rows, schemas.YIELD_FACT)
    with pytest.raises(ValueError):
        views.cell_population(facts_df, Cell("SORTING", "Fortnight", "x"))
    week = views.cell_population(facts_df, Cell("SORTING", "Week", "2026-01-05/2026-01-11"))
    assert [r["yield_record_id"] for r in week.collect()] == ["Y1"]
    quarter = views.cell_population(facts_df, Cell("SORTING", "Quarter", "2026Q1"))
    assert quarter.count() == 2


def test_one_record_id_in_two_spellings_gives_two_facts(spark):
    sources = tiny_sources(spark)
    t0 = ts("2026-01-05 08:00:00")
    more = spark.createDataFrame(
        [("insp_W1", "WI-W1", t0, 25, 21, "", 1), (" INSP-W1", "WI-W1", t0, 25, 22, "", 1), ("INSP:W1", "W%1", t0, 25, 23, "", 1)],
        schemas.WAFER_INSPECTION,
    )
    sources["wafer_inspection"] = sources["wafer_inspection"].unionByName(more)
    ids = [r[0] for r in facts.yield_fact(facts.build(spark, sources).enriched).where("stage_code = 'WAFER_INSPECTION'").select("yield_record_id").collect()]
    assert len(ids) == len(set(ids)) == 5
    parts = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), ("a%3Ab", "c"), (None, "c"), ("", "c")], "x string, y string")
    keys = [r[0] for r in parts.select(facts.fact_key(F.lit("S"), F.col("x"), F.col("y"))).collect()]
    assert len(set(keys)) == 4  # null and empty are one


def test_filters_on_other_columns_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        views.filtered(spark.createDataFrame([], schemas.YIELD_FACT), Scope({"lot_id": "L"}))
