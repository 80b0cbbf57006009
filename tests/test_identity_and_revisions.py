from __future__ import annotations

from factory_support import alias_rows, ts
from pyspark.sql import functions as F

from yieldspark import schemas
from yieldspark.operators import identity, revisions


def _aliases(spark, *rows):
    return spark.createDataFrame(alias_rows(*rows), schemas.IDENTITY_ALIASES)


def _resolve(spark, aliases, kind, refs):
    records = spark.createDataFrame([(r, f"R{i}") for i, r in enumerate(refs)], "ref string, record_id string")
    out = identity.resolve_records(records, aliases, kind, "ref").orderBy("record_id").collect()
    return [(r["identity_status"], r["physical_wafer_id"], r["identity_method"]) for r in out]


def test_exact_wins_over_normalized(spark):
    aliases = _aliases(spark, ("CHIP", "A_1", "W1"), ("CHIP", "A-1", "W2"))
    assert _resolve(spark, aliases, "CHIP", ["A_1"]) == [("RESOLVED", "W1", "exact alias")]


def test_ambiguous_exact_stops_before_normalized(spark):
    aliases = _aliases(spark, ("CHIP", "X", "W1"), ("CHIP", "X", "W2"), ("CHIP", "x ", "W3"))
    assert _resolve(spark, aliases, "CHIP", ["X"]) == [("AMBIGUOUS", None, "exact alias")]


def test_normalized_match_and_normalized_ambiguity(spark):
    aliases = _aliases(spark, ("SORTING", "SORT_7", "W7"), ("SORTING", "Q 1", "W1"), ("SORTING", "Q1 ", "W2"))
    assert _resolve(spark, aliases, "SORTING", ["sort-7", "q1"]) == [
        ("RESOLVED", "W7", "normalized alias"),
        ("AMBIGUOUS", None, "normalized alias"),
    ]


def test_whitespace_is_stripped_and_kind_is_respected(spark):
    aliases = _aliases(spark, ("CHIP", "SUB 7", "W7"))
    assert _resolve(spark, aliases, "CHIP", ["\tSUB 7\n"]) == [("RESOLVED", "W7", "exact alias")]
    assert _resolve(spark, aliases, "SORTING", ["SUB 7"]) == [("UNRESOLVED", None, "no alias match")]


def test_null_alias_is_unresolved(spark):
    aliases = _aliases(spark, ("CHIP", "SUB 7", "W7"))
    assert _resolve(spark, aliases, "CHIP", [None]) == [("UNRESOLVED", None, "no alias match")]


def test_revision_tie_takes_higher_record_id_under_any_order(spark):
    rows = [("REF", "R1", 1), ("REF", "R2", 1), ("REF", "R0", 0), ("OTHER", "R9", 3)]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "ref string, record_id string, revision int").repartition(3)
        out = revisions.latest_per_key(frame, ["ref"], ["revision", "record_id"]).orderBy("ref").collect()
        assert [(r["ref"], r["record_id"]) for r in out] == [("OTHER", "R9"), ("REF", "R2")]


def test_wafer_master_takes_first_kind(spark):
    aliases = spark.createDataFrame(
        [
            ("MES", "M", "M", "W1", "WO-MES", "L", 1, "F", "S"),
            ("CHIP", "C", "C", "W1", "WO-CHIP", "L", 1, "F", "S"),
        ],
        schemas.IDENTITY_ALIASES,
    )
    assert identity.wafer_master(aliases).collect()[0]["work_order"] == "WO-CHIP"


def test_audit_covers_every_record_before_dedup(spark):
    aliases = _aliases(spark, ("INSPECTION", "I1", "W1"))
    insp = spark.createDataFrame(
        [("I1", "WI-1", ts("2026-01-05 07:00:00"), 25, 24, "", 1), ("I1", "WI-1-R2", ts("2026-01-05 09:00:00"), 25, 25, "", 2),
         ("NOPE", "WI-2", ts("2026-01-05 07:00:00"), 25, 25, "", 1)],
        schemas.WAFER_INSPECTION,
    )
    annotated = identity.resolve_records(insp, aliases, "INSPECTION", "inspection_wafer_ref")
    audit = identity.identity_audit({"wafer_inspection": annotated})
    assert audit.count() == 3
    assert audit.where(F.col("identity_status") == "UNRESOLVED").count() == 1


def test_hot_alias_salting_gives_the_same_result(spark):
    aliases = _aliases(spark, ("CHIP", "HOT", "W1"), ("CHIP", "C1", "W2"), ("CHIP", "AMB", "W3"), ("CHIP", "AMB", "W4"))
    rows = [("HOT", f"H{i}") for i in range(2000)] + [("C1", "c1"), ("AMB", "a1"), ("NONE", "n1"), (None, "z1")]
    records = spark.createDataFrame(rows, "ref string, record_id string").repartition(4)
    resolution = identity.resolve_keys(aliases, identity.lookup_keys(records, "CHIP", "ref"))
    assert resolution.where(F.col("raw_alias") == "HOT").collect()[0]["key_rows"] == 2000
    policy = identity.HotKeyPolicy(fraction=0.1, buckets=8)
    plain = identity.annotate(records, "CHIP", "ref", resolution)
    salted = identity.annotate(records, "CHIP", "ref", resolution, record_column="record_id", hot_keys=policy)
    assert salted.columns == plain.columns
    key = ["record_id", "identity_status", "physical_wafer_id", "identity_method"]
    assert sorted(tuple(r[k] for k in key) for r in salted.collect()) == sorted(
        tuple(r[k] for k in key) for r in plain.collect()
    )
    # The join is keyed on (alias, deterministic salt).
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "xxhash64" in plan
