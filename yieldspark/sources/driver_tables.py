"""Source-shaped tables derived from the driver's order/line-item tables.

One order is one physical wafer and its line items are its chips.  Every
source table is a lazy projection of the driver tables, so all work grows with
them and Catalyst prunes columns down to the Parquet scan.  Each table is built
from a single scan: the variant rows of a source (revisions, second spellings,
rework) come from exploding an array of candidate structs, not from unions of
repeated scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark import schemas
from yieldspark.functions.text import normalize_alias

# ---------------------------------------------------------------------------
# Fixed values of the mapping.
# ---------------------------------------------------------------------------
PROCESS_STAGES = [
    (1, "SURFACE_PREPARATION"),
    (2, "PATTERN_SEPARATION"),
    (3, "PROTECTIVE_FINISH"),
    (4, "DEVICE_FORMATION"),
]
# (parameter, value column, lower limit, upper limit)
SORTING_PARAMETERS = [
    ("QTY", "l_quantity", 1.0, 45.0),
    ("DISC", "l_discount", 0.0, 0.095),
    ("TAX", "l_tax", 0.0, 0.075),
]
SITES_PER_WAFER = 25
SORT_DISCOUNT_LIMIT = 0.095
# ---------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.col("o_orderkey")


def _ks(column: str = "o_orderkey") -> Column:
    return F.col(column).cast("string")


def _ts(column: str) -> Column:
    """Driver timestamps are wall-clock (``timestamp_ntz``); read them as UTC instants."""
    return F.col(column).cast("timestamp")


def _hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def _days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(days=F.lit(days))


def _explode_variants(frame: DataFrame, variants: list[Column], schema) -> DataFrame:
    """One output row per non-null candidate struct, typed by ``schema``."""
    exploded = frame.select(F.explode(F.array(*variants)).alias("_v")).where(F.col("_v").isNotNull())
    return schemas.conform(exploded.select("_v.*"), schema)


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def wafer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, nation and region: one row per physical wafer.

    ``nation`` and ``region`` have a fixed size (25 and 5 rows), so they are
    broadcast; the customer join is left to the planner (AQE broadcasts it only
    when its measured size is small).
    """
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            "o_custkey",
            F.concat(F.lit("PHY-"), F.lpad(_ks(), 7, "0")).alias("physical_wafer_id"),
            F.concat(F.lit("WO-"), F.lpad(_ks("o_custkey"), 6, "0")).alias("work_order"),
            F.concat(F.lit("LOT-"), F.col("n_name")).alias("lot_id"),
            ((_k() % 25) + 1).cast("int").alias("wafer_number"),
            F.col("c_mktsegment").alias("product_family"),
            F.col("r_name").alias("wafer_size"),
        )
    )


def identity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five aliases per wafer (plus one claimed inspection alias per 97 wafers).

    Only the (kind, alias) pairs are exploded; the wafer attributes stay
    outside the generator.
    """
    base = wafer_base(spark, sf_dir)
    k = _ks()

    def alias(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("source_kind"), text.alias("source_alias"))

    variants = F.array(
        alias("MES", F.concat(F.lit("MES/"), k)),
        alias("INSPECTION", F.concat(F.lit("INSP-"), k)),
        alias("CHIP", F.concat(F.lit("SUB "), k)),
        alias("SORTING", F.concat(F.lit("SORT_"), k)),
        alias("QUALIFICATION", F.concat(F.lit("QUAL-"), k)),
        # A second wafer claims the previous wafer's inspection alias.
        _when(_k() % 97 == 1, alias("INSPECTION", F.concat(F.lit("INSP-"), (_k() - 1).cast("string")))),
    )
    exploded = base.select(*schemas.MASTER_COLUMNS, F.explode(variants).alias("_v")).where(
        F.col("_v").isNotNull()
    )
    return schemas.conform(
        exploded.select(
            "_v.source_kind",
            "_v.source_alias",
            normalize_alias(F.col("_v.source_alias")).alias("normalized_alias"),
            *schemas.MASTER_COLUMNS,
        ),
        schemas.IDENTITY_ALIASES,
    )


def wafer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = wafer_base(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (
        base.join(orders, "o_orderkey")
        .select(
            F.concat(F.lit("MES/"), _ks()).alias("mes_wafer_ref"),
            F.col("work_order").alias("work_order_ref"),
            F.col("lot_id").alias("lot_ref"),
            "wafer_number",
            "product_family",
            "wafer_size",
            _hours(_ts("o_orderdate"), 20).alias("completed_at"),
        )
        .transform(lambda df: schemas.conform(df, schemas.WAFER_INVENTORY))
    )


def wafer_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    k, kk, at = _ks(), _k(), _ts("o_orderdate")
    good = (F.lit(SITES_PER_WAFER) - (F.floor("o_totalprice") % 4)).cast("int")
    ref = (
        F.when(kk % 101 == 0, F.concat(F.lit("UNK-"), k))
        .when(kk % 10 == 3, F.concat(F.lit(" insp_"), k, F.lit(" ")))
        .otherwise(F.concat(F.lit("INSP-"), k))
    )

    def row(ref_: Column, record: Column, when_: Column, good_: Column, family: Column, rev: int):
        return F.struct(
            ref_.alias("inspection_wafer_ref"),
            record.alias("record_id"),
            when_.alias("inspection_at"),
            F.lit(SITES_PER_WAFER).alias("sites_inspected"),
            good_.alias("sites_good"),
            family.alias("failure_family"),
            F.lit(rev).alias("revision"),
        )

    variants = [
        row(
            ref,
            F.concat(F.lit("WI-"), k),
            _hours(at, 7),
            good,
            F.when(good < SITES_PER_WAFER, F.col("o_orderpriority")).otherwise(F.lit("")),
            1,
        ),
        _when(
            kk % 40 == 5,
            row(F.concat(F.lit("INSP-"), k), F.concat(F.lit("WI-"), k, F.lit("-R2")), _hours(at, 9),
                F.lit(SITES_PER_WAFER), F.lit(""), 2),
        ),
        _when(
            kk % 200 == 8,
            row(F.concat(F.lit("insp_"), k), F.concat(F.lit("WI-"), k, F.lit("-B")), _hours(at, 8),
                F.lit(SITES_PER_WAFER - 1), F.col("o_orderpriority"), 1),
        ),
    ]
    return _explode_variants(orders, variants, schemas.WAFER_INSPECTION)


def process_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    k, kk, at = _ks(), _k(), _ts("o_orderdate")

    def row(s: int, stage: str, record: Column, when_: Column, passed: Column) -> Column:
        return F.struct(
            F.concat(F.lit("MES/"), k).alias("mes_wafer_ref"),
            record.alias("record_id"),
            F.lit(stage).alias("stage_code"),
            when_.alias("completed_at"),
            F.concat(F.lit("CELL-"), (((kk + s) % 4) + 1).cast("string")).alias("tool_family"),
            passed.alias("passed"),
            F.when(passed, F.lit("")).otherwise(F.col("o_orderpriority")).alias("failure_family"),
        )

    variants = [
        row(
            s,
            stage,
            F.concat(F.lit("PR-"), k, F.lit(f"-{s}")),
            _hours(at, 8 + 3 * s),
            ((kk * 7 + F.col("o_custkey") + 13 * s) % 37) != 0,
        )
        for s, stage in PROCESS_STAGES
    ]
    # Rework: a second, passing record of the first stage.
    variants.append(
        _when(
            kk % 150 == 13,
            row(1, PROCESS_STAGES[0][1], F.concat(F.lit("PR-"), k, F.lit("-1-RW")), _hours(at, 35),
                F.lit(True)),
        )
    )
    return _explode_variants(orders, variants, schemas.PROCESS_RESULTS)


def lineitem_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip and sorting totals per order: one partial+final aggregation of lineitem."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    q = F.col("l_quantity")
    returned = F.col("l_returnflag") == "R"
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(q).alias("qty_total"),
        F.sum(F.when(~returned, q).otherwise(F.lit(0.0))).alias("qty_good"),
        F.sum(F.when(returned & (F.col("l_linestatus") == "F"), q).otherwise(F.lit(0.0))).alias("qty_ret_f"),
        F.sum(F.when(returned & (F.col("l_linestatus") == "O"), q).otherwise(F.lit(0.0))).alias("qty_ret_o"),
        F.sum(F.when(F.col("l_discount") < SORT_DISCOUNT_LIMIT, q).otherwise(F.lit(0.0))).alias("qty_sort_good"),
        F.max("l_shipdate").alias("last_ship"),
    )


def chip_inspection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = lineitem_per_order(spark, sf_dir)
    k, kk = _ks(), _k()
    total = F.col("qty_total").cast("int")
    good = F.col("qty_good").cast("int")
    dominant = (
        F.when(good == total, F.lit(""))
        .when(F.col("qty_ret_f") >= F.col("qty_ret_o"), F.lit("Return F"))
        .otherwise(F.lit("Return O"))
    )
    ref = F.when(kk % 20 == 4, F.concat(F.lit("sub "), k)).otherwise(F.concat(F.lit("SUB "), k))
    at = _ts("last_ship")

    def row(ref_: Column, record: Column, good_: Column, family: Column, rev: int) -> Column:
        return F.struct(
            ref_.alias("chip_wafer_ref"),
            record.alias("record_id"),
            at.alias("tested_at"),
            total.alias("total_chips"),
            good_.alias("good_chips"),
            family.alias("dominant_failure"),
            F.lit(rev).alias("revision"),
        )

    variants = [
        row(ref, F.concat(F.lit("CIS-"), k), good, dominant, 1),
        _when(kk % 50 == 0, row(ref, F.concat(F.lit("CIS-"), k, F.lit("-R2")), F.least(total, good + 2), dominant, 2)),
        _when(kk % 250 == 9, row(F.concat(F.lit("sub "), k), F.concat(F.lit("CIS-"), k, F.lit("-B")), total, F.lit(""), 1)),
    ]
    return _explode_variants(per_order, variants, schemas.CHIP_INSPECTION_SUMMARY)


def sorting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = lineitem_per_order(spark, sf_dir)
    k, kk = _ks(), _k()
    total = F.col("qty_total").cast("int")
    good = F.col("qty_sort_good").cast("int")
    at = _ts("last_ship")
    return schemas.conform(
        per_order.select(
            F.when(kk % 20 == 6, F.concat(F.lit("sort-"), k))
            .otherwise(F.concat(F.lit("SORT_"), k))
            .alias("sorting_wafer_ref"),
            F.concat(F.lit("SORT-"), k).alias("record_id"),
            F.lit("A").alias("channel"),
            _days(at, 1).alias("process_completed_at"),
            _days(at, 3).alias("record_generated_at"),
            total.alias("total_chips"),
            good.alias("good_chips"),
            F.when(good < total, F.lit("Parameter Drift")).otherwise(F.lit("")).alias("failure_family"),
        ),
        schemas.SORTING_SUMMARY,
    )


def qualification_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (
        _table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderdate", "o_orderstatus")
        .where(F.col("o_orderstatus") != "P")
    )
    k, kk, at = _ks(), _k(), _ts("o_orderdate")
    ref = F.concat(F.lit("QUAL-"), k)

    def row(record: Column, channel: str, when_: Column, passed: Column, rev: int) -> Column:
        return F.struct(
            ref.alias("qualification_wafer_ref"),
            record.alias("record_id"),
            F.lit(channel).alias("channel"),
            when_.alias("qualified_at"),
            passed.alias("passed"),
            F.lit(rev).alias("revision"),
        )

    variants = [
        row(ref, "A", _hours(at, 26), (kk % 19) != 0, 1),
        _when(kk % 38 == 0, row(F.concat(ref, F.lit("-R2")), "A", _hours(at, 50), F.lit(True), 2)),
        _when(kk % 300 == 11, row(F.concat(ref, F.lit("-CB")), "B", _hours(at, 30), F.lit(False), 1)),
    ]
    return _explode_variants(orders, variants, schemas.QUALIFICATION_RESULTS)


def _lineitem_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    )


def _chip_key() -> Column:
    return F.concat_ws(
        "-",
        _ks("l_orderkey"),
        _ks("l_linenumber"),
        _ks("l_partkey"),
        _ks("l_suppkey"),
    )


def chip_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem_detail(spark, sf_dir)
    passed = F.col("l_returnflag") != "R"
    return schemas.conform(
        li.select(
            F.concat(F.lit("CH-"), _chip_key()).alias("chip_record_id"),
            F.concat(F.lit("SUB "), _ks("l_orderkey")).alias("chip_wafer_ref"),
            F.col("l_linenumber").alias("chip_number"),
            ((F.col("l_partkey") % 9) - 4).alias("x"),
            ((F.col("l_suppkey") % 9) - 4).alias("y"),
            passed.alias("passed"),
            F.when(passed, F.lit("")).otherwise(F.concat(F.lit("Return "), F.col("l_linestatus"))).alias(
                "failure_family"
            ),
            _ts("l_shipdate").alias("tested_at"),
            F.lit(1).alias("revision"),
        ),
        schemas.CHIP_DETAIL,
    )


def sorting_parameter_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parameter rows per line item.

    Only the small (parameter, value, limits) struct is exploded; the id and
    alias strings are built outside the generator, so a consumer that needs a
    few columns (e.g. the distinct aliases) never builds the others.
    """
    li = _lineitem_detail(spark, sf_dir)
    params = F.array(
        *[
            F.struct(
                F.lit(name).alias("parameter"),
                F.col(value_column).cast("double").alias("value"),
                F.lit(lower).alias("lower_limit"),
                F.lit(upper).alias("upper_limit"),
            )
            for name, value_column, lower, upper in SORTING_PARAMETERS
        ]
    )
    exploded = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", F.explode(params).alias("_p")
    )
    value = F.col("_p.value")
    return schemas.conform(
        exploded.select(
            F.concat(F.lit("SP-"), _chip_key(), F.lit("-"), F.col("_p.parameter")).alias("parameter_record_id"),
            F.concat(F.lit("SORT_"), _ks("l_orderkey")).alias("sorting_wafer_ref"),
            F.col("l_linenumber").alias("chip_number"),
            F.col("_p.parameter").alias("parameter"),
            value.alias("value"),
            F.col("_p.lower_limit").alias("lower_limit"),
            F.col("_p.upper_limit").alias("upper_limit"),
            ((F.col("_p.lower_limit") <= value) & (value <= F.col("_p.upper_limit"))).alias("passed"),
            _ts("l_shipdate").alias("measured_at"),
        ),
        schemas.SORTING_PARAMETER_DETAIL,
    )


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "identity_aliases": identity_aliases,
    "wafer_inventory": wafer_inventory,
    "wafer_inspection": wafer_inspection,
    "process_results": process_results,
    "chip_inspection_summary": chip_inspection_summary,
    "sorting_summary": sorting_summary,
    "qualification_results": qualification_results,
    "chip_detail": chip_detail,
    "sorting_parameter_detail": sorting_parameter_detail,
}


def source_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    """Lazy source-shaped tables keyed by dataset name."""
    names = names or schemas.COMMON_SOURCES
    return {name: BUILDERS[name](spark, sf_dir) for name in names}
