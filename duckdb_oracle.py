"""Independent SQL formulation of every registered query, for DuckDB.

The driver runs each query twice: the Spark plan from ``queries()`` and the
SQL here, on the same driver tables.  The SQL is written from the yield model
directly (window ``QUALIFY`` for latest rows, ``count(DISTINCT)`` for cohort
completeness, ``UNION ALL`` for variant rows), so it does not share logic with
the Spark plans it checks.  All CTEs live in one prefix; DuckDB only evaluates
those a query references, and :func:`with_ctes` puts no others into its text.

Double columns are rounded to 6 decimals in the final projection of both sides
(float sums depend on the summation order), timestamps are wall-clock UTC.
"""

from __future__ import annotations

import re

from yieldspark import rules
from yieldspark.functions.text import WHITESPACE


def _strip(expr: str) -> str:
    return f"trim(coalesce({expr}, ''), '{WHITESPACE}')"


def _norm(expr: str) -> str:
    return f"upper(replace(replace({_strip(expr)}, ' ', ''), '_', '-'))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def R(col: str, alias: str | None = None) -> str:
    return f"round({col}, 6) AS {alias or col.split('.')[-1]}"


def _key(stage: str, kind: str, record: str, *parts: str) -> str:
    """The fact id of a stage row; ``stage`` and ``kind`` are SQL expressions."""
    texts = [f"replace(replace(coalesce(CAST({x} AS VARCHAR), ''), '%', '%25'), ':', '%3A')" for x in (kind, record, *parts)]
    return f"'YF:' || {stage} || ':' || " + " || ':' || ".join(texts) + " AS fact_key"


def _rules_values() -> str:
    rows = ",\n    ".join(
        f"({_q(s)}, {_q(c)}, {_q(l)}, {o}, {_q(rules.ASSUMPTIONS.get(c, rules.DEFAULT_ASSUMPTION))})"
        for s, c, l, o in rules.DEFAULT_DISPLAY_ROWS
    )
    return f"SELECT * FROM (VALUES\n    {rows}) t(section, stage_code, stage_label, display_order, assumption)"


def _annotate(name: str, kind: str, alias_col: str) -> str:
    return f"""
{name}_ann AS (
  SELECT s.*,
    CASE WHEN e.e_min IS NOT NULL THEN CASE WHEN e.e_min = e.e_max THEN 'RESOLVED' ELSE 'AMBIGUOUS' END
         WHEN n.n_min IS NOT NULL THEN CASE WHEN n.n_min = n.n_max THEN 'RESOLVED' ELSE 'AMBIGUOUS' END
         ELSE 'UNRESOLVED' END AS identity_status,
    CASE WHEN e.e_min IS NOT NULL THEN (CASE WHEN e.e_min = e.e_max THEN e.e_min END)
         WHEN n.n_min IS NOT NULL THEN (CASE WHEN n.n_min = n.n_max THEN n.n_min END) END AS physical_wafer_id,
    CASE WHEN e.e_min IS NOT NULL THEN 'exact alias'
         WHEN n.n_min IS NOT NULL THEN 'normalized alias' ELSE 'no alias match' END AS identity_method
  FROM {name} s
  LEFT JOIN exact_idx e ON e.source_kind = '{kind}' AND e.lookup_alias = {_strip('s.' + alias_col)}
  LEFT JOIN norm_idx n ON n.source_kind = '{kind}' AND n.lookup_alias = {_norm('s.' + alias_col)}
)"""


_PROCESS_STAGES = "(VALUES (1, 'SURFACE_PREPARATION'), (2, 'PATTERN_SEPARATION'), (3, 'PROTECTIVE_FINISH'), (4, 'DEVICE_FORMATION')) st(s, stage_code)"
_ELIGIBLE = ", ".join(_q(c) for _, c, _, _ in rules.DEFAULT_DISPLAY_ROWS if c != "DEVICE_FORMATION")
_WAFER_STAGES = ", ".join(_q(c) for c in rules.WAFER_STAGE_CODES)
_STAGE_COLS = "stage_code, physical_wafer_id, event_time, numerator, denominator, failure_family, source_kind, source_record_id, transformation_rule, identity_method, fact_key"


def _rule(key: str) -> str:
    return _q(rules.RULE_TEXT[key])


CTES = f"""
ords AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS ks, CAST(o_orderdate AS TIMESTAMP) AS od FROM orders),
base AS (
  SELECT o.o_orderkey AS k, o.ks,
    'PHY-' || lpad(o.ks, 7, '0') AS physical_wafer_id,
    'WO-' || lpad(CAST(o.o_custkey AS VARCHAR), 6, '0') AS work_order,
    'LOT-' || n.n_name AS lot_id,
    CAST(o.o_orderkey % 25 + 1 AS INTEGER) AS wafer_number,
    c.c_mktsegment AS product_family,
    r.r_name AS wafer_size
  FROM ords o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
alias_rows AS (
  SELECT 'MES' AS source_kind, 'MES/' || ks AS source_alias, physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size FROM base
  UNION ALL SELECT 'INSPECTION', 'INSP-' || ks, physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size FROM base
  UNION ALL SELECT 'CHIP', 'SUB ' || ks, physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size FROM base
  UNION ALL SELECT 'SORTING', 'SORT_' || ks, physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size FROM base
  UNION ALL SELECT 'QUALIFICATION', 'QUAL-' || ks, physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size FROM base
  UNION ALL SELECT 'INSPECTION', 'INSP-' || CAST(k - 1 AS VARCHAR), physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size FROM base WHERE k % 97 = 1
),
identity_aliases AS (
  SELECT source_kind, source_alias, {_norm('source_alias')} AS normalized_alias,
         physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size
  FROM alias_rows
),
wafer_inspection AS (
  SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'UNK-' || ks WHEN o_orderkey % 10 = 3 THEN ' insp_' || ks || ' ' ELSE 'INSP-' || ks END AS inspection_wafer_ref,
         'WI-' || ks AS record_id, od + INTERVAL 7 HOUR AS inspection_at, 25 AS sites_inspected,
         CAST(25 - (floor(o_totalprice) % 4) AS INTEGER) AS sites_good,
         CASE WHEN 25 - (floor(o_totalprice) % 4) < 25 THEN o_orderpriority ELSE '' END AS failure_family,
         1 AS revision
  FROM ords
  UNION ALL SELECT 'INSP-' || ks, 'WI-' || ks || '-R2', od + INTERVAL 9 HOUR, 25, 25, '', 2 FROM ords WHERE o_orderkey % 40 = 5
  UNION ALL SELECT 'insp_' || ks, 'WI-' || ks || '-B', od + INTERVAL 8 HOUR, 25, 24, o_orderpriority, 1 FROM ords WHERE o_orderkey % 200 = 8
),
process_results AS (
  SELECT 'MES/' || ks AS mes_wafer_ref, 'PR-' || ks || '-' || CAST(s AS VARCHAR) AS record_id, stage_code,
         od + to_hours(8 + 3 * s) AS completed_at,
         'CELL-' || CAST((o_orderkey + s) % 4 + 1 AS VARCHAR) AS tool_family,
         ((7 * o_orderkey + o_custkey + 13 * s) % 37) <> 0 AS passed,
         CASE WHEN ((7 * o_orderkey + o_custkey + 13 * s) % 37) <> 0 THEN '' ELSE o_orderpriority END AS failure_family
  FROM ords CROSS JOIN {_PROCESS_STAGES}
  UNION ALL SELECT 'MES/' || ks, 'PR-' || ks || '-1-RW', 'SURFACE_PREPARATION', od + INTERVAL 35 HOUR,
         'CELL-' || CAST((o_orderkey + 1) % 4 + 1 AS VARCHAR), true, '' FROM ords WHERE o_orderkey % 150 = 13
),
li_order AS (
  SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS ks,
         CAST(sum(l_quantity) AS INTEGER) AS total,
         CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS INTEGER) AS good,
         sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS ret_f,
         sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS ret_o,
         CAST(sum(CASE WHEN l_discount < 0.095 THEN l_quantity ELSE 0 END) AS INTEGER) AS sort_good,
         CAST(max(l_shipdate) AS TIMESTAMP) AS ship_at
  FROM lineitem GROUP BY l_orderkey
),
chip_src AS (
  SELECT *, CASE WHEN k % 20 = 4 THEN 'sub ' || ks ELSE 'SUB ' || ks END AS ref,
         CASE WHEN good = total THEN '' WHEN ret_f >= ret_o THEN 'Return F' ELSE 'Return O' END AS dom
  FROM li_order
),
chip_inspection_summary AS (
  SELECT ref AS chip_wafer_ref, 'CIS-' || ks AS record_id, ship_at AS tested_at, total AS total_chips, good AS good_chips, dom AS dominant_failure, 1 AS revision FROM chip_src
  UNION ALL SELECT ref, 'CIS-' || ks || '-R2', ship_at, total, least(total, good + 2), dom, 2 FROM chip_src WHERE k % 50 = 0
  UNION ALL SELECT 'sub ' || ks, 'CIS-' || ks || '-B', ship_at, total, total, '', 1 FROM chip_src WHERE k % 250 = 9
),
sorting_summary AS (
  SELECT CASE WHEN k % 20 = 6 THEN 'sort-' || ks ELSE 'SORT_' || ks END AS sorting_wafer_ref,
         'SORT-' || ks AS record_id, 'A' AS channel,
         ship_at + INTERVAL 1 DAY AS process_completed_at, ship_at + INTERVAL 3 DAY AS record_generated_at,
         total AS total_chips, sort_good AS good_chips,
         CASE WHEN sort_good < total THEN 'Parameter Drift' ELSE '' END AS failure_family
  FROM li_order
),
q_ords AS (SELECT * FROM ords WHERE o_orderstatus <> 'P'),
qualification_results AS (
  SELECT 'QUAL-' || ks AS qualification_wafer_ref, 'QUAL-' || ks AS record_id, 'A' AS channel,
         od + INTERVAL 26 HOUR AS qualified_at, o_orderkey % 19 <> 0 AS passed, 1 AS revision FROM q_ords
  UNION ALL SELECT 'QUAL-' || ks, 'QUAL-' || ks || '-R2', 'A', od + INTERVAL 50 HOUR, true, 2 FROM q_ords WHERE o_orderkey % 38 = 0
  UNION ALL SELECT 'QUAL-' || ks, 'QUAL-' || ks || '-CB', 'B', od + INTERVAL 30 HOUR, false, 1 FROM q_ords WHERE o_orderkey % 300 = 11
),
chip_detail AS (
  SELECT 'CH-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS chip_record_id,
         'SUB ' || l_orderkey AS chip_wafer_ref, l_linenumber AS chip_number,
         CAST(l_partkey % 9 - 4 AS INTEGER) AS x, CAST(l_suppkey % 9 - 4 AS INTEGER) AS y,
         l_returnflag <> 'R' AS passed,
         CASE WHEN l_returnflag <> 'R' THEN '' ELSE 'Return ' || l_linestatus END AS failure_family,
         CAST(l_shipdate AS TIMESTAMP) AS tested_at, 1 AS revision
  FROM lineitem
),
sp_params AS (
  SELECT 'CH-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ck,
         'SORT_' || l_orderkey AS sorting_wafer_ref, l_linenumber AS chip_number,
         l_quantity, l_discount, l_tax, CAST(l_shipdate AS TIMESTAMP) AS measured_at
  FROM lineitem
),
sorting_parameter_detail AS (
  SELECT replace(ck, 'CH-', 'SP-') || '-QTY' AS parameter_record_id, sorting_wafer_ref, chip_number, 'QTY' AS parameter,
         CAST(l_quantity AS DOUBLE) AS value, 1.0::DOUBLE AS lower_limit, 45.0::DOUBLE AS upper_limit,
         1.0::DOUBLE <= l_quantity AND l_quantity <= 45.0::DOUBLE AS passed, measured_at FROM sp_params
  UNION ALL SELECT replace(ck, 'CH-', 'SP-') || '-DISC', sorting_wafer_ref, chip_number, 'DISC', CAST(l_discount AS DOUBLE),
         0.0::DOUBLE, 0.095::DOUBLE, 0.0::DOUBLE <= l_discount AND l_discount <= 0.095::DOUBLE, measured_at FROM sp_params
  UNION ALL SELECT replace(ck, 'CH-', 'SP-') || '-TAX', sorting_wafer_ref, chip_number, 'TAX', CAST(l_tax AS DOUBLE),
         0.0::DOUBLE, 0.075::DOUBLE, 0.0::DOUBLE <= l_tax AND l_tax <= 0.075::DOUBLE, measured_at FROM sp_params
),
rules_t AS ({_rules_values()}),
exact_idx AS (
  SELECT source_kind, source_alias AS lookup_alias, min(physical_wafer_id) AS e_min, max(physical_wafer_id) AS e_max
  FROM identity_aliases GROUP BY source_kind, source_alias
),
norm_idx AS (
  SELECT source_kind, normalized_alias AS lookup_alias, min(physical_wafer_id) AS n_min, max(physical_wafer_id) AS n_max
  FROM identity_aliases GROUP BY source_kind, normalized_alias
),
{_annotate('wafer_inspection', 'INSPECTION', 'inspection_wafer_ref').strip()},
{_annotate('process_results', 'MES', 'mes_wafer_ref').strip()},
{_annotate('chip_inspection_summary', 'CHIP', 'chip_wafer_ref').strip()},
{_annotate('sorting_summary', 'SORTING', 'sorting_wafer_ref').strip()},
{_annotate('qualification_results', 'QUALIFICATION', 'qualification_wafer_ref').strip()},
{_annotate('chip_detail', 'CHIP', 'chip_wafer_ref').strip()},
{_annotate('sorting_parameter_detail', 'SORTING', 'sorting_wafer_ref').strip()},
identity_audit AS (
  SELECT 'INSPECTION' AS source_kind, record_id AS source_record_id, inspection_wafer_ref AS source_alias, identity_status, physical_wafer_id, identity_method FROM wafer_inspection_ann
  UNION ALL SELECT 'MES', record_id, mes_wafer_ref, identity_status, physical_wafer_id, identity_method FROM process_results_ann
  UNION ALL SELECT 'CHIP', record_id, chip_wafer_ref, identity_status, physical_wafer_id, identity_method FROM chip_inspection_summary_ann
  UNION ALL SELECT 'SORTING', record_id, sorting_wafer_ref, identity_status, physical_wafer_id, identity_method FROM sorting_summary_ann
  UNION ALL SELECT 'QUALIFICATION', record_id, qualification_wafer_ref, identity_status, physical_wafer_id, identity_method FROM qualification_results_ann
),
master AS (
  SELECT physical_wafer_id, work_order, lot_id, wafer_number, product_family, wafer_size
  FROM identity_aliases
  QUALIFY row_number() OVER (PARTITION BY physical_wafer_id ORDER BY source_kind, source_alias, work_order, lot_id, wafer_number, product_family, wafer_size) = 1
),
insp_latest AS (
  SELECT * FROM wafer_inspection_ann WHERE identity_status = 'RESOLVED'
  QUALIFY row_number() OVER (PARTITION BY inspection_wafer_ref ORDER BY revision DESC, record_id DESC) = 1
),
chip_latest AS (
  SELECT * FROM chip_inspection_summary_ann WHERE identity_status = 'RESOLVED'
  QUALIFY row_number() OVER (PARTITION BY chip_wafer_ref ORDER BY revision DESC, record_id DESC) = 1
),
qual_latest AS (
  SELECT * FROM qualification_results_ann WHERE identity_status = 'RESOLVED'
  QUALIFY row_number() OVER (PARTITION BY qualification_wafer_ref, channel ORDER BY revision DESC, record_id DESC) = 1
),
proc_res AS (SELECT * FROM process_results_ann WHERE identity_status = 'RESOLVED'),
sort_res AS (SELECT * FROM sorting_summary_ann WHERE identity_status = 'RESOLVED'),
chip_w AS (SELECT * FROM chip_latest QUALIFY row_number() OVER (PARTITION BY physical_wafer_id ORDER BY revision DESC, tested_at DESC, record_id DESC) = 1),
qual_w AS (SELECT * FROM qual_latest QUALIFY row_number() OVER (PARTITION BY physical_wafer_id ORDER BY revision DESC, qualified_at DESC, record_id DESC) = 1),
sort_w AS (SELECT * FROM sort_res QUALIFY row_number() OVER (PARTITION BY physical_wafer_id ORDER BY process_completed_at DESC, record_id DESC) = 1),
form_w AS (SELECT * FROM proc_res WHERE stage_code = 'DEVICE_FORMATION' QUALIFY row_number() OVER (PARTITION BY physical_wafer_id ORDER BY completed_at DESC, record_id DESC) = 1),
s_wafer_inspection AS (
  SELECT 'WAFER_INSPECTION' AS stage_code, physical_wafer_id, inspection_at AS event_time,
         CAST(sites_good AS DOUBLE) AS numerator, CAST(sites_inspected AS DOUBLE) AS denominator, failure_family,
         'INSPECTION' AS source_kind, record_id AS source_record_id, {_rule('WAFER_INSPECTION')} AS transformation_rule, identity_method,
         {_key("'WAFER_INSPECTION'", "'INSPECTION'", 'record_id', 'inspection_wafer_ref', 'revision')}
  FROM insp_latest
),
s_process AS (
  SELECT stage_code, physical_wafer_id, completed_at AS event_time,
         CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS numerator, 1.0::DOUBLE AS denominator, failure_family,
         'MES' AS source_kind, record_id AS source_record_id, {_rule('PROCESS')} AS transformation_rule, identity_method,
         {_key('stage_code', "'MES'", 'record_id', 'mes_wafer_ref', 'completed_at')}
  FROM proc_res WHERE stage_code IN ({_ELIGIBLE})
),
s_chip_inspection AS (
  SELECT 'CHIP_INSPECTION' AS stage_code, physical_wafer_id, tested_at AS event_time,
         CAST(good_chips AS DOUBLE) AS numerator, CAST(total_chips AS DOUBLE) AS denominator, dominant_failure AS failure_family,
         'CHIP' AS source_kind, record_id AS source_record_id, {_rule('CHIP_INSPECTION')} AS transformation_rule, identity_method,
         {_key("'CHIP_INSPECTION'", "'CHIP'", 'record_id', 'chip_wafer_ref', 'revision')}
  FROM chip_latest
),
s_auto_outlier AS (
  SELECT 'AUTO_OUTLIER' AS stage_code, physical_wafer_id, tested_at AS event_time,
         CAST(total_chips - ol AS DOUBLE) AS numerator, CAST(total_chips AS DOUBLE) AS denominator,
         CASE WHEN ol > 0 THEN {_q(rules.AUTO_OUTLIER_FAMILY)} ELSE '' END AS failure_family,
         'CHIP' AS source_kind, record_id AS source_record_id, {_rule('AUTO_OUTLIER')} AS transformation_rule, identity_method,
         {_key("'AUTO_OUTLIER'", "'CHIP'", 'record_id', 'chip_wafer_ref', 'revision')}
  FROM (SELECT *, CASE WHEN TRY_CAST(string_split(physical_wafer_id, '-')[-1] AS BIGINT) % 11 = 0 THEN 1 ELSE 0 END AS ol FROM chip_latest)
),
s_sorting AS (
  SELECT 'SORTING' AS stage_code, physical_wafer_id, process_completed_at AS event_time,
         CAST(good_chips AS DOUBLE) AS numerator, CAST(total_chips AS DOUBLE) AS denominator, failure_family,
         'SORTING' AS source_kind, record_id AS source_record_id, {_rule('SORTING')} AS transformation_rule, identity_method,
         {_key("'SORTING'", "'SORTING'", 'record_id', 'sorting_wafer_ref', 'channel')}
  FROM sort_res
),
s_qualification AS (
  SELECT 'QUALIFICATION' AS stage_code, physical_wafer_id, qualified_at AS event_time,
         CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS numerator, 1.0::DOUBLE AS denominator,
         CASE WHEN passed THEN '' ELSE {_q(rules.QUALIFICATION_HOLD)} END AS failure_family,
         'QUALIFICATION' AS source_kind, record_id AS source_record_id, {_rule('QUALIFICATION')} AS transformation_rule, identity_method,
         {_key("'QUALIFICATION'", "'QUALIFICATION'", 'record_id', 'qualification_wafer_ref', 'channel', 'revision')}
  FROM qual_latest
),
wafer_total_src AS (
  SELECT physical_wafer_id, product(numerator / denominator) AS y, max(event_time) AS t
  FROM (SELECT * FROM s_wafer_inspection UNION ALL SELECT * FROM s_process)
  WHERE denominator > 0 AND stage_code IN ({_WAFER_STAGES})
  GROUP BY physical_wafer_id
  HAVING count(DISTINCT stage_code) = 4
),
s_wafer_total AS (
  SELECT 'WAFER_TOTAL' AS stage_code, physical_wafer_id, t AS event_time, y AS numerator, 1.0::DOUBLE AS denominator,
         CASE WHEN y < 1 THEN {_q(rules.WAFER_TOTAL_LOSS)} ELSE '' END AS failure_family,
         'PREPARED' AS source_kind, 'WAFER-TOTAL-' || physical_wafer_id AS source_record_id,
         {_rule('WAFER_TOTAL')} AS transformation_rule, {_q(rules.WAFER_COHORT_METHOD)} AS identity_method,
         {_key("'WAFER_TOTAL'", "'PREPARED'", "'WAFER-TOTAL-' || physical_wafer_id")}
  FROM wafer_total_src
),
s_device_formation AS (
  SELECT 'DEVICE_FORMATION' AS stage_code, f.physical_wafer_id, f.completed_at AS event_time,
         CASE WHEN coalesce(f.passed, false) THEN CAST(c.total_chips AS DOUBLE)
              ELSE greatest(0.0::DOUBLE, CAST(c.total_chips AS DOUBLE) - 9) END AS numerator,
         CAST(c.total_chips AS DOUBLE) AS denominator, f.failure_family,
         'MES' AS source_kind, f.record_id AS source_record_id, {_rule('DEVICE_FORMATION')} AS transformation_rule, f.identity_method,
         {_key("'DEVICE_FORMATION'", "'MES'", 'f.record_id')}
  FROM form_w f JOIN chip_w c ON f.physical_wafer_id = c.physical_wafer_id
),
cohort_src AS (
  SELECT q.physical_wafer_id, q.qualified_at AS event_time, CAST(c.total_chips AS DOUBLE) AS total_chips,
         CAST(c.good_chips AS DOUBLE) / CAST(c.total_chips AS DOUBLE) AS chip_inspection,
         CASE WHEN coalesce(f.passed, false) THEN 1.0::DOUBLE
              ELSE (CAST(c.total_chips AS DOUBLE) - 9) / CAST(c.total_chips AS DOUBLE) END AS device_formation,
         CAST(s.good_chips AS DOUBLE) / CAST(s.total_chips AS DOUBLE) AS sorting,
         CASE WHEN q.passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS qualification
  FROM qual_w q
  JOIN chip_w c ON q.physical_wafer_id = c.physical_wafer_id
  JOIN sort_w s ON q.physical_wafer_id = s.physical_wafer_id
  JOIN form_w f ON q.physical_wafer_id = f.physical_wafer_id
  WHERE c.total_chips > 0 AND s.total_chips > 0
),
cohort AS (
  SELECT *, round_even(total_chips * ((((1.0::DOUBLE * chip_inspection) * device_formation) * sorting) * qualification), 0) AS final_good
  FROM cohort_src
),
s_final_chip_yield AS (
  SELECT 'FINAL_CHIP_YIELD' AS stage_code, physical_wafer_id, event_time, final_good AS numerator, total_chips AS denominator,
         CASE WHEN final_good < total_chips THEN {_q(rules.FINAL_COMPONENT_LOSS)} ELSE '' END AS failure_family,
         'PREPARED' AS source_kind, 'FINAL-' || physical_wafer_id AS source_record_id,
         {_rule('FINAL_CHIP_YIELD')} AS transformation_rule, {_q(rules.FINAL_COHORT_METHOD)} AS identity_method,
         {_key("'FINAL_CHIP_YIELD'", "'PREPARED'", "'FINAL-' || physical_wafer_id")}
  FROM cohort
),
stage_all AS (
  SELECT {_STAGE_COLS} FROM s_wafer_inspection
  UNION ALL SELECT {_STAGE_COLS} FROM s_process
  UNION ALL SELECT {_STAGE_COLS} FROM s_chip_inspection
  UNION ALL SELECT {_STAGE_COLS} FROM s_auto_outlier
  UNION ALL SELECT {_STAGE_COLS} FROM s_sorting
  UNION ALL SELECT {_STAGE_COLS} FROM s_qualification
  UNION ALL SELECT {_STAGE_COLS} FROM s_wafer_total
  UNION ALL SELECT {_STAGE_COLS} FROM s_device_formation
  UNION ALL SELECT {_STAGE_COLS} FROM s_final_chip_yield
),
enriched AS (
  SELECT s.fact_key AS yield_record_id,
         r.section, s.stage_code, r.stage_label, r.display_order,
         s.physical_wafer_id, m.work_order, m.lot_id, m.wafer_number, m.product_family, m.wafer_size,
         s.event_time, s.numerator, s.denominator, s.numerator / s.denominator AS yield_rate,
         coalesce(s.failure_family, '') AS failure_family,
         s.source_kind, s.source_record_id, s.identity_method, s.transformation_rule
  FROM stage_all s
  JOIN master m ON s.physical_wafer_id = m.physical_wafer_id
  JOIN rules_t r ON s.stage_code = r.stage_code
  WHERE s.denominator > 0
),
yield_fact AS (
  SELECT yield_record_id, section, stage_code, stage_label, display_order, physical_wafer_id, work_order, lot_id,
         wafer_number, product_family, wafer_size, event_time, numerator, denominator, yield_rate, failure_family
  FROM enriched
),
failure_fact AS (
  SELECT yield_record_id, stage_code, stage_label, physical_wafer_id, work_order, product_family, event_time,
         CASE WHEN coalesce(failure_family, '') = '' THEN {_q(rules.UNCLASSIFIED_LOSS)} ELSE failure_family END AS failure_family,
         greatest(0.0::DOUBLE, denominator - numerator) AS failure_quantity
  FROM enriched WHERE greatest(0.0::DOUBLE, denominator - numerator) > 0
),
lineage AS (
  SELECT yield_record_id, source_kind, source_record_id, identity_method, transformation_rule FROM enriched
),
final_component_fact AS (
  SELECT c.physical_wafer_id, m.work_order, m.product_family, c.event_time, c.total_chips, c.chip_inspection,
         c.device_formation, c.sorting, c.qualification, c.final_good / c.total_chips AS final_chip_yield
  FROM cohort c JOIN master m ON c.physical_wafer_id = m.physical_wafer_id
),
targeted_chip_detail AS (
  SELECT * EXCLUDE (identity_method) FROM chip_detail_ann
  WHERE identity_status = 'RESOLVED'
    AND chip_wafer_ref IN (SELECT source_alias FROM identity_aliases WHERE source_kind = 'CHIP')
),
targeted_sorting_detail AS (
  SELECT * EXCLUDE (identity_method) FROM sorting_parameter_detail_ann
  WHERE identity_status = 'RESOLVED'
    AND sorting_wafer_ref IN (SELECT source_alias FROM identity_aliases WHERE source_kind = 'SORTING')
)"""


def _named(ctes: str) -> dict[str, str]:
    """The CTEs by name, in order; each begins a line with ``name AS (``."""
    starts = [*re.finditer(r"^(\w+) AS \(", ctes, re.M)]
    ends = [m.start() for m in starts[1:]] + [len(ctes)]
    return {m.group(1): ctes[m.start() : end].rstrip().rstrip(",") for m, end in zip(starts, ends, strict=True)}


def with_ctes(select: str, extra: str | None = None) -> str:
    """The shared CTEs that the SELECT needs, directly or through others, then optional extra CTEs and the SELECT."""
    named = _named(CTES)
    needed: set[str] = set()
    open_ = [select, extra or ""]
    while open_:
        words = set(re.findall(r"\w+", open_.pop()))
        for name in words & named.keys() - needed:
            needed.add(name)
            open_.append(named[name])
    parts = [text for name, text in named.items() if name in needed] + ([extra.strip()] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def week_label(t: str) -> str:
    return (
        f"strftime(date_trunc('week', {t}), '%Y-%m-%d') || '/' || "
        f"strftime(date_trunc('week', {t}) + INTERVAL 6 DAY, '%Y-%m-%d')"
    )


def period_sql(t: str, mode: str) -> str:
    if mode == "Day":
        return f"strftime({t}, '%Y-%m-%d')"
    if mode == "Week":
        return week_label(t)
    if mode == "Month":
        return f"strftime({t}, '%Y-%m')"
    if mode == "Quarter":
        return f"CAST(year({t}) AS VARCHAR) || 'Q' || CAST(quarter({t}) AS VARCHAR)"
    return f"strftime({t}, '%Y')"


def filter_sql(product: str | None = None, wafer_size: str | None = None, work_order: str | None = None,
               start: str | None = None, end: str | None = None, has_size: bool = True) -> str:
    conds = ["TRUE"]
    if product:
        conds.append(f"product_family = {_q(product)}")
    if work_order:
        conds.append(f"work_order = {_q(work_order)}")
    if wafer_size and has_size:
        conds.append(f"wafer_size = {_q(wafer_size)}")
    if start:
        conds.append(f"event_time >= TIMESTAMP {_q(start + ' 00:00:00')}")
    if end:
        conds.append(f"event_time < CAST(DATE {_q(end)} + INTERVAL 1 DAY AS TIMESTAMP)")
    return " AND ".join(conds)
