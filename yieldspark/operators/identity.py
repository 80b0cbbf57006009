"""Identity resolution: map each source's alias to one physical wafer.

Plan shape, chosen for scale and skew:

* The alias index is an aggregate ``(source_kind, alias) -> min(id), max(id)``;
  an alias is ambiguous exactly when ``min <> max``.  This is a plain hash
  aggregate with map-side partial aggregation (no distinct aggregation), so an
  alias owned by millions of rows still shuffles one partial row per task.
* Resolution is computed once per **distinct** ``(source_kind, raw alias)``,
  not per record (stripping and normalizing touch distinct values only): detail tables carry hundreds of rows per alias, and the two
  lookups (exact, then normalized) only ever touch the distinct keys.
* Records then take one equi-join on the raw alias to the resolution table.  That table has
  one row per key, so the join is N:1; AQE broadcasts it when its measured
  size is small and splits hot record partitions (skew join) otherwise.
* A staged build (:func:`annotate_in_steps`) joins a source's records straight
  with the claims of its kind's aliases, and looks up the normalized form only
  of those that the exact lookup left: records and alias rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldspark import rules
from yieldspark.functions.text import lookup_alias, normalize_alias

RESOLUTION_COLUMNS = ("identity_status", "physical_wafer_id", "identity_method")
WAFER_ATTRIBUTES = ("work_order", "lot_id", "wafer_number", "product_family", "wafer_size")


def with_wafer_attributes(resolution: DataFrame, master: DataFrame) -> DataFrame:
    """Attach the resolved wafer's master attributes to each resolution row.

    The resolution has one row per distinct alias, far fewer than the records;
    joining the master here lets every annotated record carry its wafer's
    attributes, so the facts need no join with the master later.
    """
    return resolution.join(master.select("physical_wafer_id", *WAFER_ATTRIBUTES), "physical_wafer_id", "left")


def carries_attributes(frame: DataFrame) -> bool:
    return all(c in frame.columns for c in WAFER_ATTRIBUTES)


def with_master_attributes(aliases: DataFrame, mixed: DataFrame) -> DataFrame:
    """Alias rows with the attributes of their wafer's master row.

    ``mixed`` holds the master rows of the wafers whose alias rows differ;
    elsewhere every alias row has its master's attributes already.
    """
    master = mixed.select("physical_wafer_id", F.struct(*WAFER_ATTRIBUTES).alias("_master"))
    attributes = [F.when(F.col("_master").isNull(), F.col(c)).otherwise(F.col(f"_master.{c}")).alias(c) for c in WAFER_ATTRIBUTES]
    others = [c for c in aliases.columns if c not in WAFER_ATTRIBUTES]
    return aliases.join(master, "physical_wafer_id", "left").select(*others, *attributes)


def alias_index(aliases: DataFrame, key_column: str) -> DataFrame:
    """``(source_kind, lookup_alias, min_id, max_id)`` over an alias column.

    Index keys are used as stored (not stripped); only lookups are stripped.
    """
    return aliases.groupBy(
        F.col("source_kind"), F.col(key_column).cast("string").alias("lookup_alias")
    ).agg(
        F.min("physical_wafer_id").alias("min_id"),
        F.max("physical_wafer_id").alias("max_id"),
    )


def resolve_keys(aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """Resolve distinct ``(source_kind, raw_alias)`` keys.

    The raw alias is stripped (and normalized) here, once per distinct value,
    never per record.  Exact match first: one wafer → RESOLVED, several →
    AMBIGUOUS (and the normalized lookup is *not* tried).  Otherwise the
    normalized alias is looked up the same way; otherwise UNRESOLVED.
    """
    exact = alias_index(aliases, "source_alias").select(
        "source_kind", "lookup_alias", F.col("min_id").alias("e_min"), F.col("max_id").alias("e_max")
    )
    normalized = alias_index(aliases, "normalized_alias").select(
        "source_kind",
        F.col("lookup_alias").alias("normalized_key"),
        F.col("min_id").alias("n_min"),
        F.col("max_id").alias("n_max"),
    )
    if "key_rows" in keys.columns:
        # Records per source: one row per source table (a fixed, small set).
        totals = keys.groupBy("source").agg(F.sum("key_rows").alias("source_rows"))
        keys = keys.join(F.broadcast(totals), "source")
    joined = (
        keys.withColumn("lookup_alias", lookup_alias(F.col("raw_alias")))
        .join(exact, ["source_kind", "lookup_alias"], "left")
        .withColumn("normalized_key", normalize_alias(F.col("lookup_alias")))
        .join(normalized, ["source_kind", "normalized_key"], "left")
    )
    has_exact = F.col("e_min").isNotNull()
    has_norm = F.col("n_min").isNotNull()
    status = (
        F.when(has_exact, F.when(F.col("e_min") == F.col("e_max"), rules.RESOLVED).otherwise(rules.AMBIGUOUS))
        .when(has_norm, F.when(F.col("n_min") == F.col("n_max"), rules.RESOLVED).otherwise(rules.AMBIGUOUS))
        .otherwise(rules.UNRESOLVED)
    )
    method = (
        F.when(has_exact, F.lit(rules.EXACT_METHOD))
        .when(has_norm, F.lit(rules.NORMALIZED_METHOD))
        .otherwise(F.lit(rules.NO_MATCH_METHOD))
    )
    wafer = F.when(status == rules.RESOLVED, F.when(has_exact, F.col("e_min")).otherwise(F.col("n_min")))
    counts = [c for c in ("source", "key_rows", "source_rows") if c in keys.columns]
    return joined.select(
        "source_kind",
        "raw_alias",
        *counts,
        status.alias("identity_status"),
        wafer.alias("physical_wafer_id"),
        method.alias("identity_method"),
    )


def ref_key(column: Column) -> Column:
    """Join key of a record's alias: the raw text, null folded into empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def lookup_keys(records: DataFrame, source_kind: str, alias_column: str, source: str | None = None) -> DataFrame:
    """Distinct raw aliases of one source with their record counts.

    One partial+final aggregation; the count later identifies hot aliases
    without another pass over the records.  ``source`` names the table, as two
    tables may share a kind and each has hot aliases of its own.
    """
    return records.groupBy(
        F.lit(source or source_kind).alias("source"),
        F.lit(source_kind).alias("source_kind"),
        ref_key(F.col(alias_column)).alias("raw_alias"),
    ).agg(F.count(F.lit(1)).alias("key_rows"))


@dataclass(frozen=True)
class HotKeyPolicy:
    """How to split hot aliases in the record ⋈ resolution join.

    A key is hot when it holds at least ``fraction`` of its source's records;
    there can be at most ``1 / fraction`` such keys, which bounds what is
    broadcast, whatever the size.  The per-source totals travel with the
    resolution table, so no count is gathered on the driver.  Hot keys are
    spread over ``buckets`` salted join partitions.
    """

    fraction: float = 0.01
    buckets: int = 64


def _hot(counted: DataFrame, policy: HotKeyPolicy) -> DataFrame:
    # Bounded: at most 1/fraction keys of a source can reach the threshold.
    return counted.where(F.col("key_rows") >= F.lit(policy.fraction) * F.col("source_rows")).select(
        "_ref", F.lit(policy.buckets).alias("_buckets")
    )


def _salted_join(records: DataFrame, scoped: DataFrame, record_column: str, hot: DataFrame, how: str) -> DataFrame:
    salted_records = (
        records.join(F.broadcast(hot), "_ref", "left")
        .withColumn(
            "_salt",
            F.when(
                F.col("_buckets").isNotNull(),
                F.pmod(F.xxhash64(F.col(record_column).cast("string")), F.col("_buckets")),
            ).otherwise(F.lit(0)),
        )
        .drop("_buckets")
    )
    replicated = (
        scoped.join(F.broadcast(hot), "_ref", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_buckets") - 1, F.lit(0)))))
        .drop("_buckets")
    )
    return salted_records.join(replicated, ["_ref", "_salt"], how).drop("_salt")


def annotate(
    records: DataFrame,
    source_kind: str,
    alias_column: str,
    resolution: DataFrame,
    *,
    source: str | None = None,
    record_column: str | None = None,
    hot_keys: HotKeyPolicy | None = None,
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Append identity_status, physical_wafer_id, identity_method to every record.

    One N:1 equi-join on the raw alias; no per-record string work.  With a
    ``hot_keys`` policy (and ``key_rows`` counts in the resolution table),
    aliases that hold a large share of the records are salted so their rows
    are joined by many tasks instead of one; without it, AQE's skew-join
    splitting is relied on.  ``how="inner"`` keeps only records whose alias
    the resolution table holds.  ``hot`` lists the hot aliases where the caller
    has them (see :func:`hot_aliases`).
    """
    def counted(name: str) -> Column:
        return F.col(name) if name in resolution.columns else F.lit(None).cast("bigint")

    attributes = list(WAFER_ATTRIBUTES) if carries_attributes(resolution) else []
    mine = F.col("source_kind") == source_kind
    if "source" in resolution.columns:
        mine &= F.col("source") == (source or source_kind)
    scoped = resolution.where(mine).select(
        F.col("raw_alias").alias("_ref"), counted("key_rows").alias("key_rows"),
        counted("source_rows").alias("source_rows"), *RESOLUTION_COLUMNS, *attributes
    )
    if "physical_wafer_id" in records.columns:
        records = records.drop("physical_wafer_id")
    keyed = records.withColumn("_ref", ref_key(F.col(alias_column)))
    if hot_keys is not None and record_column is not None:
        joined = _salted_join(keyed, scoped, record_column, _hot(scoped, hot_keys) if hot is None else hot, how)
    else:
        joined = keyed.join(scoped, "_ref", how)
    return (
        joined.drop("_ref", "key_rows", "source_rows")
        .withColumn(
            "identity_status", F.coalesce(F.col("identity_status"), F.lit(rules.UNRESOLVED))
        )
        .withColumn(
            "identity_method", F.coalesce(F.col("identity_method"), F.lit(rules.NO_MATCH_METHOD))
        )
    )


def hot_aliases(resolution: DataFrame, source: str, policy: HotKeyPolicy) -> DataFrame:
    """The hot aliases of a source by the counts of its resolution table."""
    mine = resolution.where(F.col("source") == source)
    return _hot(mine.select(F.col("raw_alias").alias("_ref"), "key_rows", "source_rows"), policy)


def policy_for(resolution: DataFrame, source: str, policy: HotKeyPolicy | None) -> HotKeyPolicy | None:
    """``policy`` where a staged resolution table has hot aliases of the source, else none: a join on the alias alone."""
    return None if policy is None or hot_aliases(resolution, source, policy).isEmpty() else policy


def _hot_lookups(keyed: DataFrame, policy: HotKeyPolicy) -> DataFrame:
    """Lookup texts that hold ``fraction`` of the records or more, by one sketch a task in place of a count of every text.

    The sketch keeps the most frequent texts, ``10 / fraction`` of them at
    least, and is never off by more than a fifth of ``fraction`` of the records.  It never
    counts too few, so no hot text is missed; one a little below may be taken.
    """
    kept = round(10 / policy.fraction)
    top = keyed.agg(F.expr(f"approx_top_k(_ref, {kept // 5}, {kept})").alias("top"), F.count(F.lit(1)).alias("source_rows"))
    counted = top.select(F.explode("top").alias("_t"), "source_rows")
    return _hot(counted.select(F.col("_t.item").alias("_ref"), F.col("_t.count").alias("key_rows"), "source_rows"), policy)


def _claims(aliases: DataFrame, key_column: str) -> DataFrame:
    """The least wafer (with its attributes) and the greatest that claim each value of an alias column."""
    wafer = F.col("physical_wafer_id")
    first = F.when(wafer.isNotNull(), F.struct(wafer, *WAFER_ATTRIBUTES))
    return aliases.groupBy(F.col(key_column).cast("string").alias("_ref")).agg(F.min(first).alias("_first"), F.max(wafer).alias("_last"))


def _looked_up(joined: DataFrame, columns: list[str], method: str, otherwise: tuple[str | None, str | None]) -> DataFrame:
    """The record columns, resolution and attributes of records joined with claims; ``otherwise`` is the status and method of the others."""
    found, one = F.col("_first").isNotNull(), F.col("_first.physical_wafer_id") == F.col("_last")
    status, no_method = map(F.lit, otherwise)
    return joined.select(
        *columns,
        F.when(found, F.when(one, rules.RESOLVED).otherwise(rules.AMBIGUOUS)).otherwise(status).alias("identity_status"),
        F.when(one, F.col("_first.physical_wafer_id")).alias("physical_wafer_id"),
        F.when(found, F.lit(method)).otherwise(no_method).alias("identity_method"),
        *[F.when(one, F.col(f"_first.{c}")).alias(c) for c in WAFER_ATTRIBUTES],
    )


def annotate_in_steps(
    records: DataFrame,
    aliases: DataFrame,
    name: str,
    stage: Callable[[str, DataFrame], DataFrame],
    hot_keys: HotKeyPolicy | None = None,
) -> DataFrame:
    """What :func:`annotate` appends, with the wafer's attributes, from the alias rows themselves.

    ``aliases`` carry their master's attributes.  Records join the claims of
    the exact aliases; those that none matches (by ``missed``, their distinct
    normalized forms) join the claims of the normalized ones.  ``stage`` writes
    each step, so the sizes of the small ones are known to the planner.  Without
    a hot alias there is no salt, and the claims are joined where their
    aggregate left them.
    """
    kind, alias_column, record_column = SOURCE_IDENTITY[name]
    mine = aliases.where(F.col("source_kind") == kind)
    records = records.drop("physical_wafer_id")
    columns = records.columns
    keyed = records.withColumn("_ref", lookup_alias(F.col(alias_column)))
    exact = _claims(mine, "source_alias")
    hot = None if hot_keys is None else stage(f"hot_{name}", _hot_lookups(keyed, hot_keys))
    if hot is None or hot.isEmpty():
        joined = keyed.join(exact, "_ref", "left")
    else:
        joined = _salted_join(keyed, exact, record_column, hot, "left")
    tried = stage(f"exact_{name}", _looked_up(joined, columns, rules.EXACT_METHOD, (None, None)))
    rest = tried.where(F.col("identity_status").isNull()).select(*columns).withColumn("_ref", normalize_alias(F.col(alias_column)))
    missed = stage(f"missed_{name}", rest.select("_ref").distinct())
    near = mine.join(missed, mine["normalized_alias"] == missed["_ref"], "left_semi")
    normalized = stage(f"normalized_{name}", _claims(near, "normalized_alias"))
    second = _looked_up(rest.join(normalized, "_ref", "left"), columns, rules.NORMALIZED_METHOD, (rules.UNRESOLVED, rules.NO_MATCH_METHOD))
    return tried.where(F.col("identity_status").isNotNull()).unionByName(second)


def resolve_records(records: DataFrame, aliases: DataFrame, source_kind: str, alias_column: str) -> DataFrame:
    """Resolve one source table on its own (keys → resolution → annotate)."""
    resolution = resolve_keys(aliases, lookup_keys(records, source_kind, alias_column))
    return annotate(records, source_kind, alias_column, resolution)


def resolved_only(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("identity_status") == rules.RESOLVED)


# Source kind, alias column and record-id column of each common source.
SOURCE_IDENTITY = {
    "wafer_inspection": (rules.INSPECTION, "inspection_wafer_ref", "record_id"),
    "process_results": (rules.MES, "mes_wafer_ref", "record_id"),
    "chip_inspection_summary": (rules.CHIP, "chip_wafer_ref", "record_id"),
    "sorting_summary": (rules.SORTING, "sorting_wafer_ref", "record_id"),
    "qualification_results": (rules.QUALIFICATION, "qualification_wafer_ref", "record_id"),
}
DETAIL_IDENTITY = {
    "chip_detail": (rules.CHIP, "chip_wafer_ref"),
    "sorting_parameter_detail": (rules.SORTING, "sorting_wafer_ref"),
}


def all_lookup_keys(sources: dict[str, DataFrame], names=None) -> DataFrame:
    """Distinct lookup keys of several sources in one table, by source."""
    names = names or list(SOURCE_IDENTITY)
    parts = []
    for name in names:
        kind, alias_column = (SOURCE_IDENTITY.get(name) or DETAIL_IDENTITY[name])[:2]
        parts.append(lookup_keys(sources[name], kind, alias_column, name))
    return reduce(DataFrame.unionByName, parts)


def audit_rows(annotated: DataFrame, source_kind: str, alias_column: str, record_column: str) -> DataFrame:
    """Audit rows of one annotated source: every record, before revision dedup."""
    return annotated.select(
        F.lit(source_kind).alias("source_kind"),
        F.col(record_column).cast("string").alias("source_record_id"),
        F.col(alias_column).cast("string").alias("source_alias"),
        "identity_status",
        "physical_wafer_id",
        "identity_method",
    )


def identity_audit(annotated_sources: dict[str, DataFrame]) -> DataFrame:
    """Union of the audit rows of the five common sources."""
    parts = [
        audit_rows(annotated_sources[name], kind, alias_column, record_column)
        for name, (kind, alias_column, record_column) in SOURCE_IDENTITY.items()
        if name in annotated_sources
    ]
    return reduce(DataFrame.unionByName, parts)


def _first_alias_row() -> Column:
    return F.min(F.struct("source_kind", "source_alias", *WAFER_ATTRIBUTES)).alias("_m")


def wafer_master(aliases: DataFrame) -> DataFrame:
    """One row per wafer: attributes of its first alias row by (source_kind, source_alias).

    ``min(struct)`` keeps the choice deterministic and partial-aggregates per
    task, so a wafer holding a large share of alias rows does not pile up in
    one task the way a window over that wafer would.
    """
    picked = aliases.groupBy("physical_wafer_id").agg(_first_alias_row())
    return picked.select("physical_wafer_id", *[f"_m.{c}" for c in WAFER_ATTRIBUTES])


def checked_master(aliases: DataFrame, stage: Callable[[str, DataFrame], DataFrame] = lambda _name, frame: frame) -> DataFrame:
    """:func:`wafer_master` and whether a wafer's alias rows differ in their attributes (``mixed``).

    Equal attributes are grouped away by hash, without a sort of the alias
    rows; only a wafer that keeps several needs its first alias row.
    """
    wafer = "physical_wafer_id"
    seen = stage("wafer_attributes", aliases.select(wafer, *WAFER_ATTRIBUTES).distinct())
    several = stage("mixed_wafers", seen.groupBy(wafer).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(wafer).alias("_mixed")))
    same = F.col(wafer).eqNullSafe(F.col("_mixed"))
    one = seen.join(several, same, "left_anti").withColumn("mixed", F.lit(False))
    return one.unionByName(wafer_master(aliases.join(several, same, "left_semi")).withColumn("mixed", F.lit(True)))


def status_counts(audit: DataFrame) -> DataFrame:
    """Record counts by (source_kind, identity_status, identity_method)."""
    return audit.groupBy("source_kind", "identity_status", "identity_method").agg(
        F.count(F.lit(1)).alias("records")
    )


def is_status(status: str) -> Column:
    return F.col("identity_status") == status
