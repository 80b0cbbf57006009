"""Helpers shared by the tests of the factory part."""

from __future__ import annotations

from datetime import datetime

SF0001 = "/root/testdata/sf0.001"


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def alias_rows(*rows):
    """(kind, alias, wafer) triples → identity_aliases rows with fixed attributes."""
    from yieldspark.functions.text import WHITESPACE

    out = []
    for kind, alias, wafer in rows:
        normalized = alias.strip(WHITESPACE).replace(" ", "").replace("_", "-").upper()
        out.append((kind, alias, normalized, wafer, "WO-1", "LOT-1", 1, "FAM", "SIZE"))
    return out


def plan_of(frame) -> str:
    """The formatted physical plan as text."""
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def scan_of(frame) -> dict[str, str]:
    """What reaches the plan's first Parquet scan, by kind; empty text where nothing does."""
    lines = plan_of(frame).splitlines()
    return {kind: next((x for x in lines if x.startswith(kind)), "") for kind in ("PartitionFilters", "PushedFilters", "ReadSchema")}
