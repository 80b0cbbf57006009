"""Period labels (Day, Week, Month, Quarter, Year) as column expressions.

Labels are text and sort lexicographically in time order.  Weeks run Monday to
Sunday and are labelled ``<monday>/<sunday>``.  All labels use the session time
zone, which the library fixes to UTC.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from yieldspark.rules import PERIOD_MODES

TRUNC_UNIT = {"Day": "day", "Week": "week", "Month": "month", "Quarter": "quarter", "Year": "year"}


def check_mode(mode: str) -> str:
    if mode not in PERIOD_MODES:
        raise ValueError(f"Unsupported period mode: {mode}")
    return mode


def week_label(ts: Column) -> Column:
    monday = F.date_trunc("week", ts)
    return F.concat(
        F.date_format(monday, "yyyy-MM-dd"),
        F.lit("/"),
        F.date_format(F.date_add(monday.cast("date"), 6), "yyyy-MM-dd"),
    )


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def period_label(ts: Column, mode: str) -> Column:
    """Label of the period containing ``ts`` for one of the five modes."""
    check_mode(mode)
    if mode == "Day":
        return F.date_format(ts, "yyyy-MM-dd")
    if mode == "Week":
        return week_label(ts)
    if mode == "Month":
        return F.date_format(ts, "yyyy-MM")
    if mode == "Quarter":
        return quarter_label(ts)
    return F.date_format(ts, "yyyy")


def period_start(ts: Column, mode: str) -> Column:
    """Start of the period containing ``ts``: a compact, orderable grouping key.

    Ordering starts is the same as ordering the (zero-padded) labels, so
    views aggregate and rank on the start and format the label afterwards,
    on aggregated rows only.
    """
    return F.date_trunc(TRUNC_UNIT[check_mode(mode)], ts)


def label_of_start(start: Column, mode: str) -> Column:
    """The period label of a period start (same text as ``period_label``)."""
    return period_label(start, mode)


class NotALabel(ValueError):
    """A text that is no label of the period mode."""


def period_bounds(label: str, mode: str) -> tuple[datetime, datetime]:
    """Half-open ``[start, end)`` instants of a period label (driver-side parameter parsing)."""
    check_mode(mode)
    try:
        return _bounds(label, mode)
    except ValueError as e:
        raise NotALabel(f"{label!r} is no {mode} label") from e


def _bounds(label: str, mode: str) -> tuple[datetime, datetime]:
    if mode == "Day":
        start = datetime.strptime(label, "%Y-%m-%d")
        return start, start + timedelta(days=1)
    if mode == "Week":
        start = datetime.strptime(label.split("/")[0], "%Y-%m-%d")
        return start, start + timedelta(days=7)
    if mode == "Month":
        start = datetime.strptime(label, "%Y-%m")
        nxt = date(start.year + (start.month == 12), start.month % 12 + 1, 1)
        return start, datetime(nxt.year, nxt.month, 1)
    if mode == "Quarter":
        year, quarter = int(label[:4]), int(label[5:])
        start = datetime(year, 3 * quarter - 2, 1)
        end = datetime(year + (quarter == 4), (3 * quarter) % 12 + 1, 1)
        return start, end
    year = int(label)
    return datetime(year, 1, 1), datetime(year + 1, 1, 1)
