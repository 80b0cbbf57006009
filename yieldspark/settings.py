"""Settings of the views (S8): defaults, overridden by the session's configuration, overridden by arguments.

A session names them ``spark.yieldspark.<name>`` (``spark.yieldspark.period_mode``
and so on), so a cluster's defaults need no code.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from yieldspark import rules
from yieldspark.functions.periods import check_mode
from yieldspark.plans import views

PREFIX = "spark.yieldspark."


@dataclass(frozen=True)
class Settings:
    """What a view shows where its caller says nothing else; an empty family is every family, an empty file the built-in rules."""

    period_mode: str = "Week"
    max_periods: int = rules.DEFAULT_MAX_PERIODS
    top_n: int = rules.DEFAULT_TOP_N
    product_family: str = ""
    rules_file: str = ""

    def __post_init__(self):
        check_mode(self.period_mode)
        for name in ("max_periods", "top_n"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @property
    def scope(self) -> views.Scope:
        return views.Scope({"product_family": self.product_family}) if self.product_family else views.EVERYTHING

    def display_rows(self) -> list[rules.DisplayRow]:
        return rules.load_display_rows(self.rules_file or None)


def settings(spark: SparkSession, **given) -> Settings:
    """The settings of a session; unknown names, in either place, are refused."""
    known = {f.name: type(f.default) for f in fields(Settings)}
    stated = {k[len(PREFIX) :]: v for k, v in spark.conf.getAll.items() if k.startswith(PREFIX)}
    unknown = sorted((stated.keys() | given.keys()) - known.keys())
    if unknown:
        raise ValueError(f"no settings {unknown}; there are {sorted(known)}")
    return Settings(**({name: known[name](value) for name, value in stated.items()} | given))


def matrix(facts: DataFrame, chosen: Settings) -> DataFrame:
    """The long matrix of the settings' period mode, periods and family."""
    return views.matrix_long(facts, chosen.period_mode, chosen.scope, chosen.max_periods)


def pareto(failures: DataFrame, stage_code: str, period: str, chosen: Settings) -> DataFrame:
    """The failure Pareto of one cell of that matrix."""
    return views.cell_pareto(failures, views.Cell(stage_code, chosen.period_mode, period), chosen.scope, chosen.top_n)
