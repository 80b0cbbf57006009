"""Spark-native production yield analytics.

Source-shaped tables that name one physical wafer in several ways are resolved
to a single identity, reduced to their latest revision, and turned into
numerator/denominator facts per process stage.  Every view on top of the facts
is a ratio of sums.  All work is expressed with DataFrame operators and
built-in column expressions so Catalyst plans it and the cluster runs it.
"""

from yieldspark.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
