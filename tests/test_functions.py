from __future__ import annotations

from datetime import datetime

import pytest

from yieldspark.functions.periods import period_bounds


@pytest.mark.parametrize(
    "label, mode, start, end",
    [
        ("1995-06-05", "Day", datetime(1995, 6, 5), datetime(1995, 6, 6)),
        ("1995-06-05/1995-06-11", "Week", datetime(1995, 6, 5), datetime(1995, 6, 12)),
        ("1995-12", "Month", datetime(1995, 12, 1), datetime(1996, 1, 1)),
        ("1995Q4", "Quarter", datetime(1995, 10, 1), datetime(1996, 1, 1)),
        ("1996Q1", "Quarter", datetime(1996, 1, 1), datetime(1996, 4, 1)),
        ("1995", "Year", datetime(1995, 1, 1), datetime(1996, 1, 1)),
    ],
)
def test_period_bounds(label, mode, start, end):
    assert period_bounds(label, mode) == (start, end)


def test_period_bounds_rejects_bad_input():
    with pytest.raises(ValueError):
        period_bounds("not-a-month", "Month")
    with pytest.raises(ValueError):
        period_bounds("1995", "Fortnight")
