"""What ranges carry on is joined alike on every input."""

import re

from lexgrain.llm import point_in_time as p


def _joins(df):
    df.collect()  # an empty side leaves the plan while it runs
    final = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    return len(re.findall(r"\w+Join \[part#\d+\], \[part#\d+\], LeftOuter", final))


def test_ranges_without_a_key_that_goes_on_are_joined_as_others_are(spark):
    """One client and item a range left nothing open: the join fell out of the plan, and came back on tables of larger groups."""
    shape = "client long, item long, start long, sold long"
    apart = spark.createDataFrame([(1, 1, 0, 0)], shape)
    on = spark.createDataFrame([(1, 1, k, k) for k in range(1000)], shape)
    assert _joins(p.item_ranges(apart, (2, 14))) == _joins(p.item_ranges(on, (2, 14))) == 1


def test_every_range_has_a_row():
    ends = [(0, "a", "b", 1), (2, "b", "b", 5), (3, "b", "c", 2), (4, "d", "d", 7)]
    assert p.open_ranges(ends, max) == [(0, None), (2, 1), (3, 5), (4, None)]
