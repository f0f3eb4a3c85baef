"""Repeated lines of a track in one pass over the lines."""

import pytest

from conftest import rows
from cuestream.operators import assets as AS


@pytest.mark.parametrize("hot", [False, True])
def test_groups_from_one_pass(spark, hot):
    data = [(1, "abc", 4), (1, "abc", 2), (1, "ab", 0), (1, "ab", 1), (2, "abc", 7), (2, "xyz", 1), (2, "xyz", 3), (2, "xyz", 9), (3, None, 1), (3, None, 2)]
    got = AS.repetition_groups(spark.createDataFrame(data, "track_id long, sig string, seq long"), hot=hot)
    want = [(1, "abc", 2, 2, 2), (1, "abc", 4, 2, 2), (2, "xyz", 1, 3, 1), (2, "xyz", 3, 3, 1), (2, "xyz", 9, 3, 1)]
    assert rows(got, "track_id", "sig", "seq", "n", "first_seq") == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert hot or ("Join" not in plan and plan.split("== Initial Plan ==")[-1].count("Exchange") == 1)
