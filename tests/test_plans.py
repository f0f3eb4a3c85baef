"""Plan shape: no nested-loop or cartesian joins, no row-at-a-time Python, pruned scans."""

import pytest

from cuestream import catalog

catalog.load()
PYTHON_OK = ("seq", "sig13", "sig16", "str", "udf", "sig01")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in catalog.QUERIES if not n.startswith(("str03", "str07", "str09", "str10", "join16"))]


@pytest.mark.parametrize("name", BATCH)
def test_no_quadratic_join_and_no_row_python(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if not name.startswith(PYTHON_OK):
        assert "MapInPandas" not in text and "FlatMapGroupsInPandas" not in text


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = catalog.QUERIES["tim20_tap_progress"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint>" in text
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text


def test_post_process_shuffles_once_per_key(spark, sf_dir):
    from cuestream import adapters as A
    from cuestream.operators import postprocess as P

    out = P.post_process(A.spans(spark, sf_dir), hot=False)
    assert plan(out).count("Exchange hashpartitioning") == 1
