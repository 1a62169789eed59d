"""What a map's rows cost as the tables grow: one shuffle of the line items, and parts of bounded size."""

import pytest

from plumbline.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "wide"), [("q53_tick_lines", "Window [row_number() windowspecdefinition(map_id"), ("q02_label_nearest_line", "Exchange hashpartitioning(map_id"), ("q11_inconsistent_lines", "Exchange hashpartitioning(map_id")])
def test_maps_stay_where_they_are(spark, name, wide):
    """Neither pairs of lines, labels or ticks nor their windows are shuffled or sorted."""
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert "Exchange hashpartitioning(l_orderkey" in text and wide not in text and "Union" not in text


@pytest.mark.parametrize("name", ["q06_snap_values", "q52_toggle_points"])
def test_parts_follow_the_input(spark, monkeypatch, name):
    """A task's share of the line items does not grow with them."""
    monkeypatch.setattr(catalog, "PART_ROWS", 100)
    text = plan(catalog.QUERIES[name](spark, DATA))
    parts = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 100)
    assert f", {parts}), REPARTITION_BY_NUM" in text
