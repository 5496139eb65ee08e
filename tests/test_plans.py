"""Shapes of plans that must hold at scale."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelkiln.operators import h2h, project, quantiles, rolling
from panelkiln.plans.tables import ORDER, panel
from panelkiln.sources import io

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_all_windows_share_one_exchange(spark):
    d = rolling.rolling_features(panel(spark, SF), ["player_id"], ORDER, ["price", "minutes"], ["goals"], (3, 5, 10))
    assert exchanges(d) == 1 and len(re.findall(r"\bSort \[", plan(d))) == 1


def test_newest_rows_are_cut_before_the_shuffle(spark):
    d = h2h.head_to_head(panel(spark, SF), ["player_id", "opponent"], ORDER, ["price"], ["goals"], (3, 5, 10), was_home="was_home")
    assert len(re.findall(r"WindowGroupLimit", plan(d))) >= 2 and "partial_sum" in plan(d)


def test_ranks_need_no_window_over_a_whole_group(spark):
    d = panel(spark, SF).select(F.col("o_orderkey").alias("player_id"), F.col("opponent").alias("position"), "season", F.col("minutes").cast("double").alias("mean_points"), F.lit(1.0).alias("xi_prob"), F.lit(1.0).alias("ownership"))
    out = project.projections(d, [])
    assert all("_range" in w for w in re.findall(r"Window \[row_number.*", plan(out)))
    rows = sorted(out.collect(), key=lambda r: (-r.combined_score, r.player_id))
    assert [r.overall_rank for r in rows] == list(range(1, len(rows) + 1))
    assert project.projections(d.limit(0), []).count() == 0


def test_quantiles_by_range_are_exact(spark):
    at, rng = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0], random.Random(5)
    values = [(k % 3 if k % 17 else None, None if k % 11 == 0 else 7.5 if k % 4 == 0 else rng.gauss(0, 50)) for k in range(3000)]
    d = spark.createDataFrame(values, "g int, x double")
    for linear, name in ((True, "percentile_cont"), (False, "percentile_disc")):
        want = [F.expr(f"{name}({p}) within group (order by x)") for p in at]
        for by in ([], ["g"]):
            got = {tuple(r[:-1]): r[-1] for r in quantiles.exact_quantiles(d, "x", at, by, linear=linear).collect()}
            assert got == {tuple(r[:-1]): pytest.approx(r[-1]) for r in d.groupBy(*by).agg(F.array(*want)).collect()}
    whole = plan(quantiles.exact_quantiles(d, "x", at))
    assert "percentile" not in whole and all("_range" in w or "_size" in w for w in re.findall(r"Window \[.*", whole))  # _size: a row for each range
    assert [r.q for r in quantiles.exact_quantiles(d.where("x is null"), "x", [0.5], into="q").collect()] == [[None]]
    assert quantiles.exact_quantiles(d.limit(0), "x", [0.5], ["g"]).count() == 0
    ends = spark.createDataFrame([(float("-inf"),), (float("inf"),), (float("nan"),)], "x double")
    assert quantiles.exact_quantiles(ends, "x", [0.0, 0.5], into="q").first().q == [float("-inf"), float("inf")]


def test_cells_count_the_cuts_below(spark):
    values = [-1.0, 0.0, 0.5, 3.0, 6.5, 99.0, float("nan")]
    for n in (0, 1, 2, 7, 10):
        got = spark.createDataFrame([(v,) for v in values], "v double").select(quantiles.cell(F.col("v"), [float(k) for k in range(n)])).collect()
        assert [r[0] for r in got] == [n if v != v else sum(k < v for k in range(n)) for v in values]


def test_matching_has_no_nested_loop(spark):
    from panelkiln.plans import merging

    for name in ("j10_name_mapping", "j13_staged_player_match", "j14_season_player_mapping"):
        assert not re.search("NestedLoop|Cartesian", plan(merging.QUERIES[name](spark, SF)))


def test_columns_and_filters_reach_the_scan(spark):
    p = plan(io.read_table(spark, f"{SF}/lineitem.parquet", ["l_orderkey", "l_quantity"], at_least={"l_quantity": 10}))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in p and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("name", ["f2_rest_and_fatigue", "w5_days_since_last"])
def test_events_of_one_time_follow_their_ids(spark, tmp_path, name):
    """of a user's events at one time only one has days since the event before; which one
    must not depend on the order of the rows in the table."""
    at = lambda day, micro: datetime.datetime(2024, 1, day, 12, 0, 0, micro)
    rows = [(0, at(1, 0), 7, "view"), (1, at(3, 500), 7, "click"), (2, at(3, 500), 7, "view"), (3, at(3, 500), 7, "view"), (4, at(9, 900), 7, "view"), (5, at(9, 100), 7, "click"), (6, at(3, 500), 8, "view"), (7, at(3, 500), 8, "view")]
    for turned in (False, True):
        sf = tmp_path / f"turned_{turned}"
        spark.createDataFrame(sorted(rows, reverse=turned), "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{sf}/events.parquet")
        got = {r.event_id: r.days_since_last_match for r in __spark_entry__.queries()[name](spark, str(sf)).collect()}
        assert got == {0: None, 1: 2, 2: 0, 3: 0, 4: 0, 5: 6, 6: None, 7: 0}
