"""Running values by sections against plain windows."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkiln.operators import clean, context, h2h, impute, rolling, scan


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most rows, one with a null name, small ones, and nulls in the values."""
    draw = random.Random(9)
    keys = ["hot"] * 300 + [None] * 40 + [f"k{k % 25}" for k in range(60)]
    data = [(k, draw.randint(0, 40) if draw.random() > 0.1 else None, n, draw.choice([None, None, 1.0, 2.5, float("nan"), -3.0]), draw.choice([None, 4, 5])) for n, k in enumerate(keys)]
    draw.shuffle(data)
    return spark.createDataFrame(data, "k string, at int, id int, x double, y int").cache()


def _set(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("group", [[], ["k"]])
@pytest.mark.parametrize("number", [1, 7, 120])
def test_sections_equal_windows(rows, group, number):
    order = ["at", "id"]
    base = Window.partitionBy(*group or [F.lit(1)]).orderBy(*order)
    want = rows.withColumn("n", F.row_number().over(base).cast("long"))
    assert _set(scan.row_numbers(rows, order, group, number=number)) == _set(want)
    w = base.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("x", "y")})
    assert _set(scan.last_values(rows, ["x", "y"], order, group, number=number)) == _set(want)
    shown = lambda d: d.select(*[F.round(f, 9).alias(f) if "_rolling_" in f else f for f in d.columns])
    want = rolling.rolling_features(rows, group or [F.lit(1)], order, ["x"], ["x", "y"], (2, 5, 30))
    got = scan.rolling(rows, order, group, ["x"], ["x", "y"], (2, 5, 30), number=number)
    assert got.columns == [*rows.columns, *[c for c in got.columns if "_rolling_" in c]] and set(got.columns) == set(want.columns)
    assert _set(shown(got.select(*want.columns))) == _set(shown(want))


def test_one_key_is_many_tasks(rows):
    got = scan.Sections(rows, ["k"], ["at", "id"], 8)
    sizes = {r["_section"]: r["count"] for r in got.rows.where("k = 'hot'").groupBy("_section").count().collect()}
    assert len(sizes) >= 5 and max(sizes.values()) < 150
    plan = scan.last_values(rows, ["x"], ["at", "id"], [], 8)._jdf.queryExecution().executedPlan().toString()
    assert all("_section" in w for w in re.findall(r"Window \[.*", plan))


def test_empty_tables_and_single_rows(rows):
    assert scan.row_numbers(rows.limit(0), ["id"]).count() == 0
    assert scan.rolling(rows.limit(0), ["id"], ["k"], ["x"]).count() == 0
    assert [r.n for r in scan.row_numbers(rows.limit(1), ["id"]).collect()] == [1]


def test_operators_use_sections(rows):
    assert "_section" in impute.forward_fill(rows, ["x"], ["at", "id"])._jdf.queryExecution().toString()
    assert "_section" in clean.match_ordinal(rows, "k", ["at", "id"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("number", [1, 7, 60])
def test_counts_within_equal_moving_frames(rows, number):
    spans = {"near": 3, "far": 11}
    moving = lambda d, width: F.count("*").over(Window.partitionBy("k").orderBy(d).rangeBetween(-width, 0))
    want = rows.select("*", *[moving("at", width).alias(n) for n, width in spans.items()])
    assert _set(scan.counts_within(rows, "at", spans, ["k"], number)) == _set(want)
    assert scan.counts_within(rows.limit(0), "at", spans, ["k"], number).count() == 0


def test_rest_and_fatigue_has_no_moving_frame(rows):
    """a frame with two moving ends is counted anew for every row, and a team was one task."""
    d = rows.select("id", F.col("k").alias("team"), (F.col("id") % 9).alias("player_id"), F.timestamp_seconds(F.col("at") * 86400).alias("kickoff_time"))
    got = context.rest_and_fatigue(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in plan and not re.search(r"RangeFrame, -\d+", plan)
    assert all("_section" in w for w in re.findall(r"Window \[.*", plan) if "team" in w and "player_id" not in w.split("windowspecdefinition(")[1].split(")")[0])
    s = F.unix_seconds("kickoff_time")
    for key, prefix, days in (("player_id", "", (7, 14, 30)), ("team", "team_", (7, 14))):
        want = d.select("id", *[F.count("*").over(Window.partitionBy(key).orderBy(s).rangeBetween(-x * 86400, 0)).alias(f"{prefix}matches_last_{x}d") for x in days])
        assert _set(got.select(*want.columns)) == _set(want)


@pytest.mark.parametrize("newest", [True, False])
def test_first_rows_sorts_only_what_may_be_first(rows, newest):
    """F12 to F14: each task sorted all its rows to find a few of each group."""
    at = lambda c: F.col(c).desc_nulls_last() if newest else F.col(c).asc()
    w = Window.partitionBy("k").orderBy(at("at"), at("id"))
    want = rows.withColumn("_rank", F.row_number().over(w)).where("_rank <= 5")
    got = h2h.first_rows(rows, ["k"], ["at", "id"], 5, newest, few=True)
    assert _set(got) == _set(want)
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
