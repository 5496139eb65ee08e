"""Sketches by period against exact ranks."""

import random

import pytest

from panelkiln.operators import clean, sketches
from panelkiln.operators.metrics import resolve_metrics


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [(k % 3 if k % 50 else None, rnd.gauss(0, 10) if k % 11 else None, float(k % 7) if k % 13 else float("nan")) for k in range(40_000)]
    return spark.createDataFrame(data, "season int, x double, y double").repartition(7).cache(), data


def _off(values, found, p):
    below, upto = sum(v < found for v in values) / len(values), sum(v <= found for v in values) / len(values)
    return max(below - p, p - upto, 0)


def test_merged_sketches_keep_ranks_by_season_and_over_all(spark, rows):
    df, data = rows
    at = [0, 0.01, 0.5, 0.99, 1]
    stored = sketches.column_sketches(df.where("season = 0 or season is null"), ["x", "y"], ["season"])
    now = sketches.add_rows(stored, df.where("season <> 0"), ["x", "y"], ["season"])
    for by in (["season"], []):
        found = sketches.sketch_quantiles(now, at, by).collect()
        assert len(found) == (8 if by else 2)
        for r in found:
            k = 1 if r["column"] == "x" else 2
            values = [d[k] for d in data if d[k] is not None and d[k] == d[k] and (not by or d[0] == r["season"])]
            assert r["n"] == len(values)
            assert (r["quantiles"][0], r["quantiles"][-1]) == (min(values), max(values))
            for p, q in zip(at, r["quantiles"]):
                assert _off(values, q, p) <= 3 * sketches.rank_error()


def test_clipped_at_stored_sketches(spark, rows):
    df, data = rows
    stored = sketches.column_sketches(df, ["x"], ["season"])
    low, high = sketches.sketch_bounds(stored, ["x"], [0.01, 0.99]).first()[0]
    got = [r["x"] for r in clean.winsorize(df, ["x"], method="sketch", sketches=stored).collect()]
    kept = [v for v in got if v is not None]
    assert len(got) == len(data) and got.count(None) == sum(d[1] is None for d in data)
    values = [d[1] for d in data if d[1] is not None]
    slack = 3 * sketches.rank_error()
    assert min(kept) == pytest.approx(low, abs=1) and max(kept) == pytest.approx(high, abs=1)
    assert _off(values, min(kept), 0.01) <= slack and _off(values, max(kept), 0.99) <= slack


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "season int, x double")
    assert sketches.column_sketches(empty, ["x"], ["season"]).count() == 0
    r = sketches.sketch_quantiles(sketches.column_sketches(empty, ["x"]), [0.5]).first()
    assert (r["n"] or 0) == 0 and r["quantiles"] is None
    nulls = spark.createDataFrame([(1, None), (1, float("nan"))], "season int, x double")
    assert sketches.sketch_quantiles(sketches.column_sketches(nulls, ["x"], ["season"]), [0.5], ["season"]).first()["quantiles"] is None
    assert [r["x"] for r in clean.winsorize(nulls.where("x is null"), ["x"], method="sketch").collect()] == [None]
    with pytest.raises(ValueError):
        sketches.column_sketches(empty, ["x"], ["column"])


def test_all_columns_are_one_exchange(spark, rows):
    plan = sketches.column_sketches(spark.createDataFrame(rows[1][:10], "season int, x double, y double"), ["x", "y"], ["season"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_names_that_are_no_metrics(spark):
    df = spark.createDataFrame([], "form_rank long, team_rank long, saves_per_90 double, xg_per_90 double, source_player_id long, goals_scored long")
    assert resolve_metrics(df) == (["source_player_id", "team_rank", "xg_per_90"], ["goals_scored"])
    assert resolve_metrics(df, exclude={"source_player_id"})[0] == ["team_rank", "xg_per_90"]
