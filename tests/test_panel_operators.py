"""Operators on small literal frames; expected values by the stated rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkiln.functions import names as N
from panelkiln.functions import scoring
from panelkiln.operators import clean, context, dataset, evaluate, h2h, impute, merge, project, quality, resolve, rolling
from panelkiln.operators.metrics import resolve_metrics


def rows(df, *columns, by=None):
    found = df.select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in (sorted(found, key=lambda r: tuple((x is None, x) for x in r)) if by is None else found)]


def column(df, name, *order):
    return [r[0] for r in df.orderBy(*order).select(name).collect()]


def test_rolling_mean_and_sum(spark):
    d = spark.createDataFrame([(1, g, p) for g, p in enumerate((6, 8, 10, 4, 12), 1)], "player_id long, gameweek long, total_points long")
    out = rolling.rolling_features(d, order=["gameweek"], mean=["total_points"], windows=(3,))
    assert column(out, "total_points_rolling_mean_3", "gameweek") == pytest.approx([6, 7, 8, 22 / 3, 26 / 3])
    g = spark.createDataFrame([(1, k, v) for k, v in enumerate((1, 0, 2, 1), 1)], "player_id long, gameweek long, goals_scored long")
    assert column(rolling.rolling_features(g, order=["gameweek"], sums=["goals_scored"], windows=(3,)), "goals_scored_rolling_sum_3", "gameweek") == [1, 1, 3, 3]


def test_rolling_null_inside(spark):
    d = spark.createDataFrame([(1, g, p) for g, p in enumerate((6, None, 10, 4, 12), 1)], "player_id long, gameweek long, p long")
    got = column(rolling.rolling_features(d, order=["gameweek"], mean=["p"], windows=(3,)), "p_rolling_mean_3", "gameweek")
    assert got[1] is None and [got[0], *got[2:]] == pytest.approx([6, 16 / 3, 5, 26 / 3])


def test_rolling_empty_and_excluded(spark):
    d = spark.createDataFrame([], "player_id long, gameweek long, web_name string, xg double")
    mean, sums = resolve_metrics(d)
    assert mean == ["xg"] and sums == []
    assert rolling.rolling_features(d, order=["gameweek"], mean=mean).count() == 0


def test_rolling_nan_counts_as_zero(spark):
    d = spark.createDataFrame([(1, 1, 3.0), (1, 2, float("nan"))], "player_id long, gameweek long, xg double")
    assert column(rolling.rolling_features(d, order=["gameweek"], mean=["xg"], windows=(2,)), "xg_rolling_mean_2", "gameweek") == [3.0, 1.5]


def test_form_is_null_until_full(spark):
    d = spark.createDataFrame([(1, g, float(g)) for g in range(1, 5)], "player_id long, gameweek long, x double")
    assert column(rolling.form_metrics(d, order=["gameweek"], metrics=["x"], windows={"7d": 3}), "x_form_7d", "gameweek") == [None, None, 2.0, 3.0]


def test_head_to_head(spark):
    d = spark.createDataFrame([(1, 3, 6, 1, "a", 1), (1, 3, 8, 1, "a", 2), (2, 4, 2, 0, "a", 1)], "p long, o long, pts long, g long, season string, gw long")
    out = h2h.head_to_head(d, ["p", "o"], ["season", "gw"], ["pts"], ["g"], (1,))
    assert rows(out, "p", "avg_pts", "total_g", "appearances", "pts_h2h_last_1") == [(1, 7.0, 2, 2, 8.0), (2, 2.0, 0, 1, 2.0)]


def test_head_to_head_all_null_sum_is_zero(spark):
    d = spark.createDataFrame([(1, 1, None, True, 1)], "p long, o long, g long, home boolean, gw long")
    out = h2h.head_to_head(d, ["p", "o"], ["gw"], [], ["g"], (), was_home="home").first()
    assert (out.total_g, out.total_g_home, out.total_g_away) == (0, 0, None)


def test_advantage(spark):
    d = spark.createDataFrame([(1, 1, True, 10.0), (1, 1, True, 8.0), (1, 1, False, 2.0), (1, 1, False, 4.0)], "p long, o long, was_home boolean, x double")
    out = h2h.advantage(h2h.player_home_away(d, ["p", "o"], ["x"], ["x"], [], ()), ["x"]).first()
    assert (out.home_avg_x, out.away_avg_x, out.x_home_advantage) == (9.0, 3.0, 2.0)


def test_rest_days_and_counts(spark):
    at = [dt.datetime(2024, 8, d, h, 30) for d, h in ((17, 12), (24, 15), (31, 17))]
    d = spark.createDataFrame([(1, a) for a in at], "p long, t timestamp")
    assert column(context.days_since_last(d, ["p"], "t"), "days_since_last_match", "t") == [None, 7, 7]
    assert column(context.matches_within(d, ["p"], "t", (7, 30)), "matches_last_30d", "t") == [1, 2, 3]


def test_availability(spark):
    d = spark.createDataFrame([(s, 1) for s in "aais"], "status string, team long")
    assert set(rows(context.availability(d), "team_availability_rate", "squad_size")) == {(0.5, 4)}


def test_fixture_difficulty_and_schedule(spark):
    f = spark.createDataFrame([(1, 1, 2, 3, 4), (2, 2, 1, 4, 3)], "fixture_id long, home_team_id long, away_team_id long, team_h_difficulty long, team_a_difficulty long")
    assert rows(context.fixture_difficulty(f), "home_difficulty", "away_difficulty") == [(3.0, 4.0), (4.0, 3.0)]
    assert set(rows(context.fixture_difficulty(f.drop("team_h_difficulty", "team_a_difficulty")), "home_difficulty", "away_difficulty")) == {(3.0, 3.0)}
    s = spark.createDataFrame([(1, 2, 1, 3.0), (1, 3, 2, 4.0), (2, 1, 1, 3.0)], "home_team_id long, away_team_id long, gameweek long, overall_difficulty double")
    assert dict(rows(context.strength_of_schedule(s), "team", "schedule_difficulty"))[1] == pytest.approx(10 / 3)


def test_names(spark):
    given = ["Saka (Captain)", "Salah [Doubtful]", "Saka, Bukayo", "José", "  haaland, erling (Captain)  ", "o'brien jean-luc"]
    d = spark.createDataFrame([(k, n) for k, n in enumerate(given)], "k long, n string").withColumn("s", N.standard_name(F.col("n")))
    assert column(d, "s", "k") == ["Saka", "Salah", "Bukayo Saka", "Jose", "Erling Haaland", "O'Brien Jean-Luc"]
    p = spark.createDataFrame([(k, n) for k, n in enumerate(["GK", "DC", "MC", "FW", "AMC", None])], "k long, n string").withColumn("s", N.position(F.col("n")))
    assert column(p, "s", "k") == ["GKP", "DEF", "MID", "FWD", "FWD", ""]


def test_season_codes(spark):
    d = spark.createDataFrame([(k, s) for k, s in enumerate(["2024-25", "2024", "24-25", "2024-25; DROP", "2024-26", None])], "k long, s string")
    assert column(d.withColumn("v", N.valid_season(F.col("s"))), "v", "k") == [True, False, False, False, False, False]
    assert column(d.withColumn("v", N.season_code(F.translate("s", "-", "/"))), "v", "k")[0] == "2425"


def test_scoring(spark):
    one = spark.range(1)
    c = lambda **k: {n: F.lit(v) for n, v in k.items()}
    cases = [("MID", c(minutes=90, goals=1, assists=1), 10), ("DEF", c(minutes=90, clean_sheet=1), 6), ("GK", c(minutes=90, saves=9, clean_sheet=1), 9), ("MID", c(minutes=90, yellow_cards=1, red_cards=1), 0)]
    for position, events, want in cases:
        assert one.select(scoring.points(F.lit(position), events)).first()[0] == want
    b = spark.createDataFrame([(1, k, v) for k, v in enumerate((50, 40, 30, 20, 10))], "m long, p long, bps long")
    assert column(merge.bonus(b, "m", "bps", ["p"]), "bonus", "p") == [3, 2, 1, 0, 0]


def test_cleaning(spark):
    d = spark.createDataFrame([("3", "x", 95, None)], "a string, b string, minutes long, c long")
    out = clean.clamp(clean.clean_numeric(d, ["a", "b"]), {"minutes": (0, 90)})
    assert out.select("a", "b", "minutes").first() == (3, None, 90)
    q = clean.quality_flags(out, ["a", "b", "gone"]).first()
    assert q.missing_fields == ["b", "gone"] and q.is_incomplete and q.data_quality_score == 0.5
    w = spark.createDataFrame([(float(k),) for k in range(101)], "x double")
    assert clean.winsorize(w, ["x"], 0.1, 0.9).agg(F.min("x"), F.max("x")).first() == (10.0, 90.0)
    assert clean.winsorize(w, ["x"], 0.1, 0.9, "nearest").agg(F.min("x")).first()[0] == 10.0


def test_imputation(spark):
    d = spark.createDataFrame([("F", 1.0, 1), ("F", None, 2), ("M", 2.0, 3), (None, 4.0, 4)], "pos string, x double, k long")
    assert column(impute.mean_fill(d, ["x"]), "x", "k")[1] == pytest.approx(7 / 3)
    assert column(impute.mean_fill(d, ["x"], ["pos"]), "x", "k")[1] == 1.0
    assert column(impute.median_fill(d, ["x"]), "x", "k")[1] == 2.0
    assert column(impute.mode_fill(d, ["pos"]), "pos", "k")[3] == "F"
    assert column(impute.forward_fill(d, ["x"], ["k"]), "x", "k") == [1.0, 1.0, 2.0, 4.0]
    out, report = impute.run_imputation(d.withColumn("rare", F.when(F.col("k") == 1, 1.0)))
    assert {r.column: (r.strategy, r.nulls_after, r.rejected) for r in report.collect()}["rare"] == ("mean", 3, True)


def test_validation(spark):
    d = spark.createDataFrame([(-1, 1), (2, 1), (3, None)], "x long, id long")
    report = quality.run_validation(d, {"gone": "long"}, [*quality.range_checks({"x": (0, None)}), quality.non_negative("x")], critical=["id"], unique=[["id"]])
    found = {(r.check, r.subject): (r.severity, r.rows) for r in report.collect()}
    assert found[("range", "x")] == ("error", 1) and found[("completeness", "id")] == ("error", 1) and found[("unique", "id")] == ("error", 2) and found[("schema", "gone")][0] == "error"
    assert quality.is_valid(report).first().is_valid is False
    assert not quality.is_fresh(d.limit(0)) and quality.is_fresh(d, ["x"], 3)


def test_name_mapping(spark):
    s = spark.createDataFrame([("Saka, Bukayo",), ("Ska",), ("Xylophone",), ("Toti",)], "name string")
    t = spark.createDataFrame([("Bukayo Saka", 1), ("Saka", 2), ("Toti Gomes", 3)], "name string, k long")
    v = spark.createDataFrame([("Toti", "Toti Gomes")], "source string, canonical string")
    m = {r.source_name: (r.mapped_name, r.confidence, r.method) for r in resolve.build_name_mapping(s, t, 0.5, v, order="k").collect()}
    assert m["Saka, Bukayo"] == ("Bukayo Saka", 1.0, "exact") and m["Ska"] == ("Saka", 0.75, "fuzzy") and m["Toti"] == ("Toti Gomes", 1.0, "known")
    assert m["Xylophone"] == ("Xylophone", 0.0, "none")


def test_staged_match(spark):
    s = spark.createDataFrame([(1, "John Smith", "A", "MID"), (2, "john smith", "B", "MID"), (3, "John Smyth", "C", "FWD"), (4, "Nobody Here", None, "")], "player_id long, player_name string, team string, position string")
    t = spark.createDataFrame([(101, "John Smith", "A", "MID"), (102, "John Smith", "B", "MID"), (103, "Jon Smyth", "D", "FWD")], "target_id long, target_name string, target_team string, target_position string")
    m = {r.player_id: (r.target_id, r.stage, round(r.confidence, 3)) for r in resolve.match_players(s, t).collect()}
    # the first of two equally near names is the match of 3, and its position is another
    assert m[1] == (101, 1, 1.0) and m[2] == (102, 1, 1.0) and m[3] == (None, None, 0.0) and m[4][0] is None and m[4][2] == 0.0


def test_staged_match_ships_no_table_whole(spark):
    s = spark.createDataFrame([(k, f"Name {'a' * k}", "A", "MID") for k in range(1, 30)], "player_id long, player_name string, team string, position string")
    t = spark.createDataFrame([(k, f"Mane {'a' * k}", "B", "FWD" if k % 2 else "MID") for k in range(1, 30)], "target_id long, target_name string, target_team string, target_position string")
    d = resolve.match_players(s, t)
    assert "BroadcastNestedLoopJoin" not in d._jdf.queryExecution().executedPlan().toString()
    pairs = s.crossJoin(t).withColumn("score", N.similarity(F.lower("player_name"), F.lower("target_name")))
    best = {r.player_id: r.best for r in pairs.groupBy("player_id").agg(F.min(F.struct(-F.col("score"), "target_id", "target_position").alias("best")).alias("best")).collect()}
    for r in d.collect():
        near = best[r.player_id]
        right = near.target_position == "MID"  # stage 4 takes the J-10 match, if it has the position
        assert r.best_score == -near[0] and (r.target_id, r.stage) == ((near.target_id, 4) if right else (None, None)) and abs(r.confidence - (0.7 * -near[0] if right else 0.0)) < 1e-9


def test_matching_follows_its_stages(spark):
    """Known names the targets lack, J-10 matches in and out of the team, last names in a
    longer name, and players without a team."""
    v = spark.createDataFrame([("Toti", "Toti Gomes"), ("Nat", "Nathaniel Collins")], "source string, canonical string")
    names = spark.createDataFrame([("Toti",), ("Nat",)], "name string")
    t = spark.createDataFrame([("Toti",), ("Nathaniel Collins",)], "name string")
    m = {r.source_name: (r.mapped_name, r.method) for r in resolve.build_name_mapping(names, t, 0.75, v).collect()}
    assert m["Toti"][1] != "known" and m["Nat"] == ("Nathaniel Collins", "known")
    s = spark.createDataFrame([(1, "Foo Silva", "A", "MID"), (2, "Erik Jansen", None, "DEF"), (3, "Erik Janson", "", "DEF"), (4, "Adam Webbster", "B", "FWD")], "player_id long, player_name string, team string, position string")
    t = spark.createDataFrame([(11, "Bernardo Veiga da Silva Junior", "A", "MID"), (12, "Erik Jansen", None, "DEF"), (13, "Adam Webster", "C", "FWD"), (14, "Alan Wobster", "B", "FWD")], "target_id long, target_name string, target_team string, target_position string")
    got = {r.player_id: (r.target_id, r.stage) for r in resolve.match_players(s, t).collect()}
    assert got == {1: (11, 3), 2: (12, 4), 3: (12, 4), 4: (13, 4)}



def test_three_source_matches(spark):
    s = "season string, home_team_id long, away_team_id long, match_id long, match_date string, home_score long, away_score long"
    a = spark.createDataFrame([("x", 1, 2, 10, None, 1, 0), ("x", 3, 4, 11, None, None, None)], s)
    b = spark.createDataFrame([("x", 1, 2, 20, "2024-01-01", 9, 9)], s)
    out = resolve.match_mapping([("a", a), ("b", b)]).collect()
    assert len(out) == 1 and (out[0].match_date, out[0].home_score, out[0].match_source, out[0].a_match_id) == ("2024-01-01", 1, "b", 10)


def test_keep_best(spark):
    d = spark.createDataFrame([("A", 0.5, 1), ("A", 0.9, 2), ("B", None, 3), (None, 1.0, 4)], "k string, s double, o long")
    assert rows(merge.keep_best(d, ["k"], "s", ["o"]), "k", "o") == [("A", 2), ("B", 3)]
    assert rows(merge.keep_best(d, ["k"], sequence=["o"]), "k", "o") == [("A", 2), ("B", 3)]


def test_unified_stats(spark):
    a = spark.createDataFrame([(1, 1, 90, 2), (2, 1, 0, 1), (None, 1, 5, 5)], "p long, m long, minutes long, goals long")
    b = spark.createDataFrame([(1, 1, 80, None, 0.5), (2, 1, 30, 3, 0.1), (3, 1, 45, 0, 0.2)], "p long, m long, minutes long, goals long, xg double")
    out = merge.unified_stats(a, b, ["p", "m"], ["minutes", "goals", "xg"])
    assert rows(out, "p", "minutes", "goals", "xg") == [(1, 90, 2, 0.5), (2, 30, 3, 0.1), (3, 45, 0, 0.2)]


def test_targets_and_split(spark):
    d = spark.createDataFrame([(1, g, p) for g, p in ((1, 6), (2, 8), (3, 10))], "player_id long, gameweek long, total_points long")
    assert rows(dataset.next_period_target(d, ["player_id"], ["gameweek"]), "gameweek", "next_gw_points") == [(1, 8), (2, 10)]
    s = spark.createDataFrame([(g,) for g in range(1, 39)], "gameweek long")
    split = dict(rows(dataset.time_split(s), "gameweek", "split"))
    assert split[26] == "train" and split[27] == "validation" and split[32] == "validation" and split[33] == "test"
    with pytest.raises(ValueError):
        dataset.time_split(d.drop("gameweek"))
    y = spark.createDataFrame([(1,)] * 10 + [(0,)] * 2, "is_starter long")
    assert dataset.class_weights(y).first()[0] == 0.2


def test_evaluation(spark):
    d = spark.createDataFrame([(float(k), k + 0.5) for k in range(1, 6)], "y_true double, y_pred double")
    r = evaluate.regression_metrics(d).first()
    assert (r.mae, r.rmse, r.n) == (0.5, 0.5, 5)
    e = spark.createDataFrame([(10.0, 8.0), (20.0, 18.0), (30.0, 28.0)], "y_true double, y_pred double")
    assert evaluate.residual_summary(e).first().bias == 2.0
    c = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1), (1, 1, 0.8), (0, 0, 0.4)], "y_true long, y_pred long, y_proba double")
    m = evaluate.classification_metrics(c).first()
    assert m.accuracy == 0.8 and (m.tp, m.fp, m.fn, m.tn) == (2, 0, 1, 2)
    assert evaluate.roc_auc(c).first()[0] == pytest.approx(5.5 / 6)


def test_projections(spark):
    d = spark.createDataFrame([(1, 5.0, 0.9, 30.0, "MID"), (2, 8.0, 0.95, 60.0, "FWD"), (3, 3.0, 0.7, 5.0, "MID")], "player_id long, mean_points double, xi_prob double, ownership double, position string")
    p = project.projections(d)
    assert column(p, "player_id", "overall_rank") == [2, 1, 3]
    assert rows(project.differentials(p), "player_id") == [3] and rows(project.captains(p, 1), "player_id") == [2]


def test_fingerprints_of_multisets(spark):
    one = lambda *rows: quality.fingerprint(spark.createDataFrame([(1, r) for r in rows], "season int, v string"), ["season"])
    assert quality.changes(one("a", "a"), one("b", "b"), ["season"]).first().change == "changed"
    assert quality.changes(one("a", "b", "a"), one("a", "a", "b"), ["season"]).count() == 0
    assert quality.changes(one("a", None), one(None, "a"), ["season"]).count() == 0
    whole, parts = one(*map(str, range(50))), one(*map(str, range(20))).union(one(*map(str, range(20, 50))))
    assert quality.combined(parts, ["season"]).collect() == whole.collect()


def test_orphans_are_counted_by_key_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3 + [(None,), (9,)], "k long")
    known = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    found = quality.orphans(rows, known, "k", "id")
    assert found.first()["orphan_rows"] == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Join") :]
    assert below.index("HashAggregate") < below.index("Scan")
    assert quality.orphans(rows.limit(0), known, "k", "id").first()["orphan_rows"] == 0
    assert quality.orphans(rows, known.limit(0), "k", "id").first()["orphan_rows"] == 54
