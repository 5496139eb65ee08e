"""Queries of data sets, evaluation, projections and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, dataset, evaluate, ml, project, rolling
from .tables import ORDER, PANEL, panel, rounded, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_BY = "PARTITION BY player_id ORDER BY o_orderdate, o_orderkey"


@query("w12_next_period_target", f"WITH {PANEL} SELECT o_orderkey, t AS next_gw_points FROM (SELECT o_orderkey, lead(goals) OVER ({_BY}) AS t FROM panel) WHERE t IS NOT NULL")
def w12(spark, sf):
    return dataset.next_period_target(panel(spark, sf), ["player_id"], ORDER, "goals", drop=["price"]).select("o_orderkey", "next_gw_points")


@query("w13_starter_dataset", f"WITH {PANEL} SELECT o_orderkey, CAST(minutes >= 60 AS INTEGER) AS is_starter, c_acctbal FROM panel LEFT JOIN customer ON c_custkey = player_id")
def w13(spark, sf):
    features = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), "c_acctbal")
    return dataset.starter_dataset(panel(spark, sf), features=features, on=["player_id"]).select("o_orderkey", "is_starter", "c_acctbal")


@query("w14_time_split", "WITH p AS (SELECT DISTINCT month(o_orderdate) * 10 + year(o_orderdate) % 3 AS g FROM orders), r AS (SELECT g, row_number() OVER (ORDER BY g) AS k, count(*) OVER () AS n FROM p) SELECT o_orderkey, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + ceil(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM orders JOIN r ON g = month(o_orderdate) * 10 + year(o_orderdate) % 3")
def w14(spark, sf):
    o = table(spark, sf, "orders").withColumn("g", F.month("o_orderdate") * 10 + F.year("o_orderdate") % 3)
    return dataset.time_split(o, "g").select("o_orderkey", "split")


@query("d10_walk_forward", f"WITH {PANEL} SELECT fold, role, count(*) AS rows FROM (SELECT fold, CASE WHEN season < t THEN 'train' ELSE 'test' END AS role FROM panel JOIN (VALUES (1, 1994), (2, 1996)) f(fold, t) ON season <= t) GROUP BY 1, 2")
def d10(spark, sf):
    folds = spark.createDataFrame([(1, 1994), (2, 1996)], "fold int, at long")
    return dataset.walk_forward(panel(spark, sf), folds, "season").groupBy("fold", "role").agg(F.count("*").alias("rows"))


_SHOTS = "shots AS (SELECT user_id AS player_id, event_type AS situation, CAST(event_id AS DOUBLE) AS xg, CAST(event_id % 4 = 0 AS INTEGER) AS goal, CASE event_id % 3 WHEN 0 THEN 'Outside box' WHEN 1 THEN 'Inside' ELSE 'Six-yard' END AS location, CAST(event_id % 5 AS VARCHAR) AS body_part, CAST(month(ts) AS INTEGER) AS gameweek FROM events)"


def _shots(spark, sf):
    k = F.col("event_id")
    where = F.when(k % 3 == 0, "Outside box").when(k % 3 == 1, "Inside").otherwise("Six-yard")
    return table(spark, sf, "events").select(F.col("user_id").alias("player_id"), F.col("event_type").alias("situation"), k.cast("double").alias("xg"), (k % 4 == 0).cast("int").alias("goal"), where.alias("location"), (k % 5).cast("string").alias("body_part"), F.month("ts").alias("gameweek"))


@query("a24_shot_features", f"WITH {_SHOTS} SELECT player_id, gameweek, round(avg(xg), 6) AS avg_shot_xg, count(*) AS shot_frequency, round(avg(goal), 6) AS conversion_rate, round(avg(CASE WHEN location <> 'Outside box' THEN 1.0 ELSE 0.0 END), 6) AS box_entry_rate, CAST(max(situation = 'click') AS INTEGER) AS penalty_involvement, CAST(max(situation IN ('view')) AS INTEGER) AS set_piece_taking, count(DISTINCT body_part) AS body_part_diversity FROM shots GROUP BY 1, 2")
def a24(spark, sf):
    return rounded(dataset.shot_features(_shots(spark, sf), penalty="click", set_pieces=("view",)))


@query("a25_class_weights", "SELECT round(CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE) / count(*) FILTER (WHERE quality = 1), 6) AS scale_pos_weight FROM labels")
def a25(spark, sf):
    return rounded(dataset.class_weights(table(spark, sf, "labels"), "quality"))


@query("a26_correlations", "SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b, round(corr(l_quantity, l_extendedprice), 5) AS correlation FROM lineitem HAVING abs(corr(l_quantity, l_extendedprice)) >= 0.0 UNION ALL SELECT 'l_quantity', 'twice', 1.0 UNION ALL SELECT 'l_extendedprice', 'twice', round(corr(l_quantity, l_extendedprice), 5) FROM lineitem")
def a26(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("twice", F.col("l_quantity") * 2)  # noqa: E741
    return rounded(dataset.correlations(l, ["l_quantity", "l_extendedprice", "twice"], 0.0), 5)


_MANY = [f"m{k}" for k in range(24)]


@query("a26_many_columns", "WITH d AS (SELECT " + ", ".join(f"CASE WHEN l_orderkey % {k + 2} <> 0 THEN l_quantity * {k} + l_extendedprice / 1000 * {24 - k} END AS m{k}" for k in range(24)) + " FROM lineitem), c AS (" + " UNION ALL ".join(f"SELECT 'm{a}' AS feature_a, 'm{b}' AS feature_b, corr(m{a}, m{b}) AS correlation FROM d" for a in range(24) for b in range(a + 1, 24)) + ") SELECT feature_a, feature_b, round(correlation, 5) AS correlation FROM c WHERE abs(correlation) >= 0.9")
def a26_many(spark, sf):
    """Columns with nulls in different rows: 276 pairs in one pass."""
    q, p, o = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey")
    d = table(spark, sf, "lineitem").select(*[F.when(o % (k + 2) != 0, q * k + p / 1000 * (24 - k)).alias(c) for k, c in enumerate(_MANY)])
    return rounded(dataset.correlations(d, _MANY, 0.9), 5)


@query("a27_importance_baseline", "SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 5) AS correlation FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 5) FROM lineitem")
def a27(spark, sf):
    return rounded(dataset.importance_baseline(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"), 5)


_PRED = "q AS (SELECT o_orderkey, opponent, CAST(goals AS DOUBLE) AS y_true, avg(goals) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS y_pred FROM panel)"


def _predicted(spark, sf):
    d = rolling.rolling_features(panel(spark, sf), ["player_id"], ORDER, ["goals"], [], (4,))
    return d.select("o_orderkey", "opponent", F.col("goals").cast("double").alias("y_true"), F.col("goals_rolling_mean_4").alias("y_pred"))


@query("a28_regression_metrics", f"WITH {PANEL}, {_PRED} SELECT round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 5) AS rmse, round(avg(abs(y_true - y_pred)), 5) AS mae, round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)), 5) AS r2, round(avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END) * 100, 4) AS mape, count(*) AS n FROM q")
def a28(spark, sf):
    d = evaluate.regression_metrics(_predicted(spark, sf))
    return d.select(*[F.round(c, 5).alias(c) for c in ("rmse", "mae", "r2")], F.round("mape", 4).alias("mape"), "n")


@query("a29_residual_summary", f"WITH {PANEL}, {_PRED} SELECT round(avg(y_true - y_pred), 5) AS bias, round(stddev_samp(y_true - y_pred), 5) AS residual_std, round(min(y_true - y_pred), 5) AS residual_min, round(max(y_true - y_pred), 5) AS residual_max FROM q")
def a29(spark, sf):
    return rounded(evaluate.residual_summary(_predicted(spark, sf)), 5)


@query("a30_error_by_category", f"WITH {PANEL}, {_PRED} SELECT opponent, round(avg(abs(y_true - y_pred)), 5) AS mae, count(*) AS n FROM q GROUP BY 1")
def a30(spark, sf):
    return rounded(evaluate.error_by(_predicted(spark, sf), "opponent"), 5)


@query("a31_baseline_comparison", f"WITH {PANEL}, {_PRED}, b AS (SELECT avg(y_true) AS a, median(y_true) AS m FROM q), e AS (SELECT avg(abs(y_true - y_pred)) AS x, avg(abs(y_true - a)) AS y, avg(abs(y_true - m)) AS z FROM q, b) SELECT round(x, 5) AS model_mae, round(y, 5) AS mean_mae, round(z, 5) AS median_mae, round((y - x) / y * 100, 4) AS gain_over_mean, round((z - x) / z * 100, 4) AS gain_over_median FROM e")
def a31(spark, sf):
    d = evaluate.baseline_comparison(_predicted(spark, sf))
    return d.select(*[F.round(c, 5 if c.endswith("mae") else 4).alias(c) for c in d.columns])


_CLASS = "q AS (SELECT quality AS t, CAST(n_chars > 800 AS INTEGER) AS p, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))"


def _classified(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select(F.col("quality").alias("y_true"), (F.col("n_chars") > 800).cast("int").alias("y_pred"), F.col("n_chars").cast("double").alias("y_proba"))


@query("a32_classification_metrics", f"WITH {_CLASS}, c AS (SELECT count(*) FILTER (WHERE t = 1 AND p = 1) AS tp, count(*) FILTER (WHERE t <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE t = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE t <> 1 AND p <> 1) AS tn FROM q) SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS \"precision\", round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c")
def a32(spark, sf):
    return rounded(evaluate.classification_metrics(_classified(spark, sf)))


@query("a32_roc_auc", f"WITH {_CLASS} SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6) AS roc_auc FROM q a JOIN q b ON a.t = 1 AND b.t = 0")
def a32b(spark, sf):
    return rounded(evaluate.roc_auc(_classified(spark, sf)))


@query("a33_distribution_summary", f"WITH {PANEL} SELECT opponent, round(avg(goals), 6) AS mean, round(quantile_cont(minutes, 0.1), 6) AS x FROM panel GROUP BY 1".replace("round(avg(goals), 6) AS mean, round(quantile_cont(minutes, 0.1), 6) AS x", "round(avg(minutes), 6) AS mean, " + ", ".join(f"round(quantile_cont(minutes, {q}), 6) AS {n}" for n, q in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + ", round(stddev_samp(minutes), 6) AS std, round(avg(CASE WHEN minutes >= 60 THEN 1.0 ELSE 0.0 END), 6) AS boom_rate"))
def a33(spark, sf):
    return rounded(evaluate.distribution_summary(panel(spark, sf), ["opponent"], "minutes", 60))


@query("d12_pinball_and_log_loss", f"WITH {PANEL}, {_PRED} SELECT round(avg(greatest((y_true - y_pred) * 0.1, (y_true - y_pred) * -0.9)), 5) AS pinball_10, round(avg(greatest((y_true - y_pred) * 0.9, (y_true - y_pred) * -0.1)), 5) AS pinball_90 FROM q".replace("* -0.1", "* (0.9 - 1)").replace("* -0.9", "* (0.1 - 1)"))
def d12(spark, sf):
    return rounded(evaluate.pinball_loss(_predicted(spark, sf), "y_true", {0.1: "y_pred", 0.9: "y_pred"}), 5)


@query("d12_log_loss", f"WITH {_CLASS} SELECT round(avg(-CASE WHEN t = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM (SELECT t, greatest(1e-15, least(1 - 1e-15, s / 50000)) AS p FROM q)")
def d12b(spark, sf):
    return rounded(evaluate.log_loss(_classified(spark, sf).withColumn("p", F.col("y_proba") / 50000), "y_true", "p"))


_PROJ = f"p AS (SELECT o_orderkey AS player_id, opponent AS position, season, minutes * ((o_orderkey % 11) / 10.0) AS combined_score, (o_orderkey % 11) / 10.0 AS xi_prob, goals * 5 < 10 AS is_differential FROM panel)"


def _scored(spark, sf):
    p = panel(spark, sf).select(F.col("o_orderkey").alias("player_id"), F.col("opponent").alias("position"), "season", F.col("minutes").cast("double").alias("mean_points"), ((F.col("o_orderkey") % 11) / 10.0).alias("xi_prob"), (F.col("goals") * 5).alias("ownership"))
    return p


def _projected(spark, sf):
    return project.projections(_scored(spark, sf), ["season"])


@query("w15_projections", f"WITH {PANEL}, {_PROJ} SELECT player_id, CAST(round(combined_score, 6) AS DOUBLE) AS combined_score, CAST(row_number() OVER (PARTITION BY season ORDER BY combined_score DESC, player_id) AS INTEGER) AS overall_rank, CAST(row_number() OVER (PARTITION BY season, position ORDER BY combined_score DESC, player_id) AS INTEGER) AS position_rank, is_differential FROM p")
def w15(spark, sf):
    return rounded(_projected(spark, sf).select("player_id", "combined_score", "overall_rank", "position_rank", "is_differential"))


@query("t2_captains", f"WITH {PANEL}, {_PROJ} SELECT player_id, CASE WHEN xi_prob >= 0.9 THEN 'high projection; nailed on' ELSE 'high projection' END || CASE WHEN is_differential THEN '; differential' ELSE '' END AS reason FROM p WHERE xi_prob >= 0.5 ORDER BY combined_score DESC, player_id LIMIT 5")
def t2(spark, sf):
    return project.captains(project.scores(_scored(spark, sf))).select("player_id", "reason")


@query("t3_differentials", f"WITH {PANEL}, {_PROJ} SELECT player_id FROM p WHERE is_differential ORDER BY combined_score DESC, player_id LIMIT 10")
def t3(spark, sf):
    return project.differentials(project.scores(_scored(spark, sf))).select("player_id")


@query("t4_predictions_query", f"WITH {PANEL} SELECT o_orderkey, c_name FROM panel JOIN customer ON c_custkey = player_id WHERE season = 1996")
def t4(spark, sf):
    players = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), "c_name")
    return project.predictions_for(panel(spark, sf), players, "season", 1996, score="goals").select("o_orderkey", "c_name")


def _features(spark, sf):
    d = rolling.rolling_features(panel(spark, sf), ["player_id"], ORDER, ["minutes"], ["goals"], (3, 5))
    return dataset.next_period_target(d, ["player_id"], ORDER, "goals", "target")


_COLUMNS = ["minutes", "goals", "minutes_rolling_mean_3", "minutes_rolling_mean_5", "goals_rolling_sum_3"]


@query("m1_points_regressor")
def m1(spark, sf):
    """M-1, evaluated as in M-5 (no SQL: a trained model)."""
    d = _features(spark, sf)
    model = ml.train_regressor(d.where("o_orderkey % 4 <> 0"), _COLUMNS, "target", maxIter=5, maxDepth=3)
    return ml.evaluate_model(ml.predict(model, d.where("o_orderkey % 4 = 0")), "target", "predicted")["metrics"]


@query("m2_starter_classifier")
def m2(spark, sf):
    d = dataset.starter_dataset(panel(spark, sf)).select("o_orderkey", "goals", "price", "is_starter")
    model = ml.train_classifier(d.where("o_orderkey % 4 <> 0"), ["goals", "price"], "is_starter", weight=2.0, maxIter=3, maxDepth=3)
    return ml.evaluate_classifier(ml.predict(model, d.where("o_orderkey % 4 = 0")), "is_starter", "predicted")["metrics"]


@query("m3_feature_importance")
def m3(spark, sf):
    d = _features(spark, sf)
    return ml.importance(ml.train_regressor(d, _COLUMNS, "target", maxIter=3, maxDepth=3), d, 3)


@query("m4_random_search")
def m4(spark, sf):
    d = _features(spark, sf).select(*_COLUMNS, "target")
    return ml.random_search(d, _COLUMNS, "target", {"maxDepth": [2, 3], "maxIter": [2, 3]}, tries=2, folds=2)[1]


# what SQL can say of a model: which rows it scores, within which bounds, and that it beats a constant
_HELD_OUT = "SELECT o_orderkey, true AS in_bounds, true AS better_than_constant FROM panel WHERE o_orderkey % 4 = 0"


def _held_out(out, truth, constant):
    """Each scored row, whether its prediction is in bounds, and whether all of them together
    are no further from the truth than ``constant``."""
    off = out.agg((F.avg(F.abs(F.col(truth) - F.col("predicted"))) <= F.avg(F.abs(F.col(truth) - F.lit(constant))) + 0.01).alias("better_than_constant"))
    return out.join(F.broadcast(off)).select("o_orderkey", F.col("in_bounds"), "better_than_constant")  # one row


@query("m1_scored_rows", f"WITH {PANEL} SELECT o_orderkey, true AS in_bounds, true AS better_than_constant FROM (SELECT *, lead(goals) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey) AS target FROM panel) WHERE o_orderkey % 4 = 0 AND target IS NOT NULL")
def m1_scored(spark, sf):
    """M-1 and M-5: predictions of 0 at least, no worse than the mean of the learned rows."""
    d = _features(spark, sf).where("target is not null")
    learned = d.where("o_orderkey % 4 <> 0")
    model = ml.train_regressor(learned, _COLUMNS, "target", maxIter=3, maxDepth=2)
    out = ml.predict(model, d.where("o_orderkey % 4 = 0")).withColumn("in_bounds", F.col("predicted") >= 0)
    return _held_out(out, "target", learned.agg(F.avg("target")).first()[0])


@query("m2_scored_rows", f"WITH {PANEL} {_HELD_OUT}")
def m2_scored(spark, sf):
    """M-2 and M-5: probabilities, no worse than the share of positive rows."""
    p = panel(spark, sf).select("o_orderkey", "goals", "price", (F.col("minutes") >= 60).cast("int").alias("starts"), "minutes")
    learned = p.where("o_orderkey % 4 <> 0")
    model = ml.train_classifier(learned, ["goals", "price"], "starts", maxIter=2, maxDepth=2)
    out = ml.predict(model, p.where("o_orderkey % 4 = 0")).withColumn("in_bounds", F.col("predicted").between(0, 1))
    return _held_out(out, "starts", learned.agg(F.avg("starts")).first()[0])


@query("m3_ranked_features", " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS in_bounds" for c in sorted(_COLUMNS)))
def m3_ranked(spark, sf):
    """M-3: every feature once, importances between 0 and 1 that add up to 1."""
    d = _features(spark, sf)
    found = ml.importance(ml.train_regressor(d, _COLUMNS, "target", maxIter=2, maxDepth=2), d)
    total = found.agg((F.abs(F.sum("importance") - 1) < 1e-6).alias("_one"))
    return found.join(F.broadcast(total)).select("feature", (F.col("importance").between(0, 1) & F.col("_one")).alias("in_bounds"))


@query("m4_best_of_tries", "SELECT 2 AS tries, true AS best_is_least")
def m4_best(spark, sf):
    """M-4: so many tries, and the best parameters are those of the least error."""
    d = _features(spark, sf).where("target is not null").select(*_COLUMNS, "target")
    best, tried = ml.random_search(d, _COLUMNS, "target", {"maxDepth": [2, 3], "maxIter": [2, 3]}, tries=2, folds=2)
    return tried.agg(F.count("*").cast("int").alias("tries"), (F.min_by("parameters", "score") == str(best)).alias("best_is_least"))


_FOLDS = f"WITH {PANEL}, d AS (SELECT season, lead(goals) OVER ({_BY}) AS target FROM panel), p AS (SELECT DISTINCT season FROM d WHERE target IS NOT NULL), r AS (SELECT season AS tested, lag(season) OVER (ORDER BY season) AS until, row_number() OVER (ORDER BY season) - count(*) OVER () + 2 AS fold FROM p), t AS (SELECT fold, count(*) AS train_rows, avg(target) AS m FROM d JOIN r ON season <= until WHERE target IS NOT NULL AND fold > 0 GROUP BY 1), e AS (SELECT r.fold, count(*) AS test_rows, avg(abs(target - m)) AS off FROM d JOIN r ON season = tested JOIN t ON t.fold = r.fold WHERE target IS NOT NULL GROUP BY 1) "


@query("m4_time_ordered_search", _FOLDS + "SELECT CAST(t.fold AS INTEGER) AS fold, train_rows, test_rows, round(off, 6) AS constant_error, true AS tries_scored FROM t JOIN e ON e.fold = t.fold")
def m4_ordered(spark, sf):
    """M-4 over the folds of D-10: sizes of the folds, the error of a constant, and whether
    each try has an error of its own there."""
    d = _features(spark, sf).where("target is not null")
    folds = dataset.expanding_folds(d, "season", 2)
    _, tried = ml.ordered_search(d, _COLUMNS, "target", {"maxDepth": [2, 3], "maxIter": [2, 3]}, "season", folds, tries=2)
    made = tried.groupBy("fold", "train_rows", "test_rows").agg(F.max(F.when(F.col("try") < 0, F.col("score"))).alias("constant_error"), (F.count_if((F.col("try") >= 0) & (F.col("score") > 0)) == 2).alias("tries_scored"))
    return rounded(made)


@query("d10_expanding_folds", f"WITH {PANEL}, p AS (SELECT DISTINCT season FROM panel), r AS (SELECT season AS tested, lag(season, 2) OVER (ORDER BY season) AS until, row_number() OVER (ORDER BY season) - count(*) OVER () + 3 AS fold FROM p) SELECT CAST(fold AS INTEGER) AS fold, tested AS \"at\", until, (SELECT count(*) FROM panel WHERE season <= until) AS train_rows, (SELECT count(*) FROM panel WHERE season = tested) AS test_rows FROM r WHERE fold > 0 AND until IS NOT NULL")
def d10_folds(spark, sf):
    """Expanding folds with a gap of a period, and their sizes."""
    p = panel(spark, sf)
    folds = dataset.expanding_folds(p, "season", 3, gap=1)
    sizes = p.groupBy("season").agg(F.count("*").alias("n"))
    return folds.join(F.broadcast(sizes), F.col("season") <= F.col("at")).groupBy("fold", "at", "until").agg(F.sum(F.when(F.col("season") <= F.col("until"), F.col("n"))).alias("train_rows"), F.sum(F.when(F.col("season") == F.col("at"), F.col("n"))).alias("test_rows"))  # a row a season
