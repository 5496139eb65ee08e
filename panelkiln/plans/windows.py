"""Queries of window, head-to-head and context operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import names as N
from ..operators import context, h2h, merge, rolling, scan
from .tables import MATCH_ORDER, MATCHES, ORDER, PANEL, matches, panel, rounded, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _mean(c: str, w: int, by: str = "player_id", order: str = "o_orderdate, o_orderkey") -> str:
    over = f"PARTITION BY {by} ORDER BY {order}"
    last, all_ = f"({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)", f"({over} ROWS UNBOUNDED PRECEDING)"
    full = f"row_number() OVER ({over}) >= {w} AND count({c}) OVER {last} = {w}"
    return f"CASE WHEN {full} THEN avg({c}) OVER {last} WHEN {c} IS NULL THEN NULL ELSE sum({c}) OVER {all_} / row_number() OVER ({over}) END"


def _sum(c: str, w: int, by: str = "player_id", order: str = "o_orderdate, o_orderkey") -> str:
    over = f"PARTITION BY {by} ORDER BY {order}"
    last, all_ = f"({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)", f"({over} ROWS UNBOUNDED PRECEDING)"
    full = f"row_number() OVER ({over}) >= {w} AND count({c}) OVER {last} = {w}"
    return f"CAST(CASE WHEN {full} THEN sum({c}) OVER {last} WHEN {c} IS NULL THEN NULL ELSE sum({c}) OVER {all_} END AS BIGINT)"


def _full(c: str, w: int, by: str = "player_id", order: str = "o_orderdate, o_orderkey") -> str:
    over = f"PARTITION BY {by} ORDER BY {order}"
    last = f"({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN row_number() OVER ({over}) >= {w} AND count({c}) OVER {last} = {w} THEN avg({c}) OVER {last} END"


_W1 = ", ".join([f"round({_mean('price', w)}, 6) AS price_rolling_mean_{w}, {_sum('goals', w)} AS goals_rolling_sum_{w}" for w in (3, 5, 10)])


@query("w1_rolling_features", f"WITH {PANEL} SELECT player_id, o_orderkey, {_W1} FROM panel")
def w1(spark, sf):
    d = rolling.rolling_features(panel(spark, sf), ["player_id"], ORDER, ["price"], ["goals"])
    return rounded(d.select("player_id", "o_orderkey", *[c for c in d.columns if "_rolling_" in c]))


@query("w1_rolling_by_season", f"WITH {PANEL} SELECT season, o_orderkey, " + _W1.replace("PARTITION BY player_id", "PARTITION BY season") + " FROM panel")
def w1_seasons(spark, sf):
    """W-1 where a key is a season: few keys, each larger than a task may hold."""
    d = scan.rolling(panel(spark, sf), ORDER, ["season"], ["price"], ["goals"], config.WINDOWS)
    return rounded(d.select("season", "o_orderkey", *[c for c in d.columns if "_rolling_" in c]))


@query("w7_forward_fill_whole_table", f"WITH {PANEL} SELECT o_orderkey, last_value(price IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS price FROM panel")
def w7_whole(spark, sf):
    """W-7 without a group."""
    from ..operators.impute import forward_fill

    return forward_fill(panel(spark, sf), ["price"], ORDER).select("o_orderkey", "price")


@query("p13_metric_resolver", f"WITH {PANEL} SELECT player_id, o_orderkey, round({_mean('price', 3)}, 6) AS price_rolling_mean_3, round({_mean('minutes', 3)}, 6) AS minutes_rolling_mean_3, {_sum('goals', 3)} AS goals_rolling_sum_3 FROM panel")
def p13(spark, sf):
    from ..operators.metrics import resolve_metrics

    p = panel(spark, sf)
    mean, sums = resolve_metrics(p, sums={"goals"}, exclude={"o_orderkey"})
    d = rolling.rolling_features(p, ["player_id"], ORDER, mean, sums, (3,))
    return rounded(d.select("player_id", "o_orderkey", *[c for c in d.columns if "_rolling_" in c]))


_W2 = f"round({_mean('price', 5)}, 6)"


@query("w2_team_rolling_venue", f"WITH {PANEL}, r AS (SELECT player_id, o_orderkey, was_home, {_W2} AS price_rolling_mean_5, {_sum('goals', 5)} AS goals_rolling_sum_5 FROM panel) SELECT player_id, o_orderkey, price_rolling_mean_5, goals_rolling_sum_5, CASE WHEN was_home THEN price_rolling_mean_5 END AS home_price_rolling_mean_5, CASE WHEN was_home THEN goals_rolling_sum_5 END AS home_goals_rolling_sum_5, CASE WHEN NOT was_home THEN price_rolling_mean_5 END AS away_price_rolling_mean_5, CASE WHEN NOT was_home THEN goals_rolling_sum_5 END AS away_goals_rolling_sum_5 FROM r")
def w2(spark, sf):
    d = rolling.team_rolling_features(panel(spark, sf), ["player_id"], ORDER, ["price"], ["goals"], (5,))
    return rounded(d.select("player_id", "o_orderkey", *[c for c in d.columns if "_rolling_" in c]))


_W3 = ", ".join(f"round({_full(m, w)}, 6) AS {m}_form_{n}" for m in ("price", "goals") for n, w in (("7d", 3), ("14d", 6), ("30d", 10)))


@query("w3_player_form", f"WITH {PANEL} SELECT player_id, o_orderkey, {_W3} FROM panel")
def w3(spark, sf):
    d = rolling.form_metrics(panel(spark, sf), ["player_id"], ORDER, ["price", "goals"])
    return rounded(d.select("player_id", "o_orderkey", *[c for c in d.columns if "_form_" in c]))


_M = "home_team_id, away_team_id"
_MO = ", ".join(MATCH_ORDER)


@query("w4_team_form", f"WITH {MATCHES} SELECT {_M}, l_orderkey, l_linenumber, l_partkey, round({_full('home_goals', 3, _M, _MO)}, 6) AS team_home_goals_form_7d, round({_full('home_goals', 6, _M, _MO)}, 6) AS team_home_goals_form_14d FROM matches")
def w4(spark, sf):
    d = rolling.form_metrics(matches(spark, sf), ["home_team_id", "away_team_id"], MATCH_ORDER, ["home_goals"], {"7d": 3, "14d": 6}, "team_")
    return rounded(d.select("home_team_id", "away_team_id", "l_orderkey", "l_linenumber", "l_partkey", "team_home_goals_form_7d", "team_home_goals_form_14d"))


@query("w5_days_since_last", "SELECT event_id, CAST(floor((epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts)) / 86400) AS BIGINT) AS days_since_last_match FROM events")
def w5(spark, sf):
    return context.days_since_last(table(spark, sf, "events"), ["user_id"], "ts", tie=["event_id"]).select("event_id", "days_since_last_match")


_RANGE = ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {d * 86400} PRECEDING AND CURRENT ROW) AS matches_last_{d}d" for d in (7, 14, 30))


@query("w6_matches_within_days", f"WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) SELECT event_id, {_RANGE} FROM e")
def w6(spark, sf):
    return context.matches_within(table(spark, sf, "events"), ["user_id"], "ts").select("event_id", "matches_last_7d", "matches_last_14d", "matches_last_30d")


@query("f2_rest_and_fatigue", "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events) SELECT event_id, CAST(floor((s - lag(s) OVER (PARTITION BY user_id ORDER BY s)) / 86400) AS BIGINT) AS days_since_last_match, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS matches_last_7d, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS team_matches_last_7d FROM e")
def f2(spark, sf):
    e = table(spark, sf, "events").withColumnsRenamed({"user_id": "player_id", "event_type": "team", "ts": "kickoff_time"})
    return context.rest_and_fatigue(e, tie=["event_id"]).select("event_id", "days_since_last_match", "matches_last_7d", "team_matches_last_7d")


_H2H = """r AS (SELECT *, row_number() OVER (PARTITION BY player_id, opponent ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM panel)
SELECT player_id, opponent, round(avg(price), 6) AS avg_price, CAST(sum(goals) AS BIGINT) AS total_goals, count(*) AS appearances,
  round(avg(price) FILTER (WHERE k <= 3), 6) AS price_h2h_last_3, CAST(sum(goals) FILTER (WHERE k <= 3) AS BIGINT) AS goals_h2h_sum_last_3,
  round(avg(price) FILTER (WHERE k <= 5), 6) AS price_h2h_last_5, CAST(sum(goals) FILTER (WHERE k <= 5) AS BIGINT) AS goals_h2h_sum_last_5,
  round(avg(price) FILTER (WHERE k <= 5), 6) AS recent_price_last_5, CAST(sum(goals) FILTER (WHERE k <= 5) AS BIGINT) AS recent_goals_sum_last_5,
  round(avg(price) FILTER (WHERE was_home), 6) AS avg_price_home, CAST(sum(goals) FILTER (WHERE was_home) AS BIGINT) AS total_goals_home,
  round(avg(price) FILTER (WHERE NOT was_home), 6) AS avg_price_away, CAST(sum(goals) FILTER (WHERE NOT was_home) AS BIGINT) AS total_goals_away
FROM r GROUP BY player_id, opponent"""


@query("a1_player_vs_opponent", f"WITH {PANEL}, {_H2H}")
def a1(spark, sf):
    """A-1 with A-2 and A-3."""
    return rounded(h2h.head_to_head(panel(spark, sf), ["player_id", "opponent"], ORDER, ["price"], ["goals"], (3, 5), was_home="was_home"))


@query("p8_season_filter_h2h", f"WITH {PANEL} SELECT player_id, opponent, round(avg(price), 6) AS avg_price, count(*) AS appearances, round(avg(price) FILTER (WHERE k <= 5), 6) AS recent_price_last_5 FROM (SELECT *, row_number() OVER (PARTITION BY player_id, opponent ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM panel WHERE season IN (1995, 1996)) GROUP BY player_id, opponent")
def p8(spark, sf):
    return rounded(h2h.head_to_head(panel(spark, sf), ["player_id", "opponent"], ORDER, ["price"], [], (), seasons=[1995, 1996]))


@query("a4_team_head_to_head", f"WITH {MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY {_M} ORDER BY {', '.join(c + ' DESC' for c in MATCH_ORDER)}) AS k FROM matches) SELECT {_M}, round(avg(home_goals), 6) AS avg_home_goals, round(avg(away_goals), 6) AS avg_away_goals, round(sum(home_goals), 6) AS total_home_goals, count(*) AS total_matches, round(avg(home_goals) FILTER (WHERE k <= 3), 6) AS home_goals_h2h_last_3, round(avg(away_goals) FILTER (WHERE k <= 3), 6) AS away_goals_h2h_last_3, round(sum(home_goals) FILTER (WHERE k <= 3), 6) AS home_goals_h2h_sum_last_3, round(avg(home_goals) FILTER (WHERE k <= 5), 6) AS recent_home_goals_last_5, round(avg(away_goals) FILTER (WHERE k <= 5), 6) AS recent_away_goals_last_5, round(sum(home_goals) FILTER (WHERE k <= 5), 6) AS recent_home_goals_sum_last_5 FROM r GROUP BY {_M}")
def a4(spark, sf):
    return rounded(h2h.head_to_head(matches(spark, sf), ["home_team_id", "away_team_id"], MATCH_ORDER, ["home_goals", "away_goals"], ["home_goals"], (3,), "total_matches", few=True))


@query("a5_h2h_bundle", f"WITH {PANEL}, {MATCHES}, t AS (SELECT {_M}, round(avg(home_goals), 6) AS avg_home_goals, count(*) AS total_matches FROM matches GROUP BY {_M}), p AS (SELECT player_id, opponent, count(*) AS appearances FROM panel GROUP BY player_id, opponent) SELECT 'team' AS part, CAST(home_team_id AS VARCHAR) AS a, CAST(away_team_id AS VARCHAR) AS b, total_matches AS n FROM t UNION ALL SELECT 'player', CAST(player_id AS VARCHAR), opponent, appearances FROM p")
def a5(spark, sf):
    made = h2h.head_to_head_bundle(panel(spark, sf), matches(spark, sf), player={"pair": ["player_id", "opponent"], "order": ORDER, "mean": ["price"]}, team={"pair": ["home_team_id", "away_team_id"], "order": MATCH_ORDER, "mean": ["home_goals"]})
    part = lambda d, name, a, b, n: d.select(F.lit(name).alias("part"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(n).alias("n"))
    return part(made["team_h2h"], "team", "home_team_id", "away_team_id", "total_matches").unionByName(part(made["player_vs_team"], "player", "player_id", "opponent", "appearances"))


_VENUE = "r AS (SELECT *, row_number() OVER (PARTITION BY player_id, opponent, was_home ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM panel)"
_A6 = ", ".join(f"round(avg(price) FILTER (WHERE {s}), 6) AS {n}_avg_price, CAST(sum(goals) FILTER (WHERE {s}) AS BIGINT) AS {n}_total_goals, count(*) FILTER (WHERE {s}) AS {n}_appearances, round(avg(price) FILTER (WHERE {s} AND k <= 3), 6) AS {n}_price_rolling_3" for n, s in (("home", "was_home"), ("away", "NOT was_home")))


@query("a6_player_home_away", f"WITH {PANEL}, {_VENUE} SELECT player_id, opponent, {_A6} FROM r GROUP BY player_id, opponent")
def a6(spark, sf):
    return rounded(h2h.player_home_away(panel(spark, sf), ["player_id", "opponent"], ORDER, ["price"], ["goals"], (3,)))


_TEAM = f"""s AS (
  SELECT home_team_id AS team, away_team_id AS opponent, true AS at_home, {_MO}, home_goals AS f, away_goals AS g FROM matches
  UNION ALL SELECT away_team_id, home_team_id, false, {_MO}, away_goals, home_goals FROM matches
), r AS (SELECT *, row_number() OVER (PARTITION BY team, opponent, at_home ORDER BY {', '.join(c + ' DESC' for c in MATCH_ORDER)}) AS k FROM s)"""
_A7 = ", ".join(f"round(avg({c}) FILTER (WHERE {s}), 6) AS {n}_avg_{p}_home_goals" for n, s in (("home", "at_home"), ("away", "NOT at_home")) for p, c in (("for", "f"), ("against", "g")))
_A7L = ", ".join(f"round(avg({c}) FILTER (WHERE at_home AND k <= 3), 6) AS home_{p}_home_goals_rolling_3" for p, c in (("for", "f"), ("against", "g")))


@query("a7_team_home_away", f"WITH {MATCHES}, {_TEAM} SELECT team, opponent, {_A7}, count(*) FILTER (WHERE at_home) AS home_matches, count(*) FILTER (WHERE NOT at_home) AS away_matches, {_A7L} FROM r GROUP BY team, opponent")
def a7(spark, sf):
    return rounded(h2h.team_home_away(matches(spark, sf), "home_team_id", "away_team_id", MATCH_ORDER, [("home_goals", "away_goals")], (3,)))


_ADV = "round((h - a) / greatest(a, 0.01), 6) AS price_home_advantage, round((a - h) / greatest(h, 0.01), 6) AS price_away_degradation"


@query("a8_home_advantage", f"WITH {PANEL}, g AS (SELECT player_id, opponent, avg(price) FILTER (WHERE was_home) AS h, avg(price) FILTER (WHERE NOT was_home) AS a FROM panel GROUP BY player_id, opponent) SELECT player_id, opponent, CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN round((h - a) / greatest(a, 0.01), 6) END AS price_home_advantage, CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN round((a - h) / greatest(h, 0.01), 6) END AS price_away_degradation FROM g")
def a8(spark, sf):
    d = h2h.advantage(h2h.player_home_away(panel(spark, sf), ["player_id", "opponent"], ORDER, ["price"], [], ()), ["price"])
    return rounded(d.select("player_id", "opponent", "price_home_advantage", "price_away_degradation"))


@query("a9_home_away_bundle", f"WITH {MATCHES}, {_TEAM}, g AS (SELECT team, opponent, avg(f) FILTER (WHERE at_home) AS h, avg(f) FILTER (WHERE NOT at_home) AS a FROM r GROUP BY team, opponent) SELECT team, opponent, CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN round((h - a) / greatest(a, 0.01), 6) END AS for_home_goals_home_advantage FROM g")
def a9(spark, sf):
    made = h2h.home_away_bundle(panel(spark, sf), matches(spark, sf), {"pair": ["player_id", "opponent"], "order": ORDER, "mean": ["price"]}, {"home": "home_team_id", "away": "away_team_id", "order": MATCH_ORDER, "metrics": [("home_goals", "away_goals")]})
    return rounded(made["team"].select("team", "opponent", "for_home_goals_home_advantage"))


@query("w7_forward_fill", f"WITH {PANEL} SELECT player_id, o_orderkey, round(last_value(price IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS price FROM panel")
def w7(spark, sf):
    from ..operators.impute import forward_fill

    return rounded(forward_fill(panel(spark, sf), ["price"], ORDER, ["player_id"]).select("player_id", "o_orderkey", "price"))


@query("w8_keep_best_per_key", f"WITH {PANEL} SELECT player_id, opponent, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY player_id, opponent ORDER BY coalesce(price, 0) DESC, o_orderkey) AS k FROM panel) WHERE k = 1")
def w8(spark, sf):
    return merge.keep_best(panel(spark, sf), ["player_id", "opponent"], "price", ["o_orderkey"]).select("player_id", "opponent", "o_orderkey")


@query("w9_keep_most_minutes", f"WITH {PANEL} SELECT player_id, season, o_orderkey, minutes FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY minutes DESC, o_orderkey) AS k FROM panel) WHERE k = 1")
def w9(spark, sf):
    return merge.keep_best(panel(spark, sf), ["player_id", "season"], "minutes", ["o_orderkey"]).select("player_id", "season", "o_orderkey", "minutes")


@query("w10_one_row_per_target", f"WITH {PANEL}, q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN player_id END AS player_id, price FROM panel) SELECT o_orderkey, player_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY coalesce(price, 0) DESC, o_orderkey) AS k FROM q) WHERE k = 1 OR player_id IS NULL")
def w10(spark, sf):
    from ..operators.resolve import keep_most_confident

    p = panel(spark, sf).withColumn("player_id", F.when(F.col("o_orderkey") % 11 != 0, F.col("player_id")))
    return keep_most_confident(p, "player_id", "price", ["o_orderkey"]).select("o_orderkey", "player_id")


@query("w11_sql_dedupe", f"WITH {PANEL} SELECT season, player_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY season, player_id ORDER BY price DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey) AS k FROM panel) WHERE k = 1")
def w11(spark, sf):
    return merge.sql_dedupe(panel(spark, sf), ["season", "player_id"], [F.col("price").desc_nulls_last(), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")]).select("season", "player_id", "o_orderkey")


@query("w16_bonus_allocation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN k <= 3 THEN 4 - k ELSE 0 END AS INTEGER) AS bonus FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)")
def w16(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    return merge.bonus(l, "l_orderkey", "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "bonus")


@query("w17_match_ordinal", f"WITH {PANEL} SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY season ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS match_ordinal FROM panel")
def w17(spark, sf):
    from ..operators.clean import match_ordinal

    return match_ordinal(panel(spark, sf), "season", ORDER).select("o_orderkey", "match_ordinal")


_STRENGTH = "teams AS (SELECT CAST(s_nationkey AS BIGINT) AS id, round(avg(s_acctbal) / 2000, 1) AS strength FROM supplier GROUP BY s_nationkey)"


def _teams(spark, sf):
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.round(F.avg("s_acctbal") / 2000, 1).alias("strength"))


@query("f1_fixture_difficulty", f"WITH {MATCHES}, {_STRENGTH}, d AS (SELECT home_team_id, away_team_id, l_orderkey, l_linenumber, l_partkey, CASE WHEN b.strength IS NULL THEN 3.0 ELSE least(5.0, greatest(1.0, b.strength - 1)) END AS h, CASE WHEN a.strength IS NULL THEN 3.0 ELSE least(5.0, greatest(1.0, a.strength + 1)) END AS v FROM matches LEFT JOIN teams b ON b.id = away_team_id LEFT JOIN teams a ON a.id = home_team_id) SELECT home_team_id, away_team_id, l_orderkey, l_linenumber, l_partkey, round(h, 6) AS home_difficulty, round(v, 6) AS away_difficulty FROM d")
def f1(spark, sf):
    d = context.fixture_difficulty(matches(spark, sf), _teams(spark, sf))
    return rounded(d.select("home_team_id", "away_team_id", "l_orderkey", "l_linenumber", "l_partkey", "home_difficulty", "away_difficulty"))


@query("a10_team_strength", f"WITH {MATCHES}, t AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 1000.0 AS base FROM nation), h AS (SELECT home_team_id AS id, avg(home_goals) AS g, avg(home_xg) AS x FROM matches GROUP BY 1), a AS (SELECT away_team_id AS id, avg(away_goals) AS g FROM matches GROUP BY 1) SELECT t.id, round(coalesce(h.g, base / 10), 6) AS attack_home, round(coalesce(a.g, base / 10), 6) AS attack_away, round(h.x, 6) AS home_xg_mean FROM t LEFT JOIN h ON h.id = t.id LEFT JOIN a ON a.id = t.id")
def a10(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(1000.0).alias("strength_attack_home"), F.lit(1000.0).alias("strength_attack_away"))
    d = context.team_strength(t, matches(spark, sf).withColumn("away_xg", F.lit(0.0)))
    return d.select("id", F.round("attack_home", 6).alias("attack_home"), F.round("attack_away", 6).alias("attack_away"), F.round("home_xg_mean", 6).alias("home_xg_mean"))


@query("a11_strength_of_schedule", f"WITH {MATCHES}, s AS (SELECT home_team_id AS team, true AS hm, {_MO}, home_goals AS v FROM matches UNION ALL SELECT away_team_id, false, {_MO}, home_goals FROM matches), r AS (SELECT *, row_number() OVER (PARTITION BY team, hm ORDER BY {_MO}) AS k FROM s) SELECT team, round(avg(v) FILTER (WHERE hm), 6) AS home_difficulty_mean, count(*) FILTER (WHERE hm) AS home_fixtures, round(avg(v) FILTER (WHERE NOT hm), 6) AS away_difficulty_mean, count(*) FILTER (WHERE NOT hm) AS away_fixtures, round(avg(v), 6) AS schedule_difficulty FROM r WHERE k <= 5 GROUP BY team")
def a11(spark, sf):
    return rounded(context.strength_of_schedule(matches(spark, sf), 5, MATCH_ORDER, value="home_goals"))


@query("a12_defensive_totals", f"WITH {PANEL} SELECT f.season, f.opponent, CAST(coalesce(sum(goals) FILTER (WHERE was_home), 0) AS BIGINT) AS team_h_goals, CAST(coalesce(sum(goals) FILTER (WHERE NOT was_home), 0) AS BIGINT) AS team_a_goals FROM panel f GROUP BY f.season, f.opponent")
def a12(spark, sf):
    p = panel(spark, sf).withColumn("key", F.concat_ws("|", "season", "opponent"))
    f = p.select("key", "season", "opponent").distinct()
    d = context.defensive_totals(f, p, "key", "was_home", ["goals"])
    return d.select("season", "opponent", F.coalesce("team_h_goals", F.lit(0)).alias("team_h_goals"), F.coalesce("team_a_goals", F.lit(0)).alias("team_a_goals"))


@query("a13_team_availability", f"WITH {PANEL} SELECT o_orderkey, status = 'a' AS is_available, CAST(CASE status WHEN 'a' THEN 1.0 WHEN 'd' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS availability_score, round(avg(CASE WHEN status = 'a' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY opponent), 6) AS team_availability_rate, count(*) OVER (PARTITION BY opponent) AS squad_size FROM panel")
def a13(spark, sf):
    """A-13 with P-18; F-3."""
    d = context.availability(panel(spark, sf), "opponent")
    return d.select("o_orderkey", "is_available", "availability_score", F.round("team_availability_rate", 6).alias("team_availability_rate"), "squad_size")


@query("a20_international_load", "WITH l AS (SELECT user_id, CAST(sum(event_id % 91) AS BIGINT) AS m FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT c_custkey, coalesce(m, 0) AS intl_minutes_total, CAST(coalesce(m, 0) > 0 AS INTEGER) AS played_international FROM customer LEFT JOIN l ON user_id = c_custkey")
def a20(spark, sf):
    """A-20; F-4."""
    load = table(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("c_custkey"), (F.col("event_id") % 91).alias("minutes"))
    return context.international_load(table(spark, sf, "customer"), load, "c_custkey").select("c_custkey", "intl_minutes_total", "played_international")


_L = "OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_KO = (["player_id"], ORDER)


@query("d1_minutes_reliability", f"WITH {PANEL}, q AS (SELECT o_orderkey, avg(CASE WHEN minutes >= 60 THEN 1.0 ELSE 0.0 END) {_L} AS s, sum(CASE WHEN minutes >= 60 THEN minutes END) {_L} AS t, sum(CASE WHEN minutes >= 60 THEN 1 ELSE 0 END) {_L} AS k, stddev_samp(minutes) {_L} AS d FROM panel) SELECT o_orderkey, round(s, 6) AS start_prob, round(CASE WHEN k > 0 THEN t / k END, 6) AS minutes_if_started, round(s * coalesce(CASE WHEN k > 0 THEN t / k END, 0), 6) AS expected_minutes, round(d, 6) AS minutes_std FROM q")
def d1(spark, sf):
    d = rolling.minutes_reliability(panel(spark, sf), *_KO, 5)
    return rounded(d.select("o_orderkey", "start_prob", "minutes_if_started", "expected_minutes", "minutes_std"))


@query("d2_per_90", f"WITH {PANEL}, q AS (SELECT o_orderkey, sum(CASE WHEN minutes >= 30 THEN goals END) {_L} AS g, sum(CASE WHEN minutes >= 30 THEN minutes END) {_L} AS m FROM panel) SELECT o_orderkey, round(g / m * 90, 6) AS goals_per90_5 FROM q")
def d2(spark, sf):
    return rounded(rolling.per_90(panel(spark, sf), *_KO, 5, ["goals"]).select("o_orderkey", "goals_per90_5"))


@query("d3_usage_share", f"WITH {PANEL}, t AS (SELECT opponent, season, sum(goals) AS g FROM panel GROUP BY 1, 2), u AS (SELECT opponent, season, sum(g) OVER (PARTITION BY opponent ORDER BY season ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS g FROM t), q AS (SELECT o_orderkey, opponent, season, sum(goals) {_L} AS own FROM panel) SELECT o_orderkey, round(CASE WHEN g <> 0 THEN CAST(own AS DOUBLE) / CAST(g AS DOUBLE) END, 6) AS goals_share_5 FROM q LEFT JOIN u USING (opponent, season)")
def d3(spark, sf):
    d = rolling.usage_share(panel(spark, sf), ["player_id"], ["opponent"], ORDER, 5, ["goals"], ["season"])
    return rounded(d.select("o_orderkey", "goals_share_5"), 6)


@query("d4_quality_ratios", f"WITH {PANEL}, q AS (SELECT o_orderkey, sum(CAST(goals AS DOUBLE)) {_L} AS g, sum(CAST(minutes AS DOUBLE)) {_L} AS m FROM panel) SELECT o_orderkey, round(CASE WHEN m <> 0 THEN g / m END, 6) AS goals_a_minute FROM q")
def d4(spark, sf):
    return rounded(rolling.ratios(panel(spark, sf), *_KO, 5, {"goals_a_minute": ("goals", "minutes")}).select("o_orderkey", "goals_a_minute"), 6)


@query("d5_team_strength_window", f"WITH {PANEL} SELECT o_orderkey, round(avg(goals) {_L}, 6) AS goals_mean_5, round(stddev_samp(goals) {_L}, 6) AS goals_std_5, round(avg(minutes) {_L}, 6) AS minutes_mean_5, round(stddev_samp(minutes) {_L}, 6) AS minutes_std_5 FROM panel")
def d5(spark, sf):
    d = rolling.team_strength_window(panel(spark, sf), *_KO, 5, "goals", "minutes")
    return rounded(d.select("o_orderkey", "goals_mean_5", "goals_std_5", "minutes_mean_5", "minutes_std_5"))


@query("d6_fatigue_factor", "SELECT event_id, CAST(round(least(1.0, greatest(0.0, 1 - (3 - (event_id % 5)) * 0.1)), 6) AS DOUBLE) AS fatigue FROM events")
def d6(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(context.fatigue_factor(F.col("event_id") % 5), 6).alias("fatigue"))


@query("d7_form_ratio", f"WITH {PANEL} SELECT o_orderkey, round(avg(price) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / avg(price) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS price_form_ratio, round(avg(price) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS price_to_date FROM panel")
def d7(spark, sf):
    d = rolling.form_ratio(panel(spark, sf), *_KO, "price")
    return d.select("o_orderkey", F.round("price_form_ratio", 6).alias("price_form_ratio"), F.round("price_to_date", 6).alias("price_to_date"))


@query("d8_availability_probability", "SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 101) / 100 END, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS p FROM orders")
def d8(spark, sf):
    o = panel(spark, sf)
    return o.select("o_orderkey", context.availability_probability(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 101), F.col("status")).alias("p"))


_LAG = [f"lag(goals, {k}) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey)" for k in range(5)]
_TOP = " + ".join(f"coalesce({v} * {5 - k}, 0)" for k, v in enumerate(_LAG))
_LOW = " + ".join(f"(CASE WHEN {v} IS NOT NULL THEN {5 - k} ELSE 0 END)" for k, v in enumerate(_LAG))


@query("d11_form_index", f"WITH {PANEL} SELECT o_orderkey, round(({_TOP}) / ({_LOW}), 6) AS goals_form_index, round(stddev_samp(goals) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS goals_consistency FROM panel")
def d11(spark, sf):
    return rounded(rolling.form_index(panel(spark, sf), *_KO, "goals").select("o_orderkey", "goals_form_index", "goals_consistency"))


@query("d11_forward_means", f"WITH {PANEL} SELECT o_orderkey, " + ", ".join(f"round(avg(goals) OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), 6) AS goals_next_{n}" for n in (1, 3, 5)) + " FROM panel")
def d11b(spark, sf):
    return rounded(rolling.forward_means(panel(spark, sf), *_KO, "goals").select("o_orderkey", "goals_next_1", "goals_next_3", "goals_next_5"))


@query("d13_busy_periods", f"WITH {PANEL}, c AS (SELECT DISTINCT player_id, s.season FROM panel CROSS JOIN (SELECT DISTINCT season FROM panel) s), n AS (SELECT player_id, season, count(*) AS n FROM panel GROUP BY 1, 2) SELECT player_id, season, coalesce(n, 0) AS fixtures, coalesce(n, 0) > 1 AS is_double, coalesce(n, 0) = 0 AS is_blank FROM c LEFT JOIN n USING (player_id, season)")
def d13(spark, sf):
    p = panel(spark, sf)
    calendar = p.select("player_id").distinct().crossJoin(F.broadcast(p.select("season").distinct()))
    return context.busy_periods(p, calendar, "player_id", "season")


@query("d9_defensive_points", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(least(5, floor((l_linenumber + l_partkey % 3 + l_suppkey % 4 + l_orderkey % 2) / 2)) AS BIGINT) AS points FROM lineitem")
def d9(spark, sf):
    from ..functions.scoring import defensive_points

    l = table(spark, sf, "lineitem")  # noqa: E741
    c = F.col
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", defensive_points(c("l_linenumber"), c("l_partkey") % 3, c("l_suppkey") % 4, c("l_orderkey") % 2).alias("points"))


@query("p26_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def p26(spark, sf):
    return table(spark, sf, "events").select("event_id", N.day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))
