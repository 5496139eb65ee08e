"""Queries of cleaning, imputation, validation and monitoring operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scoring
from ..operators import clean, impute, quality, sketches
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


@query("p1_conform_source", "SELECT o_custkey AS player_id, o_orderkey AS fixture_id, CAST(o_orderpriority AS VARCHAR) AS opponent_team_id FROM orders")
def p1(spark, sf):
    o = table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "element", "o_orderkey": "fixture", "o_orderpriority": "opponent_team"})
    d = clean.conform(o, {"element": "player_id", "fixture": "fixture_id", "opponent_team": "opponent_team_id", "GW": "gameweek"}, {"player_id": "long"})
    return d.select("player_id", "fixture_id", "opponent_team_id")


@query("p2_conform_by_crosswalk", "SELECT event_id, c_custkey + 1000000 AS player_id, CAST(NULL AS BIGINT) AS gameweek FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey % 3 <> 0")
def p2(spark, sf):
    x = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") + 1000000).alias("to"))
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("c_custkey"))
    return clean.by_crosswalk(e, x, "c_custkey", "to").select("event_id", "player_id", "gameweek")


@query("p3_stack_two_sources", "SELECT c_custkey AS player_id, c_acctbal AS value, c_mktsegment AS team, 'a' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'b' FROM supplier WHERE s_suppkey % 2 = 0")
def p3(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("team"))
    b = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("player_id"), F.col("s_acctbal").alias("value"))
    return clean.stack_sources({"a": a, "b": b}, {"player_id": "long", "value": "double", "team": "string"}, "player_id")


@query("p4_state_snapshot", "SELECT o_custkey AS player_id, CAST(38 AS INTEGER) AS gameweek, o_orderstatus = 'F' AS in_squad, CAST(floor(o_totalprice) AS INTEGER) AS now_cost FROM orders")
def p4(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("player_id"), (F.col("o_orderstatus") == "F").alias("in_squad"), F.floor("o_totalprice").alias("now_cost"))
    return clean.conform(o, {}, {"now_cost": "int"}, {"gameweek": 38})


@query("p5_split_tables", "SELECT 'ownership' AS part, o_orderkey, CAST(o_totalprice AS DOUBLE) AS v FROM orders UNION ALL SELECT 'performance', o_orderkey, CAST(o_custkey AS DOUBLE) FROM orders")
def p5(spark, sf):
    parts = clean.split_columns(table(spark, sf, "orders"), ["o_orderkey"], {"ownership": ["o_totalprice", "absent"], "performance": ["o_custkey"]})
    a = parts["ownership"].select(F.lit("ownership").alias("part"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return a.unionByName(parts["performance"].select(F.lit("performance").alias("part"), "o_orderkey", F.col("o_custkey").cast("double").alias("v")))


@query("p6_drop_undated", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 4 <> 0")
def p6(spark, sf):
    e = table(spark, sf, "events").withColumn("date", F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(""))
    return e.select("event_id", N.day(F.col("date")).alias("day")).where("day is not null")


@query("p7_valid_ids_and_range", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND event_id % 50 BETWEEN 1 AND 38")
def p7(spark, sf):
    ids = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return clean.in_ids(table(spark, sf, "events"), ids, "user_id").where((F.col("event_id") % 50).between(1, 38)).select("event_id")


@query("p9_season_codes", "SELECT o_orderkey, substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS code, year(o_orderdate) BETWEEN 1993 AND 1996 AS valid FROM orders")
def p9(spark, sf):
    y = F.year("o_orderdate")
    tail = F.lpad(((y + 1) % 100).cast("string"), 2, "0")
    sep = F.element_at(F.array(F.lit("/"), F.lit("-"), F.lit("_")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", N.season_code(F.concat(y.cast("string"), sep, tail)).alias("code"), N.valid_season(F.concat(y.cast("string"), F.lit("-"), tail), 1993, 1996).alias("valid"))


@query("p10_clean_numeric", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS INTEGER) AS a, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS DOUBLE) AS b FROM orders")
def p10(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    d = o.select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("a"), F.when(k % 5 == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).alias("b"))
    return clean.clean_numeric(d, ["a", "absent"], ["b"])


@query("p11_clamp_ranges", f"WITH {PANEL} SELECT o_orderkey, CASE WHEN minutes > 60 THEN 60 WHEN minutes < 10 THEN 10 ELSE minutes END AS minutes, CASE WHEN price > 20000000 THEN 20000000 ELSE price END AS price FROM panel")
def p11(spark, sf):
    return clean.clamp(panel(spark, sf), {"minutes": (10, 60), "price": (None, 20000000)}).select("o_orderkey", "minutes", "price")


@query("p12_quality_flags", f"WITH {PANEL} SELECT o_orderkey, CASE WHEN price IS NULL THEN round(CAST(2 AS DOUBLE) / 3, 3) ELSE 1.0 END AS data_quality_score, price IS NULL AS is_incomplete, CASE WHEN price IS NULL THEN 'price' ELSE '' END AS missing FROM panel")
def p12(spark, sf):
    d = clean.quality_flags(panel(spark, sf).select("o_orderkey", "price", "goals"), ["price", "goals"])
    return d.select("o_orderkey", "data_quality_score", "is_incomplete", F.array_join("missing_fields", ",").alias("missing"))


@query("p14_standard_column_names", "SELECT p_partkey, list_aggregate(list_transform(string_split(trim(p_name), ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), 'string_agg', ' ') AS name FROM part")
def p14(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.simple_name(F.concat(F.lit("  "), F.upper("p_name"))).alias("name"))


@query("p15_standard_names", "SELECT p_partkey, strip_accents(list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), 'string_agg', ' ')) AS name FROM part")
def p15(spark, sf):
    n = F.col("p_name")
    raw = F.concat(F.lit(" "), F.substring_index(n, " ", -1), F.lit(", "), F.expr("substring(p_name, 1, length(p_name) - length(substring_index(p_name, ' ', -1)) - 1)"), F.lit(" (Captain) [Doubtful] "))
    return table(spark, sf, "part").select("p_partkey", N.standard_name(F.when(F.instr(n, " ") > 0, raw).otherwise(n)).alias("name"))


@query("p15_strip_accents", "SELECT doc_id, strip_accents(text) AS head FROM documents")
def p15b(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.strip_accents(F.col("text")).alias("head"))


@query("p16_positions", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'FWD' WHEN 3 THEN 'X' ELSE '' END AS position, CASE p_partkey % 5 WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS by_type FROM part")
def p16(spark, sf):
    code = F.element_at(F.array(F.lit("gk"), F.lit("DC"), F.lit("AMC"), F.lit("xyz"), F.lit("")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", N.position(code).alias("position"), N.element_type((F.col("p_partkey") % 5).cast("int")).alias("by_type"))


@query("p17_team_names", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Builders' WHEN 'MACHINERY' THEN 'Engines' ELSE c_mktsegment END AS team FROM customer")
def p17(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.team_name(F.col("c_mktsegment"), {"BUILDING": "Builders", "MACHINERY": "Engines"}).alias("team"))


@query("p19_null_minutes", f"WITH {PANEL} SELECT o_orderkey, coalesce(price, 0) AS price FROM panel")
def p19(spark, sf):
    return clean.fill_zero(panel(spark, sf), ["price"]).select("o_orderkey", "price")


@query("p20_nan_to_zero", f"WITH {PANEL} SELECT o_orderkey, CASE WHEN price IS NULL THEN NULL WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(price AS DOUBLE) END AS price FROM panel")
def p20(spark, sf):
    p = panel(spark, sf).withColumn("price", F.when(F.col("price").isNull(), None).when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("price").cast("double")))
    return clean.no_nan(p).select("o_orderkey", "price")


@query("p21_winsorize", f"WITH {PANEL}, q AS (SELECT quantile_cont(price, 0.05) AS a, quantile_cont(price, 0.95) AS b FROM panel) SELECT o_orderkey, round(CASE WHEN price < a THEN a WHEN price > b THEN b ELSE price END, 6) AS price FROM panel, q")
def p21(spark, sf):
    return rounded(clean.winsorize(panel(spark, sf), ["price"], 0.05, 0.95).select("o_orderkey", "price"))


@query("p22_clean_data", f"WITH {PANEL}, q AS (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.99) AS b FROM panel) SELECT o_orderkey, coalesce(minutes, 0) AS minutes, round(CASE WHEN price < a THEN a WHEN price > b THEN b ELSE price END, 6) AS price FROM panel, q")
def p22(spark, sf):
    d, _ = clean.clean_data(panel(spark, sf), columns=["price"])
    return rounded(d.select("o_orderkey", "minutes", "price"))


_SKETCHED = " UNION ALL ".join(
    f"SELECT {season} AS season, '{c}' AS \"column\", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, true AS within FROM panel{group}"
    for c in ("price", "minutes") for season, group in (("season", " GROUP BY season"), ("NULL", ""))
)


@query("p21_season_sketches", f"WITH {PANEL} {_SKETCHED}")
def p21_sketches(spark, sf):
    """Sketches stored by season, those of half the rows added as a daily run does, for each
    season and (null) all: rows, least, greatest, and whether the true rank of the sketched
    median is that of the median within three times the error."""
    p = panel(spark, sf).select("season", "o_orderkey", "price", "minutes")
    columns = ["price", "minutes"]
    stored = sketches.column_sketches(p.where("o_orderkey % 2 = 0"), columns, ["season"])
    now = sketches.add_rows(stored, p.where("o_orderkey % 2 <> 0"), columns, ["season"])
    every = now.unionByName(sketches.merged(now).withColumn("season", F.lit(None).cast("long")))
    q = sketches.sketch_quantiles(every, [0, 0.5, 1], ["season"])
    values = p.select(F.explode(F.array(F.col("season"), F.lit(None).cast("long"))).alias("_season"), F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_v")) for c in columns])))
    middle = F.col("quantiles")[1]
    same = F.col("season").eqNullSafe(F.col("_season")) & (F.col("column") == F.col("_column"))
    ranked = values.join(q, same).groupBy("season", "column").agg(F.first("n").alias("n"), F.first("quantiles").alias("quantiles"), F.count_if(F.col("_v") < middle).alias("below"), F.count_if(F.col("_v") <= middle).alias("upto"))
    slack = 3 * sketches.rank_error()
    within = (F.col("below") <= F.col("n") * (0.5 + slack) + 1) & (F.col("upto") >= F.col("n") * (0.5 - slack) - 1)
    return ranked.select("season", "column", "n", F.col("quantiles")[0].alias("least"), F.col("quantiles")[2].alias("greatest"), within.alias("within"))


_STATS = "s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS pos, l_orderkey % 91 AS minutes, l_partkey % 3 AS goals, l_linenumber % 3 AS assists, l_partkey % 2 AS cs, l_suppkey % 4 AS conceded, l_orderkey % 10 AS saves, l_partkey % 2 AS yellow, l_suppkey % 2 AS pen FROM lineitem)"


def _stats(spark, sf):
    c = F.col
    pos = F.element_at(F.array(*[F.lit(x) for x in ("GK", "DEF", "MID", "FWD")]), (c("l_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pos.alias("pos"), (c("l_orderkey") % 91).alias("minutes"), (c("l_partkey") % 3).alias("goals"), (c("l_linenumber") % 3).alias("assists"), (c("l_partkey") % 2).alias("clean_sheet"), (c("l_suppkey") % 4).alias("goals_conceded"), (c("l_orderkey") % 10).alias("saves"), (c("l_partkey") % 2).alias("yellow_cards"), (c("l_suppkey") % 2).alias("penalty_save"))


_POINTS = """CAST(greatest(0, CASE WHEN minutes >= 60 THEN 2 WHEN minutes > 0 THEN 1 ELSE 0 END + goals * CASE pos WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END
  + assists * 3 + CASE WHEN cs > 0 AND minutes >= 60 THEN CASE pos WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END ELSE 0 END
  - CASE WHEN pos IN ('GK', 'DEF') THEN conceded ELSE 0 END + CASE WHEN pos = 'GK' THEN saves // 3 ELSE 0 END - yellow + pen * 5) AS BIGINT)"""


@query("p23_points_scoring", f"WITH {_STATS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_POINTS} AS points FROM s")
def p23(spark, sf):
    s = _stats(spark, sf)
    events = {c: F.col(c) for c in s.columns if c != "pos"}
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.points(F.col("pos"), events).alias("points"))


@query("p24_bps_scoring", f"WITH {_STATS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(0, goals * 24 + assists * 12 + cs * 12 - conceded * 2 + saves // 3 - yellow * 3 + pen * 15) AS BIGINT) AS bps FROM s")
def p24(spark, sf):
    s = _stats(spark, sf)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.bps({c: F.col(c) for c in s.columns if c != "pos"}).alias("bps"))


@query("p25_prefer_first", f"WITH {PANEL} SELECT o_orderkey, coalesce(price, goals) AS home_goals FROM panel WHERE o_orderkey % 13 <> 0")
def p25(spark, sf):
    p = panel(spark, sf).withColumn("match_id", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey")))
    return clean.prefer_first(p, {"home_goals": ["price", "goals", "h_goals"]}, "match_id").select("o_orderkey", "home_goals")


@query("p27_heuristic_prediction", f"WITH {PANEL} SELECT o_orderkey, round(goals * 0.6 + minutes * 0.4, 4) AS predicted_points, CAST(0.8 AS DOUBLE) AS start_probability, 'heuristic' AS model_version FROM panel".replace("round(goals * 0.6 + minutes * 0.4, 4)", "CAST(round(CAST(goals AS DOUBLE) * 0.6 + CAST(minutes AS DOUBLE) * 0.4, 4) AS DOUBLE)"))
def p27(spark, sf):
    d = clean.heuristic_prediction(panel(spark, sf).withColumns({"goals": F.col("goals").cast("double"), "minutes": F.col("minutes").cast("double")}), "goals", "minutes")
    return rounded(d.select("o_orderkey", "predicted_points", "start_probability", "model_version"))


@query("p28_feature_columns", f"WITH {PANEL} SELECT o_orderkey, goals, minutes FROM panel")
def p28(spark, sf):
    from ..operators.metrics import feature_columns

    p = panel(spark, sf)
    return p.select("o_orderkey", *feature_columns(p, "price", {"o_orderkey"}))


# --- imputation


@query("i1_mean_imputation", f"WITH {PANEL} SELECT o_orderkey, round(coalesce(price, avg(price) OVER ()), 6) AS price, round(coalesce(price, avg(price) OVER (PARTITION BY opponent)), 6) AS by_group FROM panel")
def i1(spark, sf):
    p = panel(spark, sf).withColumn("by_group", F.col("price"))
    return rounded(impute.mean_fill(impute.mean_fill(p, ["price"]), ["by_group"], ["opponent"]).select("o_orderkey", "price", "by_group"))


@query("i2_median_imputation", f"WITH {PANEL} SELECT o_orderkey, round(coalesce(price, median(price) OVER ()), 6) AS price, round(coalesce(price, median(price) OVER (PARTITION BY opponent)), 6) AS by_group FROM panel")
def i2(spark, sf):
    p = panel(spark, sf).withColumn("by_group", F.col("price"))
    return rounded(impute.median_fill(impute.median_fill(p, ["price"]), ["by_group"], ["opponent"]).select("o_orderkey", "price", "by_group"))


@query("i3_mode_imputation", f"WITH {PANEL}, q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN opponent END AS opponent FROM panel), m AS (SELECT opponent AS v FROM q WHERE opponent IS NOT NULL GROUP BY opponent ORDER BY count(*) DESC, opponent LIMIT 1) SELECT o_orderkey, coalesce(opponent, v) AS opponent FROM q, m")
def i3(spark, sf):
    p = panel(spark, sf).select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("opponent")).alias("opponent"))
    return impute.mode_fill(p, ["opponent"])


@query("i4_constant_imputation", f"WITH {PANEL} SELECT o_orderkey, coalesce(price, -1) AS price FROM panel")
def i4(spark, sf):
    return impute.constant_fill(panel(spark, sf), {"price": -1}).select("o_orderkey", "price")


@query("i5_run_imputation", f"WITH {PANEL} SELECT 'price' AS \"column\", 'mean' AS strategy, count(*) FILTER (WHERE price IS NULL) AS nulls_before, CAST(0 AS BIGINT) AS nulls_after, false AS rejected FROM panel UNION ALL SELECT 'rare', 'mean', count(*) FILTER (WHERE o_orderkey % 3 <> 0), count(*) FILTER (WHERE o_orderkey % 3 <> 0), true FROM panel UNION ALL SELECT 'opponent', 'mode', CAST(0 AS BIGINT), CAST(0 AS BIGINT), false")
def i5(spark, sf):
    p = panel(spark, sf).select("price", F.when(F.col("o_orderkey") % 3 == 0, F.col("goals")).alias("rare"), "opponent")
    return impute.run_imputation(p)[1]


# --- validation and monitoring

_CHECKS = lambda: [*quality.range_checks({"minutes": (5, 80)}), quality.implies("cheap", F.col("price") < 5000000, F.col("goals") > 1), quality.sum_check("sum", ["goals", "minutes"], "o_orderkey"), quality.non_negative("goals")]
_VALID = f"""WITH {PANEL}, c AS (
  SELECT count(*) FILTER (WHERE minutes < 5 OR minutes > 80) AS r, count(*) FILTER (WHERE price < 5000000 AND NOT goals > 1) AS i,
         count(*) FILTER (WHERE abs(goals + minutes - o_orderkey) > 0.01) AS s, count(*) FILTER (WHERE goals < 0) AS g,
         count(*) FILTER (WHERE price IS NULL) AS n, count(*) AS t, count(*) - count(DISTINCT o_orderkey) AS d FROM panel)
SELECT 'range' AS "check", CASE WHEN r > 0 THEN 'error' ELSE 'passed' END AS severity, 'minutes' AS subject, r AS rows FROM c
UNION ALL SELECT 'implies', CASE WHEN i > 0 THEN 'warning' ELSE 'passed' END, 'cheap', i FROM c
UNION ALL SELECT 'sum_check', CASE WHEN s > 0 THEN 'warning' ELSE 'passed' END, 'sum', s FROM c
UNION ALL SELECT 'non_negative', CASE WHEN g > 0 THEN 'error' ELSE 'passed' END, 'goals', g FROM c
UNION ALL SELECT 'completeness', CASE WHEN t - n < 0.95 * t THEN 'warning' ELSE 'passed' END, 'price', n FROM c
UNION ALL SELECT 'completeness', 'passed', x, 0 FROM (VALUES ('o_orderkey'), ('goals'), ('minutes')) v(x)
UNION ALL SELECT 'schema', 'error', 'absent', 0
UNION ALL SELECT 'schema', 'warning', 'goals', 0
UNION ALL SELECT 'unique', CASE WHEN d > 0 THEN 'error' ELSE 'passed' END, 'o_orderkey', d FROM c"""


def _validated(spark, sf):
    p = panel(spark, sf).select("o_orderkey", "price", "goals", "minutes")
    return quality.run_validation(p, {"absent": "bigint", "goals": "double", "price": "bigint"}, _CHECKS(), unique=[["o_orderkey"]], critical=["o_orderkey"])


@query("v6_run_validation", _VALID)
def v6(spark, sf):
    """V-6 with V-1 to V-5."""
    return _validated(spark, sf)


@query("v6_validity", f"SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'passed') AS passed, count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid FROM ({_VALID})")
def v6b(spark, sf):
    return quality.is_valid(_validated(spark, sf))


@query("v4_completeness", f"WITH {PANEL} SELECT 'price' AS \"column\", round(CAST(count(price) AS DOUBLE) / count(*), 6) AS ratio FROM panel UNION ALL SELECT 'goals', CAST(1.0 AS DOUBLE)")
def v4(spark, sf):
    return rounded(quality.completeness(panel(spark, sf).select("price", "goals")), 6)


@query("v5_duplicate_keys", "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows, count(*) AS duplicate_keys FROM g")
def v5(spark, sf):
    return quality.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v7_contract", f"WITH {PANEL} SELECT 'player_id' AS \"column\", count(*) FILTER (WHERE player_id < 100) AS rows FROM panel UNION ALL SELECT 'minutes', count(*) FILTER (WHERE minutes < 0 OR minutes > 60) FROM panel")
def v7(spark, sf):
    return quality.contract_violations(panel(spark, sf), {"player_id": (100, None), "minutes": (0, 60), "absent": (0, 1)})


@query("v8_freshness", "SELECT count(*) >= 1 AS fresh, count(*) >= 100000000 AS huge FROM orders")
def v8(spark, sf):
    o = table(spark, sf, "orders")
    return quality.freshness(o, ["o_orderkey"], fresh=1, huge=100000000)


@query("v9_unique_per_source_id", "WITH g AS (SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS k, year(o_orderdate) AS y FROM orders) WHERE k IS NOT NULL GROUP BY y, k HAVING count(*) > 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows, count(*) AS duplicate_keys FROM g")
def v9(spark, sf):
    p = panel(spark, sf).withColumn("k", F.when(F.col("o_orderkey") % 2 == 0, F.col("player_id")))
    return quality.duplicate_rows(p, ["season", "k"], ignore_null=True)


@query("v10_orphans", "SELECT count(*) AS orphan_rows FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def v10(spark, sf):
    return quality.orphans(table(spark, sf, "events"), table(spark, sf, "customer").where("c_acctbal > 0"), "user_id", "c_custkey")


_MAPPING = "m AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS season, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS a_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS b_id, (o_orderkey % 100) / 100.0 AS confidence_score FROM orders)"


def _mapping(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    return o.select(F.year("o_orderdate").cast("string").alias("season"), F.when(k % 2 == 0, k).alias("a_id"), F.when(k % 3 == 0, F.col("o_custkey")).alias("b_id"), ((k % 100) / 100.0).alias("confidence_score"))


@query("a14_mapping_quality", f"WITH {_MAPPING} SELECT season, count(*) AS total, count(a_id) AS with_a_id, count(b_id) AS with_b_id, count(*) FILTER (WHERE a_id IS NOT NULL AND b_id IS NOT NULL) AS with_a_id_and_b_id, round(count(a_id) / count(*) * 100, 1) AS rate_a_id, round(count(b_id) / count(*) * 100, 1) AS rate_b_id, count(*) FILTER (WHERE confidence_score >= 0.85) AS high_confidence, CAST(grouping(season) AS INTEGER) AS is_total FROM m GROUP BY ROLLUP (season)")
def a14(spark, sf):
    return quality.mapping_quality(_mapping(spark, sf), ["a_id", "b_id"])


@query("a15_row_counts", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'gone', -1")
def a15(spark, sf):
    return quality.row_counts({"orders": table(spark, sf, "orders"), "part": table(spark, sf, "part"), "gone": None})


@query("a16_duplicate_count", f"WITH {_MAPPING}, g AS (SELECT count(*) AS n FROM m WHERE b_id IS NOT NULL GROUP BY season, b_id HAVING count(*) > 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows, count(*) AS duplicate_keys FROM g")
def a16(spark, sf):
    return quality.duplicate_rows(_mapping(spark, sf), ["season", "b_id"], True)


@query("a17_all_metrics", f"WITH {_MAPPING} SELECT metric, season, value FROM (SELECT unnest(['total', 'with_b_id', 'rate_b_id', 'high_confidence']) AS metric, season, unnest([CAST(n AS DOUBLE), b, round(b / n * 100, 1), high]) AS value FROM (SELECT coalesce(season, 'total') AS season, count(*) AS n, count(b_id) AS b, count(*) FILTER (WHERE confidence_score >= 0.85) AS high FROM m GROUP BY ROLLUP (season)) UNION ALL SELECT 'rows_part', NULL, count(*) FROM part UNION ALL SELECT 'duplicates_b_id', NULL, coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM m WHERE b_id IS NOT NULL GROUP BY season, b_id))")
def a17(spark, sf):
    return quality.all_metrics({"part": table(spark, sf, "part")}, _mapping(spark, sf), ["b_id"])


@query("a21_mapping_coverage", f"WITH {_MAPPING} SELECT season, count(*) AS total, count(a_id) AS with_a_id, count(b_id) AS with_b_id, count(*) FILTER (WHERE a_id IS NOT NULL AND b_id IS NOT NULL) AS with_several, round(count(*) FILTER (WHERE a_id IS NOT NULL AND b_id IS NOT NULL) / count(*) * 100, 1) AS rate, CAST(grouping(season) AS INTEGER) AS is_total FROM m GROUP BY ROLLUP (season)")
def a21(spark, sf):
    return quality.coverage(_mapping(spark, sf), ["a_id", "b_id"])


@query("a22_date_overlap", "WITH d AS (SELECT year(l_shipdate) AS season, CAST(l_shipdate AS DATE) AS day, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1, 2) SELECT CAST(season AS INTEGER) AS season, count(*) FILTER (WHERE a) AS dates_A, count(*) FILTER (WHERE n) AS dates_N, count(*) FILTER (WHERE r) AS dates_R, count(*) FILTER (WHERE a AND n) AS shared_A_N, count(*) FILTER (WHERE a AND r) AS shared_A_R, count(*) FILTER (WHERE n AND r) AS shared_N_R, count(*) FILTER (WHERE a AND n AND r) AS shared_all FROM d GROUP BY 1")
def a22(spark, sf):
    l = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("season"), F.to_date("l_shipdate").alias("day"), "l_returnflag")  # noqa: E741
    return quality.date_overlap({f: l.where(F.col("l_returnflag") == f) for f in "ANR"}, "season", "day")


@query("a23_season_histogram", "SELECT 'orders' AS table_name, CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', CAST(year(l_shipdate) AS INTEGER), count(*) FROM lineitem GROUP BY 2")
def a23(spark, sf):
    return quality.season_histogram({"orders": table(spark, sf, "orders").select(F.year("o_orderdate").alias("season")), "lineitem": table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("season"))})


@query("src20_change_detection", f"WITH {PANEL} SELECT season, CASE WHEN season = 1994 THEN 'new' WHEN season = 1995 THEN 'changed' END AS change FROM panel WHERE season IN (1994, 1995) GROUP BY season")
def src20(spark, sf):
    p = panel(spark, sf).select("season", "o_orderkey", "goals")
    old = p.where("season <> 1994").withColumn("goals", F.when((F.col("season") == 1995), F.col("goals") + 1).otherwise(F.col("goals")))
    return quality.changes(quality.fingerprint(p, ["season"]), quality.fingerprint(old, ["season"]), ["season"])
