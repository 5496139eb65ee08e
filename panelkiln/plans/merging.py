"""Queries of joins, identity resolution, sets and storage, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import merge, resolve, scan
from ..sources import io
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


def _folder(spark) -> str:
    """A new folder that executors share: in spark.checkpoint.dir; in local mode (tests) one
    of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-panelkiln-")
    return f"{base.rstrip('/')}/plans-{uuid.uuid4().hex}"


@query("j1_merge_player_data", "SELECT c_custkey, c_name, o_orderkey, n_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j1(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "player_id").withColumnRenamed("c_nationkey", "team")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("player_id"), "o_orderkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("team"), "n_name")
    d = merge.merge_left(c, (o, ["player_id"]), (n, ["team"]), (n, ["absent"]))
    return d.select(F.col("player_id").alias("c_custkey"), "c_name", "o_orderkey", "n_name")


@query("j2_merge_fixture_data", "SELECT o_orderkey, round(a, 6) AS a FROM orders LEFT JOIN (SELECT o_orderpriority AS p, o_orderstatus AS s, CAST(sum(o_orderkey) AS DOUBLE) / count(*) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) ON p = o_orderpriority AND s = o_orderstatus")
def j2(spark, sf):
    o = table(spark, sf, "orders")
    h = o.where("o_orderstatus <> 'P'").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_orderkey").alias("a"))
    return rounded(merge.merge_left(o, (h, ["o_orderpriority", "o_orderstatus"])).select("o_orderkey", "a"))


_THREE = [("a", "l_returnflag = 'A'"), ("n", "l_returnflag = 'N'"), ("r", "l_returnflag = 'R'")]


@query("j3_unified_periods", "WITH a AS (SELECT l_suppkey AS k, count(*) AS n, max(l_partkey) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey + 1 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), c AS (SELECT l_suppkey + 2 AS k, count(*) AS z FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, a.n AS n_a, b.n AS n_b, x, z, s_name FROM a FULL JOIN b USING (k) FULL JOIN c USING (k) LEFT JOIN supplier ON s_suppkey = k")
def j3(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    g = lambda flag, d, *agg: l.where(F.col("l_returnflag") == flag).groupBy((F.col("l_suppkey") + d).alias("k")).agg(*agg)
    n = F.count("*")
    info = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return merge.unified_periods(g("A", 0, n.alias("n"), F.max("l_partkey").alias("x")), g("N", 1, n.alias("n")), g("R", 2, n.alias("z")), ["k"], info, "k").select("k", "n_a", "n_b", "x", "z", "s_name")


@query("j4_resolve_ids", "SELECT event_id, m AS unified_id FROM events LEFT JOIN (SELECT c_custkey, c_custkey * 10 AS m FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id")
def j4(spark, sf):
    m = table(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_custkey") * 10).alias("m"))
    return merge.resolve_ids(table(spark, sf, "events"), m, {"user_id": "c_custkey"}, {"unified_id": "m"}).select("event_id", "unified_id")


@query("j5_resolve_any_id", "WITH m AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 5 END AS b, c_custkey * 10 AS u FROM customer), s AS (SELECT a AS k, u, 0 AS o FROM m UNION ALL SELECT b, u, 1 FROM m WHERE b IS NOT NULL), f AS (SELECT k, arg_min(u, o) AS u FROM s GROUP BY k) SELECT event_id, u AS unified_id FROM events LEFT JOIN f ON k = user_id")
def j5(spark, sf):
    k = F.col("c_custkey")
    m = table(spark, sf, "customer").select(F.lit("s").alias("season"), k.alias("a"), F.when(k % 3 == 0, k + 5).alias("b"), (k * 10).alias("u"))
    e = table(spark, sf, "events").select(F.lit("s").alias("season"), "event_id", "user_id")
    return merge.resolve_any(e, m, ["a", "b"], ["season"], "user_id", "u", "unified_id").select("event_id", "unified_id")


@query("j6_fill_from_lookup", f"WITH {PANEL} SELECT o_orderkey, coalesce(price, CAST(round(c_acctbal) AS BIGINT)) AS price FROM panel LEFT JOIN customer ON c_custkey = player_id".replace("CAST(round(c_acctbal) AS BIGINT)", "CAST(floor(c_acctbal) AS BIGINT)"))
def j6(spark, sf):
    look = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), F.floor("c_acctbal").alias("v"))
    return merge.fill_from_lookup(panel(spark, sf), look, ["player_id"], "price", "v").select("o_orderkey", "price")


@query("j7_unified_stats", f"WITH {PANEL}, a AS (SELECT player_id, season, max(goals) AS goals, max(minutes) AS minutes FROM panel WHERE was_home GROUP BY 1, 2), b AS (SELECT player_id, season, max(price) AS xg, max(minutes) AS minutes, CASE WHEN min(goals) > 0 THEN min(goals) END AS goals FROM panel WHERE NOT was_home GROUP BY 1, 2) SELECT player_id, season, coalesce(b.goals, a.goals) AS goals, xg, CASE WHEN a.minutes > 0 THEN greatest(a.minutes, b.minutes) ELSE coalesce(b.minutes, a.minutes) END AS minutes FROM a FULL JOIN b USING (player_id, season)")
def j7(spark, sf):
    p = panel(spark, sf)
    a = p.where("was_home").groupBy("player_id", "season").agg(F.max("goals").alias("goals"), F.max("minutes").alias("minutes"))
    b = p.where("not was_home").groupBy("player_id", "season").agg(F.max("price").alias("xg"), F.max("minutes").alias("minutes"), F.min("goals").alias("goals")).withColumn("goals", F.when(F.col("goals") > 0, F.col("goals")))
    return merge.unified_stats(a, b, ["player_id", "season"], ["goals", "xg", "minutes"])


_SRC = "SELECT CAST(year(l_shipdate) AS INTEGER) AS season, l_suppkey AS h, l_partkey % 50 AS t, max(CAST(l_shipdate AS DATE)) AS d, max(l_orderkey) AS i, CASE WHEN max(l_orderkey) % 2 = 0 THEN max(l_linenumber) END AS x FROM lineitem WHERE {} GROUP BY 1, 2, 3"


_J8 = f"WITH a AS ({_SRC.format(_THREE[0][1])}), n AS ({_SRC.format(_THREE[1][1])}), r AS ({_SRC.format(_THREE[2][1])})"


@query("j8_three_source_matches", _J8 + " SELECT season, h AS home_team_id, t AS away_team_id, coalesce(a.d, n.d, r.d) AS match_date, coalesce(a.x, n.x, r.x) AS home_score, a.i AS a_match_id, n.i AS n_match_id, r.i AS r_match_id, CASE WHEN r.i IS NOT NULL THEN 'r' WHEN n.i IS NOT NULL THEN 'n' ELSE 'a' END AS match_source FROM a FULL JOIN n USING (season, h, t) FULL JOIN r USING (season, h, t)")
def j8(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    parts = []
    for name, cond in _THREE:
        g = l.where(cond).groupBy(F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("home_team_id"), (F.col("l_partkey") % 50).alias("away_team_id")).agg(F.max(F.to_date("l_shipdate")).alias("match_date"), F.max("l_orderkey").alias("match_id"), F.max("l_linenumber").alias("s"))
        score = F.when(F.col("match_id") % 2 == 0, F.col("s"))
        parts.append((name, g.select("season", "home_team_id", "away_team_id", "match_date", "match_id", score.alias("home_score"), score.alias("away_score"))))
    return resolve.match_mapping(parts).drop("match_id", "away_score")


@query("j9_team_lookup", "WITH m AS (SELECT '2024' AS season, n_name, CAST(n_nationkey AS VARCHAR) AS n, n_nationkey AS u FROM nation) SELECT season, 'a' AS source_type, n_name AS team_key, u AS unified_team_id FROM m UNION ALL SELECT season, 'a', n, u FROM m UNION ALL SELECT season, 'b', n, u FROM m")
def j9(spark, sf):
    m = table(spark, sf, "nation").select(F.lit("2024").alias("season"), "n_name", "n_nationkey", F.col("n_nationkey").alias("unified_team_id"))
    return resolve.team_lookup(m, {"a": ["n_name", "n_nationkey"], "b": ["n_nationkey"]})


_NAMES = """t AS (SELECT p_name AS target_name, min(p_partkey) AS o FROM part GROUP BY p_name),
s AS (SELECT target_name AS source_name, lower(target_name) AS std FROM t WHERE o % 3 = 0 UNION SELECT substr(target_name, 2), lower(substr(target_name, 2)) FROM t WHERE o % 3 <> 0),
e AS (SELECT source_name, arg_min(target_name, o) AS mapped FROM s JOIN t ON std = lower(target_name) GROUP BY 1),
c AS (SELECT source_name, target_name, o, 1 - CAST(levenshtein(std, lower(target_name)) AS DOUBLE) / greatest(length(std), length(target_name)) AS score FROM s, t WHERE source_name NOT IN (SELECT source_name FROM e)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY score DESC, o, target_name) AS k FROM c WHERE score >= 0.75) WHERE k = 1),
m AS (SELECT source_name, coalesce(mapped, target_name, source_name) AS mapped_name, CASE WHEN mapped IS NOT NULL THEN 1.0 ELSE round(coalesce(score, 0), 6) END AS confidence, CASE WHEN mapped IS NOT NULL THEN 'exact' WHEN target_name IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method
      FROM s LEFT JOIN e USING (source_name) LEFT JOIN b USING (source_name))"""


def _names(spark, sf):
    t = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("o"))
    s = t.select(F.when(F.col("o") % 3 == 0, F.col("name")).otherwise(F.expr("substring(name, 2)")).alias("name"))
    return s, t


@query("j10_name_mapping", f"WITH {_NAMES} SELECT source_name, mapped_name, CAST(confidence AS DOUBLE) AS confidence, method FROM m")
def j10(spark, sf):
    s, t = _names(spark, sf)
    return rounded(resolve.build_name_mapping(s, t, 0.75, order="o"))


_LOOP = "(p_partkey - p_partkey % 8) % 80 = 0"


@query("p15_known_variations", f"WITH k AS (SELECT p_partkey AS n, p_partkey % 8 AS h, {_LOOP} AS loop FROM part), w AS (SELECT n, h, loop FROM k WHERE h > 0) SELECT 'n' || n AS source, 'n' || (n - h) AS canonical, CAST(h AS BIGINT) AS hops, 'closed' AS kind FROM w WHERE NOT loop UNION ALL SELECT 'n' || n, 'n' || (n - 1), NULL, 'clash' FROM w WHERE n % 40 = 1 UNION ALL SELECT 'n' || n, 'zz', NULL, 'clash' FROM w WHERE n % 40 = 1 UNION ALL SELECT 'n' || n, 'n' || (n - 1), NULL, 'cycle' FROM w WHERE loop UNION ALL SELECT 'n' || (n - 1), 'n' || n, NULL, 'cycle' FROM w WHERE loop AND h = 1")
def p15_variations(spark, sf):
    """Chains of up to seven names, some that meet themselves and some names with two, written as
    CSV and loaded."""
    n = F.col("p_partkey")
    named = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = table(spark, sf, "part").select(n, (n % 8).alias("h"), F.expr(_LOOP).alias("loop")).where("h > 0")
    rows = [k.select(named(n).alias("source"), F.concat(named(n - 1), F.lit(" ")).alias("canonical"))]
    rows.append(k.where("loop and h = 1").select(named(n - 1).alias("source"), named(n).alias("canonical")))
    rows.append(k.where("p_partkey % 40 = 1").select(named(n).alias("source"), F.lit("zz").alias("canonical")))
    path = _folder(spark)
    io.write_csv(merge.diagonal(*rows), path)
    closed, problems = resolve.close_variations(io.read_variations(spark, path))
    return merge.diagonal(closed.withColumn("kind", F.lit("closed")), problems).select("source", "canonical", "hops", "kind")


@query("j11_name_statistics", f"WITH {_NAMES} SELECT count(*) AS total, count(*) FILTER (WHERE method = 'exact') AS exact, count(*) FILTER (WHERE method = 'fuzzy') AS fuzzy, count(*) FILTER (WHERE method = 'none') AS unmatched, count(*) FILTER (WHERE confidence < 0.9) AS low_confidence, round(avg(confidence), 5) AS mean_confidence FROM m")
def j11(spark, sf):
    s, t = _names(spark, sf)
    return rounded(resolve.name_match_statistics(resolve.build_name_mapping(s, t, 0.75, order="o")), 5)


@query("j12_crosswalk", f"WITH {_NAMES}, p AS (SELECT row_number() OVER (ORDER BY source_name) AS source_id, source_name FROM s) SELECT source_id, source_name, CASE WHEN method <> 'none' THEN o END AS target_id, CASE WHEN method <> 'none' THEN mapped_name END AS matched_name, CAST(round(confidence, 3) AS DOUBLE) AS confidence FROM p JOIN m USING (source_name) LEFT JOIN t ON t.target_name = mapped_name".replace("row_number() OVER (ORDER BY source_name)", "CAST(row_number() OVER (ORDER BY source_name) AS INTEGER)"))
def j12(spark, sf):
    s, t = _names(spark, sf)
    s = scan.row_numbers(s.distinct(), ["name"], into="player_id").select(F.col("player_id").cast("int"), F.col("name").alias("player"))
    return resolve.build_crosswalk(s, t.select(F.col("o").alias("id"), F.col("name").alias("web_name")))


def _players(spark, sf):
    """All parts as players: equal names, some cut, brands as teams, types as positions."""
    p = table(spark, sf, "part")
    t = p.select(F.col("p_partkey").alias("target_id"), F.concat_ws(" ", "p_name", "p_type").alias("target_name"), F.col("p_brand").alias("target_team"), F.substring("p_type", 1, 1).alias("target_position"))
    name = F.when(F.col("target_id") % 2 == 0, F.col("target_name")).otherwise(F.expr("substring(target_name, 1, length(target_name) - 1)"))
    s = t.select(F.col("target_id").alias("player_id"), name.alias("player_name"), F.when(F.col("target_id") % 3 == 0, F.lit("other")).otherwise(F.col("target_team")).alias("team"), F.col("target_position").alias("position"))
    return s, t


_PLAYERS = """t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS tn, lower(p_brand) AS tt, upper(substr(p_type, 1, 1)) AS c FROM part),
t2 AS (SELECT id, tn, tt, CASE c WHEN 'G' THEN 'GKP' WHEN 'D' THEN 'DEF' WHEN 'M' THEN 'MID' WHEN 'F' THEN 'FWD' ELSE c END AS tp FROM t),
s AS (SELECT id AS pid, CASE WHEN id % 2 = 0 THEN tn ELSE substr(tn, 1, length(tn) - 1) END AS sn, CASE WHEN id % 3 = 0 THEN 'other' ELSE tt END AS st, tp AS sp FROM t2),
d AS (SELECT tn, min(id) AS o FROM t2 GROUP BY tn),
n AS (SELECT DISTINCT sn FROM s),
x AS (SELECT sn, tn, 1.0 AS score, o FROM n JOIN d ON sn = tn UNION ALL SELECT sn, tn, 1 - CAST(levenshtein(sn, tn) AS DOUBLE) / greatest(length(sn), length(tn)), o FROM n, d WHERE sn NOT IN (SELECT tn FROM d)),
m AS (SELECT sn, tn AS mn, score FROM (SELECT *, row_number() OVER (PARTITION BY sn ORDER BY score DESC, o) AS k FROM x WHERE score >= 0.4) WHERE k = 1),
r AS (SELECT pid, id, 1 AS stage, 1.0 AS c FROM s JOIN t2 ON st = tt AND sn = tn
  UNION ALL SELECT pid, id, 2, least(1.0, score + 0.2) FROM s JOIN m USING (sn) JOIN t2 ON mn = tn AND st = tt
  UNION ALL SELECT pid, id, 3, CASE WHEN sp = tp THEN 0.65 ELSE 0.55 END FROM s JOIN t2 ON st = tt
    WHERE (contains(tn, string_split(sn, ' ')[-1]) OR contains(sn, tn) OR string_split(sn, ' ')[-1] = string_split(tn, ' ')[-1]) AND (sp = tp OR (sp IN ('DEF', 'GKP') AND tp IN ('DEF', 'GKP')))
  UNION ALL SELECT pid, id, 4, score * 0.7 FROM s JOIN m USING (sn) JOIN t2 ON mn = tn WHERE score >= 0.45 AND sp = tp
  UNION ALL SELECT pid, id, 5, 0.9 FROM s JOIN t2 ON sn = tn),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY stage, id) AS k FROM r) WHERE k = 1)"""


@query("j13_staged_player_match", f"WITH {_PLAYERS} SELECT s.pid AS player_id, w.id AS target_id, stage, CAST(round(coalesce(c, 0), 6) AS DOUBLE) AS confidence FROM s LEFT JOIN w ON w.pid = s.pid")
def j13(spark, sf):
    s, t = _players(spark, sf)
    return rounded(resolve.match_players(s, t).select("player_id", "target_id", "stage", "confidence"))


@query("j15_manual_overrides", f"WITH {_PLAYERS} SELECT s.pid AS player_id, CASE WHEN s.pid % 50 = 0 THEN 7 ELSE w.id END AS target_id, CAST(CASE WHEN s.pid % 50 = 0 THEN 1.0 ELSE round(coalesce(c, 0), 6) END AS DOUBLE) AS confidence FROM s LEFT JOIN w ON w.pid = s.pid")
def j15(spark, sf):
    s, t = _players(spark, sf)
    o = s.where("player_id % 50 = 0").select(F.lit("2024-25").alias("season"), F.col("player_id").alias("source_id"), F.lit(7).cast("long").alias("target_id"))
    return rounded(resolve.with_overrides(resolve.match_players(s, t), o, "2024-25").select("player_id", "target_id", "confidence"))


@query("j14_season_player_mapping", f"WITH {_PLAYERS}, b AS (SELECT * FROM (SELECT pid, id, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, pid) AS z FROM w) WHERE z = 1) SELECT t2.id AS player_id, b.pid AS other_id, CAST(round(coalesce(b.c, 0), 6) AS DOUBLE) AS confidence_score, coalesce(b.c, 0) < 0.85 AS requires_manual_review, CASE WHEN coalesce(b.c, 0) >= 1 THEN 'exact' WHEN b.c > 0 THEN 'fuzzy' ELSE 'manual' END AS source FROM t2 LEFT JOIN b ON b.id = t2.id")
def j14(spark, sf):
    s, t = _players(spark, sf)
    base = t.select(F.col("target_id").alias("player_id"), F.col("target_name").alias("player_name"), F.col("target_team").alias("team"), F.col("target_position").alias("position"))
    d = resolve.season_player_mapping(base, {"other": s}, "2024-25")
    return rounded(d.select("player_id", "other_id", "confidence_score", "requires_manual_review", "source"))


@query("j16_team_mapping", "SELECT n_name AS team_name, CASE WHEN n_nationkey % 2 = 0 OR n_name = 'BRAZIL' THEN n_name END AS other_name FROM nation")
def j16(spark, sf):
    n = table(spark, sf, "nation")
    other = n.where("n_nationkey % 2 = 0 or n_name = 'BRAZIL'").select(F.col("n_name").alias("team_name"))
    return resolve.team_mapping(n.select(F.col("n_name").alias("team_name")), other, "2024-25").select("team_name", "other_name")


@query("j17_resolve_teams", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) + 100 AS canonical_id, n_name || ' new' AS canonical_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j17(spark, sf):
    n = table(spark, sf, "nation")
    ids = n.select(F.lit("a").alias("source"), F.col("n_nationkey").cast("long").alias("raw"), (F.col("n_nationkey") + 100).cast("long").alias("canonical_id"), F.col("n_name").alias("name"), F.lit("2023-24").alias("season"))
    ids = ids.unionByName(ids.withColumns({"season": F.lit("2024-25"), "name": F.concat("name", F.lit(" new")), "source": F.lit("b")}))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("team_key"))
    return resolve.resolve_teams(c, ids, "a", "team_key").select("c_custkey", "canonical_id", "canonical_name")


@query("j18_mapping_rows", "SELECT s_suppkey, s_nationkey + 100 AS canonical_id, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey % 2 = 0")
def j18(spark, sf):
    n = table(spark, sf, "nation")
    ids = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") + 100).alias("canonical_id"))
    canonical = n.select((F.col("n_nationkey") + 100).alias("canonical_id"), "n_name")
    return resolve.mapping_rows(table(spark, sf, "supplier"), ids, canonical, "s_nationkey").select("s_suppkey", "canonical_id", "n_name")


@query("j19_engineer_features", f"WITH {PANEL}, h AS (SELECT player_id, opponent, count(*) AS appearances FROM panel GROUP BY 1, 2) SELECT o_orderkey, appearances FROM panel LEFT JOIN h USING (player_id, opponent)")
def j19(spark, sf):
    from ..operators import h2h, rolling

    p = panel(spark, sf)
    wide = rolling.rolling_features(p, ["player_id"], ORDER, ["price"], [], (3,))
    pairs = h2h.head_to_head(p, ["player_id", "opponent"], ORDER, ["price"], [], ())
    return merge.merge_left(wide, (pairs, ["player_id", "opponent"]), (pairs, ["home_team_id"])).select("o_orderkey", "appearances")


@query("j20_fill_missing", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) ON user_id = c_custkey")
def j20(spark, sf):
    shots = table(spark, sf, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    return merge.fill_missing(table(spark, sf, "customer").select("c_custkey"), shots, ["c_custkey"])


@query("j21_merge_player_state", f"WITH {PANEL}, a AS (SELECT player_id, season, max(goals) AS goals FROM panel WHERE season <= 1995 GROUP BY 1, 2), b AS (SELECT player_id, season, max(goals) + 100 AS goals FROM panel WHERE season >= 1995 GROUP BY 1, 2) SELECT * FROM b UNION ALL SELECT * FROM a WHERE season < 1995 OR (player_id, season) NOT IN (SELECT player_id, season FROM b)")
def j21(spark, sf):
    g = panel(spark, sf).groupBy("player_id", "season").agg(F.max("goals").alias("goals"))
    return io.upsert(g.where("season <= 1995"), g.where("season >= 1995").withColumn("goals", F.col("goals") + 100), ["player_id", "season"], sequence=["goals"])


@query("j22_rebuild_fixtures", f"WITH {PANEL} SELECT season, o_orderkey % 97 AS fixture, max(opponent) FILTER (WHERE was_home) AS home_team, max(opponent) FILTER (WHERE NOT was_home) AS away_team, max(o_orderdate) AS kickoff_time FROM panel GROUP BY 1, 2 HAVING count(*) FILTER (WHERE was_home) > 0 AND count(*) FILTER (WHERE NOT was_home) > 0")
def j22(spark, sf):
    p = panel(spark, sf).select("season", (F.col("o_orderkey") % 97).alias("fixture"), F.col("opponent").alias("team"), "was_home", F.col("o_orderdate").alias("kickoff_time"))
    return merge.rebuild_fixtures(p)


@query("j23_latest_and_quality", f"WITH {PANEL}, l AS (SELECT player_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM panel GROUP BY 1) SELECT l.player_id, l.o_orderkey, price IS NULL AS is_incomplete FROM l JOIN panel USING (o_orderkey)".replace("SELECT l.player_id", "SELECT panel.player_id"))
def j23(spark, sf):
    from ..operators.clean import quality_flags

    d = merge.latest(panel(spark, sf), ["player_id"], "o_orderdate", ["o_orderkey", "price"])
    return quality_flags(d, ["price"]).select("player_id", "o_orderkey", "is_incomplete")


@query("j24_player_stats_update", f"WITH {PANEL}, s AS (SELECT season, player_id AS element, opponent, max(o_orderkey) AS o FROM panel GROUP BY 1, 2, 3) SELECT season, element * 10 AS player_id, opponent, o AS o_orderkey, CASE WHEN minutes > 60 THEN 60 ELSE minutes END AS minutes FROM s JOIN panel ON o = o_orderkey".replace("SELECT season, element", "SELECT s.season, element").replace("opponent, o AS", "s.opponent, o AS"))
def j24(spark, sf):
    from ..operators import clean

    p = clean.conform(panel(spark, sf).withColumnRenamed("player_id", "element"), {"element": "source_id"})
    m = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 10).alias("u"))
    d = clean.clamp(merge.resolve_ids(p, m, {"source_id": "c_custkey"}, {"player_id": "u"}, "inner"), {"minutes": (None, 60)})
    return merge.keep_best(d, ["season", "player_id", "opponent"], "o_orderkey").select("season", "player_id", "opponent", "o_orderkey", "minutes")


@query("j25_fixtures_update", f"WITH {PANEL}, t AS (SELECT season, opponent, CAST(coalesce(sum(goals) FILTER (WHERE was_home), 0) AS BIGINT) AS h FROM panel GROUP BY 1, 2) SELECT season, opponent, h AS team_h_goals FROM t WHERE opponent <> '5-LOW'")
def j25(spark, sf):
    from ..operators.context import defensive_totals

    p = panel(spark, sf).withColumn("key", F.concat_ws("|", "season", "opponent"))
    ids = p.select(F.col("opponent").alias("o")).distinct().where("o <> '5-LOW'").withColumn("u", F.col("o"))
    f = merge.resolve_ids(p.select("key", "season", "opponent").distinct(), ids, {"opponent": "o"}, {"match_id": "u"}, "inner")
    return defensive_totals(f, p, "key", "was_home", ["goals"]).select("season", "opponent", F.coalesce("team_h_goals", F.lit(0)).alias("team_h_goals"))


@query("j26_match_stats_update", f"WITH {PANEL} SELECT o_orderkey AS match_id, coalesce(price, goals) AS home_goals, player_id * 10 AS team_id FROM panel WHERE o_orderkey % 13 <> 0")
def j26(spark, sf):
    from ..operators.clean import prefer_first

    m = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 10).alias("u"))
    p = panel(spark, sf).withColumn("match_id", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey")))
    d = prefer_first(p, {"home_goals": ["price", "goals"]}, "match_id")
    return merge.resolve_ids(d, m, {"player_id": "c_custkey"}, {"team_id": "u"}).select("match_id", "home_goals", "team_id")


@query("j27_enrich_players", "SELECT c_custkey AS player_id, n_name AS team_name, CASE c_custkey % 5 WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j27(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team"), (F.col("c_custkey") % 5).cast("int").alias("element_type"))
    teams = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return merge.enrich_players(c.union(c), teams, ["player_id"], position_type="element_type").select("player_id", "team_name", "position")


@query("a18_latest_per_player", f"WITH {PANEL} SELECT player_id, arg_max(season, (o_orderdate, season, o_orderkey)) AS season, arg_max(o_orderkey, (o_orderdate, season, o_orderkey)) AS o_orderkey FROM panel GROUP BY 1")
def a18(spark, sf):
    return merge.latest(panel(spark, sf), ["player_id"], "o_orderdate", ["season", "o_orderkey"])


@query("a19_daily_features", f"WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM panel) SELECT player_id, round(avg(goals) FILTER (WHERE k <= 3), 6) AS goals_last_3, round(avg(minutes) FILTER (WHERE k <= 3), 6) AS minutes_last_3, max(season) + 1 AS next_season FROM r GROUP BY 1")
def a19(spark, sf):
    return rounded(merge.last_mean(panel(spark, sf), ["player_id"], ORDER, ["goals", "minutes"], 3, "season"))


# --- sets and limits


@query("u1_diagonal_union", "SELECT c_custkey AS id, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def u1(spark, sf):
    return merge.diagonal(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg")), table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")))


@query("u2_strict_union", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u2(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("u3_distinct_by_subset", f"WITH {PANEL} SELECT player_id, opponent, min(o_orderkey) AS o_orderkey FROM panel GROUP BY 1, 2")
def u3(spark, sf):
    return merge.first_by(panel(spark, sf), ["player_id", "opponent"], ["o_orderkey"]).select("player_id", "opponent", "o_orderkey")


@query("u4_team_list", "SELECT c_mktsegment AS team_name FROM customer UNION SELECT p_brand FROM part")
def u4(spark, sf):
    m = merge.diagonal(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("home_team")), table(spark, sf, "part").select(F.col("p_brand").alias("away_team")))
    return resolve.team_list(m)


@query("u5_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def u5(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey"))


@query("u6_new_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def u6(spark, sf):
    seen = table(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("c_custkey"))
    return merge.new_keys(table(spark, sf, "customer"), seen, ["c_custkey"]).select("c_custkey")


@query("u7_rosters", f"WITH {PANEL} SELECT DISTINCT season, player_id, opponent FROM panel UNION ALL SELECT DISTINCT season, NULL, opponent FROM panel")
def u7(spark, sf):
    players, teams = merge.rosters(panel(spark, sf), "player_id", "opponent")
    return players.unionByName(teams.withColumn("player_id", F.lit(None).cast("long")))


@query("t1_mixed_sort_rank", f"WITH {PANEL} SELECT o_orderkey FROM panel ORDER BY season DESC, player_id, o_orderkey DESC LIMIT 50")
def t1(spark, sf):
    return panel(spark, sf).orderBy(F.desc("season"), "player_id", F.desc("o_orderkey")).limit(50).select("o_orderkey")


@query("t5_first_rows_per_group", f"WITH {PANEL} SELECT player_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY o_orderdate, o_orderkey) AS k FROM panel) WHERE k <= 2")
def t5(spark, sf):
    return merge.first_n(panel(spark, sf), ["player_id"], ORDER, 2).select("player_id", "o_orderkey")


@query("t6_unmatched_sample", f"WITH {_PLAYERS} SELECT s.pid AS player_id FROM s LEFT JOIN w ON w.pid = s.pid WHERE w.id IS NULL ORDER BY 1 LIMIT 10")
def t6(spark, sf):
    s, t = _players(spark, sf)
    return resolve.match_players(s, t).where("target_id is null").orderBy("player_id").select("player_id").limit(10)


for _name in ("j13_staged_player_match", "j14_season_player_mapping", "j15_manual_overrides", "t6_unmatched_sample"):  # the names under which they were read over every part
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]


@query("src1_json_documents", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src1(spark, sf):
    """SRC-1 and SRC-2: each user's events as one JSON document, read back as rows."""
    path = _folder(spark)
    e = table(spark, sf, "events").select("user_id", F.struct("event_id", F.from_json("props", "k long")["k"].alias("k")).alias("e"))
    e.groupBy("user_id").agg(F.collect_list("e").alias("elements")).write.json(path)
    return io.read_documents(spark, path, "user_id long, elements array<struct<event_id: long, k: long>>", "elements", multi_line=False)


@query("src3_histories", "SELECT user_id AS player_id, event_id FROM events")
def src3(spark, sf):
    """One folder per user stands for one document per user."""
    path = _folder(spark)
    e = table(spark, sf, "events")
    e.withColumn("part", F.col("user_id") % 7).groupBy("part", "user_id").agg(F.collect_list(F.struct("event_id", "user_id")).alias("history")).write.partitionBy("part").json(path)
    return io.read_histories(spark, path, "history array<struct<event_id: long, user_id: long>>", id_pattern=r"part=(\d+)", id_col="part", multi_line=False).select(F.col("user_id").alias("player_id"), "event_id")


@query("src4_csv_read", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS c FROM orders WHERE o_orderkey % 50 BETWEEN 1 AND 38")
def src4(spark, sf):
    """SRC-4, SRC-5 and SRC-9."""
    path, k = _folder(spark), F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.cast("string"), F.when(k % 5 == 0, "None").otherwise(F.col("o_orderpriority")).alias("p"), F.when(k % 4 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("c"))
    io.write_csv(o, path)
    return io.read_csv_table(spark, path, "o_orderkey string, p string, c string", types={"o_orderkey": "long", "c": "long"}, where="o_orderkey % 50 between 1 and 38")


@query("src6_seasons_diagonal", "SELECT o_orderkey, CASE WHEN year(o_orderdate) > 1995 THEN o_custkey END AS c, CASE WHEN year(o_orderdate) > 1995 THEN 'new' ELSE 'old' END AS season FROM orders")
def src6(spark, sf):
    o = table(spark, sf, "orders")
    return io.read_seasons({"old": o.where(F.year("o_orderdate") <= 1995).select("o_orderkey"), "new": o.where(F.year("o_orderdate") > 1995).select("o_orderkey", F.col("o_custkey").alias("c"))}).select("o_orderkey", "c", "season")


@query("src7_player_match_table", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
def src7(spark, sf):
    return io.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"], at_least={"l_quantity": 10}, at_most={"l_quantity": 20})


@query("src8_feature_table_round_trip", f"WITH {PANEL} SELECT player_id, o_orderkey, goals FROM panel")
def src8(spark, sf):
    path = io.write_version(panel(spark, sf).select("player_id", "o_orderkey", "goals"), _folder(spark))
    return io.read_table(spark, path)


@query("src10_table_read", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def src10(spark, sf):
    return io.read_table(spark, f"{sf}/customer.parquet", ["c_custkey", "c_acctbal"], equal={"c_mktsegment": "BUILDING"}, at_least={"c_acctbal": 0}, order=["c_custkey"])


@query("src11_season_partitions", f"WITH {PANEL} SELECT o_orderkey, CAST(season AS INTEGER) AS season FROM panel WHERE season IN (1994, 1996)")
def src11(spark, sf):
    path = io.write_version(panel(spark, sf).select("o_orderkey", "season"), _folder(spark), ["season"])
    return io.read_season_table(spark, path, [1994, 1996])


@query("src12_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def src12(spark, sf):
    o = table(spark, sf, "orders")
    return io.counted(o, "o_orderstatus = 'F'", "n")


@query("src13_upsert", f"WITH {PANEL}, o AS (SELECT player_id, opponent, max(goals) AS goals FROM panel WHERE season < 1996 GROUP BY 1, 2), n AS (SELECT * FROM (SELECT player_id, opponent, goals, row_number() OVER (PARTITION BY player_id, opponent ORDER BY minutes DESC, o_orderkey) AS k FROM panel WHERE season >= 1996) WHERE k = 1) SELECT player_id, opponent, goals, 'replace' AS mode FROM n UNION ALL SELECT player_id, opponent, goals, 'replace' FROM o WHERE (player_id, opponent) NOT IN (SELECT player_id, opponent FROM n) UNION ALL SELECT player_id, opponent, goals, 'skip' FROM o UNION ALL SELECT player_id, opponent, goals, 'skip' FROM n WHERE (player_id, opponent) NOT IN (SELECT player_id, opponent FROM o)")
def src13(spark, sf):
    p = panel(spark, sf)
    old = p.where("season < 1996").groupBy("player_id", "opponent").agg(F.max("goals").alias("goals"))
    new = p.where("season >= 1996").select("player_id", "opponent", "goals", "minutes", "o_orderkey")
    part = lambda skip, name: io.upsert(old, new, ["player_id", "opponent"], "minutes", ["o_orderkey"], skip).select("player_id", "opponent", "goals", F.lit(name).alias("mode"))
    return part(False, "replace").unionByName(part(True, "skip"))


@query("src13_upsert_touched_partitions", f"WITH {PANEL}, o AS (SELECT player_id, opponent, max(goals) AS goals FROM panel WHERE season < 1996 GROUP BY 1, 2), n AS (SELECT * FROM (SELECT player_id, opponent, goals, row_number() OVER (PARTITION BY player_id, opponent ORDER BY minutes DESC, o_orderkey) AS k FROM panel WHERE season >= 1996) WHERE k = 1) SELECT player_id, opponent, goals FROM n UNION ALL SELECT player_id, opponent, goals FROM o WHERE (player_id, opponent) NOT IN (SELECT player_id, opponent FROM n)")
def src13_touched(spark, sf):
    """SRC-13 in place, in a table kept in partitions by key."""
    path, p = _folder(spark), panel(spark, sf)
    io.create_keyed(p.where("season < 1996").groupBy("player_id", "opponent").agg(F.max("goals").alias("goals")), path, ["player_id", "opponent"], 16)
    io.upsert_keyed(p.where("season >= 1996").select("player_id", "opponent", "goals", "minutes", "o_orderkey"), path, ["player_id", "opponent"], "minutes", ["o_orderkey"])
    return io.read_keyed(spark, path)


@query("src14_append_and_reload", "SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def src14(spark, sf):
    """SRC-14 and SRC-15."""
    path, c = _folder(spark), table(spark, sf, "customer").select("c_custkey")
    io.append(c, path)
    io.append(c.where("c_custkey % 2 = 0"), path)
    return spark.read.parquet(path)


@query("src16_replace_season", f"WITH {PANEL} SELECT o_orderkey, CASE WHEN season = 1995 THEN goals + 50 ELSE goals END AS goals, CAST(season AS VARCHAR) || '-' || right(CAST(season + 1 AS VARCHAR), 2) AS season FROM panel WHERE season <> 1995 OR o_orderkey % 2 = 0")
def src16(spark, sf):
    path = _folder(spark)
    s = F.concat(F.col("season").cast("string"), F.lit("-"), F.right((F.col("season") + 1).cast("string"), F.lit(2)))
    p = panel(spark, sf).select("o_orderkey", "goals", s.alias("season"))
    p.write.partitionBy("season").parquet(path)
    io.replace_season(p.where("season = '1995-96' and o_orderkey % 2 = 0").withColumn("goals", F.col("goals") + 50), path, "1995-96")
    io.replace_season(p.limit(0), path, "1996-97")
    return spark.read.parquet(path)


@query("src17_append_mappings", "SELECT c_custkey, 'old' AS tag FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 <> 0")
def src17(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return io.append_mappings(c.where("c_custkey % 2 = 0").withColumn("tag", F.lit("old")), c.withColumn("tag", F.lit("new")), ["c_custkey"])


@query("src18_without_managed", "SELECT c_custkey, c_name FROM customer")
def src18(spark, sf):
    return io.without_managed(table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(1).alias("created_at"), F.lit(1).alias("id")))


@query("src19_whitelist", "SELECT p_partkey, p_brand FROM part")
def src19(spark, sf):
    from ..operators.clean import whitelist

    return whitelist(table(spark, sf, "part"), ["p_partkey", "p_brand", "absent"])


@query("p15_similarity", "SELECT p_partkey, round(1 - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)), 6) AS s FROM part")
def similarity(spark, sf):
    return rounded(table(spark, sf, "part").select("p_partkey", N.similarity(F.col("p_name"), F.col("p_type")).alias("s")))
