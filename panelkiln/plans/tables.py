"""The driver's tables in the roles of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as sums of doubles depend on their order.  Prices are whole cents, so
    their means have no ties at six digits."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an entity x period panel: customers as players, some prices null."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("player_id"), "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("opponent"), (F.col("o_orderstatus") == "F").alias("was_home"),
        F.when(F.col("o_orderkey") % 7 != 0, F.round(F.col("o_totalprice") * 100).cast("long")).alias("price"), (F.col("o_orderkey") % 5).alias("goals"), F.year("o_orderdate").cast("long").alias("season"),
        F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "d").otherwise("i").alias("status"), (F.col("o_orderkey") % 91).alias("minutes"),
    )


PANEL = """panel AS (
  SELECT o_custkey AS player_id, o_orderkey, o_orderdate, o_orderpriority AS opponent, o_orderstatus = 'F' AS was_home,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS price, o_orderkey % 5 AS goals, CAST(year(o_orderdate) AS BIGINT) AS season,
         CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'd' ELSE 'i' END AS status, o_orderkey % 91 AS minutes
  FROM orders)"""
ORDER = ["o_orderdate", "o_orderkey"]


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as matches of the supplier's and the customer's nation."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_linenumber", "l_partkey", "l_returnflag")  # noqa: E741
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # hashed, not sorted: of the two sides of a task only the orders, whose keys are unique, are held in memory
    placed = o.join(c.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    j = l.join(placed.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(
        F.col("s_nationkey").cast("long").alias("home_team_id"), F.col("c_nationkey").cast("long").alias("away_team_id"), F.col("l_quantity").alias("home_goals"), (F.col("l_discount") * 100).alias("away_goals"),
        F.col("l_extendedprice").alias("home_xg"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.year("l_shipdate").cast("long").alias("season"),
    )


MATCHES = """matches AS (
  SELECT CAST(s_nationkey AS BIGINT) AS home_team_id, CAST(c_nationkey AS BIGINT) AS away_team_id, l_quantity AS home_goals, l_discount * 100 AS away_goals, l_extendedprice AS home_xg,
         l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(year(l_shipdate) AS BIGINT) AS season
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
MATCH_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "home_xg"]
