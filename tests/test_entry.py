"""The driver's contract: names, columns and some queries against their SQL."""

import tempfile

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    d = __spark_entry__.entry(spark)
    assert d.limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["w1_rolling_features", "a1_player_vs_opponent", "a7_team_home_away", "j8_three_source_matches", "j13_staged_player_match", "p23_points_scoring", "v6_run_validation", "w15_projections"])
def test_against_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toArrow()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.column_names) == columns
    assert _keys(got.to_pandas(), columns) == _keys(want, columns)


@pytest.mark.parametrize("name", ["j13_staged_player_match", "j14_season_player_mapping", "j15_manual_overrides", "t6_unmatched_sample"])
def test_every_part_against_brute_force(spark, name):
    """Names two edits and more apart, and ids beyond those of the small tables."""
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    parts = f"SELECT p_partkey * 12 AS p_partkey, p_name, p_brand, p_type FROM '{sf}/part.parquet' UNION ALL SELECT p_partkey * 12 + 7, 'x' || p_name || '{'y' * 30}', 'Brand#0', p_type FROM '{sf}/part.parquet' WHERE p_partkey % 9 = 0"
    folder = tempfile.mkdtemp(prefix="spark-parts-")
    con.execute(f"COPY ({parts}) TO '{folder}/part.parquet'")
    con.execute(f"CREATE VIEW part AS FROM '{folder}/part.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, folder).toArrow()
    columns = sorted(want.columns)
    assert sorted(got.column_names) == columns
    assert _keys(got.to_pandas(), columns) == _keys(want, columns)


def _keys(frame, columns) -> list[str]:
    """Rows as sorted texts, numbers to six digits, all kinds of null alike."""
    f = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr([_plain(v) for v in row]) for row in f.itertuples(index=False))


def _plain(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return None if v is None else str(v).removesuffix(" 00:00:00")
