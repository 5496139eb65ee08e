import json

import pytest
from pyspark.sql import functions as F

from panelkiln.sources import io


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"elements": [{"id": 1, "web_name": "A"}, {"id": 2}]}))
    schema = "elements array<struct<id: long, web_name: string>>"
    assert sorted(map(tuple, io.read_documents(spark, str(tmp_path), schema, "elements").collect())) == [(1, "A"), (2, None)]
    (tmp_path / "a.json").write_text("{}")
    empty = io.read_documents(spark, str(tmp_path), schema, "elements")
    assert empty.count() == 0 and empty.columns == ["id", "web_name"]


def test_histories_take_the_id_from_the_file_name(spark, tmp_path):
    (tmp_path / "7.json").write_text(json.dumps({"history": [{"round": 1}, {"round": 2}]}))
    out = io.read_histories(spark, str(tmp_path), "history array<struct<round: long>>")
    assert sorted(map(tuple, out.collect())) == [(7, 1), (7, 2)]


def test_csv_nulls_and_bad_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,GW,x\nA,1,3\n,2,None\nB,3,bad\n")
    out = io.read_csv_table(spark, str(tmp_path), types={"GW": "int", "x": "int"}, where="GW > 1")
    assert sorted(map(tuple, out.collect()), key=str) == [("B", 3, None), (None, 2, None)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "k long, v string, s double")
    new = spark.createDataFrame([(2, "c", 0.5), (2, "d", 0.9), (3, "e", None), (None, "z", 9.0)], "k long, v string, s double")
    once = io.upsert(old, new, ["k"], "s")
    twice = io.upsert(once, new, ["k"], "s")
    want = [(1, "a", 1.0), (2, "d", 0.9), (3, "e", None)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    skipped = io.upsert(old, new, ["k"], "s", skip_existing=True)
    assert sorted(r.v for r in skipped.collect()) == ["a", "b", "e"]


def test_replace_season_keeps_others(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([("2023-24", 1), ("2024-25", 2)], "season string, x long")
    d.write.partitionBy("season").parquet(path)
    assert io.replace_season(spark.createDataFrame([("2024-25", 9)], "season string, x long"), path, "2024-25")
    assert not io.replace_season(d.limit(0), path, "2023-24")
    assert sorted((str(r.season), r.x) for r in spark.read.parquet(path).collect()) == [("2023-24", 1), ("2024-25", 9)]
    for bad in ("2024", "24-25", "2024-25; DROP", None):
        with pytest.raises(ValueError):
            io.replace_season(d, path, bad)
    with pytest.raises(ValueError):
        io.replace_season(d, path, "2024-25")


def test_season_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("season", F.concat(F.lit("s"), F.col("id") % 2)).write.partitionBy("season").parquet(path)
    plan = io.read_season_table(spark, path, ["s1"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(season" in plan or "PartitionFilters: [season" in plan


def test_upsert_touches_only_partitions_of_new_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    io.create_keyed(old, path, ["k"], 8)
    files = lambda: {p.relative_to(path).as_posix() for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(3, "a", 0.1), (3, "b", 0.9), (500, "c", None), (None, "z", 1.0)], "k int, v string, s double")
    touched = io.upsert_keyed(new, path, ["k"], "s")
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert kept and kept <= files() and not (before - kept) & files()
    want = io.upsert(old, new.withColumn("k", F.col("k").cast("long")), ["k"], "s").select("k", "v")
    assert sorted(map(tuple, io.read_keyed(spark, path).collect())) == sorted(map(tuple, want.collect()))
    again = files()
    assert io.upsert_keyed(new.limit(0), path, ["k"], "s") == [] and files() == again
    io.upsert_keyed(spark.createDataFrame([(3, "no"), (501, "yes")], "k long, v string"), path, ["k"], skip_existing=True)
    got = dict(map(tuple, io.read_keyed(spark, path).collect()))
    assert got[3] == "b" and got[501] == "yes" and len(got) == 202
    with pytest.raises(ValueError):
        io.upsert_keyed(new.withColumn("absent", F.lit(1)), path, ["k"], "s")
