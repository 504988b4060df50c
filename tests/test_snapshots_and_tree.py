"""Changes between snapshots, and per-key results without imbalance."""

import datetime as dt
import random

from pyspark.sql import functions as F

from reelgrid.operators import snapshots, tree

SNAP = "snapshot_no int, snapshot_date date, tconst string, averagerating double, numvotes int, loaded_at timestamp, e string"
DAY = dt.date(2026, 1, 1)


def snap(no, key, rating, votes, hour=0):
    return (no, DAY, key, rating, votes, dt.datetime(2026, 1, 1, hour), "x")


def test_changes(spark, rows):
    data = [
        snap(1, "a", 7.0, 10), snap(3, "a", 7.0000001, 10), snap(7, "a", 7.1, 10),
        snap(1, "b", None, None), snap(3, "b", None, 5), snap(7, "b", None, 5),
        snap(3, "c", 5.0, 1),
        snap(1, "d", 5.0, 1), snap(7, "d", 5.0, 1),
        snap(1, "e", 1.0, 1), snap(3, "e", 9.0, 9, 1), snap(3, "e", 1.0, 1, 2), snap(7, "e", 1.0, 1),
        snap(1, None, 1.0, 1), snap(7, "f", None, None), *[snap(1, "a", 7.0, 10)] * 50,
    ]
    got = rows(snapshots.changes(spark.createDataFrame(data, SNAP)).select("snapshot_no", "tconst", "change_kind"))
    assert got == sorted([(7, "a", "changed"), (3, "b", "changed"), (3, "c", "added"), (7, "c", "removed"), (3, "d", "removed"), (7, "d", "added"), (7, "f", "added")], key=repr)


def test_one_or_no_snapshot(spark):
    assert snapshots.changes(spark.createDataFrame([snap(1, "a", 1.0, 1)], SNAP)).count() == 0
    assert snapshots.changes(spark.createDataFrame([], SNAP)).count() == 0


def test_kept_deliveries_are_merged_without_an_exchange(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "BATCH", 7)
    draw = random.Random(4)
    data = [snap(no, f"t{draw.randrange(300)}", draw.choice([None, 1.0, 2.04]), draw.choice([None, 5, 6]), draw.randrange(9)) for no in (2, 3, 9) for _ in range(400)]
    kept = snapshots.Kept(spark, f"file://{tmp_path}/kept")
    kept.add(spark.createDataFrame([d for d in data if d[0] < 9], SNAP), ranges=5)
    before = kept.files()
    kept.add(spark.createDataFrame(data, SNAP))  # only the new delivery is written
    assert {no: kept.files()[no] for no in before} == before and sorted(kept.files()) == [2, 3, 9] and len(before[2]) == 5
    df = kept.changes()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    last = {}
    for no, _, key, rating, votes, at, _ in data:
        low = lambda v: (v is not None, v or 0)
        rating = None if rating is None else round(rating, 1)
        last[no, key] = max(last.get((no, key), (at, low(rating), low(votes))), (at, low(rating), low(votes)))
    want = []
    for old, new in ((2, 3), (3, 9)):
        for key in {k for n, k in last if n in (old, new)}:
            a, b = last.get((old, key)), last.get((new, key))
            if kind := "added" if a is None else "removed" if b is None else "changed" if a[1:] != b[1:] else None:
                want.append((new, key, kind))
    assert rows(df.select("snapshot_no", "tconst", "change_kind")) == sorted(want, key=repr)


def test_hot_keys_only_go_through_rounds(spark, rows):
    df = spark.range(0, 4000, 1, 3).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("k"), F.col("id").cast("string").alias("v"))
    got = tree.tree_aggregate(df, "k", [tree.rows_of("n"), tree.min_of("a", F.col("v"))], fan_in=4, chunk_rows=50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 + 1 + 3  # cold keys once, hot ones in three rounds after 81 chunks
    assert rows(got) == rows(df.groupBy("k").agg(F.count(F.lit(1)), F.min("v")))


def test_tree_equals_one_aggregation(spark, rows):
    df = spark.range(0, 5000, 1, 40).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 11).cast("string")).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"), F.lit(1).alias("n"))
    states = [tree.rows_of("n"), tree.count_of("c", F.col("v")), tree.sum_of("s", F.col("v")), tree.min_of("a", F.col("v")), tree.max_of("b", F.col("v"))]
    want = df.groupBy("k").agg(F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v"))
    for fan_in in (2, 3, 64):
        assert rows(tree.tree_aggregate(df, "k", states, fan_in)) == rows(want)


def test_hot_keys(spark, rows):
    data = [("a",)] * 50 + [(None,)] * 49 + [("b",)]
    df = spark.createDataFrame(data, "k string")
    assert rows(tree.hot_keys(df, "k", 2)) == [("a", 50, 100)]
    assert rows(tree.hot_keys(df, "k", 1)) == [("a", 50, 100), ("b", 1, 100)]
    assert tree.hot_keys(df.limit(0), "k").count() == 0
