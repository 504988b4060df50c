"""Several values packed in one field."""

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import packed

CASES = [
    ("text", "Drama", ["Drama"]),
    ("text", "Drama,Comedy", ["Drama", "Comedy"]),
    ("text", " Drama ,  Comedy , ", ["Drama", "Comedy"]),
    ("text", "A; B|C\u0002D / E", ["A", "B", "C", "D", "E"]),
    ("text", "Home Cooking / Travel", ["Home Cooking", "Travel"]),
    ("text", "AC/DC,War", ["AC/DC", "War"]),
    ("text", '"Music, Live","The ""B"" Reel"', ["Music, Live", 'The "B" Reel']),
    ("text", '"Puppet / Mask";War', ["Puppet / Mask", "War"]),
    ("text", '"never closed, War', ['"never closed', "War"]),
    ("text", '"A" and "B",C', ['"A" and "B"', "C"]),
    ("text", "a,,b", ["a", "b"]),
    ("text", "a,a", ["a", "a"]),
    ("text", '"","a"', ["a"]),
    ("text", " a　, b", ["a", "b"]),
    ("text", ",;|", []),
    ("text", "   ", []),
    ("id", "nm1  nm2", ["nm1", "nm2"]),
    ("id", "nm1 / nm2/nm3 nm4", ["nm1", "nm2", "nm3", "nm4"]),
    ("id", '"nm1" "nm2", nm3', ["nm1", "nm2", "nm3"]),
    ("text", None, []),
    ("text", "", []),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_cases(spark, broadcast):
    df = spark.createDataFrame([(k, kind, v) for k, (kind, v, _) in enumerate(CASES)], "k int, kind string, v string")
    got = {r["k"]: r["vals"] for r in packed.split_packed(df, "v", F.col("kind"), **({} if broadcast else {"most_rows": 1})).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}


def test_long_text_and_clashing_columns(spark):
    long = ",".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([(long, "x", "y", 1)], "`a b` string, vals string, skeleton string, rule int")
    row = packed.split_packed(df, "a b", into="parts").first()
    assert len(row["parts"]) == 20_000 and row["vals"] == "x" and row["skeleton"] == "y"


def test_repeated_rows_count_once(spark, rows):
    df = spark.createDataFrame([("f", "text", "r", "a,b")] * 3 + [("f", "text", "r", "a;b"), ("f", "text", None, "c|d")], "field string, rule_kind string, rec_key string, packed string")
    assert rows(packed.packed_values(df, 2)) == [("f", "r", 1, "a"), ("f", "r", 2, "b"), ("f", None, 1, "c"), ("f", None, 2, "d")] or len(rows(packed.packed_values(df, 2))) == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "field string, rule_kind string, rec_key string, packed string")
    assert packed.packed_values(df).count() == 0


def test_skeleton(spark):
    df = spark.createDataFrame([('Drama, "Music, Live"',)], "v string")
    assert df.select(packed.skeleton(F.col("v"))).first()[0] == 'a, "a, a"'


def test_frequent_rules_are_broadcast_and_rare_ones_joined(spark, monkeypatch):
    monkeypatch.setattr(packed, "FREQUENT", 2)
    df = spark.createDataFrame([(k, kind, v) for k, (kind, v, _) in enumerate(CASES)] + [(1000 + k, "text", "a,b") for k in range(50)] + [(2000, None, "a,b"), (2001, "text", None)], "k int, kind string, v string")
    got = {r["k"]: r["vals"] for r in packed.split_packed(df, "v", F.col("kind"), most_rows=1).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)} | {1000 + k: ["a", "b"] for k in range(50)} | {2000: [], 2001: []}
