"""Top N of every group, against a plain ranking, and skipping by statistics."""

import random

import pytest

from reelgrid import session
from reelgrid.llm import topn

COLS = "grp string, item string, score double, second long, number int"


def brute(data, n):
    best = {}
    for g, i, s, v, _ in data:
        if g is None or i is None or s is None:
            continue
        v = -1 if v is None else v
        best[g, i] = max(best.get((g, i), (s, v)), (s, v))
    groups = {}
    for (g, i), (s, v) in best.items():
        digits = "".join(c for c in i if c.isdigit())
        groups.setdefault(g, []).append((-s, -v, int(digits or 0), i))
    return sorted((g, k, x[3]) for g, xs in groups.items() for k, x in enumerate(sorted(xs)[:n], 1))


@pytest.mark.parametrize("n", [1, 5])
def test_against_brute_force(spark, rows, n):
    draw = random.Random(n)
    data = [(draw.choice(["hot", "hot", "a", "b", f"g{k % 50}"]), f"tt{draw.randrange(4000)}", draw.randrange(20) / 2, draw.randrange(3), 1) for k in range(6000)]
    data += data[:100] + [(None, "tt1", 1.0, 1, 1), ("a", None, 1.0, 1, 1), ("a", "tt1", None, 1, 1), ("only", "x", 1.0, None, 1)]
    got = topn.top_n(spark.createDataFrame(data, COLS), n, row_group=200)
    assert rows(got.select("grp", "rnk", "item")) == brute(data, n)


def test_row_groups_below_the_nth_score_are_skipped(spark):
    df = spark.range(200_000).selectExpr("'g' as grp", "concat('tt', id) as item", "cast(id % 1000 as double) as score", "1L as second", "cast(0 as decimal(38,0)) as number")
    path = session.written(df.coalesce(1).sortWithinPartitions("grp", df["score"].desc()), "t", **{"parquet.block.row.count.limit": "5000"})
    reader = topn._Reader(session.parts(spark, path)[0], 5)
    best = list(reader.run())
    assert len(best) == 1 and len(best[0]) == 5 and set(best[0]["score"]) == {999.0} and reader.skipped > 30 and reader.read < 5


def test_empty(spark):
    assert topn.top_n(spark.createDataFrame([], COLS), 5).count() == 0


def test_kept_table_is_found_again_and_skips(spark, rows, tmp_path):
    spark.range(40_000).selectExpr("case when id % 2 = 0 then 'hot' else concat('g', id % 90) end as grp", "concat('tt', id) as item", "cast(id % 997 as double) as score", "id % 7 as second").write.parquet(f"file://{tmp_path}/in")
    df = spark.read.parquet(f"file://{tmp_path}/in")
    path = topn.kept_table(df, 1000, "again")
    assert topn.kept_table(df, 1000, "again") == path
    told = topn.skipping(spark, path, 3).collect()
    assert sum(r["skipped"] for r in told) > 5 and all(r["read"] + r["skipped"] == r["row_groups"] for r in told)
    assert rows(topn.best_of(spark, path, 3).select("grp", "rnk", "item")) == brute([(*r, 1) for r in df.collect()], 3)
