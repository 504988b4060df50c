"""The join of a twentieth of all titles with all titles and alternate titles: its pairs are those of every two texts, and are not scored one by one."""

import random

from pyspark.sql import functions as F

from reelgrid.functions import keys
from reelgrid.operators import search
from reelgrid.plans import catalogue


def stored(spark, path, basics, akas):
    spark.createDataFrame(basics, "tconst string, primarytitle string, startyear int").write.parquet(f"{path}/title_basics.parquet")
    spark.createDataFrame(akas, "titleid string, title string").write.parquet(f"{path}/title_akas.parquet")
    return catalogue.QUERIES["batch_fuzzy_join"](spark, str(path))


def every_pair(spark, basics, akas):
    titles = spark.createDataFrame(basics, "id string, t string, startyear int")
    known = titles.select("id", "t").unionByName(spark.createDataFrame(akas, "id string, t string")).withColumn("key", keys.title_key(F.col("t")))
    asked = search.row_queries(titles, "id", "t").withColumn("key", keys.title_key(F.col("query")))
    near = F.least(F.length("t"), F.length("query")) / F.greatest(F.length("t"), F.length("query"))
    score = F.when(F.lower("t") == F.lower("query"), 1.0).otherwise(near)
    return known.join(asked, "key").groupBy("query_id", "id").agg(F.max(score).alias("score")).filter("score >= 0.6")


def joined_rows(plan):
    """Rows that the joins of an executed plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return joined_rows(plan.plan())
    mine = [plan.metrics().apply("numOutputRows").value()] if name.endswith("Join") else []
    return mine + [n for k in range(plan.children().size()) for n in joined_rows(plan.children().apply(k))]


def test_pairs_are_those_of_every_two_texts(spark, tmp_path, rows):
    random.seed(5)
    word = lambda: random.choice("SBR") + "".join(random.choice("aeioué ") for _ in range(random.randint(0, 14)))
    name = "tt{:07d}".format
    basics = [(name(k), random.choice([word(), word(), None, "", "東京", "The " + word()]), 2000) for k in range(1, 900)]
    akas = [(name(random.randint(1, 300)), random.choice([word(), word(), None, "!!!"])) for _ in range(2000)]
    # lower case is longer than these texts, so that texts of other lengths equal them
    long, short = "S" + "i̇" * 5, "S" + "İ" * 5
    basics += [(name(1000), short, 2000), (name(1020), long, 2000), (name(1003), short, 2000), (name(1005), long, 2000), (name(1007), "Other", 2000)]
    akas += [(name(1007), short), (name(1007), "S"), (name(1009), long), (name(1009), "Seeeee")]
    got, wanted = stored(spark, tmp_path, basics, akas), every_pair(spark, basics, akas)
    assert got.columns == ["query_id", "id", "score"] and rows(got) == rows(wanted.select(*got.columns))
    held = {(r["query_id"], r["id"]): r["score"] for r in got.collect()}
    assert all(held[name(q), name(i)] == 1.0 for q in (1000, 1020) for i in (1000, 1003, 1005, 1007, 1009, 1020))


def test_queries_of_one_length_are_scored_once(spark, tmp_path):
    basics = [(f"tt{k:07d}", f"Stone {'aeiou'[k % 5]}", 2000) for k in range(1, 1001)]
    got = stored(spark, tmp_path, basics, [])
    found = got.collect()
    assert len(found) == 1000 * 75
    plan = got._jdf.queryExecution().executedPlan()
    assert 0 < max(joined_rows(plan)) <= 1000


def test_nothing_asked_and_nothing_known(spark, tmp_path):
    assert stored(spark, tmp_path / "a", [("tt0000003", "Stone", 2000)], [("tt0000003", "Stone")]).count() == 0
    assert stored(spark, tmp_path / "b", [("tt0000020", None, 2000)], []).count() == 0
