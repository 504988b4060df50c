"""Searches, lookups and orders over small tables."""

from pyspark.sql import functions as F

from reelgrid.operators import lookup, ordering, search

TITLES = "tconst long, primarytitle string, titletype string, startyear int, isadult boolean"
AKAS = "titleid long, ordering int, title string"


def ids(df):
    return [r["tconst"] for r in df.orderBy("query_id", "rank").collect()]


def find(spark, text, titles, akas=(), **how):
    return ids(search.search_titles(search.title_queries(spark, [text]), spark.createDataFrame(list(titles), TITLES), spark.createDataFrame(list(akas), AKAS), **how))


def test_title_ranking(spark):
    same = [(40123928, "The Matrix", "short", 2022, False), (31444806, "The Matrix", None, None, False), (133093, "The Matrix", "movie", 1999, False), (9851526, "The Matrix", "short", 2004, False)]
    assert find(spark, "The Matrix", same)[0] == 133093 and find(spark, "The Matrix", same)[1:3] == [9851526, 40123928]
    assert find(spark, "Matrix, The", [(1, "The Matrix", "movie", 1, False), (2, "Matrice", "movie", 1, False)])[0] == 1
    rows = [(1, "Matrix", "episode", 1, False), (2, "Matrix", "short", 1, False), (3, "Matrix", "movie", 1, False)]
    assert find(spark, "Matrix", rows, [(3, 1, "Matrix, The")], results=2) == [3, 2]
    assert find(spark, "Matrix", [], []) == []


def test_year_is_a_wish(spark):
    rows = [(133093, "The Matrix", "movie", 1999, False), (9642498, "The Matrix", "movie", 2016, False)]
    assert find(spark, "Matrix, The (2016)", rows) == [9642498]
    assert find(spark, "Matrix, The (1950)", rows) == [133093, 9642498]


def test_titles_without_a_key(spark):
    rows = [(k, str(k), "movie", 2025, False) for k in range(1, 300)] + [(1000 + k, "!!!", "movie", 2025, False) for k in range(105)] + [(3001, "!!!", "movie", 2026, False), (3002, "東京", "movie", 2026, False)]
    akas = [(5000 + k, 1, "123") for k in range(105)]
    assert find(spark, "!!", rows, akas) == [] and find(spark, "東京", rows, akas) == [3002]
    assert len(find(spark, "123", rows, akas, results=5)) == 5 and len(find(spark, "!!!", rows, akas, results=500)) == 100


def test_bound_without_a_key_comes_after_year_filter_and_title(spark):
    rows = [(k, "!!!", "movie", 2025, False) for k in range(1, 151)] + [(900, "!!!", "movie", 2026, False), (901, "!!!", "episode", 2025, False)]
    assert find(spark, "!!! (2026)", rows) == [900] and find(spark, "!!!", rows, only=search.title_filter(episodes=True)) == [901]
    named = [(k, "Other", kind, year, False) for k, _, kind, year, _ in rows]
    akas = [(k, 1, "東京") for k, *_ in rows]
    assert find(spark, "東京 (2026)", named, akas) == [900] and find(spark, "東京", named, akas, only=search.title_filter(episodes=True)) == [901]
    hot = [(1, k, "東京") for k in range(150)] + [(2, 1, "東京")]
    assert find(spark, "東京", named, hot) == [1, 2]
    assert len(find(spark, "東京", named, akas, results=500)) == 100


def test_filters(spark):
    rows = [(1, "Matrix", "movie", 1, True), (2, "Matrix", "episode", 1, False), (3, "Matrix", "tv series", 1, False)]
    assert find(spark, "Matrix", rows, only=search.title_filter(adult=True)) == [1]
    assert find(spark, "Matrix", rows, only=search.title_filter(episodes=True)) == [2]
    assert find(spark, "Matrix", rows, only=search.title_filter(kinds=["tvSeries"])) == find(spark, "Matrix", rows, only=search.title_filter(kinds=["tv series"])) == [3]
    assert search.title_filter() is None


def test_queries_of_a_table(spark):
    rows = [("tt0000020", "A", 2000), ("tt0000020", "A", 2000), ("tt0000040", None, None), ("tt0000041", "B", None), ("tt0000021", "C", 1), ("tt0000039", "D", 1), ("x", "E", 1)]
    got = search.row_queries(spark.createDataFrame(rows, "tconst string, primarytitle string, startyear int"), "tconst", "primarytitle", "startyear")
    assert sorted(tuple(r) for r in got.collect()) == [("tt0000020", "A", 2000), ("tt0000040", None, None), ("tt0000041", "B", None)]


def test_ranked_searches_ask_a_twentieth_of_the_tables(spark):
    from conftest import DATA

    from reelgrid.plans import catalogue

    for name, table, key in (("title_search_ranked", "title_basics", "tconst"), ("person_search_ranked", "name_basics", "nconst")):
        ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct().collect()}
        wanted = {i for i in ids if int(i[2:]) % 20 == 0 or int(i[2:]) % 40 == 1}
        asked = {r[0] for r in catalogue.QUERIES[name](spark, DATA).select("query_id").distinct().collect()}
        assert asked <= wanted and len(asked) >= 0.8 * len(wanted) > 0


def test_people(spark):
    people = spark.createDataFrame([(1, "Fred Astaire"), (2, "Astaire Fred"), (3, "Freda Astair"), (4, "Nobody"), (5, None), (6, "!!!")], "nconst long, primaryname string")
    run = lambda q: [r["nconst"] for r in search.search_people(spark.createDataFrame([(0, q)], "query_id int, query string"), people).orderBy("rank").collect()]
    assert run("Fred Astaire")[:2] == [2, 1] and run("Astaire, Fred")[0] in (1, 2) and run("!!!") == [] and run("123") == []


def test_episodes(spark):
    ep = spark.createDataFrame([(101, 100, 1, 1), (102, 100, None, None), (103, 100, 1, 1), (104, 100, 2, None)], "tconst long, parenttconst long, seasonnumber int, episodenumber int")
    tb = spark.createDataFrame([(101, "Pilot"), (102, "Special"), (103, "Alternate Pilot")], "tconst long, primarytitle string")
    tr = spark.createDataFrame([(101, 8.5, 42)], "tconst long, averagerating double, numvotes int")
    got = {r["tconst"]: r for r in lookup.episodes(ep, tb, tr).collect()}
    assert [(got[k]["season_key"], got[k]["episode_key"]) for k in sorted(got)] == [("1", "1"), ("unknown season", "tt0000102"), ("1", "tt0000103"), ("2", "tt0000104")]
    assert got[101]["rating_numvotes"] == 42 and got[104]["title_primarytitle"] is None
    assert {r["tconst"] for r in lookup.episodes(ep, tb, tr, ["1", lookup.UNKNOWN_SEASON]).collect()} == {101, 102, 103}
    assert lookup.episodes(ep, tb, tr, [9]).count() == 0 and lookup.episodes(ep.limit(0), tb, tr).count() == 0
    order = ordering.numbered(lookup.keyed_episodes(ep), ["parenttconst"], ordering.episode_order()).orderBy("pos")
    assert [r["tconst"] for r in order.collect()] == [101, 103, 104, 102]


def test_orders(spark):
    films = spark.createDataFrame([("1", "B", 2000), ("2", "A", 2000), ("10", "A", 2000), ("3", None, 2000), ("4", "Z", 2010), ("5", "A", None)], "tconst string, title string, year int")
    assert [r["tconst"] for r in films.orderBy(*ordering.title_order()).collect()] == ["4", "2", "10", "1", "3", "5"]
    people = spark.createDataFrame([("1", 2, "A"), ("2", 1, "B"), ("3", 0, "A"), ("4", None, "B"), ("5", 1, None)], "nconst string, ordering int, canonical_name string")
    assert [r["nconst"] for r in people.orderBy(*ordering.people_order()).collect()] == ["2", "5", "1", "3", "4"]
    firms = spark.createDataFrame([("1", "B", "[us]"), ("2", "A", None), ("3", "A", "[de]")], "company_id string, name string, country string")
    assert [r["company_id"] for r in firms.orderBy(*ordering.company_order()).collect()] == ["3", "2", "1"]
    same = films.select(ordering.same_item(F.lit(1), F.lit("1"), F.lit("x"), F.lit("x")), ordering.same_item(F.lit(1), F.lit(None), F.lit("x"), F.lit("x"))).first()
    assert tuple(same) == (True, False)


def test_head_and_tail(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    assert sorted(r[0] for r in lookup.head_and_tail(df, ["n"], 2, 3).collect()) == [0, 1, 97, 98, 99]
    assert lookup.head_and_tail(df, [F.col("n")], 80, 80).count() == 100


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/title_basics.parquet").select("tconst", "primarytitle")
    plan = lookup.rows_where(df, "tconst", "tt1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tconst,tt1)" in plan and "ReadSchema: struct<tconst:string,primarytitle:string>" in plan


def test_numbering_of_groups_that_span_partitions(spark, rows):
    from pyspark.sql import Window as W

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("g"), F.col("id"), (F.col("id") % 10).alias("v"))
    order = [F.col("v").desc_nulls_first(), F.col("id").asc()]
    want = df.withColumn("pos", F.row_number().over(W.partitionBy("g").orderBy(*order)))
    assert rows(ordering.numbered(df, ["g"], order)) == rows(want)
    assert ordering.numbered(df.limit(0), ["g"], order).count() == 0
