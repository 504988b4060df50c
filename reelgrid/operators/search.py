"""Ranked fuzzy search over titles and persons, for one query text or a DataFrame of them.

Candidates share the query's phonetic key, which is a stored column; a few keys hold much of a catalogue, so their texts are
dealt to several tasks. Texts without a Latin letter have no key and are compared as they are. What is scored are distinct texts.
A query's known texts are taken by falling bound of their score and measured until the bound is below the score that enough
records have already; only what is left meets the rows that have the texts. A query with a year meets the titles of that year
first, and all others only if none of those is a hit. A title and its alternate titles count once, with the best score.

Scores. Titles: the larger of ratio(query, title) + 0.1 and the ratio of both without article; an episode loses 0.2.
Persons: the larger of ratio(query, name) + 0.1 and the ratio of the canonical forms; an equal name has 2 at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid import session
from reelgrid.functions import keys
from reelgrid.functions.parse import analyze
from reelgrid.functions.similarity import LEAST_SCORE, nearest_pairs
from reelgrid.functions.text import canonical_name, id_number
from reelgrid.schema import KINDS

#: Weights of kinds among equal scores; other kinds weigh nothing.
KIND_WEIGHT = {"movie": 6, "tv movie": 5, "tv series": 4, "tv mini series": 4, "tv special": 3, "tv short": 2, "short": 1, "video": 1}
#: Fixed value: titles compared as they are, per query, where there is no key and a bound is wanted.
EXACT_ROWS = 100
#: Known texts, and pairs with asked ones, of a phonetic key that one call looks at; beyond it the key is dealt to several.
KNOWN_PART, PAIRS_PART = 50_000, 4_000_000
#: What an episode loses.
EPISODE_LOSS = 0.2
EPISODE_KINDS = ("episode", "tvEpisode")
DEFAULT_RESULTS = 20


def with_title_key(df: DataFrame, title: str) -> DataFrame:
    return df if "t_soundex" in df.columns else df.withColumn("t_soundex", keys.title_key(F.col(title)))


def with_name_keys(df: DataFrame, name: str = "primaryname") -> DataFrame:
    if "ns_soundex" in df.columns:
        return df
    coded = df.withColumn("__keys", keys.name_keys_struct(F.col(name)))
    return coded.withColumns({"ns_soundex": F.col("__keys.given"), "sn_soundex": F.col("__keys.canonical"), "s_soundex": F.col("__keys.family")}).drop("__keys")


def title_queries(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """(query_id, query, query_year) of query texts; a year in the text is a wish, not a part of the title."""
    rows = []
    for k, text in enumerate(texts):
        found = analyze(text)
        rows.append((k, found.title, found.year))
    return spark.createDataFrame(rows, "query_id int, query string, query_year int")


def row_queries(rows: DataFrame, key: str, query: str, year: str | None = None) -> DataFrame:
    """(query_id, query, query_year) of a twentieth of the rows, one per id, their ids being the query ids.

    Taken are all ids whose number is divisible by 20. Delivered numbers are nearly all odd, so that this alone takes next
    to none; those that leave 1 by 40 are taken as well, which are a twentieth of odd numbers.
    """
    number = id_number(F.col(key))
    mine = rows.filter((F.pmod(number, F.lit(20)) == 0) | (F.pmod(number, F.lit(40)) == 1))
    wish = (F.col(year) if year else F.lit(None)).cast("int")
    one = mine.groupBy(F.col(key).alias("query_id")).agg(F.min(F.struct(F.col(query).alias("query"), wish.alias("query_year"))).alias("q"))
    return one.select("query_id", "q.query", "q.query_year")


def title_filter(kinds: Iterable[str] | None = None, episodes: bool = False, adult: bool | None = None) -> Column | None:
    """Filter of titles by kind (in either spelling) and adult flag; None without any."""
    tests = []
    if episodes:
        tests.append(F.col("titletype").isin(*EPISODE_KINDS))
    if kinds:
        both = {k for kind in kinds for k in (kind, KINDS.get(kind, kind), *(raw for raw, shown in KINDS.items() if shown == kind))}
        tests.append(F.col("titletype").isin(*sorted(both)))
    if adult is not None:
        tests.append(F.col("isadult") == adult)
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def candidates(queries: DataFrame, rows: DataFrame, title: str, key: str, joined: Callable[[DataFrame], DataFrame] = lambda hits: hits, year: str | None = None, keyed: bool = True, bound: int | None = None) -> DataFrame:
    """Pairs of (query_id, query, ...) and rows with the same phonetic key, or without one the same text.

    ``joined`` adds to the pairs what filters them, before they are bounded. If ``year`` names a column, ids of the query's
    year come first. An id counts once, however many of its rows have the text. Without ``keyed`` only texts without a key
    are sought; with a ``bound`` a query without a key has so many ids at most, else all.
    """
    asked = queries.withColumn("query_key", keys.title_key(F.col("query")))
    bare = joined(asked.filter("query_key is null").join(rows.filter("t_soundex is null"), F.col("query") == F.col(title)))
    order = [F.coalesce(F.col(year) == F.col("query_year"), F.lit(False)).desc()] if year else []
    few = bare if bound is None else bare.withColumn("__nr", F.dense_rank().over(W.partitionBy("query_id").orderBy(*order, key))).filter(F.col("__nr") <= bound).drop("__nr")
    if not keyed:
        return few
    return joined(asked.filter("query_key is not null").join(rows, F.col("query_key") == F.col("t_soundex"))).unionByName(few)


_ASKED = ["key", "part", "wish", "text_q", "low_q", "turned_q", "low_turned_q", "same_q", "same_turned_q"]
_KNOWN = ["key", "part", "wish", "text_t", "low_t", "turned_t", "low_turned_t", "n", "n_less"]


def _nearest(asked: DataFrame, known: DataFrame, least: float, results: int, cross: bool = False, penalty: float = 0.0) -> DataFrame:
    """(text_q, wish, text_t, base) of ``nearest_pairs`` over all keys.

    ``asked`` has key, wish, text_q, turned_q, same_q and same_turned_q, ``known`` key, wish, text_t, turned_t, n and n_less. Each
    pair of texts of a key meets in one part of it; the best of every part hold the best of all.
    """
    spark = known.sparkSession
    asked, known = session.cut(asked, "asked-texts"), session.cut(known, "known-texts")
    sizes = asked.groupBy("key").agg(F.count(F.lit(1)).alias("a")).join(known.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "key")
    sizes = sizes.withColumn("pk", F.ceil(F.col("k") / KNOWN_PART).cast("int"))
    sizes = sizes.withColumn("pa", F.ceil(F.col("a") * (F.col("k") / F.col("pk")) / PAIRS_PART).cast("int")).select("key", "pk", "pa")
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys of one part come together, as a call for each would cost more than its pairs
    shared = max(4 * number, -(-known.count() // KNOWN_PART))

    def dealt(df: DataFrame, mine: str, others: str, text: str, part: Callable[[Column, Column], Column], columns: list[str]) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("__other")
        put = df.join(sizes, "key").select("*", F.pmod(F.xxhash64(text), F.col(mine)).cast("int").alias("__mine"), each)
        low = {f"low_{c}": F.lower(F.col(c if c.startswith("turned") else f"text_{c}")) for c in (text[-1], f"turned_{text[-1]}")}
        # a number of its own keeps adaptive execution from putting few texts, which make many pairs, into few tasks
        return put.withColumns(low).withColumn("part", F.when(F.col("pa") * F.col("pk") == 1, F.pmod(F.xxhash64("key"), F.lit(shared)).cast("string")).otherwise(F.concat_ws("/", "key", part(F.col("__mine"), F.col("__other"))))).select(*columns).repartition(number, "part")

    left = dealt(asked, "pa", "pk", "text_q", lambda mine, other: F.concat_ws("/", mine, other), _ASKED)
    right = dealt(known, "pk", "pa", "text_t", lambda mine, other: F.concat_ws("/", other, mine), _KNOWN)

    def run(a, k):  # noqa: ANN001, ANN202
        return nearest_pairs(a, k, least, results, cross, penalty)

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(run, "text_q string, wish long, text_t string, base double")


def scored_titles(queries: DataFrame, texts: DataFrame, least: float, results: int) -> DataFrame:
    """(query, wish, text, base) of asked and known texts with one phonetic key and a score of at least ``least``, by which the best ``results`` titles are found.

    ``queries`` has query and wish, ``texts`` text, t_soundex, wish, n and n_less (titles that are counted at the text).
    """
    bare = lambda c: keys.strip_article(F.col(c))
    none = F.lit(None).cast("string")
    asked = queries.select(F.col("query").alias("text_q"), "wish").filter("text_q is not null").distinct()
    asked = asked.select(keys.title_key(F.col("text_q")).alias("key"), "wish", "text_q", bare("text_q").alias("turned_q"), none.alias("same_q"), none.alias("same_turned_q")).filter("key is not null")
    known = texts.filter("t_soundex is not null").groupBy(F.col("t_soundex").alias("key"), "wish", F.col("text").alias("text_t")).agg(F.sum("n").alias("n"), F.sum("n_less").alias("n_less"))
    known = known.select("key", "wish", "text_t", bare("text_t").alias("turned_t"), "n", "n_less")
    found = _nearest(asked, known, least, results, penalty=EPISODE_LOSS)
    return found.groupBy(F.col("text_q").alias("query"), "wish", F.col("text_t").alias("text")).agg(F.max("base").alias("base"))


def title_hits(queries: DataFrame, titles: DataFrame, akas: DataFrame | None = None, only: Column | None = None, least: float = LEAST_SCORE, results: int = DEFAULT_RESULTS, wished: bool = False, bound: int | None = EXACT_ROWS) -> DataFrame:
    """(query_id, query_year, tconst, title, kind, year, title_year, source, ordering, score) of the rows that meet a query, with all of the best ``results`` titles.

    ``wished``: only titles that have a row of the query's year, with all their rows; queries without a key are then left out.
    Without a ``bound`` those are ranked over all rows of their text.
    """
    rows = with_title_key(titles if only is None else titles.filter(only), "primarytitle").select("tconst", F.col("primarytitle").alias("text"), F.col("titletype").alias("kind"), F.col("startyear").alias("year"), F.col("startyear").alias("title_year"), "t_soundex")
    # written, as the keys are used again and again
    rows, asked = session.cut(rows, "titles-keyed"), queries.select("query_id", "query", "query_year")
    less = F.coalesce(F.col("kind") == "episode", F.lit(False))
    years = rows.filter("year is not null").select("tconst", F.col("year").cast("long").alias("wish")).distinct()
    every = rows.select("tconst", "text", "t_soundex", less.alias("less"), F.coalesce("year", F.lit(-1)).alias("of_year"))
    if akas is not None:
        others = session.cut(with_title_key(akas, "title").select(F.col("titleid").alias("tconst"), F.col("title").alias("text"), F.col("ordering").cast("int").alias("ordering"), "t_soundex"), "akas-keyed")
        mine = others if only is None else others.join(rows.select("tconst").distinct(), "tconst", "left_semi")
        every = every.unionByName(mine.select("tconst", "text", "t_soundex", F.lit(False).alias("less"), F.lit(None).cast("int").alias("of_year")))
    # each title counts at one of its texts; where a year is wished, only if it has no other
    one = every.filter("text is not null and tconst is not null").groupBy("tconst").agg(F.min(F.struct("less", "text", "t_soundex")).alias("r"), F.min("of_year").alias("low"), F.max("of_year").alias("high"))
    if wished:
        one = one.filter("low = high and low <> -1")
    counted = one.select("r.text", "r.t_soundex", F.col("high").cast("long").alias("wish") if wished else F.lit(0).cast("long").alias("wish"), (~F.col("r.less")).cast("int").alias("n"), F.col("r.less").cast("int").alias("n_less"))
    met = every.join(years, "tconst") if wished else every.withColumn("wish", F.lit(0).cast("long"))
    texts = met.select("text", "t_soundex", "wish", F.lit(0).alias("n"), F.lit(0).alias("n_less")).unionByName(counted)
    put = asked.withColumn("wish", F.col("query_year").cast("long") if wished else F.lit(0).cast("long"))
    # written, as titles and alternate titles meet it; it holds pairs that are close
    scored = session.cut(scored_titles(put, texts, least, results), "scored-texts").join(put, ["query", "wish"])
    near = (lambda df: df.join(years, "tconst").join(scored, ["text", "wish"])) if wished else (lambda df: df.join(scored, "text"))
    none = [F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("year")]
    columns = ["query_id", "query_year", "tconst", F.col("text").alias("title"), "kind", "year", "title_year", "source", "ordering", "base"]
    hits = near(rows.drop("t_soundex")).withColumns({"source": F.lit(0), "ordering": F.lit(0)}).select(*columns)
    bare = [(rows.withColumns({"source": F.lit(0), "ordering": F.lit(0)}), lambda found: found)]
    if akas is not None:
        # a wished year or a filter belongs to the title, so only then the titles are joined
        title_years = rows.select("tconst", "title_year")
        with_year = lambda found: found.join(title_years, "tconst", "left" if only is None else "inner")
        hits = hits.unionByName(with_year(near(others.drop("t_soundex"))).select("*", *none).withColumn("source", F.lit(1)).select(*columns))
        bare.append((others.select("*", *none).withColumn("source", F.lit(1)), with_year))
    if not wished:
        hits = hits.unionByName(_every_bare_hit(asked, bare, columns, results) if bound is None else _bare_hits(asked, bare, columns, bound))
    return _less_episodes(hits).filter(F.col("score") >= least).drop("base")


def _less_episodes(hits: DataFrame) -> DataFrame:
    # an alternate title stands for its title without a kind
    return hits.withColumn("score", F.col("base") - F.when(F.col("kind") == "episode", EPISODE_LOSS).otherwise(0.0))


def _bare_hits(asked: DataFrame, sources: list, columns: list, bound: int) -> DataFrame:
    """Hits of queries without a key: of each of the sources (rows, what joins their titles) rows of the same text, ``bound`` ids of each query; equal texts score as such."""
    found = [candidates(asked, rows, "text", "tconst", joined, year="title_year", keyed=False, bound=bound).withColumn("base", F.lit(1.1)).filter(F.length("query") > 0).select(*columns) for rows, joined in sources]
    return reduce(DataFrame.unionByName, found)


def _every_bare_hit(asked: DataFrame, sources: list, columns: list, results: int) -> DataFrame:
    """Hits of queries without a key over all rows of their text: the best ``results`` titles of each of the text's years, which hold those of any query.

    Rank and year depend on the text alone, so texts that are asked again and again are ranked once, and no pair is made that cannot count.
    """
    wanted = asked.filter(F.length("query") > 0).filter(keys.title_key(F.col("query")).isNull()).select("query_id", "query_year", F.col("query").alias("text"))
    texts = wanted.select("text").distinct()
    shown = ["text", "tconst", "source", "ordering", "kind", "year", "title_year"]
    found = [joined(rows.filter("t_soundex is null").join(texts, "text", "left_semi")).select(*shown) for rows, joined in sources]
    scored = _less_episodes(reduce(DataFrame.unionByName, found).withColumn("base", F.lit(1.1)))
    one = scored.groupBy("text", "tconst").agg(F.min(F.struct(-F.col("score"), *shown[2:])).alias("b")).select("text", "tconst", (-F.col("b.col1")).alias("score"), *[f"b.{c}" for c in shown[2:]])
    best = one.withColumn("__nr", F.row_number().over(W.partitionBy("text", "title_year").orderBy(*_rank_order()))).filter(F.col("__nr") <= results)
    return best.join(wanted, "text").withColumn("base", F.lit(1.1)).select(*columns)


def search_titles(
    queries: DataFrame, titles: DataFrame, akas: DataFrame | None = None, results: int = DEFAULT_RESULTS, only: Column | None = None, least: float = LEAST_SCORE, bound: int | None = EXACT_ROWS
) -> DataFrame:
    """(query_id, rank, tconst, title, kind, year, score): the best ``results`` titles of every query.

    ``titles`` has tconst, primarytitle, titletype, startyear, isadult; ``akas`` has titleid and title. A query's year is
    kept to if any hit has it, else dropped: both cases come from one plan. Equal scores are ordered by kind, by having a
    year, then by id. With a ``bound`` a query without a key is compared with so many titles of its text at most.
    """
    # of a title's rows the best score, then the title itself, then the first alternate title
    order = F.struct(-F.col("score"), "source", "ordering", "title", "kind", "year", "title_year", "query_year")

    def best(asked: DataFrame, wished: bool) -> DataFrame:
        hits = title_hits(asked, titles, akas, only, least, results, wished, bound)
        return hits.groupBy("query_id", "tconst").agg(F.min(order).alias("b")).select("query_id", "tconst", (-F.col("b.col1")).alias("score"), "b.title", "b.kind", "b.year", "b.title_year", "b.query_year")

    met = session.cut(best(queries.filter("query_year is not null"), True).filter("title_year = query_year"), "met-titles")
    rest = queries.join(met.select("query_id").distinct(), "query_id", "left_anti")
    return ranked_titles(met.unionByName(year_relaxed(best(rest, False))), results)


def year_relaxed(hits: DataFrame) -> DataFrame:
    """Hits (query_id, query_year, title_year, ...) of a query's year if it has any, else all of them."""
    met = F.col("title_year").eqNullSafe(F.col("query_year"))
    # one flag for each query, combined before the shuffle, and the queries that have it: no task sees all hits of a query
    granted = hits.filter(F.col("query_year").isNotNull() & met).select(F.col("query_id").alias("__granted")).distinct()
    flagged = hits.join(granted, F.col("query_id") == F.col("__granted"), "left")
    return flagged.filter(F.col("__granted").isNull() | met).drop("__granted")


def _rank_order() -> list:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv])[F.col("kind")], F.lit(0))
    return [F.desc("score"), weight.desc(), F.col("year").isNotNull().desc(), "tconst"]


def ranked_titles(scored: DataFrame, results: int) -> DataFrame:
    """The best rows of each query by score, kind, having a year, and id."""
    order = W.partitionBy("query_id").orderBy(*_rank_order())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= results).select("query_id", "rank", "tconst", "title", "kind", "year", "score")


def scored_people(queries: DataFrame, people: DataFrame, least: float, results: int = DEFAULT_RESULTS) -> DataFrame:
    """(query, name, score) of the distinct asked and known names that share one of three phonetic keys, with a score of at least ``least``, by which the best ``results`` persons are found."""
    turned = lambda c: F.replace(canonical_name(F.col(c)), F.lit(","), F.lit(""))

    def named(df: DataFrame, text: str, s: str, *more: str) -> DataFrame:
        held = with_name_keys(df, text).select(F.col(text).alias(f"text_{s}"), turned(text).alias(f"turned_{s}"), *more, F.array("ns_soundex", "sn_soundex", "s_soundex").alias("keys"))
        return held.withColumn("key", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull())))).drop("keys").withColumn("wish", F.lit(0).cast("long"))

    low = lambda c: F.lower(F.trim(F.col(c)))
    asked = named(queries.select("query").filter("query is not null").distinct(), "query", "q").withColumns({"same_q": low("text_q"), "same_turned_q": low("turned_q")})
    coded = [c for c in people.columns if c.endswith("_soundex")]
    every = people.filter("primaryname is not null")
    # each person counts at one of their names
    one = every.filter("nconst is not null").groupBy("nconst").agg(F.min(F.struct("primaryname", *coded)).alias("r")).select("r.*", F.lit(1).alias("n"))
    texts = every.select("primaryname", *coded, F.lit(0).alias("n")).unionByName(one).groupBy("primaryname", *coded).agg(F.sum("n").alias("n"), F.lit(0).alias("n_less"))
    found = _nearest(asked, named(texts, "primaryname", "t", "n", "n_less"), least, results, cross=True)
    # a pair that shares several keys counts once
    return found.groupBy(F.col("text_q").alias("query"), F.col("text_t").alias("name")).agg(F.max("base").alias("score"))


def search_people(queries: DataFrame, people: DataFrame, results: int = DEFAULT_RESULTS, least: float = LEAST_SCORE) -> DataFrame:
    """(query_id, rank, nconst, name, score): the best persons for (query_id, query) names.

    Any of a query's three phonetic keys may meet any of a person's three. Equal scores are ordered by descending id.
    """
    scored = scored_people(queries, people, least, results).join(queries.select("query_id", "query"), "query")
    hits = people.select("nconst", F.col("primaryname").alias("name")).join(scored, "name")
    best = hits.groupBy("query_id", "nconst").agg(F.max(F.struct("score", "name")).alias("s")).select("query_id", "nconst", "s.name", "s.score")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("nconst"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= results).select("query_id", "rank", "nconst", "name", "score")


def _all_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    keyed = F.array_distinct(F.filter(F.array("ns_soundex", "sn_soundex", "s_soundex"), lambda k: k.isNotNull()))
    return df.select(*columns, F.explode(keyed).alias("key"))


def best_score_per_id(hits: DataFrame) -> DataFrame:
    """One row per id of (id, score, source, seq) hits: the best score, ties by source then sequence."""
    return hits.withColumn("__nr", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "source", "seq"))).filter("__nr = 1").drop("__nr")
