"""Lookups and expansions of titles, persons and series as joins.

All functions take whole relations and DataFrames of ids, so one plan serves one id or millions; a point lookup is a
filter that reaches the scan. Relations have lower-case columns and ids of any one type.

Orders that the relations leave open are fixed: ties end with the id or the whole row. Repeated rows give repeated list
items, as in the relations; ``once`` removes them first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions.text import split_list, split_roles

UNKNOWN_SEASON = "unknown season"
CAST = ("actor", "actress", "self")


def once(df: DataFrame, leave_out: str = "loaded_at") -> DataFrame:
    """Distinct rows without the arrival time."""
    return df.drop(leave_out).distinct()


def rows_where(df: DataFrame, column: str, value: object) -> DataFrame:
    """All rows with a value."""
    return df.filter(F.col(column) == value)


def first_where(df: DataFrame, column: str, value: object) -> DataFrame:
    """One row with a value: the first in the order of all its columns."""
    return rows_where(df, column, value).orderBy(*df.columns).limit(1)


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__nr", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__nr = 1").drop("__nr")


def title_shape(titles: DataFrame) -> DataFrame:
    """Titles as they are shown: tconst, kind, title, original, adult, year text, genres and runtimes lists.

    The year is the start, with the end behind a hyphen if there is one; genres are lower-case; missing lists are empty.
    """
    year = F.concat(F.coalesce(F.nullif("startyear", F.lit(0)).cast("string"), F.lit("")), F.when(F.col("endyear") > 0, F.concat(F.lit("-"), F.col("endyear").cast("string"))).otherwise(""))
    genres = F.filter(split_list(F.lower(F.coalesce("genres", F.lit("")))), lambda g: g != "")
    runtimes = F.filter(F.array(F.nullif("runtimeminutes", F.lit(0))), lambda r: r.isNotNull())
    return titles.select("tconst", F.col("titletype").alias("kind"), F.col("primarytitle").alias("title"), F.col("originaltitle").alias("original_title"), F.col("isadult").alias("adult"), F.nullif(year, F.lit("")).alias("year"), genres.alias("genres"), runtimes.alias("runtimes"))


def episodes(episode: DataFrame, titles: DataFrame, ratings: DataFrame, seasons: Iterable[int | str] | None = None) -> DataFrame:
    """Episodes with season and episode keys and all columns of their title and rating, prefixed.

    ``seasons`` keeps some: numbers, their texts, or UNKNOWN_SEASON. The key of an episode is its number; without one, or
    where an earlier row of the season has it, it is the padded id.
    """
    rows = episode
    if seasons is not None:
        wanted = {int(s) if isinstance(s, str) and s.isdigit() else s for s in seasons}
        numbers = [s for s in wanted if isinstance(s, int)]
        keep = F.col("seasonnumber").isin(*numbers) if numbers else F.lit(False)
        rows = rows.filter(F.coalesce(keep, F.lit(False)) | (F.col("seasonnumber").isNull() & F.lit(UNKNOWN_SEASON in wanted)))
    prefixed = lambda df, p: df.select(F.col("tconst").alias("__id"), *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != "tconst"])
    joined = rows
    for df, prefix in ((titles, "title_"), (ratings, "rating_")):
        side = prefixed(df, prefix)
        joined = joined.join(side, joined["tconst"] == side["__id"], "left").drop("__id")
    return keyed_episodes(joined)


def keyed_episodes(rows: DataFrame) -> DataFrame:
    """``rows`` of episodes with season_key and episode_key."""
    # rows without a number are not ranked together: their place is not used, so each stands by itself
    alone = F.when(F.col("episodenumber").isNull(), F.xxhash64("tconst", "parenttconst"))
    nth = F.row_number().over(W.partitionBy("parenttconst", "seasonnumber", "episodenumber", alone).orderBy("tconst"))
    return rows.withColumn("__nth", nth).withColumns({
        "season_key": F.coalesce(F.col("seasonnumber").cast("string"), F.lit(UNKNOWN_SEASON)),
        "episode_key": F.when(F.col("episodenumber").isNotNull() & (F.col("__nth") == 1), F.col("episodenumber").cast("string")).otherwise(padded("tconst")),
    }).drop("__nth")


def padded(column: str) -> Column:
    """Text form of a title id, be it text or a number."""
    text = F.regexp_replace(F.col(column).cast("string"), "^tt", "")
    return F.concat(F.lit("tt"), F.when(F.length(text) < 7, F.lpad(text, 7, "0")).otherwise(text))


def listed_people(crew: DataFrame, people: DataFrame, field: str) -> DataFrame:
    """(tconst, pos, nconst, primaryname) of the ids listed in a crew field; unknown ids keep their row."""
    items = crew.select("tconst", F.posexplode(split_list(F.col(field))).alias("pos", "nconst")).filter("nconst <> ''")
    return items.join(people.select("nconst", "primaryname"), "nconst", "left").select("tconst", "pos", "nconst", "primaryname")


def known_for(people: DataFrame, titles: DataFrame) -> DataFrame:
    """(nconst, pos, tconst, primarytitle, startyear) of the titles that persons are known for."""
    items = people.select("nconst", F.posexplode(split_list(F.col("knownfortitles"))).alias("pos", "tconst")).filter("tconst <> ''")
    return items.join(titles.select("tconst", "primarytitle", "startyear"), "tconst", "left").select("nconst", "pos", "tconst", "primarytitle", "startyear")


def category() -> Column:
    """Category of a credit, actors and selves being cast; a missing or empty one is null."""
    return F.when(F.col("category").isin(*CAST), "cast").otherwise(F.nullif("category", F.lit("")))


def credits(principals: DataFrame, people: DataFrame) -> DataFrame:
    """(tconst, category, ordering, nconst, primaryname, roles, job) of credits with a person and a category."""
    rows = principals.withColumn("category", category()).filter("category is not null and nconst is not null")
    return rows.join(people.select("nconst", "primaryname"), "nconst", "left").select("tconst", "category", "ordering", "nconst", "primaryname", split_roles(F.col("characters")).alias("roles"), "job")


def by_category(found: DataFrame) -> DataFrame:
    """(tconst, category, persons): credits of a title and category as one list in billing order."""
    return found.groupBy("tconst", "category").agg(F.sort_array(F.collect_list(F.struct("ordering", "nconst", "primaryname", "roles", "job"))).alias("persons"))


def parents(episode: DataFrame, titles: DataFrame) -> DataFrame:
    """(tconst, parenttconst, primarytitle, titletype, startyear) of every episode's series, also of unknown ones."""
    top = titles.select(F.col("tconst").alias("parenttconst"), "primarytitle", "titletype", "startyear")
    return episode.select("tconst", "parenttconst").join(top, "parenttconst", "left").select("tconst", "parenttconst", "primarytitle", "titletype", "startyear")


def rated(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    """Titles with their rating, null without one; of several ratings the first by votes and rating is used."""
    best = first_per_key(ratings, "tconst", [F.col("numvotes").desc_nulls_last(), F.col("averagerating").desc_nulls_last()])
    return titles.join(best.select("tconst", "averagerating", "numvotes"), "tconst", "left")


def akas_shape(akas: DataFrame) -> DataFrame:
    """Alternate titles as they are shown: empty and false fields are null, types and attributes lists."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return akas.select("titleid", "ordering", blank("title").alias("title"), blank("region").alias("region"), blank("language").alias("language"), split_list(blank("types")).alias("types"), split_list(blank("attributes")).alias("attributes"), F.when(F.col("isoriginaltitle"), True).alias("original"))


def _one_of_each(titles: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of each wanted title, the first in the order of the columns shown: other titles go before anything is shuffled."""
    mine = titles.select("tconst", "primarytitle", "titletype", "startyear").join(wanted.filter("tconst is not null").distinct(), "tconst", "left_semi")
    return mine.groupBy("tconst").agg(F.min(F.struct("primarytitle", "titletype", "startyear")).alias("t")).select("tconst", "t.*")


def title_detail(ids: DataFrame, titles: DataFrame, crew: DataFrame, episode: DataFrame, principals: DataFrame, people: DataFrame, ratings: DataFrame, akas: DataFrame) -> DataFrame:
    """One row per id of ``ids`` (tconst) with everything known of the title; an unknown id keeps its row."""
    mine = lambda df, key="tconst": df.join(ids.select(F.col("tconst").alias(key)), key, "left_semi")
    shape = title_shape(first_per_key(mine(titles), "tconst", [F.col("primarytitle")]))
    named = lambda field: listed_people(first_per_key(mine(crew), "tconst", [F.col(field)]), people, field).groupBy("tconst").agg(F.sort_array(F.collect_list(F.struct("pos", "nconst", "primaryname"))).alias(field))
    top = parents(first_per_key(mine(episode), "tconst", [F.col("parenttconst")]), _one_of_each(titles, mine(episode).select(F.col("parenttconst").alias("tconst")))).select("tconst", F.struct("parenttconst", "primarytitle", "titletype", "startyear").alias("episode_of"))
    roles = by_category(credits(mine(principals), people)).groupBy("tconst").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "persons")))).alias("people"))
    other = akas_shape(mine(akas, "titleid")).groupBy(F.col("titleid").alias("tconst")).agg(F.sort_array(F.collect_list(F.struct("ordering", "title", "region", "language", "types", "attributes", "original"))).alias("akas"))
    rating = rated(ids.select("tconst").distinct(), mine(ratings))
    out = rating.join(shape, "tconst", "left")
    for part in (named("directors"), named("writers"), top, roles, other):
        out = out.join(part, "tconst", "left")
    return out


def person_detail(ids: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """One row per id of ``ids`` (nconst) with the titles that the person is known for."""
    mine = first_per_key(people.join(ids, "nconst", "left_semi"), "nconst", [F.col("primaryname")])
    wanted = mine.select(F.explode(split_list(F.col("knownfortitles"))).alias("tconst"))
    films = known_for(mine, _one_of_each(titles, wanted)).groupBy("nconst").agg(F.sort_array(F.collect_list(F.struct("pos", "tconst", "primarytitle", "startyear"))).alias("known_for"))
    shown = mine.select("nconst", F.nullif("primaryname", F.lit("")).alias("name"), "birthyear", "deathyear", F.nullif("primaryprofession", F.lit("")).alias("profession"))
    return ids.select("nconst").distinct().join(shown, "nconst", "left").join(films, "nconst", "left")


def contained(names: DataFrame, credits_: DataFrame) -> DataFrame:
    """Persons of ``names`` that are credited anywhere (membership)."""
    return names.join(credits_.select("nconst").distinct(), "nconst", "left_semi")


def head_and_tail(df: DataFrame, order: list[Column], head: int, tail: int) -> DataFrame:
    """The first ``head`` and last ``tail`` rows in an order, each row once: two bounded top-k scans, no global sort."""
    turned = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    first = df.orderBy(*order).limit(head)
    last = df.orderBy(*turned).limit(tail)
    return first.unionAll(last).distinct()


# ---------------------------------------------------------------- computed keys and alternate titles


def title_keys(shown: DataFrame, language: str | None = None) -> DataFrame:
    """``shown`` (title, kind, startyear) with its computed keys; ``language`` decides which words are articles."""
    from reelgrid.functions import keys, text

    index = F.lit(None).cast("string")
    canonical, smart = keys.canonical_title(F.col("title")), keys.canonical_title(F.col("title"), language)
    long = lambda t: text.build_title(t, F.col("kind"), F.col("startyear"), index)
    return shown.withColumns({"canonical_title": canonical, "smart_canonical_title": smart, "long_title": long(F.col("title")), "long_canonical_title": long(canonical), "smart_long_canonical_title": long(smart)})


def episode_keys(shown: DataFrame) -> DataFrame:
    """``shown`` (title, startyear, series_title, series_kind) with the computed keys of episodes."""
    from reelgrid.functions import keys, text

    long = text.build_episode_title(F.col("series_title"), F.col("series_kind"), F.col("title"), F.col("startyear"), F.lit(None).cast("string"))
    return shown.withColumns({"long_episode_title": long, "canonical_series_title": keys.canonical_title(F.col("series_title")), "episode_title": F.col("title"), "canonical_episode_title": keys.canonical_title(F.col("title"))})


def person_keys(shown: DataFrame) -> DataFrame:
    """``shown`` (name) with its computed keys."""
    from reelgrid.functions import text

    split = shown.withColumn("__split", text.split_name(F.col("name")))
    return split.withColumns({"first_name": F.col("__split.first"), "last_name": F.col("__split.last"), "canonical_name": text.canonical_name(F.col("name")), "normal_name": text.normalize_name(F.col("name"))}).drop("__split")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Records of ``old`` with the values of ``new`` where it has any."""
    other = new.select(*[F.col(c).alias(f"__{c}") for c in new.columns])
    joined = old.join(other, old[key] == other[f"__{key}"], "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new.columns and c != key else F.col(c) for c in old.columns])


def aka_language() -> Column:
    """Language of an alternate title: its own, else null."""
    return F.nullif(F.lower(F.col("language")), F.lit(""))


def akas_in_language(akas: DataFrame, language: str) -> DataFrame:
    """Alternate titles in a language."""
    return akas.filter(aka_language() == language.lower())


def akas_by_similarity(akas: DataFrame, titles: DataFrame, wanted: str, language: str | None = None) -> DataFrame:
    """(tconst, title, language, score): a title and its alternate ones by similarity to a text, a language being preferred by 1."""
    from reelgrid.functions.similarity import ratio

    own = titles.select("tconst", F.col("primarytitle").alias("title"), F.lit(None).cast("string").alias("language"))
    rows = own.unionByName(akas.select(F.col("titleid").alias("tconst"), "title", aka_language().alias("language"))).filter("title is not null").distinct()
    scored = rows.withColumn("__raw", ratio(F.lower("title"), F.lit(wanted.lower())))
    bonus = F.when(F.col("language") == (language or "").lower(), 1.0).otherwise(0.0)
    return scored.withColumn("score", F.col("__raw") + F.coalesce(bonus, F.lit(0.0))).drop("__raw")


def same_title(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) of records of two frames (tconst, long_title) that are the same by id or long title."""
    left, right = a.select(F.col("tconst").alias("a_id"), F.col("long_title").alias("a_title")), b.select(F.col("tconst").alias("b_id"), F.col("long_title").alias("b_title"))
    by_id = left.join(right, left["a_id"].cast("string") == right["b_id"].cast("string"))
    by_title = left.join(right, left["a_title"] == right["b_title"])
    return by_id.select("a_id", "b_id").unionAll(by_title.select("a_id", "b_id")).distinct()
