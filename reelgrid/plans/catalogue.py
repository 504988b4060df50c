"""Queries of the catalogue's own operators over the film and series tables, and their SQL.

Tables hold every row as delivered, repeated rows included; ids are texts. Lists come out as joined texts, so that results
can be compared by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid import session
from reelgrid.functions import keys, linguistics, render, text
from reelgrid.functions.parse import analyze_title
from reelgrid.operators import lookup, ordering, search
from reelgrid.schema import KINDS
from reelgrid.session import table

# ---------------------------------------------------------------- SQL pieces


def _alt(joined: bool) -> str:
    return "|".join(a.replace("'", "''") for a in linguistics.ARTICLES if (a[-1] in "'-") == joined)


_APART, _JOINED = _alt(False), _alt(True)


def _ends(t: str) -> str:
    return f"regexp_matches({t}, '(?is)(^|, )({_APART}|{_JOINED})$')"


def _canonical_title(t: str) -> str:
    return f"CASE WHEN {_ends(t)} THEN {t} ELSE regexp_replace({t}, '(?is)^(?:({_APART}) |({_JOINED}))(.*)$', '\\3, \\1\\2') END"


def _strip(t: str) -> str:
    return f"CASE WHEN {_ends(t)} THEN regexp_replace({t}, '(?is)(^|, )({_APART}|{_JOINED})$', '') ELSE regexp_replace({t}, '(?is)^(({_APART}) |({_JOINED}))', '') END"


def _phonetic(t: str) -> str:
    up = f"upper(replace(regexp_replace({t}, '^[^a-zA-Z]*', ''), 'ß', 'ss'))"
    digits = f"translate(regexp_replace(substr({up}, 2), '[^{keys.CONSONANTS}]', '', 'g'), '{keys.CONSONANTS}', '{keys.DIGITS}')"
    for d in sorted(set(keys.DIGITS)):
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {up} <> '' THEN substr({up}, 1, 1) || substr({digits}, 1, 4) END"


_PARTICLES = ", ".join(f"'{p}'" for p in text.PARTICLES)


def _canonical_names(source: str, column: str, extra: str) -> str:
    """CTEs ending in ``named`` (extra columns, name, canonical)."""
    return f"""
    words AS (SELECT {extra}, {column} AS name, string_split({column}, ' ') AS w FROM {source}),
    placed AS (SELECT *, len(w) AS n, CASE WHEN lower(w[1]) IN ({_PARTICLES}) THEN 0 WHEN lower(w[len(w) - 1]) IN ({_PARTICLES}) THEN len(w) - 2
      WHEN len(w) > 3 AND lower(w[len(w) - 2]) IN ({_PARTICLES}) THEN len(w) - 3 END AS pl FROM words),
    junior AS (SELECT *, CASE WHEN starts_with(lower(coalesce(w[pl + 3], '')), 'jr') THEN 1 ELSE 0 END AS jr FROM placed),
    named AS (SELECT *, CASE WHEN contains(name, ', ') OR n < 2 THEN name
      WHEN n > 2 AND pl IS NOT NULL THEN array_to_string(w[pl + 1 : pl + 2 + jr], ' ') || ', ' || array_to_string(list_concat(w[1 : pl], w[pl + 3 + jr : n]), ' ')
      ELSE w[n] || ', ' || array_to_string(w[1 : n - 1], ' ') END AS canonical FROM junior)"""


def _list(t: str) -> str:
    return f"CASE WHEN contains({t}, ',') THEN string_split({t}, ',') ELSE string_split({t}, chr(2)) END"


_KIND_SQL = "CASE titletype " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE titletype END"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL if it has one."""

    def take(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def _least(df: DataFrame, column: str) -> str:
    return df.agg(F.min(column)).first()[0]


# ---------------------------------------------------------------- lookups and projections


@query("SELECT tconst, titletype, primarytitle, startyear FROM title_basics WHERE tconst = (SELECT min(tconst) FROM title_basics) ORDER BY ALL LIMIT 1")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "title_basics").select("tconst", "titletype", "primarytitle", "startyear")
    return lookup.first_where(titles, "tconst", _least(titles, "tconst"))


@query("SELECT titleid, ordering, title, region FROM title_akas WHERE titleid = (SELECT titleid FROM title_akas WHERE titleid IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, titleid LIMIT 1)")
def multi_lookup(spark: SparkSession, folder: str) -> DataFrame:
    akas = table(spark, folder, "title_akas").select("titleid", "ordering", "title", "region")
    most = akas.filter("titleid is not null").groupBy("titleid").count().orderBy(F.desc("count"), "titleid").first()[0]
    return lookup.rows_where(akas, "titleid", most)


@query(f"""SELECT tconst, titletype AS kind, primarytitle AS title, originaltitle AS original_title, isadult AS adult,
    nullif(coalesce(CAST(nullif(startyear, 0) AS VARCHAR), '') || CASE WHEN endyear > 0 THEN '-' || CAST(endyear AS VARCHAR) ELSE '' END, '') AS year,
    array_to_string(list_filter({_list("lower(coalesce(genres, ''))")}, lambda g: g <> ''), '|') AS genres, CAST(nullif(runtimeminutes, 0) AS VARCHAR) AS runtimes FROM title_basics""")
def title_normalize(spark: SparkSession, folder: str) -> DataFrame:
    shape = lookup.title_shape(table(spark, folder, "title_basics"))
    return shape.withColumns({"genres": F.array_join("genres", "|"), "runtimes": F.get("runtimes", F.lit(0)).cast("string")})


@query(f"SELECT tconst, CAST(unnest(generate_series(0, len(g) - 1)) AS INTEGER) AS pos, unnest(g) AS genre FROM (SELECT tconst, {_list('genres')} AS g FROM title_basics WHERE genres <> '')")
def split_genres(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "title_basics").filter("genres <> ''")
    return rows.select("tconst", F.posexplode(text.split_list(F.col("genres"))).alias("pos", "genre"))


@query(f"SELECT {_KIND_SQL} AS kind, count(*) AS n FROM title_basics GROUP BY 1")
def kind_map(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_basics").groupBy(text.mapped_kind(F.col("titletype")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- keys and title text


@query(f"SELECT tconst, primarytitle, {_phonetic('bare')} AS t_soundex FROM (SELECT tconst, primarytitle, {_strip('primarytitle')} AS bare FROM title_basics)")
def phonetic_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_basics").select("tconst", "primarytitle", keys.title_key(F.col("primarytitle")).alias("t_soundex"))


@query(f"""WITH {_canonical_names("name_basics", "primaryname", "nconst")},
    coded AS (SELECT nconst, name, {_phonetic("name")} AS a, {_phonetic("canonical")} AS b, {_phonetic("string_split(canonical, ', ')[1]")} AS c FROM named),
    two AS (SELECT *, CASE WHEN b IS DISTINCT FROM a THEN b END AS b2 FROM coded)
    SELECT nconst, CASE WHEN name <> '' THEN a END AS ns_soundex, CASE WHEN name <> '' THEN b2 END AS sn_soundex, CASE WHEN name <> '' AND c IS DISTINCT FROM a AND c IS DISTINCT FROM b2 THEN c END AS s_soundex FROM two""")
def phonetic_name3(spark: SparkSession, folder: str) -> DataFrame:
    given, canonical, family = keys.name_keys(F.col("primaryname"))
    return table(spark, folder, "name_basics").select("nconst", given.alias("ns_soundex"), canonical.alias("sn_soundex"), family.alias("s_soundex"))


@query(f"SELECT titleid, ordering, {_canonical_title('title')} AS canonical FROM title_akas")
def canonical_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_akas").select("titleid", "ordering", keys.canonical_title(F.col("title")).alias("canonical"))


@query(f"""WITH c AS (SELECT titleid, ordering, {_canonical_title("title")} AS c FROM title_akas),
    j AS (SELECT titleid, ordering, regexp_replace(c, '(?is)^(.*), ({_JOINED})$', '\\2\\1') AS c FROM c)
    SELECT titleid, ordering, regexp_replace(c, '(?is)^(.*), ({_APART})$', '\\2 \\1') AS normal FROM j""")
def normalize_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_akas").select("titleid", "ordering", keys.normalize_title(keys.canonical_title(F.col("title"))).alias("normal"))


@query(f"SELECT titleid, ordering, {_strip('title')} AS bare FROM title_akas")
def strip_article(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_akas").select("titleid", "ordering", keys.strip_article(F.col("title")).alias("bare"))


@query(f"WITH {_canonical_names('name_basics', 'primaryname', 'nconst')} SELECT nconst, name, canonical FROM named")
def canonical_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "name_basics").select("nconst", F.col("primaryname").alias("name"), text.canonical_name(F.col("primaryname")).alias("canonical"))


_SUFFIX = "|".join(text.SUFFIXES)


@query(f"""WITH bare AS (SELECT DISTINCT nconst, primaryname, regexp_replace(trim(regexp_replace(primaryname, '\\s+', ' ', 'g')), '(?i)((^| )({_SUFFIX})[.,]*)+$', '') AS b FROM name_basics),
    {_canonical_names("bare", "b", "nconst, primaryname")}
    SELECT nconst, primaryname AS name, CASE WHEN contains(canonical, ', ') THEN regexp_replace(canonical, '(?s)^.*?, ', '') ELSE '' END AS first_name, string_split(canonical, ', ')[1] AS last_name FROM named""")
def name_split(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_basics").select("nconst", "primaryname").distinct()
    return names.select("nconst", F.col("primaryname").alias("name"), text.split_name(F.col("primaryname")).alias("s")).select("nconst", "name", F.col("s.first").alias("first_name"), F.col("s.last").alias("last_name"))


# ---------------------------------------------------------------- search blocks

WANTED = ("The Last Debt", "Return to Fonvomnir", "Bitter Promise, The")


def _wanted(spark: SparkSession) -> DataFrame:
    return search.title_queries(spark, WANTED)


def _asked_titles(spark: SparkSession, folder: str) -> DataFrame:
    return search.row_queries(table(spark, folder, "title_basics"), "tconst", "primarytitle", "startyear")


_WANTED_SQL = "asked(query_id, query) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(WANTED)) + f"), wanted AS (SELECT query_id, query, {_phonetic('b')} AS k FROM (SELECT *, {_strip('query')} AS b FROM asked))"
_TITLES_SQL = f"titles AS (SELECT *, {_phonetic('b')} AS t_soundex FROM (SELECT *, {_strip('primarytitle')} AS b FROM title_basics))"
_AKAS_SQL = f"akas AS (SELECT *, {_phonetic('b')} AS t_soundex FROM (SELECT *, {_strip('title')} AS b FROM title_akas))"


@query(f"WITH {_WANTED_SQL}, {_TITLES_SQL} SELECT query_id, tconst, primarytitle FROM wanted JOIN titles ON k = t_soundex")
def block_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.with_title_key(table(spark, folder, "title_basics").select("tconst", "primarytitle"), "primarytitle")
    return search.candidates(_wanted(spark), rows, "primarytitle", "tconst").select("query_id", "tconst", "primarytitle")


@query(f"WITH {_WANTED_SQL}, {_TITLES_SQL} SELECT query_id, tconst, primarytitle, startyear FROM wanted JOIN titles ON k = t_soundex WHERE titletype IN ('movie', 'tvSeries', 'tv series') AND isadult = false AND startyear >= 1990")
def block_with_filters(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "title_basics").filter(search.title_filter(kinds=["movie", "tv series"], adult=False) & (F.col("startyear") >= 1990))
    rows = search.with_title_key(titles.select("tconst", "primarytitle", "startyear"), "primarytitle")
    return search.candidates(_wanted(spark), rows, "primarytitle", "tconst").select("query_id", "tconst", "primarytitle", "startyear")


@query(f"WITH {_WANTED_SQL}, {_AKAS_SQL} SELECT query_id, a.titleid, a.ordering, a.title FROM wanted JOIN akas a ON k = t_soundex JOIN (SELECT tconst FROM title_basics WHERE titletype IN ('episode', 'tvEpisode')) t ON a.titleid = t.tconst")
def aka_join_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.with_title_key(table(spark, folder, "title_akas").select("titleid", "ordering", "title"), "title")
    hits = search.candidates(_wanted(spark), rows, "title", "titleid")
    titles = table(spark, folder, "title_basics").filter(search.title_filter(episodes=True)).select(F.col("tconst").alias("titleid"))
    return hits.join(titles, "titleid").select("query_id", "titleid", "ordering", "title")


@query(f"WITH {_WANTED_SQL}, {_AKAS_SQL} SELECT query_id, titleid, ordering, title FROM wanted JOIN akas ON k = t_soundex")
def aka_no_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.with_title_key(table(spark, folder, "title_akas").select("titleid", "ordering", "title"), "title")
    return search.candidates(_wanted(spark), rows, "title", "titleid").select("query_id", "titleid", "ordering", "title")


@query(f"WITH {_TITLES_SQL}, texts AS (SELECT DISTINCT primarytitle AS q FROM titles WHERE t_soundex IS NULL AND primarytitle <> ''), hits AS (SELECT q, tconst, row_number() OVER (PARTITION BY q ORDER BY tconst) AS nr FROM texts JOIN (SELECT DISTINCT tconst, primarytitle, t_soundex FROM titles) t ON q = primarytitle AND t_soundex IS NULL) SELECT q AS query, tconst FROM hits WHERE nr <= 100")
def no_key_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without a Latin letter as a query against all titles; the bound of rows per query is the feature."""
    rows = search.with_title_key(table(spark, folder, "title_basics").select("tconst", "primarytitle").distinct(), "primarytitle")
    asked = rows.filter("t_soundex is null and primarytitle <> ''").select(F.col("primarytitle").alias("query")).distinct().withColumn("query_id", F.col("query"))
    return search.candidates(asked, rows, "primarytitle", "tconst", bound=search.EXACT_ROWS).select("query", "tconst")


ASKED = ("Rosa de Zotwom", "Fenis Gakhus", "Mirela van Tun Jr.")


@query(f"""WITH asked(query_id, q) AS (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(ASKED))}),
    people AS (SELECT DISTINCT nconst, primaryname FROM name_basics),
    both_ AS (SELECT 'q' || query_id AS id, q AS t FROM asked UNION ALL SELECT nconst, primaryname FROM people),
    {_canonical_names("both_", "t", "id")},
    coded AS (SELECT DISTINCT id, k FROM (SELECT id, unnest([{_phonetic("name")}, {_phonetic("canonical")}, {_phonetic("string_split(canonical, ', ')[1]")}]) AS k FROM named WHERE name <> '') WHERE k IS NOT NULL)
    SELECT DISTINCT CAST(substr(a.id, 2) AS INTEGER) AS query_id, b.id AS nconst FROM coded a JOIN coded b ON a.k = b.k WHERE a.id LIKE 'q%' AND b.id NOT LIKE 'q%'""")
def person_block_or(spark: SparkSession, folder: str) -> DataFrame:
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")
    asked = search._all_keys(search.with_name_keys(queries, "query"), ["query_id"])
    known = search._all_keys(search.with_name_keys(table(spark, folder, "name_basics").select("nconst", "primaryname").distinct()), ["nconst"])
    return asked.join(known, "key").select("query_id", "nconst").distinct()


@query()
def title_search_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of all titles as queries, with their years as wishes, against all titles and alternate titles."""
    titles = table(spark, folder, "title_basics").select("tconst", "primarytitle", text.mapped_kind(F.col("titletype")).alias("titletype"), "startyear", "isadult").distinct()
    akas = table(spark, folder, "title_akas").select("titleid", "ordering", "title").distinct()
    return search.search_titles(_asked_titles(spark, folder), titles, akas, bound=None)


@query()
def person_search_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of all persons as queries against all persons."""
    queries = search.row_queries(table(spark, folder, "name_basics"), "nconst", "primaryname")
    return search.search_people(queries, table(spark, folder, "name_basics").select("nconst", "primaryname").distinct())


@query(f"""WITH {_WANTED_SQL}, {_TITLES_SQL}, {_AKAS_SQL},
    hits AS (SELECT tconst AS id, primarytitle AS t, 0 AS source, 0 AS seq, query FROM wanted JOIN titles ON k = t_soundex UNION ALL SELECT titleid, title, 1, ordering, query FROM wanted JOIN akas ON k = t_soundex),
    scored AS (SELECT *, CASE WHEN lower(t) = lower(query) THEN 1.0 ELSE CAST(least(length(t), length(query)) AS DOUBLE) / greatest(length(t), length(query)) END AS score FROM hits)
    SELECT id, max(score) AS score FROM scored WHERE score >= 0.6 GROUP BY id""")
def union_hits_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    titles = search.with_title_key(table(spark, folder, "title_basics").select("tconst", "primarytitle"), "primarytitle")
    akas = search.with_title_key(table(spark, folder, "title_akas").select("titleid", "ordering", "title"), "title")
    a = search.candidates(_wanted(spark), titles, "primarytitle", "tconst").select("query", F.col("tconst").alias("id"), F.col("primarytitle").alias("t"), F.lit(0).alias("source"), F.lit(0).alias("seq"))
    b = search.candidates(_wanted(spark), akas, "title", "titleid").select("query", F.col("titleid").alias("id"), F.col("title").alias("t"), F.lit(1).alias("source"), F.col("ordering").alias("seq"))
    lengths = F.least(F.length("t"), F.length("query")).cast("double") / F.greatest(F.length("t"), F.length("query"))
    scored = a.unionByName(b).withColumn("score", F.when(F.lower("t") == F.lower("query"), 1.0).otherwise(lengths)).filter("score >= 0.6")
    return search.best_score_per_id(scored).select("id", "score")


# ---------------------------------------------------------------- searches of a twentieth of all rows


def _row_queries_sql(name: str, key: str, query: str, year: str) -> str:
    number = f"TRY_CAST(substr({key}, 3) AS BIGINT)"
    return f"(SELECT {key} AS query_id, {query} AS query, {year} AS query_year FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {query} NULLS FIRST, {year} NULLS FIRST) AS nr FROM {name} WHERE {number} % 20 = 0 OR {number} % 40 = 1) WHERE nr = 1)"


_ROWS_SQL = f"rows_ AS {_row_queries_sql('title_basics', 'tconst', 'primarytitle', 'startyear')}, asked AS (SELECT *, {_phonetic('b')} AS k FROM (SELECT *, {_strip('query')} AS b FROM rows_))"


#: Queries up to which they are broadcast (about 100 bytes each), so that no key's pairs are one task's.
MOST_ASKED = 500_000


@query(f"""WITH {_ROWS_SQL}, {_TITLES_SQL}, {_AKAS_SQL},
    texts AS (SELECT DISTINCT tconst AS id, primarytitle AS t, t_soundex FROM titles UNION SELECT titleid, title, t_soundex FROM akas),
    scored AS (SELECT query_id, id, CASE WHEN lower(t) = lower(query) THEN 1.0 ELSE CAST(least(length(t), length(query)) AS DOUBLE) / greatest(length(t), length(query)) END AS score FROM asked JOIN texts ON k = t_soundex)
    SELECT query_id, id, max(score) AS score FROM scored WHERE score >= 0.6 GROUP BY 1, 2""")
def batch_fuzzy_join(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of all titles against all titles and alternate titles by key, with the stand-in score; ``no_key_exact`` has the texts without a key."""
    titles = table(spark, folder, "title_basics").select(F.col("tconst").alias("id"), F.col("primarytitle").alias("t"))
    akas = table(spark, folder, "title_akas").select(F.col("titleid").alias("id"), F.col("title").alias("t"))
    # written, as a filter on the key would otherwise compute it once more
    rows = session.cut(search.with_title_key(titles.unionByName(akas), "t").select("id", "t_soundex", F.lower("t").alias("low"), F.length("t").alias("n")), "titles-keyed").filter("t_soundex is not null")
    asked = _asked_titles(spark, folder).select("query_id", keys.title_key(F.col("query")).alias("t_soundex"), F.lower("query").alias("low"), F.length("query").alias("n")).filter("t_soundex is not null")
    # equal texts have equal lengths, unless lower case is longer than the text; so only these queries need their text, the others of a key and a length are one row
    longer = rows.filter(F.length("low") != F.col("n")).select("low", F.lit(True).alias("met")).distinct()
    asked = asked.join(longer, "low", "left").withColumn("low", F.when(F.col("met") | (F.length("low") != F.col("n")), F.col("low")))
    asked = session.cut(asked.groupBy("t_soundex", "low", "n").agg(F.collect_list("query_id").alias("query_ids")), "asked-titles")
    if (asked.agg(F.sum(F.size("query_ids"))).first()[0] or 0) <= MOST_ASKED:
        asked = F.broadcast(asked)
    # a query has one key, so an id's texts of a key meet it in one row, and what is joined need not be grouped again; a number of
    # its own keeps adaptive execution from putting few texts, which make many pairs, into few tasks
    known = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "t_soundex").groupBy("id", "t_soundex")
    known = known.agg(F.collect_set("n").alias("lengths"), F.collect_set("low").alias("lows")).sortWithinPartitions("t_soundex")
    closest = F.array_max(F.transform("lengths", lambda n: F.least(n, F.col("n")).cast("double") / F.greatest(n, F.col("n"))))
    score = F.when(F.array_contains("lows", F.col("low")), 1.0).otherwise(closest)
    # scored once for all queries of a length, and only then a row for each
    met = known.join(asked, "t_soundex").select("id", "query_ids", score.alias("score")).filter("score >= 0.6")
    return met.select(F.explode("query_ids").alias("query_id"), "id", "score")


@query(f"""WITH {_ROWS_SQL}, {_TITLES_SQL}, hits AS (SELECT DISTINCT query_id, query_year, tconst, startyear FROM asked JOIN titles ON k = t_soundex AND lower(primarytitle) = lower(query)),
    met AS (SELECT *, bool_or(coalesce(query_year = startyear, false)) OVER (PARTITION BY query_id) AS any_met FROM hits)
    SELECT query_id, tconst, startyear FROM met WHERE NOT any_met OR startyear = query_year""")
def year_relax(spark: SparkSession, folder: str) -> DataFrame:
    """Titles with the text of a twentieth of all titles: those of its year if there are any, else of all years."""
    rows = search.with_title_key(table(spark, folder, "title_basics").select("tconst", "primarytitle", "startyear").distinct(), "primarytitle")
    hits = search.candidates(_asked_titles(spark, folder), rows, "primarytitle", "tconst").filter("t_soundex is not null").filter(F.lower("primarytitle") == F.lower("query"))
    return search.year_relaxed(hits.withColumn("title_year", F.col("startyear"))).select("query_id", "tconst", "startyear").distinct()


@query(f"""WITH rows_ AS {_row_queries_sql("name_basics", "nconst", "primaryname", "NULL")},
    both_ AS (SELECT 'q' || query_id AS id, query AS t FROM rows_ UNION ALL SELECT DISTINCT nconst, primaryname FROM name_basics),
    {_canonical_names("both_", "t", "id")},
    coded AS (SELECT DISTINCT id, k FROM (SELECT id, unnest([{_phonetic("name")}, {_phonetic("canonical")}, {_phonetic("string_split(canonical, ', ')[1]")}]) AS k FROM named WHERE name <> '') WHERE k IS NOT NULL)
    SELECT DISTINCT substr(a.id, 2) AS query_id, b.id AS nconst FROM coded a JOIN coded b ON a.k = b.k WHERE a.id LIKE 'q%' AND b.id NOT LIKE 'q%'""")
def batch_person_block(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of all persons against all persons by any of three keys."""
    names = table(spark, folder, "name_basics")
    asked = search._all_keys(search.with_name_keys(search.row_queries(names, "nconst", "primaryname"), "query"), ["query_id"])
    known = search._all_keys(search.with_name_keys(names.select("nconst", "primaryname").distinct()), ["nconst"])
    return asked.join(known, "key").select("query_id", "nconst").distinct()


# ---------------------------------------------------------------- series and episodes

_EPISODES = "episodes AS (SELECT DISTINCT tconst, parenttconst, seasonnumber, episodenumber FROM title_episode)"
_EP_KEY = "CASE WHEN episodenumber IS NOT NULL AND row_number() OVER (PARTITION BY parenttconst, seasonnumber, episodenumber ORDER BY tconst) = 1 THEN CAST(episodenumber AS VARCHAR) ELSE tconst END AS episode_key"


def _episodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_episode").select("tconst", "parenttconst", "seasonnumber", "episodenumber").distinct()


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_basics").select("tconst", "titletype", "primarytitle", "startyear").distinct()


def _ratings(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.first_per_key(table(spark, folder, "title_ratings").select("tconst", "averagerating", "numvotes"), "tconst", [F.col("numvotes").desc_nulls_last(), F.col("averagerating").desc_nulls_last()])


_RATINGS_SQL = "ratings AS (SELECT tconst, averagerating, numvotes FROM title_ratings QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY numvotes DESC NULLS LAST, averagerating DESC NULLS LAST) = 1)"
_BASICS_SQL = "basics AS (SELECT DISTINCT tconst, titletype, primarytitle, startyear FROM title_basics)"


@query(f"""WITH {_EPISODES}, {_BASICS_SQL}, {_RATINGS_SQL} SELECT e.tconst, e.parenttconst, e.seasonnumber, e.episodenumber, b.titletype AS title_titletype, b.primarytitle AS title_primarytitle, b.startyear AS title_startyear,
    r.averagerating AS rating_averagerating, r.numvotes AS rating_numvotes, coalesce(CAST(seasonnumber AS VARCHAR), 'unknown season') AS season_key, {_EP_KEY.replace("parenttconst", "e.parenttconst").replace("ORDER BY tconst", "ORDER BY e.tconst").replace("ELSE tconst", "ELSE e.tconst")}
    FROM episodes e LEFT JOIN basics b ON e.tconst = b.tconst LEFT JOIN ratings r ON e.tconst = r.tconst""")
def episodes_left_join(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.episodes(_episodes(spark, folder), _titles(spark, folder), _ratings(spark, folder))


@query(f"WITH {_EPISODES} SELECT tconst, parenttconst, seasonnumber FROM episodes WHERE seasonnumber IN (1, 2) OR seasonnumber IS NULL")
def season_select(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.episodes(_episodes(spark, folder), _titles(spark, folder), _ratings(spark, folder), seasons=[1, "2", lookup.UNKNOWN_SEASON]).select("tconst", "parenttconst", "seasonnumber")


@query(f"WITH {_EPISODES} SELECT tconst, parenttconst, coalesce(CAST(seasonnumber AS VARCHAR), 'unknown season') AS season_key, {_EP_KEY} FROM episodes")
def episode_key_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.keyed_episodes(_episodes(spark, folder)).select("tconst", "parenttconst", "season_key", "episode_key")


@query(f"WITH {_EPISODES}, s AS (SELECT DISTINCT parenttconst, seasonnumber FROM episodes) SELECT parenttconst, seasonnumber, CAST(row_number() OVER (PARTITION BY parenttconst ORDER BY seasonnumber NULLS LAST) AS INTEGER) AS pos FROM s")
def season_sort(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.numbered(_episodes(spark, folder).select("parenttconst", "seasonnumber").distinct(), ["parenttconst"], ordering.season_order())


@query(f"""WITH {_EPISODES}, k AS (SELECT *, {_EP_KEY} FROM episodes), n AS (SELECT *, regexp_full_match(episode_key, '[0-9]+') AS num FROM k)
    SELECT parenttconst, tconst, CAST(row_number() OVER (PARTITION BY parenttconst ORDER BY seasonnumber NULLS LAST, NOT num, CASE WHEN num THEN episodenumber END NULLS LAST, episode_key) AS INTEGER) AS pos FROM n""")
def episode_sort(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.numbered(lookup.keyed_episodes(_episodes(spark, folder)), ["parenttconst"], ordering.episode_order()).select("parenttconst", "tconst", "pos")


@query(f"WITH {_EPISODES} SELECT parenttconst, count(*) AS n FROM episodes GROUP BY 1")
def episode_count(spark: SparkSession, folder: str) -> DataFrame:
    return _episodes(spark, folder).groupBy("parenttconst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EPISODES}, {_BASICS_SQL} SELECT e.tconst, e.parenttconst, b.primarytitle, b.titletype, b.startyear FROM episodes e LEFT JOIN basics b ON e.parenttconst = b.tconst")
def parent_of_episode(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.parents(_episodes(spark, folder), _titles(spark, folder))


@query(f"WITH {_BASICS_SQL}, {_RATINGS_SQL} SELECT b.tconst, b.primarytitle, averagerating, numvotes FROM basics b LEFT JOIN ratings r ON b.tconst = r.tconst")
def ratings_left(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.rated(_titles(spark, folder).select("tconst", "primarytitle"), table(spark, folder, "title_ratings").select("tconst", "averagerating", "numvotes"))


# ---------------------------------------------------------------- people


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "name_basics").select("nconst", "primaryname", "birthyear", "deathyear", "primaryprofession", "knownfortitles").distinct()


_PEOPLE = "people AS (SELECT DISTINCT nconst, primaryname FROM name_basics)"
_PRINCIPALS = "principals AS (SELECT DISTINCT tconst, ordering, nconst, CASE WHEN category IN ('actor', 'actress', 'self') THEN 'cast' ELSE nullif(category, '') END AS category, job, characters FROM title_principals)"


def _principals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_principals").withColumn("category", lookup.category()).select("tconst", "ordering", "nconst", "category", "job", "characters").distinct()


@query(f"""WITH {_PEOPLE}, {_PRINCIPALS} SELECT tconst, category, nconst, primaryname, characters, CAST(row_number() OVER (PARTITION BY tconst, category ORDER BY ordering NULLS FIRST, nconst, primaryname NULLS FIRST, characters NULLS FIRST, job NULLS FIRST) AS INTEGER) AS pos
    FROM principals LEFT JOIN people USING (nconst) WHERE category IS NOT NULL AND nconst IS NOT NULL""")
def cast_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """Credits of every title by category, in billing order; a row each, as a title may hold any number."""
    people = _people(spark, folder).select("nconst", "primaryname").distinct()
    found = _principals(spark, folder).filter("category is not null and nconst is not null").join(people, "nconst", "left")
    order = [F.col("ordering"), F.col("nconst"), F.col("primaryname"), F.col("characters"), F.col("job")]
    return ordering.numbered(found, ["tconst", "category"], order).select("tconst", "category", "nconst", "primaryname", "characters", "pos")


@query("SELECT tconst, category, count(*) AS n, min(ordering) AS first_ordering FROM (SELECT DISTINCT tconst, ordering, nconst, CASE WHEN category IN ('actor', 'actress', 'self') THEN 'cast' ELSE nullif(category, '') END AS category FROM title_principals) WHERE category IS NOT NULL AND nconst IS NOT NULL GROUP BY 1, 2")
def credits_per_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = _principals(spark, folder).select("tconst", "ordering", "nconst", "category").distinct().filter("category is not null and nconst is not null")
    return rows.groupBy("tconst", "category").agg(F.count(F.lit(1)).alias("n"), F.min("ordering").alias("first_ordering"))


@query(f"""WITH {_PEOPLE}, crew AS (SELECT DISTINCT tconst, writers FROM title_crew), items AS (SELECT tconst, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS nconst FROM (SELECT tconst, {_list("writers")} AS l FROM crew WHERE writers IS NOT NULL))
    SELECT tconst, pos, nconst, primaryname FROM items LEFT JOIN people USING (nconst) WHERE nconst <> ''""")
def crew_explode(spark: SparkSession, folder: str) -> DataFrame:
    crew = table(spark, folder, "title_crew").select("tconst", "writers").distinct()
    return lookup.listed_people(crew, _people(spark, folder).select("nconst", "primaryname").distinct(), "writers")


@query(f"""WITH {_BASICS_SQL}, t AS (SELECT DISTINCT tconst, primarytitle, startyear FROM basics), p AS (SELECT DISTINCT nconst, knownfortitles FROM name_basics),
    items AS (SELECT nconst, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS tconst FROM (SELECT nconst, {_list("knownfortitles")} AS l FROM p WHERE knownfortitles IS NOT NULL))
    SELECT nconst, pos, tconst, primarytitle, startyear FROM items LEFT JOIN t USING (tconst) WHERE tconst <> ''""")
def known_for_explode(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.known_for(_people(spark, folder).select("nconst", "knownfortitles").distinct(), _titles(spark, folder))


@query(f"""WITH {_PEOPLE} SELECT nconst, primaryname FROM people WHERE nconst IN (SELECT nconst FROM title_principals)""")
def membership_semi(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.contained(_people(spark, folder).select("nconst", "primaryname").distinct(), table(spark, folder, "title_principals"))


@query(f"""SELECT titleid, ordering, nullif(title, '') AS title, nullif(region, '') AS region, nullif(language, '') AS language, array_to_string({_list("nullif(types, '')")}, '|') AS types, array_to_string({_list("nullif(attributes, '')")}, '|') AS attributes, CASE WHEN isoriginaltitle THEN true END AS original FROM title_akas""")
def akas_shape(spark: SparkSession, folder: str) -> DataFrame:
    shape = lookup.akas_shape(table(spark, folder, "title_akas"))
    return shape.withColumns({"types": F.array_join("types", "|"), "attributes": F.array_join("attributes", "|")})


@query(f"""WITH {_BASICS_SQL}, {_PEOPLE}, {_PRINCIPALS}, {_EPISODES}, {_RATINGS_SQL},
    crew AS (SELECT DISTINCT tconst, directors, writers FROM title_crew),
    listed AS (SELECT tconst, 'director' AS part, {_list("directors")} AS l FROM crew WHERE directors <> '' UNION ALL SELECT tconst, 'writer', {_list("writers")} FROM crew WHERE writers <> ''),
    staff AS (SELECT tconst, part, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS ref FROM listed)
    SELECT tconst, 'title' AS part, startyear AS pos, titletype AS ref, primarytitle AS value FROM basics
    UNION ALL SELECT tconst, part, pos, ref, primaryname FROM staff LEFT JOIN people ON ref = nconst WHERE ref <> ''
    UNION ALL SELECT tconst, category, ordering, nconst, primaryname FROM (SELECT DISTINCT tconst, category, ordering, nconst FROM principals WHERE category IS NOT NULL AND nconst IS NOT NULL) LEFT JOIN people USING (nconst)
    UNION ALL SELECT e.tconst, 'episode of', e.seasonnumber, e.parenttconst, b.primarytitle FROM episodes e LEFT JOIN basics b ON e.parenttconst = b.tconst
    UNION ALL SELECT tconst, 'rating', numvotes, NULL, CAST(averagerating AS VARCHAR) FROM ratings
    UNION ALL SELECT titleid, 'aka', ordering, region, title FROM (SELECT DISTINCT titleid, ordering, region, title FROM title_akas)""")
def title_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Everything known of every title, a row for each part, as a title may have any number of credits and other titles."""
    titles, people = _titles(spark, folder), _people(spark, folder).select("nconst", "primaryname").distinct()
    crew = table(spark, folder, "title_crew").select("tconst", "directors", "writers").distinct()
    row = lambda df, part, pos, ref, value, key="tconst": df.select(F.col(key).alias("tconst"), part.alias("part"), pos.cast("int").alias("pos"), ref.cast("string").alias("ref"), value.cast("string").alias("value"))
    staff = lambda field, part: row(lookup.listed_people(crew.filter(F.col(field) != ""), people, field), F.lit(part), F.col("pos"), F.col("nconst"), F.col("primaryname"))
    credited = _principals(spark, folder).filter("category is not null and nconst is not null").select("tconst", "category", "ordering", "nconst").distinct().join(people, "nconst", "left")
    seasons = _episodes(spark, folder).join(titles.select(F.col("tconst").alias("parenttconst"), "primarytitle"), "parenttconst", "left")
    akas = table(spark, folder, "title_akas").select("titleid", "ordering", "region", "title").distinct()
    parts = [
        row(titles, F.lit("title"), F.col("startyear"), F.col("titletype"), F.col("primarytitle")), staff("directors", "director"), staff("writers", "writer"),
        row(credited, F.col("category"), F.col("ordering"), F.col("nconst"), F.col("primaryname")), row(seasons, F.lit("episode of"), F.col("seasonnumber"), F.col("parenttconst"), F.col("primarytitle")),
        row(_ratings(spark, folder), F.lit("rating"), F.col("numvotes"), F.lit(None), F.col("averagerating")), row(akas, F.lit("aka"), F.col("ordering"), F.col("region"), F.col("title"), "titleid"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- orders


@query(f"WITH {_BASICS_SQL} SELECT tconst, titletype, CAST(row_number() OVER (PARTITION BY titletype ORDER BY coalesce(startyear, 0) DESC, primarytitle NULLS LAST, tconst DESC) AS INTEGER) AS pos FROM basics")
def movie_order(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.numbered(_titles(spark, folder), ["titletype"], ordering.title_order("startyear", "primarytitle")).select("tconst", "titletype", "pos")


@query(f"""WITH {_PEOPLE}, pr AS (SELECT DISTINCT tconst, ordering, nconst FROM title_principals WHERE nconst IS NOT NULL),
    j AS (SELECT tconst, ordering, nconst, primaryname FROM pr LEFT JOIN people USING (nconst)), {_canonical_names("j", "primaryname", "tconst, ordering, nconst")}
    SELECT tconst, nconst, ordering, CAST(row_number() OVER (PARTITION BY tconst ORDER BY nullif(ordering, 0) NULLS LAST, canonical NULLS LAST, nconst) AS INTEGER) AS pos FROM named""")
def people_order(spark: SparkSession, folder: str) -> DataFrame:
    people = _people(spark, folder).select("nconst", "primaryname").distinct()
    rows = table(spark, folder, "title_principals").filter("nconst is not null").select("tconst", "ordering", "nconst").distinct().join(people, "nconst", "left")
    named = rows.withColumn("canonical_name", text.canonical_name(F.col("primaryname")))
    return ordering.numbered(named, ["tconst"], ordering.people_order()).select("tconst", "nconst", "ordering", "pos")


# ---------------------------------------------------------------- texts, ids, output


@query(f"""WITH {_BASICS_SQL} SELECT tconst, CASE WHEN primarytitle <> '' THEN CASE WHEN k IN ('tv series', 'tv mini series') THEN '"' || primarytitle || '"' ELSE primarytitle END || ' (' || coalesce(CAST(startyear AS VARCHAR), '????') || ')'
    || CASE k WHEN 'tv movie' THEN ' (TV)' WHEN 'video movie' THEN ' (V)' WHEN 'tv mini series' THEN ' (mini)' WHEN 'video game' THEN ' (VG)' ELSE '' END ELSE '' END AS long_title FROM (SELECT *, {_KIND_SQL} AS k FROM basics)""")
def long_title(spark: SparkSession, folder: str) -> DataFrame:
    return _titles(spark, folder).select("tconst", text.build_title(F.col("primarytitle"), text.mapped_kind(F.col("titletype")), F.col("startyear"), F.lit(None).cast("string")).alias("long_title"))


@query(f"WITH {_BASICS_SQL} SELECT tconst, primarytitle AS title, startyear AS year FROM basics WHERE primarytitle <> ''")
def long_title_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Long titles of all titles, as films, built and taken apart again."""
    long = text.build_title(F.col("primarytitle"), F.lit("movie"), F.col("startyear"), F.lit(None).cast("string"))
    return _titles(spark, folder).filter("primarytitle <> ''").select("tconst", analyze_title(long).alias("t")).select("tconst", "t.title", "t.year")


@query("SELECT tconst, regexp_extract(url, '\\b(nm|tt|ch|co)([0-9]{7,8})\\b', 1) AS kind, regexp_extract(url, '\\b(nm|tt|ch|co)([0-9]{7,8})\\b', 2) AS id FROM (SELECT DISTINCT tconst, 'https://films.example/title/' || tconst || '/?ref=1' AS url FROM title_basics)")
def url_id_extract(spark: SparkSession, folder: str) -> DataFrame:
    url = F.concat(F.lit("https://films.example/title/"), F.col("tconst"), F.lit("/?ref=1"))
    return table(spark, folder, "title_basics").select("tconst").distinct().select("tconst", text.id_in_url(url).alias("u")).select("tconst", "u.kind", "u.id")


@query("SELECT DISTINCT tconst, 'tt' || lpad(CAST(CAST(substr(tconst, 3) AS BIGINT) AS VARCHAR), CAST(greatest(7, length(CAST(CAST(substr(tconst, 3) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') AS padded FROM title_basics")
def pad_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_basics").select("tconst").distinct().select("tconst", text.padded_id("tt", text.id_number(F.col("tconst"))).alias("padded"))


@query("SELECT tconst, ordering, nconst, CASE WHEN characters = '' THEN '' ELSE array_to_string(CAST(from_json(characters, '[\"VARCHAR\"]') AS VARCHAR[]), ' / ') END AS roles FROM title_principals WHERE characters IS NOT NULL")
def role_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_principals").filter("characters is not null").select("tconst", "ordering", "nconst", text.characters_text(F.col("characters")).alias("roles"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '_(.+?(?: \\([0-9?]{4}(?:/[IVXLCDM]+)?\\))?(?: \\(mini\\)| \\(TV\\)| \\(V\\)| \\(VG\\))?)_ \\(qv\\)', '\\1', 'g'), '#([^'']+?)# \\(qv\\)', '\\1', 'g'), '''([^'']+?)'' \\(qv\\)', '\\1', 'g')) AS digest FROM documents""")
def clear_refs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(text.clear_refs(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(string_split(text, '::')[1]) AS head, contains(text, '::') AS noted FROM documents")
def text_notes(spark: SparkSession, folder: str) -> DataFrame:
    parts = text.text_and_notes(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(parts["text"]).alias("head"), parts["notes"].isNotNull().alias("noted")).withColumn("noted", F.when(F.col("head").isNotNull(), F.col("noted")))


@query("""SELECT nconst, CASE WHEN t <> '' AND regexp_matches(t, '^[0-9]') THEN CASE WHEN split_part(t, ',', 1) <> '????' THEN split_part(t, ',', 1) ELSE '' END ELSE '' END AS date,
    CASE WHEN regexp_matches(t, '^[0-9]') THEN CASE WHEN contains(t, ',') THEN trim(regexp_replace(t, '^[^,]*,', '')) ELSE '' END ELSE t END AS notes
    FROM (SELECT DISTINCT nconst, coalesce(CAST(birthyear AS VARCHAR) || ', ', '') || primaryprofession AS t FROM name_basics WHERE primaryprofession IS NOT NULL)""")
def date_notes(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.concat(F.coalesce(F.concat(F.col("birthyear").cast("string"), F.lit(", ")), F.lit("")), F.col("primaryprofession"))
    rows = table(spark, folder, "name_basics").filter("primaryprofession is not null").select("nconst", joined.alias("t")).distinct()
    return rows.select("nconst", text.date_and_notes(F.col("t")).alias("d")).select("nconst", "d.date", "d.notes")


def _xml_sql(t: str) -> str:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("''", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


@query(f"""WITH {_BASICS_SQL} SELECT tconst, '<movie id="' || tconst || '"><title>' || {_xml_sql("coalesce(primarytitle, '')")} || '</title>' || coalesce('<kind>' || titletype || '</kind>', '') || coalesce('<year type="int">' || CAST(startyear AS VARCHAR) || '</year>', '') || '</movie>' AS xml FROM basics
    """)
def xml_row(spark: SparkSession, folder: str) -> DataFrame:
    rows = _titles(spark, folder)
    parts = [render.element("kind", F.col("titletype"), "string"), render.element("year", F.col("startyear"), "int")]
    return rows.select("tconst", render.container("movie", "title", F.col("tconst"), F.col("primarytitle"), parts).alias("xml"))


@query(f"WITH {_BASICS_SQL}, {_RATINGS_SQL} SELECT b.tconst, 'Movie' || chr(10) || '=====' || chr(10) || 'Title: ' || coalesce(primarytitle, '') || chr(10) || CASE WHEN averagerating > 0 THEN 'Rating: ' || CAST(averagerating AS VARCHAR) || CASE WHEN numvotes > 0 THEN ' (' || CAST(numvotes AS VARCHAR) || ' votes)' ELSE '' END || '.' || chr(10) ELSE '' END AS card FROM basics b LEFT JOIN ratings r ON b.tconst = r.tconst")
def summary_card(spark: SparkSession, folder: str) -> DataFrame:
    none: Column = F.lit(None)
    people = none.cast("array<struct<primaryname: string, roles: array<string>>>")
    rows = lookup.rated(_titles(spark, folder), table(spark, folder, "title_ratings").select("tconst", "averagerating", "numvotes"))
    return rows.select("tconst", render.title_card(F.col("primarytitle"), none.cast("array<string>"), people, people, people, none.cast("array<int>"), F.col("averagerating"), F.coalesce("numvotes", F.lit(0))).alias("card"))


@query(f"WITH {_BASICS_SQL} SELECT tconst, coalesce(primarytitle, '') || CASE WHEN startyear IS NOT NULL THEN ' [' || CAST(startyear AS VARCHAR) || ']' ELSE '' END AS line FROM basics")
def template_line(spark: SparkSession, folder: str) -> DataFrame:
    return _titles(spark, folder).select("tconst", text.template("%(title)s<if year> [%(year)s]</if year>", {"title": F.col("primarytitle"), "year": F.col("startyear")}).alias("line"))


# ---------------------------------------------------------------- loading


@query("SELECT file_name, count(*) AS n FROM raw_lines WHERE line_no > 1 GROUP BY 1")
def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_lines").filter("line_no > 1").groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_name, raw_id, line_no FROM (SELECT file_name, raw_id, line_no, count(*) OVER (PARTITION BY file_name) AS n, row_number() OVER (PARTITION BY file_name ORDER BY line_no, raw_id) AS nr FROM raw_lines) WHERE nr <= 20 OR nr > n - 20")
def head_tail_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first and last 20 lines of every archive; the limit is the feature."""
    raw = table(spark, folder, "raw_lines").select("file_name", "raw_id", "line_no")
    up = F.row_number().over(W.partitionBy("file_name").orderBy("line_no", "raw_id"))
    down = F.row_number().over(W.partitionBy("file_name").orderBy(F.desc("line_no"), F.desc("raw_id")))
    # each window keeps 20 rows per archive before the shuffle (window group limit)
    first = raw.withColumn("nr", up).filter("nr <= 20").drop("nr")
    last = raw.withColumn("nr", down).filter("nr <= 20").drop("nr")
    return first.unionAll(last).distinct()


@query("SELECT region, language, count(*) AS n FROM title_akas GROUP BY 1, 2")
def aka_languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_akas").groupBy("region", "language").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- computed keys and alternate titles

_LONG = "CASE WHEN {t} <> '' THEN CASE WHEN k IN ('tv series', 'tv mini series') THEN '\"' || {t} || '\"' ELSE {t} END || ' (' || coalesce(CAST(startyear AS VARCHAR), '????') || ')' || CASE k WHEN 'tv movie' THEN ' (TV)' WHEN 'video movie' THEN ' (V)' WHEN 'tv mini series' THEN ' (mini)' WHEN 'video game' THEN ' (VG)' ELSE '' END ELSE '' END"


@query(f"""WITH {_BASICS_SQL}, c AS (SELECT tconst, startyear, primarytitle AS title, {_canonical_title("primarytitle")} AS canonical_title, {_KIND_SQL} AS k FROM basics)
    SELECT tconst, title, canonical_title, {_LONG.format(t="title")} AS long_title, {_LONG.format(t="canonical_title")} AS long_canonical_title FROM c""")
def title_computed_keys(spark: SparkSession, folder: str) -> DataFrame:
    shown = _titles(spark, folder).select("tconst", F.col("primarytitle").alias("title"), text.mapped_kind(F.col("titletype")).alias("kind"), "startyear")
    return lookup.title_keys(shown).select("tconst", "title", "canonical_title", "long_title", "long_canonical_title")


@query(f"""WITH {_BASICS_SQL}, {_EPISODES}, k AS (SELECT e.tconst, e.parenttconst, b.primarytitle AS title, b.startyear, s.primarytitle AS series_title, CASE s.titletype {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE s.titletype END AS kind
      FROM episodes e JOIN basics b ON e.tconst = b.tconst JOIN basics s ON e.parenttconst = s.tconst WHERE b.primarytitle <> '')
    SELECT tconst, parenttconst, series_title, CASE WHEN kind IN ('tv series', 'tv mini series') THEN '"' || series_title || '"' ELSE series_title END || CASE kind WHEN 'tv movie' THEN ' (TV)' WHEN 'video movie' THEN ' (V)' WHEN 'tv mini series' THEN ' (mini)' WHEN 'video game' THEN ' (VG)' ELSE '' END
      || ' ' || title || ' (' || coalesce(CAST(startyear AS VARCHAR), '????') || ')' AS long_episode_title, {_canonical_title("series_title")} AS canonical_series_title FROM k""")
def episode_computed_keys(spark: SparkSession, folder: str) -> DataFrame:
    titles = _titles(spark, folder)
    series = titles.select(F.col("tconst").alias("parenttconst"), F.col("primarytitle").alias("series_title"), text.mapped_kind(F.col("titletype")).alias("series_kind"))
    rows = _episodes(spark, folder).select("tconst", "parenttconst", "seasonnumber", "episodenumber").join(titles.select("tconst", F.col("primarytitle").alias("title"), "startyear"), "tconst").join(series, "parenttconst").filter("title <> ''")
    return lookup.episode_keys(rows).select("tconst", "parenttconst", "series_title", "long_episode_title", "canonical_series_title")


@query(f"""WITH {_canonical_names("name_basics", "primaryname", "nconst")} SELECT DISTINCT nconst, name, canonical AS canonical_name,
    CASE WHEN len(string_split(name, ', ')) = 2 THEN string_split(name, ', ')[2] || ' ' || string_split(name, ', ')[1] ELSE name END AS normal_name FROM named""")
def person_computed_keys(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_basics").select("nconst", F.col("primaryname").alias("name")).distinct()
    return lookup.person_keys(names).select("nconst", "name", "canonical_name", "normal_name")


@query("SELECT titleid, ordering, title FROM title_akas WHERE lower(language) = 'de'")
def akas_in_language(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.akas_in_language(table(spark, folder, "title_akas"), "de").select("titleid", "ordering", "title")


@query()
def akas_by_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.akas_by_similarity(table(spark, folder, "title_akas"), _titles(spark, folder), "Der letzte Fluss", "de")


@query(f"WITH {_BASICS_SQL}, b AS (SELECT tconst, CASE WHEN primarytitle <> '' THEN primarytitle || ' (' || coalesce(CAST(startyear AS VARCHAR), '????') || ')' ELSE '' END AS t FROM basics) SELECT t AS long_title, count(*) AS n, min(tconst) AS first_tconst FROM b GROUP BY 1 HAVING count(*) > 1")
def same_long_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Long titles that several titles share, without making their pairs."""
    long = text.build_title(F.col("primarytitle"), F.lit("movie"), F.col("startyear"), F.lit(None).cast("string"))
    return _titles(spark, folder).select("tconst", long.alias("long_title")).groupBy("long_title").agg(F.count(F.lit(1)).alias("n"), F.min("tconst").alias("first_tconst")).filter("n > 1")


@query(f"WITH {_BASICS_SQL}, {_RATINGS_SQL} SELECT b.tconst, b.primarytitle, coalesce(r.numvotes, b.startyear) AS startyear FROM basics b LEFT JOIN ratings r ON b.tconst = r.tconst")
def merged_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records updated from another relation: the newer value where there is one."""
    newer = _ratings(spark, folder).select("tconst", F.col("numvotes").alias("startyear"))
    return lookup.merged(_titles(spark, folder).select("tconst", "primarytitle", "startyear"), newer, "tconst")
