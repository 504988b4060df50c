"""Queries of texts in the catalogue's notations, of records and of loading, over whole tables, and their SQL.

The tables hold no long titles, references, notes or addresses, so these are built from their columns by the notation; the SQL
states what has to come out of them, from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import session
from reelgrid.functions import linguistics, render, text
from reelgrid.functions.parse import analyze_title
from reelgrid.operators import lookup, ordering
from reelgrid.plans.catalogue import _BASICS_SQL, _EPISODES, _KIND_SQL, _PEOPLE, _RATINGS_SQL, _episodes, _list, _people, _ratings, _titles
from reelgrid.schema import ARCHIVES, TYPES, table_of
from reelgrid.session import table
from reelgrid.sources import archives

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if it has one."""

    def take(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


# ---------------------------------------------------------------- long titles

_NONE = "CAST(NULL AS VARCHAR) AS series_title, CAST(NULL AS VARCHAR) AS series_kind, CAST(NULL AS INTEGER) AS season, CAST(NULL AS INTEGER) AS episode, CAST(NULL AS VARCHAR) AS aired"
_OF = f"parts AS (SELECT e.tconst, e.parenttconst, e.seasonnumber, e.episodenumber, b.primarytitle AS title, b.startyear, s.primarytitle AS series, s.startyear AS series_year FROM episodes e JOIN basics b ON e.tconst = b.tconst JOIN basics s ON e.parenttconst = s.tconst)"


def _of_series(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes (tconst, parenttconst, seasonnumber, episodenumber, title, startyear) with their series (series, series_year), where both are known."""
    titles = _titles(spark, folder)
    mine, top = titles.select("tconst", F.col("primarytitle").alias("title"), "startyear"), titles.select(F.col("tconst").alias("parenttconst"), F.col("primarytitle").alias("series"), F.col("startyear").alias("series_year"))
    return _episodes(spark, folder).join(mine, "tconst").join(top, "parenttconst")


@query(f"""WITH {_BASICS_SQL}, {_EPISODES}, {_OF}, plain AS (SELECT tconst, primarytitle AS title, startyear AS year, CASE WHEN {_KIND_SQL} IN ('tv series', 'tv mini series', 'video game') THEN {_KIND_SQL} ELSE 'movie' END AS kind FROM basics)
    SELECT tconst, 'plain' AS notation, title, kind, year, CAST(NULL AS VARCHAR) AS roman_index, {_NONE} FROM plain
    UNION ALL SELECT tconst, 'index', title, kind, year, 'II', {_NONE} FROM plain
    UNION ALL SELECT tconst, 'behind', title, 'episode', startyear, NULL, series, 'tv series', NULL, NULL, NULL FROM parts
    UNION ALL SELECT tconst, 'braces', title, 'episode', NULL, NULL, series, 'tv series', coalesce(seasonnumber, 0), coalesce(episodenumber, 0), '1998-04-05' FROM parts
    UNION ALL SELECT tconst, 'number', '(#' || coalesce(seasonnumber, 0) || '.' || coalesce(episodenumber, 0) || ')', 'episode', NULL, NULL, series, 'tv series', coalesce(seasonnumber, 0), coalesce(episodenumber, 0), NULL FROM parts
    UNION ALL SELECT tconst, 'before', title, 'episode', startyear, NULL, series, 'movie', coalesce(seasonnumber, 0), coalesce(episodenumber, 0), NULL FROM parts""")
def title_notations(spark: SparkSession, folder: str) -> DataFrame:
    """Long titles of all titles and episodes in six notations, taken apart again."""
    no_index, films = F.lit(None).cast("string"), _titles(spark, folder).withColumn("kind", text.mapped_kind(F.col("titletype")))
    built = lambda index: text.build_title(F.col("primarytitle"), F.col("kind"), F.col("startyear"), index)
    parts = _of_series(spark, folder).withColumns({"s": F.coalesce("seasonnumber", F.lit(0)), "e": F.coalesce("episodenumber", F.lit(0))})
    year = lambda c: F.concat(F.lit(" ("), F.coalesce(F.col(c).cast("string"), F.lit("????")), F.lit(")"))
    record = lambda title, aired: text.build_episode_record(F.col("series"), F.col("series_year"), title, aired, F.col("s"), F.col("e"))
    before = F.concat("title", year("startyear"), F.lit(" (TV Episode) - Season "), "s", F.lit(" | Episode "), "e", F.lit(" - "), "series", year("series_year"))
    made = [
        (films, "plain", built(no_index)), (films, "index", built(F.lit("II"))), (parts, "behind", text.build_episode_title(F.col("series"), F.lit("tv series"), F.col("title"), F.col("startyear"), no_index)),
        (parts, "braces", record(F.col("title"), F.lit("1998-04-05"))), (parts, "number", F.concat(F.lit('"'), "series", F.lit('"'), year("series_year"), F.lit(" {(#"), "s", F.lit("."), "e", F.lit(")}"))), (parts, "before", before),
    ]
    rows = [df.select("tconst", F.lit(n).alias("notation"), long.alias("long")) for df, n, long in made]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionAll(r)
    return every.select("tconst", "notation", analyze_title(F.col("long")).alias("t")).select("tconst", "notation", "t.title", "t.kind", "t.year", "t.roman_index", "t.series_title", "t.series_kind", "t.season", "t.episode", "t.aired")


@query(f"""WITH {_BASICS_SQL}, {_EPISODES}, {_OF} SELECT tconst, 'braces' AS notation, true AS is_episode FROM parts UNION ALL SELECT tconst, 'behind', true FROM parts UNION ALL SELECT tconst, 'film', false FROM parts
    UNION ALL SELECT tconst, 'series', false FROM parts""")
def episode_test(spark: SparkSession, folder: str) -> DataFrame:
    """Which long titles are an episode's."""
    none = F.lit(None).cast("string")
    forms = F.array(
        F.struct(F.lit("braces").alias("n"), text.build_episode_record(F.col("series"), F.col("series_year"), F.col("title"), none, F.col("seasonnumber"), F.col("episodenumber")).alias("t")),
        F.struct(F.lit("behind").alias("n"), text.build_episode_title(F.col("series"), F.lit("tv series"), F.col("title"), F.col("startyear"), none).alias("t")),
        F.struct(F.lit("film").alias("n"), text.build_title(F.col("title"), F.lit("movie"), F.col("startyear"), none).alias("t")), F.struct(F.lit("series").alias("n"), text.build_title(F.col("series"), F.lit("tv series"), F.col("series_year"), none).alias("t")),
    )
    return _of_series(spark, folder).select("tconst", F.explode(forms).alias("f")).select("tconst", F.col("f.n").alias("notation"), text.is_series_episode(F.col("f.t")).alias("is_episode"))


@query("SELECT DISTINCT tconst, 'Episode dated ' || strftime(loaded_at, '%-d %B %Y') AS shown, '(' || strftime(loaded_at, '%Y-%m-%d') || ')' AS aired FROM title_basics")
def dated_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes called by a date, as text and back."""
    day = F.concat(F.lit("("), F.date_format("loaded_at", "yyyy-MM-dd"), F.lit(")"))
    return table(spark, folder, "title_basics").select("tconst", text.aired_as_text(day).alias("shown")).distinct().withColumn("aired", text.text_as_aired(F.col("shown")))


@query(f"""WITH {_BASICS_SQL}, {_EPISODES}, {_OF} SELECT tconst, parenttconst, seasonnumber, episodenumber, CAST(row_number() OVER (ORDER BY coalesce(series_year, 0) DESC, series NULLS LAST, parenttconst DESC NULLS FIRST, seasonnumber DESC NULLS LAST, episodenumber DESC NULLS LAST, title NULLS LAST, tconst DESC NULLS FIRST) AS INTEGER) AS pos FROM parts""")
def episodes_across_series(spark: SparkSession, folder: str) -> DataFrame:
    """All episodes in one order over all series; no task sorts them all."""
    rows = _of_series(spark, folder).select("tconst", "parenttconst", "seasonnumber", "episodenumber", "title", F.col("series").alias("series_title"), "series_year", F.lit(1).alias("all"))
    return ordering.numbered(rows, ["all"], ordering.series_episode_order()).select("tconst", "parenttconst", "seasonnumber", "episodenumber", "pos")


@query("SELECT tconst, runtimeminutes, CAST(row_number() OVER (PARTITION BY runtimeminutes ORDER BY primarytitle NULLS LAST, country NULLS LAST, tconst NULLS LAST) AS INTEGER) AS pos FROM (SELECT DISTINCT tconst, runtimeminutes, primarytitle, CASE WHEN isadult THEN 'x' END AS country FROM title_basics)")
def companies_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order of companies (name, country, id), over titles in their place."""
    rows = table(spark, folder, "title_basics").select("runtimeminutes", F.col("primarytitle").alias("name"), F.when(F.col("isadult"), "x").alias("country"), F.col("tconst").alias("company_id")).distinct()
    return ordering.numbered(rows, ["runtimeminutes"], ordering.company_order()).select(F.col("company_id").alias("tconst"), "runtimeminutes", "pos")


# ---------------------------------------------------------------- names and companies


@query("SELECT DISTINCT nconst, primaryname AS name, 'II' AS roman_index, primaryname || ' (II)' AS long_name FROM name_basics WHERE primaryname <> ''")
def name_notations(spark: SparkSession, folder: str) -> DataFrame:
    """Names with an index, built, with other names behind, and taken apart."""
    names = _people(spark, folder).select("nconst", text.build_name(F.col("primaryname"), F.lit("II")).alias("long_name")).distinct()
    return names.withColumn("n", text.analyze_name(F.concat("long_name", F.lit(" aka Someone")))).filter("n is not null").select("nconst", "n.name", "n.roman_index", "long_name")


@query(f"WITH {_BASICS_SQL} SELECT tconst, primarytitle AS name, '[' || coalesce(titletype, 'us') || ']' AS country, '(' || coalesce(startyear, 0) || ') (TV)' AS notes FROM basics WHERE primarytitle <> ''")
def company_notations(spark: SparkSession, folder: str) -> DataFrame:
    """Companies called like titles, with country and notes, built and taken apart."""
    long = text.build_company(F.col("primarytitle"), F.concat(F.lit("["), F.coalesce("titletype", F.lit("us")), F.lit("]")))
    noted = F.concat(long, F.lit(" ("), F.coalesce("startyear", F.lit(0)).cast("string"), F.lit(") (TV)"))
    split = _titles(spark, folder).filter("primarytitle <> ''").select("tconst", text.split_company_notes(noted).alias("s"))
    return split.select("tconst", "s.notes", text.analyze_company(F.col("s.name")).alias("c")).select("tconst", "c.name", "c.country", "notes")


# ---------------------------------------------------------------- markup, notes, dates, ids, addresses

@query(f"""WITH {_BASICS_SQL} SELECT tconst, regexp_replace('Like ' || primarytitle || ' (' || coalesce(CAST(startyear AS VARCHAR), '????') || '), #' || coalesce(titletype, '') || '# (qv) by ' || tconst || ' is _real_.', '#([^'']+?)# \\(qv\\)', '\\1', 'g') AS cleared FROM basics WHERE primarytitle IS NOT NULL""")
def refs_cleared(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that refer to a title, a character and a person, without the marks."""
    year = F.coalesce(F.col("startyear").cast("string"), F.lit("????"))
    marked = F.concat(F.lit("Like _"), "primarytitle", F.lit(" ("), year, F.lit(")_ (qv), #"), F.coalesce("titletype", F.lit("")), F.lit("# (qv) by '"), "tconst", F.lit("' (qv) is _real_."))
    return _titles(spark, folder).filter("primarytitle is not null").select("tconst", text.clear_refs(marked).alias("cleared"))


@query(f"WITH {_BASICS_SQL} SELECT tconst, primarytitle AS head, coalesce(titletype, '') || '::' || tconst AS notes, primarytitle || '<notes>' || coalesce(titletype, '') || '::' || tconst || '</notes>' AS tagged FROM basics WHERE primarytitle IS NOT NULL")
def notes_split(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with notes behind the mark, split and as a tag."""
    noted = F.concat("primarytitle", F.lit("::"), F.coalesce("titletype", F.lit("")), F.lit("::"), "tconst")
    parts = text.text_and_notes(noted)
    return _titles(spark, folder).filter("primarytitle is not null").select("tconst", parts["text"].alias("head"), parts["notes"].alias("notes"), text.notes_as_xml(noted).alias("tagged"))


_MONTHS = text.DATE_WORDS[1:13]


@query(f"""WITH p AS (SELECT DISTINCT nconst, coalesce(birthyear, 1900) AS y, coalesce(primaryprofession, 'x') AS n FROM name_basics)
    SELECT nconst, CASE y % 5 WHEN 0 THEN '12 ' || m || ' ' || y WHEN 1 THEN m || ' ' || y WHEN 2 THEN 'circa ' || y ELSE '' END AS date, CASE y % 5 WHEN 4 THEN n || ', ' || y ELSE trim(n) END AS notes
    FROM (SELECT *, [{", ".join(f"'{m.title()}'" for m in _MONTHS)}][y % 12 + 1] AS m FROM p)""")
def dates_split(spark: SparkSession, folder: str) -> DataFrame:
    """Birth texts that begin with a day, a month, a guess, an unknown date, or none, split into date and notes."""
    rows = table(spark, folder, "name_basics").select("nconst", F.coalesce("birthyear", F.lit(1900)).alias("y"), F.coalesce("primaryprofession", F.lit("x")).alias("n")).distinct()
    month = F.get(F.array(*[F.lit(m.title()) for m in _MONTHS]), F.col("y") % 12)
    head = F.when(F.col("y") % 5 == 0, F.concat(F.lit("12 "), month, F.lit(" "), "y")).when(F.col("y") % 5 == 1, F.concat(month, F.lit(" "), "y")).when(F.col("y") % 5 == 2, F.concat(F.lit("circa "), "y")).when(F.col("y") % 5 == 3, "????")
    told = F.when(head.isNull(), F.concat("n", F.lit(", "), "y")).otherwise(F.concat(head, F.lit(", "), "n"))
    return rows.select("nconst", text.date_and_notes(told).alias("d")).select("nconst", "d.date", "d.notes")


@query("SELECT DISTINCT nconst, regexp_replace(knownfortitles, '(^|[^0-9a-zA-Z])(nm|tt)([0-9])', '\\1\\3', 'g') AS ids FROM name_basics")
def id_lists(spark: SparkSession, folder: str) -> DataFrame:
    return _people(spark, folder).select("nconst", text.bare_ids(F.col("knownfortitles")).alias("ids")).distinct()


@query("""SELECT DISTINCT tconst, 'https://pictures.example/images/M/' || tconst || '@.jpg' AS full_size, 'https://pictures.example/images/M/' || tconst || '@._V1_SX30_SY40_CR0,1,30,40_.jpg' AS sized, 'https://pictures.example/images/M/' || tconst || '.jpg' AS full_plain FROM title_basics""")
def picture_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of pictures at full and at a given size."""
    at = F.concat(F.lit("https://pictures.example/images/M/"), "tconst", F.lit("@._V1_SX3_.jpg"))
    plain = F.concat(F.lit("https://pictures.example/images/M/"), "tconst", F.lit("._V1_.jpg"))
    return table(spark, folder, "title_basics").select("tconst").distinct().select("tconst", text.full_size_url(at).alias("full_size"), text.sized_url(at, 30, 40, ("0", "1", "30", "40")).alias("sized"), text.full_size_url(plain).alias("full_plain"))


_COUNTRIES = sorted(linguistics.language_of_countries())


@query(f"""WITH n AS (SELECT DISTINCT tconst, TRY_CAST(substr(tconst, 3) AS BIGINT) AS k FROM title_basics)
    SELECT tconst, CASE WHEN k % 7 = 0 THEN 'Klingon' ELSE [{", ".join("'" + linguistics.language_of_countries()[c].replace("'", "''") + "'" for c in _COUNTRIES)}][k % {len(_COUNTRIES)} + 1] END AS language FROM n""")
def languages_of_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The language of titles that name one, else of their country."""
    rows = table(spark, folder, "title_basics").select("tconst", text.id_number(F.col("tconst")).alias("k")).distinct()
    country = F.get(F.array(*[F.lit(c) for c in _COUNTRIES]), (F.col("k") % len(_COUNTRIES)).cast("int"))
    return rows.select("tconst", text.language_of(F.when(F.col("k") % 7 == 0, F.array(F.lit("Klingon"))), F.array(country)).alias("language"))


@query(f"""WITH {_BASICS_SQL} SELECT tconst, '<movie id="' || tconst || '"><title>' || replace(replace(replace(replace(replace(primarytitle, '&', '&amp;'), '"', '&quot;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;') || ' &amp; &lt;b&gt;Co&lt;/b&gt; &quot;Ltd&quot;<notes>' || coalesce(titletype, '') || '</notes></title>' ||
    '<genres><item>a</item><item>&lt;b&gt;</item></genres>' || coalesce('<year type="int">' || CAST(startyear AS VARCHAR) || '</year>', '') || '</movie>' AS xml FROM basics WHERE primarytitle IS NOT NULL""")
def xml_escaped(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose titles hold signs that XML has to escape, and notes."""
    title = F.concat("primarytitle", F.lit(' & <b>Co</b> "Ltd"::'), F.coalesce("titletype", F.lit("")))
    parts = [render.element("genres", F.array(F.lit("a"), F.lit("<b>")), "array<string>"), render.element("year", F.col("startyear"), "int")]
    return _titles(spark, folder).filter("primarytitle is not null").select("tconst", render.container("movie", "title", F.col("tconst"), title, parts).alias("xml"))


# ---------------------------------------------------------------- whole records

_SHAPE = f"""shaped AS (SELECT DISTINCT tconst, titletype AS kind, primarytitle AS title, nullif(coalesce(CAST(nullif(startyear, 0) AS VARCHAR), '') || CASE WHEN endyear > 0 THEN '-' || CAST(endyear AS VARCHAR) ELSE '' END, '') AS year,
      list_filter({_list("lower(coalesce(genres, ''))")}, lambda g: g <> '') AS g, nullif(runtimeminutes, 0) AS runtime FROM title_basics)"""
_STAFF = f"""staff AS (SELECT tconst, part, string_agg(ref || '=' || coalesce(primaryname, ''), '|' ORDER BY pos) AS people, string_agg(coalesce(primaryname, ''), ', ' ORDER BY pos) AS names FROM
      (SELECT tconst, part, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS ref FROM (SELECT tconst, 'directors' AS part, {_list("directors")} AS l FROM (SELECT DISTINCT tconst, directors FROM title_crew) UNION ALL SELECT tconst, 'writers', {_list("writers")} FROM (SELECT DISTINCT tconst, writers FROM title_crew)) WHERE l IS NOT NULL)
      LEFT JOIN people ON ref = nconst WHERE ref <> '' GROUP BY ALL)"""
_CAST = """cast_ AS (SELECT tconst, category, string_agg(nconst || '=' || coalesce(primaryname, ''), '|' ORDER BY ordering NULLS FIRST, nconst, primaryname NULLS FIRST) AS people FROM
      (SELECT tconst, ordering, nconst, CASE WHEN category IN ('actor', 'actress', 'self') THEN 'cast' ELSE nullif(category, '') END AS category FROM (SELECT DISTINCT tconst, ordering, nconst, category, job, characters FROM title_principals)) LEFT JOIN people USING (nconst) WHERE category IS NOT NULL AND nconst IS NOT NULL GROUP BY ALL),
    credits AS (SELECT tconst, string_agg(category || ':' || people, ';' ORDER BY category) AS people FROM cast_ GROUP BY ALL),
    other AS (SELECT titleid AS tconst, string_agg(coalesce(CAST(ordering AS VARCHAR), '') || '=' || coalesce(nullif(title, ''), ''), '|' ORDER BY ordering NULLS FIRST, nullif(title, '') NULLS FIRST) AS akas FROM (SELECT DISTINCT titleid, ordering, title FROM title_akas) GROUP BY ALL),
    top AS (SELECT e.tconst, e.parenttconst || '=' || coalesce(b.primarytitle, '') AS episode_of FROM (SELECT tconst, min(parenttconst) AS parenttconst FROM title_episode GROUP BY ALL) e LEFT JOIN basics b ON e.parenttconst = b.tconst)"""


@query(f"""WITH {_BASICS_SQL}, {_PEOPLE}, {_RATINGS_SQL}, {_SHAPE}, {_STAFF}, {_CAST}
    SELECT s.tconst, title, kind, year, array_to_string(g, '|') AS genres, CAST(runtime AS VARCHAR) AS runtimes, d.people AS directors, w.people AS writers, c.people AS people, episode_of, akas, averagerating, numvotes
    FROM shaped s LEFT JOIN staff d ON s.tconst = d.tconst AND d.part = 'directors' LEFT JOIN staff w ON s.tconst = w.tconst AND w.part = 'writers' LEFT JOIN credits c ON s.tconst = c.tconst LEFT JOIN top ON s.tconst = top.tconst LEFT JOIN other o ON s.tconst = o.tconst LEFT JOIN ratings r ON s.tconst = r.tconst""")
def title_detail(spark: SparkSession, folder: str) -> DataFrame:
    """The record of every title with its lists as texts."""
    one = lambda name: table(spark, folder, name).drop("loaded_at").distinct()
    titles, people = one("title_basics"), one("name_basics").select("nconst", "primaryname").distinct()
    ids = table(spark, folder, "title_basics").select("tconst").distinct()
    found = lookup.title_detail(ids, titles, one("title_crew"), one("title_episode"), one("title_principals"), people, one("title_ratings"), one("title_akas"))
    pair = lambda a, b: F.concat(F.coalesce(a.cast("string"), F.lit("")), F.lit("="), F.coalesce(b, F.lit("")))
    persons = lambda c: F.array_join(F.transform(c, lambda p: pair(p["nconst"], p["primaryname"])), "|")
    credits = F.array_join(F.transform(F.map_entries("people"), lambda e: F.concat(e["key"], F.lit(":"), persons(e["value"]))), ";")
    akas = F.array_join(F.transform("akas", lambda a: pair(a["ordering"], a["title"])), "|")
    series = F.when(F.col("episode_of.parenttconst").isNotNull(), pair(F.col("episode_of.parenttconst"), F.col("episode_of.primarytitle")))
    return found.select("tconst", "title", "kind", "year", F.array_join("genres", "|").alias("genres"), F.get("runtimes", F.lit(0)).cast("string").alias("runtimes"), persons("directors").alias("directors"), persons("writers").alias("writers"), credits.alias("people"), series.alias("episode_of"), akas.alias("akas"), "averagerating", "numvotes")


@query(f"""WITH {_BASICS_SQL}, p AS (SELECT DISTINCT nconst, primaryname, birthyear, deathyear, primaryprofession, knownfortitles FROM name_basics),
    k AS (SELECT nconst, string_agg(ref || '=' || coalesce(b.primarytitle, ''), '|' ORDER BY pos) AS known_for FROM (SELECT nconst, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS ref FROM (SELECT nconst, {_list("knownfortitles")} AS l FROM p) WHERE l IS NOT NULL) LEFT JOIN basics b ON ref = b.tconst WHERE ref <> '' GROUP BY ALL)
    SELECT p.nconst, nullif(primaryname, '') AS name, birthyear, deathyear, nullif(primaryprofession, '') AS profession, known_for FROM p LEFT JOIN k USING (nconst)""")
def person_detail(spark: SparkSession, folder: str) -> DataFrame:
    """The record of every person with the titles they are known for as text."""
    people = _people(spark, folder)
    found = lookup.person_detail(people.select("nconst").distinct(), people, _titles(spark, folder))
    known = F.array_join(F.transform("known_for", lambda k: F.concat(k["tconst"], F.lit("="), F.coalesce(k["primarytitle"], F.lit("")))), "|")
    return found.select("nconst", "name", "birthyear", "deathyear", "profession", known.alias("known_for"))


@query(f"""WITH {_PEOPLE}, {_RATINGS_SQL}, {_SHAPE}, {_STAFF} SELECT s.tconst, 'Movie' || chr(10) || '=====' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || coalesce('Genres: ' || nullif(array_to_string(g, ', '), '') || '.' || chr(10), '') || coalesce('Director: ' || nullif(d.names, '') || '.' || chr(10), '') || coalesce('Writer: ' || nullif(w.names, '') || '.' || chr(10), '')
    || coalesce('Runtime: ' || runtime || '.' || chr(10), '') || CASE WHEN averagerating > 0 THEN 'Rating: ' || CAST(averagerating AS VARCHAR) || CASE WHEN numvotes > 0 THEN ' (' || CAST(numvotes AS VARCHAR) || ' votes)' ELSE '' END || '.' || chr(10) ELSE '' END AS card
    FROM shaped s LEFT JOIN staff d ON s.tconst = d.tconst AND d.part = 'directors' LEFT JOIN staff w ON s.tconst = w.tconst AND w.part = 'writers' LEFT JOIN ratings r ON s.tconst = r.tconst""")
def full_card(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of all titles with genres, crew, runtime and rating."""
    people, crew = _people(spark, folder).select("nconst", "primaryname").distinct(), table(spark, folder, "title_crew").select("tconst", "directors", "writers").distinct()
    roles = F.array().cast("array<string>")
    named = lambda f: lookup.listed_people(crew, people, f).groupBy("tconst").agg(F.sort_array(F.collect_list(F.struct("pos", "primaryname", roles.alias("roles")))).alias(f))
    shape = lookup.title_shape(table(spark, folder, "title_basics").drop("loaded_at").distinct())
    rows = shape.join(named("directors"), "tconst", "left").join(named("writers"), "tconst", "left").join(_ratings(spark, folder), "tconst", "left")
    cast = F.array().cast("array<struct<primaryname: string, roles: array<string>>>")
    return rows.select("tconst", render.title_card(F.col("title"), F.col("genres"), F.col("directors"), F.col("writers"), cast, F.col("runtimes"), F.col("averagerating"), F.coalesce("numvotes", F.lit(0))).alias("card"))


# ---------------------------------------------------------------- loading

_KEYS = {"name_basics": "nconst", "title_akas": "titleid"}


def _first_columns(name: str) -> str:
    return ", ".join(c.lower() for c in ARCHIVES[name])


@query(" UNION ALL ".join(f"SELECT '{table_of(a)}' AS relation, count(*) AS n, count(DISTINCT {_KEYS.get(table_of(a), 'tconst')}) AS n_keys FROM (SELECT DISTINCT {_first_columns(a)} FROM {table_of(a)} WHERE {' AND '.join(f'{c.lower()} IS NOT NULL' for c in ARCHIVES[a] if c in archives.IDS)})" for a in ARCHIVES))
def loaded_relations(spark: SparkSession, folder: str) -> DataFrame:
    """All seven archives written from the tables, loaded all or nothing, and their relations counted."""
    out = f"{session.shared_dir(spark)}/reelgrid/{spark.sparkContext.applicationId}/archives-{abs(hash(folder))}"
    destination = f"{out}-loaded"
    found = []

    def packed(archive: str) -> None:
        names = ARCHIVES[archive]
        rows = table(spark, folder, table_of(archive)).select(*[c.lower() for c in names]).distinct()
        for c in (n for n in names if n in archives.IDS):
            rows = rows.filter(F.col(c.lower()).isNotNull())
        raw = lambda c: F.coalesce(F.col(c.lower()).cast("int").cast("string") if TYPES.get(c) == "boolean" else F.col(c.lower()).cast("string"), F.lit("\\N"))
        archives.write_archive(rows.select(*[raw(c).alias(c) for c in names]), out, archive)

    archives.each(packed, ARCHIVES)
    archives.load(spark, out, destination)
    for archive in ARCHIVES:
        name = table_of(archive)
        relation = spark.read.parquet(f"{destination}/{name}.parquet")
        found.append(relation.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n"), F.countDistinct(_KEYS.get(name, "tconst")).alias("n_keys")))
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    return every
