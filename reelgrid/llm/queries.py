"""Queries of problems 2, 5, 7, 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import session
from reelgrid.llm import bpe, cooccur, lookalike, mix, residue, topn
from reelgrid.operators.packed import split_packed
from reelgrid.session import table
from reelgrid.sources.files import Files

# ---------------------------------------------------------------- problem 2

PERSON, GENRE = {"least_shared": 4, "least_lift": 10}, {"least_shared": 4, "least_lift": 2}


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with counts, lift and pointwise mutual information."""
    credits = table(spark, folder, "title_principals").select(F.col("tconst").alias("basket"), F.col("nconst").alias("item"))
    titles = credits.filter("basket is not null").select("basket").distinct().count()
    people = cooccur.together(credits, titles, **PERSON)
    fields = table(spark, folder, "title_basics").filter("tconst is not null and length(genres) > 0").select("tconst", "genres").distinct()
    genres = split_packed(fields, "genres").filter(F.size("vals") > 0).select(F.col("tconst").alias("basket"), F.explode("vals").alias("item"))
    with_genre = genres.select("basket").distinct().count()
    kinds = cooccur.together(genres, with_genre, **GENRE)
    return people.select(F.lit("person").alias("item_kind"), "*").unionAll(kinds.select(F.lit("genre").alias("item_kind"), "*"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pairs(spark, folder).select("item_kind", "item_a", "item_b")


def _p2_sql(cols: str) -> str:
    from reelgrid.plans.problems import _p1_sql

    one = lambda kind, shared, lift: f"""SELECT '{kind}' AS item_kind, a.item AS item_a, b.item AS item_b, count(*) AS shared, any_value(ma.n) AS n_a, any_value(mb.n) AS n_b, any_value(t.n) AS baskets
      FROM {kind}_d a JOIN {kind}_d b ON a.basket = b.basket AND a.item < b.item JOIN {kind}_m ma ON ma.item = a.item JOIN {kind}_m mb ON mb.item = b.item CROSS JOIN {kind}_t t
      GROUP BY a.item, b.item HAVING count(*) >= {shared} AND count(*)::HUGEINT * any_value(t.n) >= {lift} * any_value(ma.n)::HUGEINT * any_value(mb.n)"""  # noqa: E731
    return f"""
    WITH vals AS ({_p1_sql(1)}),
    person_d AS (SELECT DISTINCT tconst AS basket, nconst AS item FROM title_principals WHERE nconst IS NOT NULL AND tconst IS NOT NULL),
    person_m AS (SELECT item, count(*) AS n FROM person_d GROUP BY 1), person_t AS (SELECT count(DISTINCT tconst) AS n FROM title_principals),
    genre_d AS (SELECT DISTINCT rec_key AS basket, val AS item FROM vals WHERE field = 'genres'),
    genre_m AS (SELECT item, count(*) AS n FROM genre_d GROUP BY 1), genre_t AS (SELECT count(DISTINCT basket) AS n FROM genre_d),
    pairs AS ({one("person", 4, 10)} UNION ALL {one("genre", 4, 2)})
    SELECT {cols} FROM pairs"""


# ---------------------------------------------------------------- problem 5


def _texts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """rec_key and text of each source; aka has parent_key too."""
    names = table(spark, folder, "name_basics").select(F.col("nconst").alias("rec_key"), F.col("primaryname").alias("text"))
    titles = table(spark, folder, "title_basics").select(F.col("tconst").alias("rec_key"), F.col("primarytitle").alias("text"))
    akas = table(spark, folder, "title_akas").select(F.col("titleid").alias("parent_key"), F.concat("titleid", F.lit("#"), F.col("ordering").cast("string")).alias("rec_key"), F.col("title").alias("text"))
    return {src: df.filter("text is not null") for src, df in (("name", names), ("title", titles), ("aka", akas))}


def _classes(texts: dict[str, DataFrame]) -> DataFrame:
    return lookalike.classes(texts["name"].select("text").unionAll(texts["title"].select("text")).unionAll(texts["aka"].select("text")))


#: Bytes of the written texts of classes with different texts, up to which they are broadcast; beyond it records and texts are joined by text.
MOST_VARIANTS = 16 << 20


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """(src, parent_key, rec_key, text, canonical) of the records whose text is in a class of different texts, written once."""
    texts = _texts(spark, folder)
    path = session.written(lookalike.variants(_classes(texts)), "variants")
    varied = spark.read.schema("text string, canonical string").parquet(path)
    if Files(spark).size(path) <= MOST_VARIANTS:
        varied = F.broadcast(varied)
    no_parent = F.lit(None).cast("string").alias("parent_key")
    records = [df.select(F.lit(src).alias("src"), F.col("parent_key") if src == "aka" else no_parent, "rec_key", "text") for src, df in texts.items()]
    return session.cut(lookalike.members(records[0].unionAll(records[1]).unionAll(records[2]), varied), "members")


def p5_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that looks like another one but is not the same characters, with the canonical text of its class."""
    return _members(spark, folder).select("src", "rec_key", "text", "canonical").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _members(spark, folder)
    one = lambda src: found.filter(F.col("src") == src)
    pairs = [lookalike.same_looking(one(s)).select(F.lit(s).alias("src"), "key_a", "key_b") for s in ("name", "title")]
    pairs.append(lookalike.same_looking_children(one("title"), one("aka")).select(F.lit("aka").alias("src"), "key_a", "key_b"))
    return pairs[0].unionAll(pairs[1]).unionAll(pairs[2])


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct title and name with the one form of its class."""
    return _classes(_texts(spark, folder))


def _p5_sql(what: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # characters that SQL texts cannot hold as they are
    literal = lambda c: f"chr({ord(c)})" if ord(c) < 32 or ord(c) in (0x7F, 0x85) else quoted(c)
    table = lookalike.composed_mapping()
    known = f"MAP {{{', '.join(f'{literal(a)}: {quoted(b)}' for a, b in table.items())}}}"
    raw = lambda c: f"CASE WHEN regexp_full_match({c}, '[ -~]*') THEN {c} ELSE array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN x BETWEEN ' ' AND '~' THEN x ELSE coalesce(list_extract(map_extract(k.m, x), 1), x) END), '') END"
    form = lambda c: f"nfc_normalize({raw(f'nfc_normalize({c})')})"
    texts = f"""
    WITH k AS (SELECT {known} AS m),
    n AS (SELECT DISTINCT nconst AS k, primaryname AS t, {form("primaryname")} AS f FROM name_basics, k WHERE primaryname IS NOT NULL),
    b AS (SELECT DISTINCT tconst AS k, primarytitle AS t, {form("primarytitle")} AS f FROM title_basics, k WHERE primarytitle IS NOT NULL),
    a AS (SELECT DISTINCT titleid AS p, titleid || '#' || CAST(ordering AS VARCHAR) AS k, title AS t, {form("title")} AS f FROM title_akas, k WHERE title IS NOT NULL)"""
    if what != "found":
        texts = f"""{texts}, u AS (SELECT t, f FROM n UNION SELECT t, f FROM b UNION SELECT t, f FROM a),
    c AS (SELECT t AS text, first_value(t) OVER (PARTITION BY f ORDER BY t <> f, length(t), t) AS canonical, count(*) OVER (PARTITION BY f) AS n_forms FROM u)"""
        if what == "forms":
            return f"{texts} SELECT text, canonical, n_forms FROM c"
        return f"""{texts}, r AS (SELECT 'name' AS src, k, t FROM n UNION SELECT 'title', k, t FROM b UNION SELECT 'aka', k, t FROM a)
    SELECT src, k AS rec_key, text, canonical FROM r JOIN c ON t = text WHERE n_forms > 1"""
    pair = lambda src, v: f"SELECT DISTINCT '{src}' AS src, x.k AS key_a, y.k AS key_b FROM {v} x JOIN {v} y ON x.f = y.f AND x.k < y.k AND x.t <> y.t"
    return f"""{texts} {pair("name", "n")} UNION ALL {pair("title", "b")}
    UNION ALL SELECT DISTINCT 'aka' AS src, b.k AS key_a, a.k AS key_b FROM a JOIN b ON a.p = b.k AND a.f = b.f AND a.t <> b.t"""


# ---------------------------------------------------------------- problem 7

BEST = 5


def _rated_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """(grp, item, score, second): every episode of a series with its last full rating."""
    full = table(spark, folder, "title_ratings").filter("tconst is not null and averagerating is not null and numvotes is not null")
    last = full.groupBy("tconst").agg(F.max(F.struct("loaded_at", "averagerating", "numvotes")).alias("r")).select("tconst", "r.averagerating", "r.numvotes")
    episodes = table(spark, folder, "title_episode").filter("parenttconst is not null and tconst is not null").select("parenttconst", "tconst").distinct()
    return episodes.join(last, "tconst").select(F.col("parenttconst").alias("grp"), F.col("tconst").alias("item"), F.col("averagerating").alias("score"), F.col("numvotes").cast("long").alias("second"))


def _clustered(spark: SparkSession, folder: str) -> str:
    return topn.kept_table(_rated_episodes(spark, folder), label="rated-episodes")


def p7_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best rated episodes of every series, with rating and votes."""
    best = topn.best_of(spark, _clustered(spark, folder), BEST)
    return best.select(F.col("grp").alias("parenttconst"), F.col("rnk").cast("int").alias("rnk"), F.col("item").alias("tconst"), F.col("score").alias("averagerating"), F.col("second").cast("int").alias("numvotes"))


def p7_skipping(spark: SparkSession, folder: str) -> DataFrame:
    """Row groups of each file of the clustered table, those read and those skipped."""
    return topn.skipping(spark, _clustered(spark, folder), BEST)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_best(spark, folder).select("parenttconst", "rnk", "tconst")


_P7 = """
    WITH last_ AS (SELECT tconst, averagerating, numvotes FROM title_ratings WHERE averagerating IS NOT NULL AND numvotes IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY loaded_at DESC, averagerating DESC, numvotes DESC) = 1),
    ranked AS (SELECT parenttconst, tconst, averagerating, numvotes, CAST(row_number() OVER (PARTITION BY parenttconst ORDER BY averagerating DESC, numvotes DESC, CAST(tconst[3:] AS BIGINT), tconst) AS INTEGER) AS rnk
      FROM (SELECT DISTINCT parenttconst, tconst FROM title_episode WHERE parenttconst IS NOT NULL) JOIN last_ USING (tconst))
    SELECT {} FROM ranked WHERE rnk <= 5"""

# ---------------------------------------------------------------- problem 8


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), bpe.vocabulary())


# ---------------------------------------------------------------- problem 9


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    sources = table(spark, folder, "mix_targets")
    docs = table(spark, folder, "documents").join(F.broadcast(sources.select("source").distinct()), "source", "left_semi")
    return mix.mixture(bpe.counted(docs, bpe.vocabulary(), ["doc_id", "source"]), sources)


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their tokens and number of copies."""
    return _mixture(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source."""
    return mix.reached(*_mixture(spark, folder))


# ---------------------------------------------------------------- problem 10


def p10_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged documents with the evidence that decided."""
    titles = table(spark, folder, "title_basics").select("tconst", F.col("primarytitle").alias("title"))
    return residue.residue(table(spark, folder, "documents"), titles)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_evidence(spark, folder).select("doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p5_found": p5_found, "p5_members": p5_members, "p5_forms": p5_forms, "p7_found": p7_found, "p7_best": p7_best, "p7_skipping": p7_skipping,
    "p8_ids": p8_ids, "p9_selection": p9_selection, "p9_shares": p9_shares, "p10_found": p10_found, "p10_evidence": p10_evidence,
}

_LIFT = "shared::DOUBLE * baskets / (n_a::DOUBLE * n_b)"
SQL = {
    "p2_found": _p2_sql("item_kind, item_a, item_b"),
    "p2_pairs": _p2_sql(f"item_kind, item_a, item_b, shared, n_a, n_b, baskets, {_LIFT} AS lift, log2({_LIFT}) AS pmi"),
    "p5_found": _p5_sql("found"),
    "p5_members": _p5_sql("members"),
    "p5_forms": _p5_sql("forms"),
    "p7_found": _P7.format("parenttconst, rnk, tconst"),
    "p7_best": _P7.format("parenttconst, rnk, tconst, averagerating, numvotes"),
}
