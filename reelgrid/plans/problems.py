"""Queries of the general problems 1, 3, 4 and 6, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import packed, rawlines, snapshots, tree
from reelgrid.session import table

# ---------------------------------------------------------------- problem 1


def packed_fields(spark: SparkSession, folder: str) -> DataFrame:
    """(field, rule_kind, rec_key, packed) of the four packed fields."""
    one = lambda name, field, kind, key: table(spark, folder, name).filter(F.length(field) > 0).select(F.lit(field).alias("field"), F.lit(kind).alias("rule_kind"), key.alias("rec_key"), F.col(field).alias("packed"))
    return (
        one("title_basics", "genres", "text", F.col("tconst"))
        .unionAll(one("name_basics", "knownfortitles", "id", F.col("nconst")))
        .unionAll(one("title_crew", "directors", "id", F.col("tconst")))
        .unionAll(one("title_akas", "types", "text", F.concat("titleid", F.lit("#"), F.col("ordering").cast("string"))))
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.packed_values(packed_fields(spark, folder), least=2)


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values, also of fields that hold one."""
    return packed.packed_values(packed_fields(spark, folder))


def _p1_sql(least: int) -> str:
    one = lambda name, field, kind, key: f"SELECT '{field}' AS field, '{kind}' AS kind, {key} AS rec_key, {field} AS packed FROM {name} WHERE length({field}) > 0"
    fields = " UNION ALL ".join(
        (
            one("title_basics", "genres", "text", "tconst"),
            one("name_basics", "knownfortitles", "id", "nconst"),
            one("title_crew", "directors", "id", "tconst"),
            one("title_akas", "types", "text", "titleid || '#' || CAST(ordering AS VARCHAR)"),
        )
    )
    return f"""
    WITH fields AS ({fields}),
    marked AS (
      SELECT field, rec_key, array_to_string(list_transform(regexp_extract_all(packed, '"(?:[^"]|"")*"|[^"]+'),
        lambda x: CASE WHEN x[1] = '"' THEN x WHEN kind = 'id' THEN regexp_replace(x, '[,;|/\\s]', chr(2), 'g')
             ELSE regexp_replace(x, '\\s+/\\s+|[,;|]', chr(2), 'g') END), '') AS packed FROM fields),
    lists AS (
      SELECT DISTINCT field, rec_key, list_filter(list_transform(regexp_extract_all(packed, '(?:"(?:[^"]|"")*"|[^\\x02"])+'),
        lambda v: CASE WHEN trim(v)[1] = '"' THEN replace(trim(v)[2:-2], '""', '"') ELSE trim(v) END), lambda v: v <> '') AS vals FROM marked)
    SELECT field, rec_key, CAST(unnest(generate_series(1, len(vals))) AS INTEGER) AS pos, unnest(vals) AS val FROM lists WHERE len(vals) >= {least}"""


# ---------------------------------------------------------------- problem 3


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return rawlines.parse_lines(table(spark, folder, "raw_lines"), strict=True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).filter(F.col("bad_field").isin("line", *rawlines.FIRST.values())).select("raw_id", "bad_field")


def p3_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Failing records with reason and byte offset."""
    return _parsed(spark, folder).filter("bad_field is not null").select("raw_id", "file_name", "line_no", "bad_field", "reason", "bad_offset")


def p3_title_basics(spark: SparkSession, folder: str) -> DataFrame:
    return rawlines.loaded(_parsed(spark, folder), "title.basics.tsv.gz")


def p3_title_principals(spark: SparkSession, folder: str) -> DataFrame:
    return rawlines.loaded(_parsed(spark, folder), "title.principals.tsv.gz")


def p3_title_episode(spark: SparkSession, folder: str) -> DataFrame:
    return rawlines.loaded(_parsed(spark, folder), "title.episode.tsv.gz")


#: The longest beginning of a value that a valid one may have, and a valid one, by kind; blanks, units of a string, a string and a begun one.
_W, _C = r"[ \t\n\r]*", r'(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})'
_S, _BEGUN = f'"{_C}*"', rf'"{_C}*(?:\\(?:u[0-9a-fA-F]{{0,3}})?)?'
_PREFIX = {
    "json": rf"^{_W}(?:\[{_W}(?:{_S}{_W}(?:,{_W}{_S}{_W})*(?:\]{_W}|,{_W}(?:{_BEGUN})?)?|\]{_W}|{_BEGUN})?)?", "int": "^[0-9]*",
    "boolean": "^[01]?", "double": r"^(?:[0-9]+(?:\.[0-9]*)?)?",
}
_VALID = {"json": rf"{_W}\[{_W}(?:{_S}{_W}(?:,{_W}{_S}{_W})*)?\]{_W}", "int": "[0-9]+", "boolean": "[01]", "double": r"[0-9]+(?:\.[0-9]+)?"}


def _p3_sql() -> str:
    """CTEs ending in ``judged`` (raw_id, line_no, file_name, f, bad_field, reason, bad_offset)."""
    from reelgrid.schema import ARCHIVES, TYPES

    tests = []
    for archive, names in ARCHIVES.items():
        for name in sorted(names, key=lambda x: x != rawlines.FIRST.get(archive)):
            kind = "json" if name == "characters" else TYPES.get(name, "text")
            if kind == "text":
                continue
            k = names.index(name) + 1
            here = f"file_name = '{archive}' AND f[{k}] <> '\\N'" + (f" AND f[{k}] <> ''" if kind == "json" else "")
            # a begun null mark is a beginning too
            reached = rf"strlen(CASE WHEN f[{k}][1] = '\' THEN regexp_extract(f[{k}], '^\\N?') ELSE regexp_extract(f[{k}], '{_PREFIX[kind]}') END)"
            before = f"strlen(array_to_string(f[1:{k - 1}], chr(9))) + {1 if k > 1 else 0}"
            tests.append(f"WHEN {here} AND NOT regexp_full_match(f[{k}], '{_VALID[kind]}') THEN {{'field': '{name}', 'reason': '{rawlines.REASONS[kind]}', 'at': {before} + {reached}}}")
            if kind == "int":
                tests.append(f"WHEN {here} AND NOT coalesce(TRY_CAST(f[{k}] AS HUGEINT) <= {rawlines.LARGEST}, false) THEN {{'field': '{name}', 'reason': 'larger than {rawlines.LARGEST}', 'at': {before}}}")
    return rf"""
    WITH heads AS (SELECT file_name, len(string_split(rtrim(line, chr(13)), chr(9))) AS n FROM raw_lines WHERE line_no = 1),
    split AS (SELECT raw_id, r.line_no, r.file_name, string_split(rtrim(coalesce(line, ''), chr(13)), chr(9)) AS f, n FROM raw_lines r LEFT JOIN heads h ON r.file_name = h.file_name WHERE r.line_no <> 1),
    told AS (SELECT raw_id, line_no, file_name, f, CASE WHEN n IS NULL THEN {{'field': 'line', 'reason': 'unknown archive', 'at': 0}}
      WHEN len(f) <> n THEN {{'field': 'line', 'reason': len(f) || ' fields, expected ' || n, 'at': strlen(array_to_string(f[1:n], chr(9)))}}
      {" ".join(tests)} END AS e FROM split),
    judged AS (SELECT raw_id, line_no, file_name, f, e.field AS bad_field, e.reason AS reason, CAST(e.at AS BIGINT) AS bad_offset FROM told)"""


_P3 = _p3_sql()


def _p3_typed(archive: str) -> str:
    from reelgrid.schema import ARCHIVES, TYPES

    cols = []
    for k, name in enumerate(ARCHIVES[archive], 1):
        text = rf"nullif(f[{k}], '\N')"
        kind = TYPES.get(name, "string")
        cols.append({"string": text, "boolean": f"coalesce({text} = '1', false)"}.get(kind, f"TRY_CAST({text} AS {kind})") + f" AS {name.lower()}")
    return f"{_P3} SELECT raw_id, line_no, {', '.join(cols)} FROM judged WHERE bad_field IS NULL AND file_name = '{archive}'"


# ---------------------------------------------------------------- problem 4


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.changes(table(spark, folder, "title_snapshots")).select("snapshot_no", "tconst", "change_kind")


def p4_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every change with its old and new values."""
    return snapshots.changes(table(spark, folder, "title_snapshots"))


_P4 = """
    WITH latest AS (SELECT snapshot_no, tconst, round(averagerating, 1) AS rating, numvotes AS votes FROM title_snapshots WHERE tconst IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY snapshot_no, tconst ORDER BY loaded_at DESC, round(averagerating, 1) DESC NULLS LAST, numvotes DESC NULLS LAST) = 1),
    nos AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS after FROM (SELECT DISTINCT snapshot_no FROM title_snapshots)),
    old AS (SELECT after AS snapshot_no, tconst, rating, votes FROM latest JOIN nos USING (snapshot_no) WHERE after IS NOT NULL),
    new AS (SELECT * FROM latest WHERE snapshot_no > (SELECT min(snapshot_no) FROM nos)),
    both_ AS (SELECT coalesce(o.snapshot_no, n.snapshot_no) AS snapshot_no, coalesce(o.tconst, n.tconst) AS tconst,
      CASE WHEN o.tconst IS NULL THEN 'added' WHEN n.tconst IS NULL THEN 'removed' WHEN o.rating IS DISTINCT FROM n.rating OR o.votes IS DISTINCT FROM n.votes THEN 'changed' END AS change_kind,
      o.rating AS old_rating, n.rating AS new_rating, o.votes AS old_votes, n.votes AS new_votes
      FROM old o FULL JOIN new n ON o.snapshot_no = n.snapshot_no AND o.tconst = n.tconst)"""

# ---------------------------------------------------------------- problem 6

HOT = (("title_episode", "parenttconst"), ("title_akas", "titleid"), ("title_principals", "nconst"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    keys = [table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col(key).alias("key")) for name, key in HOT]
    return tree.hot_keys(keys[0].unionAll(keys[1]).unionAll(keys[2]), "key", within="table_name").select("table_name", "hot_key")


def p6_per_series(spark: SparkSession, folder: str) -> DataFrame:
    states = [tree.rows_of("n_rows"), tree.count_of("n_season", F.col("seasonnumber")), tree.sum_of("sum_episode", F.col("episodenumber")), tree.min_of("first_season", F.col("seasonnumber")), tree.max_of("last_season", F.col("seasonnumber"))]
    return tree.tree_aggregate(table(spark, folder, "title_episode").select("parenttconst", "seasonnumber", "episodenumber"), "parenttconst", states)


def p6_per_title(spark: SparkSession, folder: str) -> DataFrame:
    states = [tree.rows_of("n_rows"), tree.count_of("n_language", F.col("language")), tree.sum_of("n_original", F.col("isoriginaltitle").cast("long")), tree.max_of("last_ordering", F.col("ordering"))]
    return tree.tree_aggregate(table(spark, folder, "title_akas").select("titleid", "language", "isoriginaltitle", "ordering"), "titleid", states)


def p6_per_person(spark: SparkSession, folder: str) -> DataFrame:
    states = [tree.rows_of("n_rows"), tree.count_of("n_characters", F.col("characters")), tree.min_of("first_tconst", F.col("tconst")), tree.max_of("last_tconst", F.col("tconst"))]
    return tree.tree_aggregate(table(spark, folder, "title_principals").select("nconst", "characters", "tconst"), "nconst", states)


QUERIES = {
    "p1_found": p1_found, "p1_values": p1_values,
    "p3_found": p3_found, "p3_errors": p3_errors, "p3_title_basics": p3_title_basics, "p3_title_principals": p3_title_principals, "p3_title_episode": p3_title_episode,
    "p4_found": p4_found, "p4_changes": p4_changes,
    "p6_found": p6_found, "p6_per_series": p6_per_series, "p6_per_title": p6_per_title, "p6_per_person": p6_per_person,
}

SQL = {
    "p1_found": _p1_sql(2),
    "p1_values": _p1_sql(1),
    "p3_found": f"{_P3} SELECT raw_id, bad_field FROM judged WHERE bad_field IN ('line', 'characters', 'runtimeMinutes', 'seasonNumber')",
    "p3_errors": f"{_P3} SELECT raw_id, file_name, line_no, bad_field, reason, bad_offset FROM judged WHERE bad_field IS NOT NULL",
    "p3_title_basics": _p3_typed("title.basics.tsv.gz"),
    "p3_title_principals": _p3_typed("title.principals.tsv.gz"),
    "p3_title_episode": _p3_typed("title.episode.tsv.gz"),
    "p4_found": f"{_P4} SELECT snapshot_no, tconst, change_kind FROM both_ WHERE change_kind IS NOT NULL",
    "p4_changes": f"{_P4} SELECT * FROM both_ WHERE change_kind IS NOT NULL",
    "p6_found": " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS hot_key FROM {t} GROUP BY {k} HAVING {k} IS NOT NULL AND count(*) * 100 >= 2 * (SELECT count(*) FROM {t})" for t, k in HOT),
    "p6_per_series": "SELECT parenttconst, count(*) AS n_rows, count(seasonnumber) AS n_season, CAST(sum(episodenumber) AS BIGINT) AS sum_episode, min(seasonnumber) AS first_season, max(seasonnumber) AS last_season FROM title_episode GROUP BY 1",
    "p6_per_title": "SELECT titleid, count(*) AS n_rows, count(language) AS n_language, CAST(sum(CAST(isoriginaltitle AS INT)) AS BIGINT) AS n_original, max(ordering) AS last_ordering FROM title_akas GROUP BY 1",
    "p6_per_person": "SELECT nconst, count(*) AS n_rows, count(characters) AS n_characters, min(tconst) AS first_tconst, max(tconst) AS last_tconst FROM title_principals GROUP BY 1",
}
