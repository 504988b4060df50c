"""Names, headers and types of the seven relations."""

from __future__ import annotations

from pyspark.sql import types as T

#: The archives and their header columns, in source order.
ARCHIVES: dict[str, tuple[str, ...]] = {
    "name.basics.tsv.gz": ("nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles"),
    "title.akas.tsv.gz": ("titleId", "ordering", "title", "region", "language", "types", "attributes", "isOriginalTitle"),
    "title.basics.tsv.gz": ("tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"),
    "title.crew.tsv.gz": ("tconst", "directors", "writers"),
    "title.episode.tsv.gz": ("tconst", "parentTconst", "seasonNumber", "episodeNumber"),
    "title.principals.tsv.gz": ("tconst", "ordering", "nconst", "category", "job", "characters"),
    "title.ratings.tsv.gz": ("tconst", "averageRating", "numVotes"),
}

#: Columns that are no plain text, by name; a name has the same type wherever it stands.
TYPES: dict[str, str] = {
    "birthYear": "int", "deathYear": "int", "ordering": "int", "isOriginalTitle": "boolean", "isAdult": "boolean",
    "startYear": "int", "endYear": "int", "runtimeMinutes": "int", "seasonNumber": "int", "episodeNumber": "int",
    "averageRating": "double", "numVotes": "int",
}

#: Columns that hold one id; they are loaded as numbers.
IDS = frozenset({"tconst", "nconst", "titleId", "parentTconst"})
#: Columns that hold a list of ids; their prefixes are removed.
ID_LISTS = frozenset({"knownForTitles", "directors", "writers"})

#: Phonetic keys derived at load, by table.
DERIVED: dict[str, tuple[str, ...]] = {
    "title_basics": ("t_soundex",),
    "title_akas": ("t_soundex",),
    "name_basics": ("ns_soundex", "sn_soundex", "s_soundex"),
}

#: Names under which columns are shown on reading.
SHOWN_AS: dict[str, dict[str, str]] = {
    "title_basics": {"tconst": "movieID", "titleType": "kind", "primaryTitle": "title", "originalTitle": "original title", "isAdult": "adult", "runtimeMinutes": "runtimes"},
    "name_basics": {"nconst": "personID", "primaryName": "name", "birthYear": "birth date", "deathYear": "death date", "primaryProfession": "primary profession", "knownForTitles": "known for"},
    "title_akas": {"titleId": "movieID", "isOriginalTitle": "original"},
    "title_crew": {"tconst": "movieID", "directors": "director", "writers": "writer"},
    "title_episode": {"tconst": "movieID", "seasonNumber": "seasonNr", "episodeNumber": "episodeNr"},
    "title_principals": {"tconst": "movieID", "nconst": "personID"},
    "title_ratings": {"tconst": "movieID", "averageRating": "rating", "numVotes": "votes"},
}

#: Title kinds that are relabelled at load; others stay as they are.
KINDS: dict[str, str] = {
    "tvEpisode": "episode",
    "tvMiniSeries": "tv mini series",
    "tvSeries": "tv series",
    "tvShort": "tv short",
    "tvSpecial": "tv special",
    "videoGame": "video game",
}


def table_of(archive: str) -> str:
    """Table name of an archive's file name."""
    return archive.rsplit("/", 1)[-1].removesuffix(".tsv.gz").replace(".", "_")


ARCHIVE_OF: dict[str, str] = {table_of(a): a for a in ARCHIVES}


def spark_type(column: str) -> T.DataType:
    if column in IDS:
        return T.LongType()
    return {"int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}.get(TYPES.get(column, ""), T.StringType())


def table_schema(table: str) -> T.StructType:
    """Stored schema of a relation: header columns, then derived keys."""
    header = ARCHIVES[ARCHIVE_OF[table]]
    fields = [T.StructField(c, spark_type(c)) for c in header]
    return T.StructType(fields + [T.StructField(c, T.StringType()) for c in DERIVED.get(table, ())])


SCHEMAS: dict[str, T.StructType] = {t: table_schema(t) for t in ARCHIVE_OF}
