"""The catalogue as an object: loaded relations, searches and lookups.

Results are DataFrames; ``Record`` wraps one row for callers that want keys with aliases and computed values. Single
lookups are one-row DataFrames of ids, so the same plans serve one id and millions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reelgrid.errors import DataAccessError, ParseError
from reelgrid.functions import text
from reelgrid.operators import lookup, search
from reelgrid.sources.relations import open_relation

SYSTEMS = ("parquet",)
TITLE_PARTS = ("main", "plot", "episodes")
PERSON_PARTS = ("main", "filmography", "biography")


def available_systems() -> tuple[str, ...]:
    return SYSTEMS


class Catalog:
    """A stored catalogue, opened read-only; relations are read when they are needed."""

    def __init__(self, spark: SparkSession, path: str, results: int | str = search.DEFAULT_RESULTS, modify: Callable[[str], str] | None = None) -> None:
        self.spark, self.path, self.results, self.modify = spark, path.rstrip("/"), self._count(results), modify
        self._open: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> Catalog:
        return cls(spark, path, **options)

    @staticmethod
    def _count(results: Any) -> int:
        try:
            n = int(results)
        except (TypeError, ValueError):
            return search.DEFAULT_RESULTS
        return n if n > 0 else search.DEFAULT_RESULTS

    def __enter__(self) -> Catalog:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Forget the relations; closing twice does nothing."""
        self._open.clear()

    def table(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = open_relation(self.spark, self.path, name)
        return self._open[name]

    # ------------------------------------------------------------ searches

    def _titles(self, texts: Iterable[str], results: Any, **only: Any) -> DataFrame:
        try:
            queries = search.title_queries(self.spark, texts)
        except ValueError as e:
            raise ParseError(str(e)) from e
        titles = self.table("title_basics")
        return search.search_titles(queries, titles, self.table("title_akas"), self._count(results or self.results), search.title_filter(**only))

    def search_titles(self, *texts: str, results: Any = None) -> DataFrame:
        """(query_id, rank, tconst, title, kind, year, score) of one or more texts."""
        return self._titles(texts, results)

    def search_titles_advanced(self, *texts: str, adult: bool | None = None, kinds: Iterable[str] | None = None, results: Any = None) -> DataFrame:
        return self._titles(texts, results, adult=adult, kinds=kinds)

    def search_episodes(self, *texts: str, results: Any = None) -> DataFrame:
        return self._titles(texts, results, episodes=True)

    def search_people(self, *names: str, results: Any = None) -> DataFrame:
        queries = self.spark.createDataFrame(list(enumerate(names)), "query_id int, query string")
        return search.search_people(queries, self.table("name_basics"), self._count(results or self.results))

    # ------------------------------------------------------------ lookups

    def _ids(self, ids: Iterable[int | str], key: str) -> DataFrame:
        numbers = [(int(str(i).lstrip("tnm")),) for i in ids]
        return self.spark.createDataFrame(numbers, f"{key} long")

    def titles(self, ids: Iterable[int | str]) -> DataFrame:
        """Everything known of the titles with these ids, one row each."""
        names = ("title_basics", "title_crew", "title_episode", "title_principals", "name_basics", "title_ratings", "title_akas")
        return lookup.title_detail(self._ids(ids, "tconst"), *[self.table(n) for n in names])

    def title(self, key: int | str) -> Record:
        return Record(self.titles([key]).first(), "movie", self.modify)

    def episodes(self, series: int | str, seasons: Iterable[int | str] | int | str | None = None) -> DataFrame:
        """Episodes of a series, all or of some seasons."""
        if isinstance(seasons, int | str):
            seasons = None if seasons == "all" else [seasons]
        mine = lookup.rows_where(self.table("title_episode"), "parenttconst", int(str(series).lstrip("t")))
        return lookup.episodes(mine, self.table("title_basics"), self.table("title_ratings"), seasons)

    def people(self, ids: Iterable[int | str]) -> DataFrame:
        return lookup.person_detail(self._ids(ids, "nconst"), self.table("name_basics"), self.table("title_basics"))

    def person(self, key: int | str) -> Record:
        return Record(self.people([key]).first(), "person", self.modify)

    def by_url(self, url: str) -> Record | None:
        """The title or person whose id stands in an address; None without one."""
        found = self.spark.createDataFrame([(url,)], "u string").select(text.id_in_url(F.col("u")).alias("i")).first()["i"]
        if found is None:
            return None
        if found["kind"] in ("ch", "co"):
            raise DataAccessError(f"no records of kind {found['kind']}")
        return self.title(found["id"]) if found["kind"] == "tt" else self.person(found["id"])

    # ------------------------------------------------------------ updates

    def update(self, record: Record, parts: str | Iterable[str] = "main", override: bool = False) -> None:
        """Merge parts of a record into what it holds: a name, several, or "all"; parts that it has are read again with ``override`` only."""
        known = TITLE_PARTS if record.kind == "movie" else PERSON_PARTS
        wanted = known if parts == "all" else [parts] if isinstance(parts, str) else list(parts)
        if record.key() is None:
            raise DataAccessError("a record without an id cannot be updated")
        for part in dict.fromkeys(self.part(record.kind, name) for name in wanted):
            if part in record.parts and not override:
                continue
            if part == "episodes":
                self.update_seasons(record, None, override)
            else:
                row = self.titles([record.key()]) if record.kind == "movie" else self.people([record.key()])
                record.merge(Record(row.first(), record.kind).data)
            record.parts.add(part)

    def update_seasons(self, record: Record, seasons: Iterable[int | str] | int | str | None, override: bool = False) -> None:
        """Merge episodes of some seasons of a series, or of all, by season and episode key; seasons that it has stay unless ``override``."""
        held = record.data.setdefault("episodes", {})
        for row in self.episodes(record.key(), seasons).collect():  # one series, as its record holds it
            if override or row["season_key"] not in record.seasons:
                held.setdefault(row["season_key"], {})[row["episode_key"]] = {k: v for k, v in row.asDict(recursive=True).items() if v not in (None, "", [])}
        record.seasons.update(held)
        if not held:
            del record.data["episodes"]

    def part(self, kind: str, name: str) -> str:
        """The part of a record that a name stands for; an unknown one is an error."""
        known = TITLE_PARTS if kind == "movie" else PERSON_PARTS
        if name not in known:
            raise DataAccessError(f"no part {name}")
        return "episodes" if name == "episodes" else "main"


#: Other names of keys.
ALIASES = {
    "movie": {"user rating": "averagerating", "rating": "averagerating", "votes": "numvotes", "genre": "genres", "runtime": "runtimes", "director": "directors", "writer": "writers", "aka": "akas", "also known as": "akas", "episode of": "episode_of", "original title": "original_title", "adult": "adult", "id": "tconst"},
    "person": {"birth date": "birthyear", "death date": "deathyear", "known for": "known_for", "primary profession": "profession", "id": "nconst"},
}


class Record:
    """One row with key access: aliases, computed keys, and no keys for what is null or empty."""

    def __init__(self, row: Row | None, kind: str, modify=None) -> None:  # noqa: ANN001
        data = {} if row is None else row.asDict(recursive=True)
        self.kind, self.data, self._modify = kind, {k: v for k, v in data.items() if v not in (None, "", [])}, modify
        self.parts: set[str] = {"main"} if self.data else set()
        self.seasons: set[str] = set()

    def merge(self, values: dict[str, Any]) -> None:
        """Take over values where there are any; a nested record is merged key by key, and what is not told anew stays."""
        for key, value in values.items():
            if value in (None, "", []):
                continue
            if isinstance(value, dict) and isinstance(self.data.get(key), dict):
                self.data[key] = {**self.data[key], **value}
            else:
                self.data[key] = value

    def _modified(self, value: Any, depth: int = 2) -> Any:
        """Texts through the modifier, also those in lists and records, two levels down."""
        if self._modify is None or isinstance(value, bool | int | float):
            return value
        if isinstance(value, str):
            return self._modify(value)
        if depth and isinstance(value, list):
            return [self._modified(v, depth - 1) for v in value]
        if depth and isinstance(value, dict):
            return {k: self._modified(v, depth - 1) for k, v in value.items()}
        return value

    def _computed(self, key: str) -> Any:
        if self.kind == "movie" and key == "long title" and "title" in self.data:
            year = self.data.get("year", "????")
            title = f'"{self["title"]}"' if self.data.get("kind") in ("tv series", "tv mini series") else self["title"]
            return f"{title} ({str(year)[:4]})"
        if self.kind == "person" and key == "long name":
            return self.data.get("name")
        return None

    def __getitem__(self, key: str) -> Any:
        value = self.data.get(key, self.data.get(ALIASES[self.kind].get(key, key)))
        if value is None:
            value = self._computed(key)
        if value is None:
            raise KeyError(key)
        return self._modified(value)

    def get(self, key: str, default: Any = None) -> Any:
        try:
            return self[key]
        except KeyError:
            return default

    def __contains__(self, key: object) -> bool:
        if isinstance(key, Record):
            return self._holds(self.data, key.key())
        return isinstance(key, str) and self.get(key) is not None

    def _holds(self, value: Any, wanted: Any) -> bool:
        if isinstance(value, dict):
            return any(self._holds(v, wanted) for v in value.values())
        if isinstance(value, list):
            return any(self._holds(v, wanted) for v in value)
        return str(value) == str(wanted)

    def key(self) -> Any:
        return self.data.get("tconst" if self.kind == "movie" else "nconst")

    def keys(self) -> list[str]:
        return list(self.data)

    def items(self) -> list[tuple[str, Any]]:
        return list(self.data.items())

    def __len__(self) -> int:
        return len(self.data)

    def __bool__(self) -> bool:
        return bool(self.data.get("title" if self.kind == "movie" else "name"))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Record) and self.kind == other.kind and str(self.key()) == str(other.key())

    def __hash__(self) -> int:
        return hash((self.kind, str(self.key())))

    def __repr__(self) -> str:
        return f"<{self.kind} {self.key()}: {self.get('title' if self.kind == 'movie' else 'name')}>"
