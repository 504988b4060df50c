"""Orders of titles, persons, companies, seasons and episodes, as lists of sort columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid import session


def season_order(season: str = "seasonnumber") -> list[Column]:
    """Numbered seasons first, ascending; unknown ones last."""
    return [F.col(season).asc_nulls_last()]


def episode_order(season: str = "seasonnumber", episode: str = "episodenumber", key: str = "episode_key") -> list[Column]:
    """Within a series: season, then numbered episodes, then the others by key."""
    numbered = F.col(key).cast("string").rlike("^[0-9]+$")
    return [F.col(season).asc_nulls_last(), (~numbered).asc(), F.when(numbered, F.col(episode)).asc_nulls_last(), F.col(key).asc()]


def title_order(year: str = "year", title: str = "title", index: str | None = None, key: str = "tconst") -> list[Column]:
    """Newest first, then title, index and id (as text), descending; a missing title or index counts as the largest."""
    by_index = [F.col(index).desc_nulls_first()] if index else []
    return [F.coalesce(F.col(year), F.lit(0)).desc(), F.col(title).asc_nulls_last(), *by_index, F.col(key).cast("string").desc_nulls_first()]


def series_episode_order(key: str = "tconst") -> list[Column]:
    """Episodes across series: the series in title order, then season and episode, latest first."""
    return [*title_order("series_year", "series_title", None, "parenttconst"), F.col("seasonnumber").desc_nulls_last(), F.col("episodenumber").desc_nulls_last(), *title_order("series_year", "title", None, key)]


def people_order(billing: str = "ordering", name: str = "canonical_name", index: str | None = None, key: str = "nconst") -> list[Column]:
    """Billing position (none and 0 last), canonical name, index, id as text."""
    by_index = [F.col(index).asc_nulls_last()] if index else []
    return [F.nullif(F.col(billing), F.lit(0)).asc_nulls_last(), F.col(name).asc_nulls_last(), *by_index, F.col(key).cast("string").asc_nulls_last()]


def company_order(name: str = "name", country: str = "country", key: str = "company_id") -> list[Column]:
    return [F.col(name).asc_nulls_last(), F.col(country).asc_nulls_last(), F.col(key).cast("string").asc_nulls_last()]


def numbered(df: DataFrame, by: list[str], order: list[Column], into: str = "pos") -> DataFrame:
    """``df`` with the position of each row in its group's order, from 1.

    A group may hold most of the rows, so no task sorts a whole group: rows are range-partitioned by group and order, each
    part of a group is numbered by itself, and the rows before a part are added. Only groups that lie in several
    partitions need that, which are fewer than the partitions, so those numbers are broadcast. The order must be total;
    rows that are equal in it are numbered in any order.
    """
    held = session.cut(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = held.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*by)
    spread = sizes.withColumn("__parts", F.count(F.lit(1)).over(group)).filter("__parts > 1")
    before = spread.withColumn("__before", F.sum("__n").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__in"), "__before")
    inner = held.withColumn("__nr", F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)))
    met = F.col("__part") == F.col("__in")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = inner.join(F.broadcast(before), met, "left")
    return placed.select(*df.columns, (F.col("__nr") + F.coalesce("__before", F.lit(0))).cast("int").alias(into))


def same_item(a: Column, b: Column, system_a: Column, system_b: Column) -> Column:
    """Whether two records are one item: equal ids as text, of one access system."""
    return F.coalesce((a.cast("string") == b.cast("string")) & system_a.eqNullSafe(system_b), F.lit(False))
