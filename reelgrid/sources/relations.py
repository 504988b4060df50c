"""Opening stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.errors import DataAccessError
from reelgrid.schema import SCHEMAS, SHOWN_AS
from reelgrid.sources.files import Files


def open_relation(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored relation, with columns in lower case. It is never created; a missing one is an error."""
    where = f"{path.rstrip('/')}/{table}.parquet"
    if not Files(spark).exists(where):
        raise DataAccessError(f"no relation {table} in {path}")
    df = spark.read.parquet(where)
    return df.toDF(*[c.lower() for c in df.columns])


def column_names(df: DataFrame) -> set[str]:
    return set(df.columns)


def renamed(df: DataFrame, table: str) -> DataFrame:
    """Columns under the names by which they are shown."""
    shown = {k.lower(): v for k, v in SHOWN_AS[table].items()}
    return df.toDF(*[shown.get(c.lower(), c) for c in df.columns])


def without_empty(df: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without some columns; empty texts and lists are null, 0 and false stay."""
    from pyspark.sql import functions as F

    cols = []
    for name, kind in df.dtypes:
        if name in leave_out:
            continue
        c = F.col(f"`{name}`")
        cols.append((F.nullif(c, F.lit("")) if kind == "string" else F.when(F.size(c) > 0, c) if kind.startswith("array") else c).alias(name))
    return df.select(*cols)


def jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options: str) -> None:
    """Write a relation to a database through JDBC; the driver's jar must be on the class path."""
    df.write.mode(mode).options(**options).jdbc(url, table)


TABLES = tuple(SCHEMAS)
