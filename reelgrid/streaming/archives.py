"""Archives as streams: files of archive lines that arrive in a folder become rows of the relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelgrid.schema import ARCHIVE_OF, ARCHIVES
from reelgrid.sources.archives import problem, typed


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    return spark.readStream.option("lineSep", "\n").text(folder).select(F.rtrim("value", F.lit("\r")).alias("value"))


def stream_relation(spark: SparkSession, folder: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows of the relation, rejected (value, error) lines) of a folder's files; header lines are no rows."""
    archive = ARCHIVE_OF[table]
    fields = F.split("value", "\t", -1)
    rows = stream_lines(spark, folder).filter(F.col("value") != "\t".join(ARCHIVES[archive])).select("value", problem(archive, fields, F.is_valid_utf8("value")).alias("error"), fields.alias("fields"))
    return typed(rows.filter("error is null"), archive), rows.filter("error is not null").select("value", "error")


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet relation, exactly once, until the files at hand are done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
