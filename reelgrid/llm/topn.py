"""Top N items within every group (problem 7).

Method: statistics-guided skipping. The scored rows are written to a table clustered by group (range-partitioned and
sorted by group, then score), in small row groups whose footers hold the largest and smallest score and group. The table is
kept in the shared folder for as long as the files it is made from are the same. One task
per file then reads the row groups in descending order of their largest score, keeps the N best of every group seen, and
skips a row group whose largest score is strictly below the N-th score of every group in it: for a row group of one
group the footer alone decides, for one of several groups the group column is read first. Ties are never skipped, as a
later tie rule may still choose them. A group that spans files yields at most N rows per file; a window ranks those.

The range partitioning includes the score, so a group with a third of all rows is spread over many files.

Order: larger score, then larger second score, then smaller number in the item's id, then the id by code point.

Defined results. Rows with a null group, item or score take no part. An item counts once per group (its best row).
Groups with fewer than N items give all of them. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid import session

_COLUMNS = ["grp", "item", "score", "second", "number"]
SCHEMA = "grp string, item string, score double, second long, number decimal(38,0)"


def _best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    ordered = rows.sort_values(["grp", "score", "second", "number", "item"], ascending=[True, False, False, True, True], kind="stable")
    return ordered[ordered.groupby("grp", sort=False).cumcount().to_numpy() < n]


def _opened(uri: str) -> pq.ParquetFile:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return pq.ParquetFile(where.open_input_file(path))


def best_of_file(uri: str, n: int) -> Iterator[pd.DataFrame]:
    """The N best rows of each group in a file that is sorted by group.

    A group that is neither the first nor the last of its row group lies in it wholly, so it is done at once; only the
    groups at the ends of row groups are kept and merged, and only those have an N-th score to skip by.
    """
    return _Reader(uri, n).run()


class _Reader:
    """Reads one file; ``read`` and ``skipped`` count its row groups."""

    def __init__(self, uri: str, n: int) -> None:
        self.file, self.n, self.read, self.skipped = _opened(uri), n, 0, 0
        self.kept: dict[str, pd.DataFrame] = {}
        self.nth: dict[str, float] = {}

    def below(self, top: float, groups: list[str]) -> bool:
        return all(top < self.nth.get(g, -np.inf) for g in groups)

    def heads(self) -> list[tuple[float, int, list[str] | None]]:
        """(largest score, row group, first and last group) of every row group, largest score first."""
        names = self.file.schema_arrow.names
        score_at, grp_at, out = names.index("score"), names.index("grp"), []
        for k in range(self.file.num_row_groups):
            meta = self.file.metadata.row_group(k)
            score, grp = meta.column(score_at).statistics, meta.column(grp_at).statistics
            ends = sorted({grp.min, grp.max}) if grp is not None and grp.has_min_max else None
            out.append((score.max if score is not None and score.has_min_max else np.inf, k, ends))
        return sorted(out, key=lambda h: (-h[0], h[1]))

    def run(self) -> Iterator[pd.DataFrame]:
        for top, k, ends in self.heads():
            if ends is not None and self.below(top, ends) and (len(ends) == 1 or self.below(top, pc.unique(self.file.read_row_group(k, ["grp"])["grp"]).to_pylist())):
                self.skipped += 1
                continue
            self.read += 1
            rows = self.file.read_row_group(k, _COLUMNS).to_pandas()
            grp = rows["grp"].to_numpy()
            inner = (grp != grp[0]) & (grp != grp[-1])
            if inner.any():
                yield _best(rows[inner], self.n)
            for g in {grp[0], grp[-1]}:
                mine = rows[grp == g]
                best = _best(pd.concat([self.kept[g], mine]) if g in self.kept else mine, self.n)
                self.kept[g] = best
                if len(best) == self.n:
                    self.nth[g] = float(best["score"].iloc[-1])
        yield from self.kept.values()


#: Rows of a row group: large groups have to span several, as only whole row groups can be skipped.
ROW_GROUP = 4096


def clustered(rows: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """Write the valid (grp, item, score, second) rows, an item once per group, clustered by group and score."""
    number = F.regexp_extract("item", "([0-9]+)", 1).try_cast("decimal(38,0)")
    valid = rows.filter("grp is not null and item is not null and score is not null").select("grp", "item", F.col("score").cast("double").alias("score"), F.coalesce(F.col("second").cast("long"), F.lit(-1)).alias("second"))
    once = valid.groupBy("grp", "item").agg(F.max(F.struct("score", "second")).alias("s")).select("grp", "item", "s.score", "s.second", F.coalesce(number, F.lit(0).cast("decimal(38,0)")).alias("number"))
    # written first, as range partitioning reads its input twice
    held = session.cut(once, "scored")
    ordered = held.repartitionByRange("grp", F.desc("score"), "item").sortWithinPartitions("grp", F.desc("score"))
    ordered.write.options(**{"parquet.block.row.count.limit": str(row_group), "parquet.page.row.count.limit": str(row_group)}).parquet(path)


def _tasks(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of the clustered table: file names, not data, dealt out without an exchange."""
    return spark.createDataFrame([(u,) for u in session.parts(spark, path)], "uri string")


def best_of(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(grp, rnk, item, score, second) of a clustered table."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["uri"]:
                yield from best_of_file(uri, n)

    kept = _tasks(spark, path).mapInPandas(read, SCHEMA)
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("score"), F.desc("second"), "number", "item"))
    return kept.withColumn("rnk", rank).filter(F.col("rnk") <= n).select("grp", "rnk", "item", "score", "second")


def skipping(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(file, row_groups, read, skipped) of each file of a clustered table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["uri"]:
                reader = _Reader(uri, n)
                for _ in reader.run():
                    pass
                yield pd.DataFrame({"file": [uri.rsplit("/", 1)[-1]], "row_groups": [reader.file.num_row_groups], "read": [reader.read], "skipped": [reader.skipped]})

    return _tasks(spark, path).mapInPandas(count, "file string, row_groups long, read long, skipped long")


def top_n(rows: DataFrame, n: int, row_group: int = ROW_GROUP) -> DataFrame:
    """(grp, rnk, item, score, second) of (grp, item, score, second) rows, whose clustered table is kept in the shared folder."""
    return best_of(rows.sparkSession, kept_table(rows, row_group), n)


def kept_table(rows: DataFrame, row_group: int = ROW_GROUP, label: str = "clustered") -> str:
    """Path of the clustered table of ``rows``; ``label`` has to name how they are made from their files."""
    return session.kept(rows, f"{label}-{row_group}", lambda path: clustered(rows, path, row_group))
