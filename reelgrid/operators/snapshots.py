"""What changed between full snapshots (problem 4).

Method. Snapshots are kept: ``Kept`` holds every delivery as one file per range of keys, sorted by key, the ranges being
the same for all deliveries. A new delivery is reduced to its last loaded row per key (map-side combined), placed into the
ranges and written once; older ones are not touched. For the changes, one task per range and pair of consecutive
deliveries streams both files in batches and walks them with two pointers: the smaller of the two last keys read so far bounds
what can be compared, the rest waits for the next batch. Nothing is exchanged or sorted for that, and a
task holds two batches, however large the snapshots are.

Defined results. The first snapshot yields nothing. Null is a value of its own: null to number is a change, null to null
is none; a rating that is not a number counts as null. Ratings are compared at one decimal. Of several rows of a key in a snapshot the last loaded counts, of equally
late ones the one with the larger values. Rows without a key or snapshot number have no identity and are left out. An
empty table, or one snapshot, gives no rows. A delivery that is kept already is not replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import session

CHANGES = "snapshot_no int, tconst string, change_kind string, old_rating double, new_rating double, old_votes int, new_votes int"
#: Keys, first by hash, that fit the ranges' bounds, for each range; every key is placed, the bounds only balance.
SAMPLED = 50
BATCH = 1 << 16


def last_loaded(snapshots: DataFrame) -> DataFrame:
    """One row (snapshot_no, tconst, rating, votes) per delivered record."""
    state = F.struct("loaded_at", F.round("averagerating", 1).alias("rating"), F.col("numvotes").alias("votes"))
    best = snapshots.filter("tconst is not null and snapshot_no is not null").groupBy("snapshot_no", "tconst").agg(F.max(state).alias("s"))
    return best.select("snapshot_no", "tconst", "s.rating", "s.votes")


def range_of(key: Column, bounds: list[str]) -> Column:
    """Number of the bounds that are not above a key, by halving."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), within(low, mid)).otherwise(within(mid + 1, high))

    return within(0, len(bounds))


class Kept:
    """Deliveries kept below a path, by delivery and range."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def bounds(self) -> list[str]:
        return [r[0] for r in self.spark.read.schema("bound string").parquet(f"{self.path}/bounds").orderBy("bound").collect()]

    def files(self) -> dict[int, dict[int, str]]:
        """File of each delivery and range; names only."""
        out: dict[int, dict[int, str]] = {}
        for uri in session.parts(self.spark, f"{self.path}/rows"):
            place = re.search(r"snapshot_no=(-?\d+)/rng=(\d+)/", uri)
            if place is None or int(place[2]) in out.setdefault(int(place[1]), {}):
                raise ValueError(f"{uri} is not the one file of its range")
            out[int(place[1])][int(place[2])] = uri
        return out

    def add(self, snapshots: DataFrame, ranges: int | None = None) -> None:
        """Keep the deliveries of a table that are not kept yet; the first call settles the ranges."""
        begun = session.exists(self.spark, f"{self.path}/bounds")
        have = sorted(self.files()) if begun else []
        rows = last_loaded(snapshots.filter(~F.col("snapshot_no").isin(have)) if have else snapshots)
        if not begun:
            held = session.written(rows, "deliveries")
            rows = self.spark.read.schema(rows.schema).parquet(held)
            n = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            sample = sorted({r[0] for r in rows.select("tconst").orderBy(F.xxhash64("tconst"), "tconst").limit(SAMPLED * n).collect()})
            cuts = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []
            self.spark.createDataFrame([(b,) for b in cuts], "bound string").coalesce(1).write.parquet(f"{self.path}/bounds")
        placed = rows.withColumn("rng", range_of(F.col("tconst"), self.bounds())).repartition("snapshot_no", "rng")
        placed.sortWithinPartitions("snapshot_no", "rng", "tconst").write.partitionBy("snapshot_no", "rng").mode("append").parquet(f"{self.path}/rows")
        if not begun:
            session.dropped(self.spark, held)

    def changes(self) -> DataFrame:
        """CHANGES between all consecutive deliveries."""
        files = self.files()
        tasks = [(new, files[old].get(k), files[new].get(k)) for old, new in pairwise(sorted(files)) for k in sorted({*files[old], *files[new]})]
        # names of files; they are dealt out as they are, without an exchange
        listed = self.spark.createDataFrame(tasks, "snapshot_no int, old string, new string")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for no, old, new in zip(b["snapshot_no"], b["old"], b["new"], strict=True):
                    for part in merged(batches_of(old), batches_of(new)):
                        yield part.assign(snapshot_no=np.int32(no))[["snapshot_no", "tconst", "change_kind", "old_rating", "new_rating", "old_votes", "new_votes"]]

        return listed.mapInPandas(run, CHANGES)


def batches_of(uri: str | None) -> Iterator[pd.DataFrame]:
    """(tconst, rating, votes) of a kept file, in its order, a batch at a time."""
    if uri is None:
        return
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    with where.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(BATCH, columns=["tconst", "rating", "votes"]):
            yield batch.to_pandas().astype({"rating": "float64", "votes": "float64"})


def merged(old: Iterator[pd.DataFrame], new: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes between two streams that are sorted by key, which is unique in each."""
    sides: list[Iterator[pd.DataFrame] | None] = [old, new]
    held: list[pd.DataFrame | None] = [None, None]
    while True:
        for k in (0, 1):
            while sides[k] is not None and (held[k] is None or held[k].empty):
                held[k] = next(sides[k], None)
                if held[k] is None:
                    sides[k] = None
        ends = [held[k]["tconst"].iloc[-1] for k in (0, 1) if sides[k] is not None]
        if not ends:
            return
        # a side that is still read bounds what can be compared; one that has ended does not
        bound, ready = min(ends), []
        for k in (0, 1):
            if held[k] is None:
                ready.append(None)
                continue
            n = int(np.searchsorted(held[k]["tconst"].to_numpy(object), bound, "right"))
            ready.append(held[k].iloc[:n])
            held[k] = held[k].iloc[n:]
        yield compared(*ready)


def compared(a: pd.DataFrame | None, b: pd.DataFrame | None) -> pd.DataFrame:
    """Changes between two pieces of the same key range."""
    none = pd.DataFrame({"tconst": pd.Series(dtype=object), "rating": pd.Series(dtype="float64"), "votes": pd.Series(dtype="float64")})
    both = (none if a is None else a).merge(none if b is None else b, "outer", "tconst", suffixes=("_a", "_b"), indicator="side")
    same = lambda c: (both[f"{c}_a"] == both[f"{c}_b"]) | (both[f"{c}_a"].isna() & both[f"{c}_b"].isna())
    kind = np.select([both["side"] == "right_only", both["side"] == "left_only", ~(same("rating") & same("votes"))], ["added", "removed", "changed"], "")
    out = pd.DataFrame({"tconst": both["tconst"], "change_kind": kind, "old_rating": both["rating_a"], "new_rating": both["rating_b"], "old_votes": both["votes_a"].astype("Int32"), "new_votes": both["votes_b"].astype("Int32")})
    return out[kind != ""]


def changes(snapshots: DataFrame) -> DataFrame:
    """CHANGES of a table (snapshot_no, tconst, averagerating, numvotes, loaded_at), whose deliveries are kept in the shared folder."""
    spark = snapshots.sparkSession
    path = session.kept(snapshots, "snapshots", lambda p: Kept(spark, p).add(snapshots))
    return Kept(spark, path).changes()
