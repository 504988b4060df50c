"""Per-key results although a few keys hold most rows (problem 6).

Method: multi-level tree aggregation. The input is taken in chunks of ``chunk_rows`` rows as it is read; each chunk is combined
where it lies, without an exchange (Arrow's group-by, as Spark's own partial aggregation ends at the task, not at a
chunk), and the states are written. A key with at most ``fan_in`` states is merged at once. The others, the hot
ones, are merged in rounds, each joining ``fan_in`` neighbouring chunks, until one state per key is left: no task ever
receives more than ``fan_in`` states of a key, the number of rounds is the logarithm of the number of chunks, and only
hot keys, which are few, go through them. How rows fall into chunks never changes a result, as states merge in any order,
so retried tasks are safe.

Defined results. A null key is a key of its own (null-safe grouping). Repeated rows all count. An empty table gives no
rows. Extra columns are ignored. Null values are ignored by sum, min and max, and not counted by ``count_of``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import session

CHUNK_ROWS, FAN_IN = 1 << 16, 8
#: Hot keys that are broadcast at most; more are joined by key.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class State:
    """A mergeable state: its name, the value it is made from, Arrow's and Spark's aggregate that make it from rows, and the one that merges it."""

    name: str
    value: Column
    arrow: str
    make: Callable[[str], Column]
    merge: Callable[[str], Column]


def rows_of(name: str) -> State:
    return State(name, F.lit(1).cast("long"), "sum", F.sum, F.sum)


def count_of(name: str, value: Column) -> State:
    return State(name, value.isNotNull().cast("long"), "sum", F.sum, F.sum)


def sum_of(name: str, value: Column) -> State:
    return State(name, value, "sum", F.sum, F.sum)


def min_of(name: str, value: Column) -> State:
    return State(name, value, "min", F.min, F.min)


def max_of(name: str, value: Column) -> State:
    return State(name, value, "max", F.max, F.max)


def combined(df: DataFrame, keys: list[str], states: list[State], chunk_rows: int) -> DataFrame:
    """(keys, states, __part, __seq): the states of every chunk."""
    from pyspark.sql.pandas.types import to_arrow_type

    values = df.select(*[F.col(f"`{k}`") for k in keys], *[s.value.alias(f"__v{i}") for i, s in enumerate(states)])
    made = values.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[s.make(f"__v{i}").alias(s.name) for i, s in enumerate(states)]).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made)
    types = [to_arrow_type(f.dataType) for f in made]
    whats = [(f"__v{i}", s.arrow) for i, s in enumerate(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, waiting, n = TaskContext.get().partitionId(), 0, [], 0

        def chunk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            told = rows.group_by(keys, use_threads=False).aggregate(whats)
            columns = [told[k] for k in keys] + [told[f"{v}_{how}"] for v, how in whats]
            columns = [c.combine_chunks().cast(t) for c, t in zip(columns, types, strict=True)]
            place = [pa.array([x] * len(told), pa.int64()) for x in (part, seq)]
            yield from pa.table([*columns, *place], names=[f.name for f in made] + ["__part", "__seq"]).combine_chunks().to_batches()

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, chunk_rows - n)
                waiting.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == chunk_rows:
                    yield from chunk(pa.Table.from_batches(waiting))
                    seq, waiting, n = seq + 1, [], 0
        if waiting:
            yield from chunk(pa.Table.from_batches(waiting))

    return values.mapInArrow(run, f"{kinds}, __part long, __seq long")


def tree_aggregate(df: DataFrame, key: str | list[str], states: list[State], fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per value of ``key`` (a column or several) with the merged states."""
    keys = [key] if isinstance(key, str) else key
    by = [F.col(f"`{k}`") for k in keys]
    merge = [s.merge(s.name).alias(s.name) for s in states]
    level = session.cut(combined(df, keys, states, chunk_rows), "chunk-states")
    last = level.agg(F.max("__part").alias("part"), F.max("__seq").alias("seq")).first()
    if last["part"] is None or (last["part"] + 1) * (last["seq"] + 1) <= fan_in:  # no key can have more states
        return level.groupBy(*by).agg(*merge)
    chunks = (last["part"] + 1) * (last["seq"] + 1)
    numbered = level.withColumn("__chunk", F.col("__seq") * F.lit(last["part"] + 1) + F.col("__part")).drop("__part", "__seq")
    many = session.cut(level.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > fan_in).select(*[c.alias(f"__k{i}") for i, c in enumerate(by)]), "hot-keys")
    few = many.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    met = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)])
    side = F.broadcast(many) if few else many
    hot = numbered.join(side, met, "left_semi")
    while chunks > fan_in:
        hot = hot.groupBy(*by, F.floor(F.col("__chunk") / F.lit(fan_in)).alias("__chunk")).agg(*merge)
        chunks = -(-chunks // fan_in)
    cold = numbered.join(side, met, "left_anti")
    return cold.groupBy(*by).agg(*merge).unionByName(hot.groupBy(*by).agg(*merge))


def hot_keys(df: DataFrame, key: str, percent: int = 2, within: str | None = None, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(hot_key, n, total) of the non-null keys that hold at least ``percent`` of 100 rows, all rows being the total.

    ``within`` names a column of few values, such as the table that rows are of; keys and totals are then of each, and it is kept.
    """
    group = [within] if within else []
    counted = session.cut(tree_aggregate(df.select(*group, key), [*group, key], [rows_of("n")], fan_in, chunk_rows), "key-counts")
    total = counted.groupBy(*group).agg(F.sum("n").alias("total"))
    # a row for each value of ``within``
    whole = counted.join(F.broadcast(total), group) if group else counted.withColumn("total", F.lit(total.first()[0] or 0).cast("long"))
    return whole.filter((F.col("n") * 100 >= F.col("total") * percent) & F.col(f"`{key}`").isNotNull()).select(*group, F.col(f"`{key}`").alias("hot_key"), "n", "total")
