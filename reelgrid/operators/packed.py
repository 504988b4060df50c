"""Several values packed in one field (problem 1).

Method. Ordinary characters of a field are masked, which leaves its *delimiter skeleton* (``Drama, "Music, Live"`` has
``a, "a, a"``). Every distinct skeleton gets its splitting rule once, from a small quote-aware resolver: a list of
(first token, number of tokens, quoted) triples. The rules are joined to the rows by skeleton and the values are cut out
by position, inside the JVM. Distinct skeletons are few (packed fields are short lists), but nothing guarantees it, so
their number and bytes are measured and they are broadcast whole below a bound only; beyond it the most frequent ones are broadcast
and the rows of the rare ones are joined by skeleton.

Defined results. A null, empty or blank field has no values. Empty places (``a,,b``) are no values and do not count as
positions. A value standing twice counts at both places. Blanks around a value and the quotes around it do not belong to
it; ``""`` inside quotes is one quote. A quote that is never closed, or is followed by more text, is an ordinary
character. Texts of any length are split whole. Columns of the input are never renamed; extra columns pass through
``split_packed`` unless they have the name of the output column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid import session

#: Blanks besides those of the regular expressions' ``\s``.
_WIDE = "\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
_BLANK = f"[\\s&&[^\\u0002]]|[{_WIDE}]"
_SPECIAL = f",;|/\\u0002\"\\s{_WIDE}"
TOKENS = f"(?s)[^{_SPECIAL}]+|(?:{_BLANK})+|."

#: What divides values. ``text`` values may hold single blanks and slashes; ``id`` values hold neither.
KINDS = ("text", "id")

RULE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("quoted", T.BooleanType())]))
RULES = T.StructType([T.StructField("rule_kind", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("n", T.LongType()), T.StructField("rule", RULE)])
#: Rules that are broadcast where all are too many: so many of the most frequent ones, of skeletons up to so many characters.
FREQUENT, FREQUENT_LENGTH = 20_000, 400


def skeleton(field: Column) -> Column:
    """Runs of ordinary characters become ``a``, runs of blanks one blank; every other character stays."""
    masked = F.regexp_replace(field, f"[^{_SPECIAL}]+", "a")
    return F.regexp_replace(masked, f"(?:{_BLANK})+", " ")


def resolve(shape: str, kind: str) -> list[tuple[int, int, bool]]:
    """The splitting rule of a skeleton: where each value lies, in tokens, and whether it is quoted."""
    n, found, i, start = len(shape), [], 0, 0

    def divides(at: int) -> bool:
        c = shape[at]
        if c in ",;|\x02":
            return True
        if kind == "id":
            return c in "/ "
        return c == "/" and 0 < at < n - 1 and shape[at - 1] == " " and shape[at + 1] == " "

    def plain(first: int, last: int) -> None:
        while first < last and shape[first] == " ":
            first += 1
        while last > first and shape[last - 1] == " ":
            last -= 1
        if last > first:
            found.append((first, last - first, False))

    while i < n:
        if shape[i] == '"' and not shape[start:i].strip(" "):
            close = i + 1
            while close < n:
                if shape[close] != '"':
                    close += 1
                elif close + 1 < n and shape[close + 1] == '"':
                    close += 2
                else:
                    break
            after = close + 1
            while after < n and shape[after] == " " and not divides(after):
                after += 1
            if close < n and (after >= n or divides(after)):
                first, last = i + 1, close
                while first < last and shape[first] == " ":
                    first += 1
                while last > first and shape[last - 1] == " ":
                    last -= 1
                if last > first:
                    found.append((first, last - first, True))
                i = start = after + 1
                continue
        if divides(i):
            plain(start, i)
            start = i + 1
        i += 1
    plain(start, n)
    return found


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rules = [[{"start": s, "length": k, "quoted": q} for s, k, q in resolve(x, kind)] for kind, x in zip(b["rule_kind"], b["skeleton"], strict=True)]
        yield pd.DataFrame({"rule_kind": b["rule_kind"], "skeleton": b["skeleton"], "n": b["n"], "rule": rules})


def rules_of(shapes: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> tuple[DataFrame, bool]:
    """Rules of the distinct (rule_kind, skeleton) rows, and whether they are few enough to be broadcast."""
    counted = shapes.groupBy("rule_kind", "skeleton").agg(F.count(F.lit(1)).alias("n"))
    rules = session.cut(counted.mapInPandas(_resolved, RULES), "packed-rules")
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("skeleton") + 12 * F.size("rule")), F.lit(0)).alias("b")).first()
    return rules, size["n"] <= most_rows and size["b"] <= most_bytes


def _ruled(df: DataFrame, field: str, kind: str | Column, **bounds: int) -> DataFrame:
    """``df`` with the column __rule of its field."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows = df.withColumns({"__kind": kind, "__shape": F.coalesce(skeleton(F.col(f"`{field}`")), F.lit(""))})
    rules, few = rules_of(rows.select(F.col("__kind").alias("rule_kind"), F.col("__shape").alias("skeleton")), **bounds)
    named = lambda r: r.select(F.col("rule_kind").alias("__kind"), F.col("skeleton").alias("__shape"), F.col("rule").alias("__rule"))
    keys = ["__kind", "__shape"]
    if few:
        return rows.join(F.broadcast(named(rules)), keys, "left").drop(*keys)
    # frequent skeletons, which would be hot keys of a join, are broadcast; those left are rare, each in fewer rows than any of these
    frequent = session.cut(rules.filter(F.length("skeleton") <= FREQUENT_LENGTH).orderBy(F.desc("n"), "rule_kind", "skeleton").limit(FREQUENT), "frequent-rules")
    first = rows.join(F.broadcast(named(frequent)), keys, "left")
    rare = rules.join(F.broadcast(frequent.select("rule_kind", "skeleton")), ["rule_kind", "skeleton"], "left_anti")
    return first.filter("__rule is not null").unionByName(first.filter("__rule is null").drop("__rule").join(named(rare), keys, "left")).drop(*keys)


def _values(ruled: DataFrame, field: str, into: str) -> DataFrame:
    """The values of a ruled field, cut out by position."""
    tokens = F.regexp_extract_all(F.col(f"`{field}`"), F.lit(TOKENS), F.lit(0))
    cut = lambda r: F.array_join(F.slice(F.col("__tokens"), r["start"] + 1, r["length"]), "")
    value = lambda r: F.when(r["quoted"], F.replace(cut(r), F.lit('""'), F.lit('"'))).otherwise(cut(r))
    return ruled.withColumn("__tokens", tokens).withColumn(into, F.coalesce(F.transform("__rule", value), F.array().cast("array<string>"))).drop("__rule", "__tokens")


def split_packed(df: DataFrame, field: str, kind: str | Column = "text", into: str = "vals", **bounds: int) -> DataFrame:
    """``df`` with the array column ``into``: the single values of ``field`` in written order, empty without any.

    ``kind`` is one of KINDS, or a column of them where rows differ.
    """
    return _values(_ruled(df, field, kind, **bounds), field, into)


def packed_values(fields: DataFrame, least: int = 1) -> DataFrame:
    """One row per single value (field, rec_key, pos, val) of (field, rule_kind, rec_key, packed) rows.

    Repeated rows count once: rows are made distinct as value lists, before they are exploded. ``least``: fields with
    fewer values are left out.
    """
    # a rule has an entry for each value, so fields with too few go before any is cut out
    enough = _ruled(fields, "packed", F.col("rule_kind")).filter(F.size("__rule") >= max(1, least))
    lists = _values(enough, "packed", "vals").select("field", "rec_key", "vals").distinct()
    return lists.select("field", "rec_key", F.posexplode("vals").alias("pos", "val")).select("field", "rec_key", (F.col("pos") + 1).alias("pos"), "val")
