"""Mixing sources to target weights (problem 9).

Method: entropy balancing. Every document d of source s with t tokens gets the rate r(d) = min(cap_s, exp(a_s * t / mean_s)):
of all rates between zero and the cap that give the source its share of the tokens, these are closest in relative entropy
to using each document once. So a source that is too large gives up tokens where one document costs most of them, and one
that is too small repeats its long documents first. The cap is a part of the convex dual, whose gradient in a_s is the
tokens reached less those wanted. It is solved by Newton steps for all sources at once, held in a bracket; gradient and
Hessian are sums over all documents. Documents of one source and length have one rate, so the sums are taken over a
table of (source, tokens, number), which is made once and exact. Only some numbers for each source come to the driver. A
source without a solution within ``tolerance`` is an error.

Rates become copies: the whole part is kept, and the fractional parts are filled in the order of a hash of the document's
key by its fraction (sequential Poisson sampling) until the source's tokens are reached. The threshold of that
order is found by histograms whose running sums stay in Spark, refined until one document decides. A document larger than
what is left is passed over and the search goes on behind it, among those that fit. The search ends when the rest is
below ``close`` of the goal or no document fits into it, so a share is missed by less than the smallest document left.

The total is the largest at which every source can have its share under its cap, unless a smaller one is given.

Defined results. Documents of null or unlisted sources, and texts without tokens, are in no selection. Repeated texts are
documents of their own. A listed source without tokens makes the mix impossible: a ValueError names it, unless its share is
zero. An empty mix gives no rows. Extra columns are ignored. The result is deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid import session

BINS = 4096
#: Sources of a mix, which is configuration, at most; numbers of this many rows are broadcast and come to the driver.
MOST_SOURCES = 10_000
#: A step of the bracket halves it, so that a double is exhausted before this.
MOST_STEPS = 2_000
#: Stands for a source that has to be used up to its cap: every document reaches it.
FULL = 1e300


def _with(df: DataFrame, kinds: str, values: dict[str, tuple]) -> DataFrame:
    """``df`` with numbers of each row's source; rows of other sources go. The mix is a small table, as it is configuration."""
    numbers = df.sparkSession.createDataFrame([(s, *v) for s, v in values.items()], f"source string, {kinds}")
    return df.join(F.broadcast(numbers), "source")


_PARAMS = "__a double, __mean double, __log_cap double"


def _power() -> Column:
    """Exponent of a document's rate before its cap."""
    return F.col("__a") * F.col("tokens") / F.col("__mean")


def _rate() -> Column:
    return F.exp(F.least(_power(), F.col("__log_cap")))


def tilts(lengths: DataFrame, goal: dict[str, float], caps: dict[str, int], sizes: dict[str, tuple[int, int, int]], tolerance: float) -> dict[str, float]:
    """a_s of every source of ``goal``; ``lengths`` has (source, tokens, n), ``sizes`` tokens, documents and smallest length."""
    mean = {s: sizes[s][0] / sizes[s][1] for s in goal}
    a = {s: FULL if goal[s] >= caps[s] * sizes[s][0] * (1 - 1e-12) else 0.0 for s in goal}
    # the root lies below the tilt at which the shortest document has its cap
    high = {s: math.log(caps[s]) * mean[s] / sizes[s][2] + 1e-9 for s in goal}
    low: dict[str, float] = dict.fromkeys(goal, -math.inf)
    going = sorted(s for s in goal if a[s] != FULL)
    for _ in range(MOST_STEPS):
        if not going:
            return a
        t, x = F.col("tokens") * F.col("n"), F.col("tokens") / F.col("__mean")
        slope = F.when(_power() < F.col("__log_cap"), t * x * _rate()).otherwise(0.0)
        rows = _with(lengths, _PARAMS, {s: (a[s], mean[s], math.log(caps[s])) for s in going}).groupBy("source").agg(F.sum(t * _rate()).alias("g"), F.sum(slope).alias("h")).collect()
        now, going = {r["source"]: (r["g"] - goal[r["source"]], r["h"]) for r in rows}, []
        for s, (g, h) in sorted(now.items()):
            if abs(g) <= tolerance * goal[s] or high[s] - low[s] <= 1e-15 * abs(a[s]):
                if abs(g) > 1e-6 * goal[s]:
                    raise ValueError(f"no rates give {s} its share")
                continue
            low[s], high[s] = (a[s], high[s]) if g < 0 else (low[s], a[s])
            step = a[s] - g / h if h > 0 else math.inf
            inside = low[s] < step < high[s]
            a[s] = step if inside else (low[s] + high[s]) / 2 if low[s] > -math.inf else 2 * high[s] - 1
            going.append(s)
    raise ValueError(f"no rates found for {', '.join(going)}")


def rates(counted: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, tolerance: float = 1e-10) -> tuple[DataFrame, dict[str, float]]:
    """(doc_id, source, tokens, cap, rate) of the mix, and the tokens that each source is to have.

    ``counted`` holds (doc_id, source, tokens) of the documents that have tokens; it is read once for its lengths.
    """
    listed = _with(counted.select("doc_id", "source", "tokens"), "__any int", {s: (0,) for s in targets})
    lengths = session.cut(listed.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = {r["source"]: (r["t"], r["n"], r["least"]) for r in lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n"), F.min("tokens").alias("least")).collect()}
    wanted = {s: v for s, v in targets.items() if v[0] > 0 and v[1] > 0}
    if short := [s for s in wanted if s not in sizes]:
        raise ValueError(f"no tokens in {', '.join(short)}")
    most = min((sizes[s][0] * cap / share for s, (share, cap) in wanted.items()), default=0.0)
    total = most if total is None else min(total, most)
    goal = {s: share * total for s, (share, _) in wanted.items()}
    caps = {s: cap for s, (_, cap) in wanted.items()}
    a = tilts(lengths, goal, caps, sizes, tolerance)
    rated = _with(counted.select("doc_id", "source", "tokens"), f"{_PARAMS}, cap int", {s: (a[s], sizes[s][0] / sizes[s][1], math.log(caps[s]), caps[s]) for s in wanted})
    return rated.select("doc_id", "source", "tokens", "cap", _rate().alias("rate")), goal


def copies(rated: DataFrame, goal: dict[str, float], close: float = 1e-4) -> DataFrame:
    """(doc_id, source, tokens, copies) with the rates rounded to copies, documents without any left out."""
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.col("cap")).cast("int")
    part = F.when(whole < F.col("cap"), F.greatest(F.col("rate") - whole, F.lit(0.0))).otherwise(0.0)
    # a uniform number in (0, 1) from the document's key; a larger fraction comes earlier
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    place = F.when(F.col("part") > 1e-9, 1 - F.exp(-draw / F.col("part"))).otherwise(F.lit(2.0))
    keyed = rated.withColumns({"whole": whole, "part": part}).withColumn("place", place).select("doc_id", "source", "tokens", "whole", "place")
    if not goal:
        return keyed.select("doc_id", "source", "tokens", F.col("whole").alias("copies")).limit(0)
    had = {r["source"]: r["t"] for r in keyed.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("t")).collect()}
    rest = {s: goal[s] - had.get(s, 0) for s in goal}
    # what is taken of each source: everything placed in [from, to) of at most so many tokens
    taken: dict[str, list[tuple[float, float, float]]] = {s: [] for s in goal}
    at, low, high, fits = dict.fromkeys(goal, 0.0), dict.fromkeys(goal, 0.0), dict.fromkeys(goal, 1.0), dict(rest)
    going = [s for s in goal if rest[s] > close * goal[s]]
    while going:
        found = _first_too_many(keyed, {s: (low[s], high[s], rest[s], fits[s]) for s in going})
        ended = []
        for s in going:
            if s not in found:  # all that is left here fits
                taken[s].append((at[s], high[s], fits[s]))
                ended.append(s)
                continue
            before, lo, hi, n = found[s]
            rest[s] -= before
            if n > 1 and hi - lo > 1e-15:
                low[s], high[s] = lo, hi
                continue
            # one document is too many: it is passed over, and those behind it that fit are sought
            taken[s].append((at[s], lo, fits[s]))
            at[s], low[s], high[s], fits[s] = hi, hi, 1.0, rest[s]
            if rest[s] <= close * goal[s]:
                ended.append(s)
        going = [s for s in going if s not in ended]
    ends = _with(keyed, "__taken array<struct<lo: double, hi: double, most: double>>", {s: (taken[s],) for s in goal})
    more = F.exists("__taken", lambda g: (F.col("place") >= g["lo"]) & (F.col("place") < g["hi"]) & (F.col("tokens") <= g["most"]))
    return ends.withColumn("copies", F.col("whole") + more.cast("int")).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def _first_too_many(keyed: DataFrame, ranges: dict[str, tuple[float, float, float, float]]) -> dict[str, tuple[float, float, float, int]]:
    """Of each source the first bin of its range with which the documents that fit exceed the rest: tokens before it, its bounds and number of documents."""
    inside = _with(keyed, "__lo double, __hi double, __rest double, __fits double", ranges).filter("place >= __lo and place < __hi and tokens <= __fits")
    width = (F.col("__hi") - F.col("__lo")) / BINS
    bin_ = F.least(F.floor((F.col("place") - F.col("__lo")) / width), F.lit(BINS - 1)).cast("int")
    bins = inside.groupBy("source", bin_.alias("bin")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.first("__lo").alias("lo"), F.first(width).alias("width"), F.first("__rest").alias("rest"), F.first("__hi").alias("top"))
    # at most BINS rows of a source meet here
    run = bins.withColumn("sum", F.sum("t").over(W.partitionBy("source").orderBy("bin"))).filter("sum > rest")
    first = run.groupBy("source").agg(F.min(F.struct("bin", "t", "n", "lo", "width", "sum", "top")).alias("b"))
    out = {}
    for r in first.collect():
        b = r["b"]
        lo = b["lo"] + b["bin"] * b["width"]
        out[r["source"]] = (b["sum"] - b["t"], lo, b["top"] if b["bin"] == BINS - 1 else lo + b["width"], b["n"])
    return out


def mixture(counted: DataFrame, mix: DataFrame, total: float | None = None) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    """The selection (doc_id, source, tokens, copies) and the targets of a mix (source, target_share, max_repeats)."""
    listed = mix.filter("source is not null").limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"a mix lists {MOST_SOURCES} sources at most")
    targets = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in listed}
    held = session.cut(counted.filter("source is not null and tokens > 0"), "tokens")
    rated, goal = rates(held, targets, total)
    return copies(rated, goal), targets


def reached(selection: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_copies) of each listed source."""
    spark = selection.sparkSession
    used = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    listed = spark.createDataFrame([(s, float(v[0])) for s, v in targets.items()], "source string, target_share double")
    # as many rows as the mix lists
    rows = listed.join(F.broadcast(used), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    everything = rows.agg(F.sum("tokens").alias("all_tokens")).withColumn("__one", F.lit(1))
    share = F.col("tokens") / F.nullif(F.col("all_tokens"), F.lit(0).cast("long"))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(everything), "__one").select("source", "target_share", share.alias("reached_share"), "tokens", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
