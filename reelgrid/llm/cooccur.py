"""Items that appear together (problem 2).

Method. Items are made distinct per basket, ordered pairs (a < b) are emitted from each basket, their counts are combined
on the map side before the shuffle, and lift and pointwise mutual information follow from the marginals.

Two exact bounds prune items before any pair is made: a pair shares no more baskets than either item has, so items in
fewer than ``least_shared`` baskets are out; and lift is at most baskets / max(n_a, n_b), so items in more than
baskets / ``least_lift`` baskets are out, which removes the hot items that would dominate the pairs.

Baskets with more than ``most_items`` remaining items are *giants* and never emit their pairs. With g giants, a pair
reaches s shared baskets only if at least s - g of them are small, so candidates come from the small baskets (plus, if
g >= s, from the few items that lie in s giants or more, in blocks), and the giants are then counted for the candidates
alone. The result is exact either way.

Defined results. Null items and null baskets take no part in pairs; ``baskets`` is the number given by the caller. Items
compare by code point. Repeated rows count once. Empty input gives no pairs. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid import session

_BIG = "decimal(38,0)"


def _pairs_of_lists(lists: DataFrame) -> DataFrame:
    """(item_a, item_b) of every basket's sorted list, one at a time: no list of pairs is ever held."""
    first = lists.select(F.posexplode("items").alias("at", "item_a"), "items")
    return first.select("item_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"))


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))


def _candidates_beside_giants(kept: DataFrame, sizes: DataFrame, giants: int, least_shared: int, most_items: int) -> DataFrame:
    """(item_a, item_b, shared) where some baskets are giants."""
    big = session.cut(kept.join(sizes.filter(F.col("n") > most_items).select("basket"), "basket", "left_semi"), "giants")
    small = kept.join(sizes.filter(F.col("n") <= most_items).select("basket"), "basket", "left_semi")
    found = _pairs_of_lists(_lists(small)).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("few"))
    candidates = found.filter(F.col("few") >= max(1, least_shared - giants))
    if giants >= least_shared:
        often = big.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_shared).select("item")
        block = F.pmod(F.xxhash64("item"), F.lit(-(-most_items // 8)))
        dense = big.join(often, "item", "left_semi").withColumn("block", block)
        left, right = dense.select("basket", F.col("block").alias("p"), F.col("item").alias("item_a")), dense.select("basket", F.col("block").alias("q"), F.col("item").alias("item_b"))
        blocks = dense.select("basket", "block").distinct()
        squares = blocks.select("basket", F.col("block").alias("p")).join(blocks.select("basket", F.col("block").alias("q")), "basket")
        met = squares.join(left, ["basket", "p"]).join(right, ["basket", "q"]).filter("item_a < item_b").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("m"))
        only = met.filter(F.col("m") >= least_shared).select("item_a", "item_b", F.lit(0).cast("long").alias("few"))
        candidates = candidates.unionAll(only.join(candidates, ["item_a", "item_b"], "left_anti"))
    with_a = candidates.join(big.withColumnRenamed("item", "item_a"), "item_a")
    both = with_a.join(big.withColumnRenamed("item", "item_b"), ["basket", "item_b"]).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("many"))
    return candidates.join(both, ["item_a", "item_b"], "left").select("item_a", "item_b", (F.col("few") + F.coalesce("many", F.lit(0))).alias("shared"))


def together(rows: DataFrame, baskets: int, least_shared: int, least_lift: int, most_items: int = 1000) -> DataFrame:
    """(item_a, item_b, shared, n_a, n_b, baskets, lift, pmi) of the (basket, item) ``rows``."""
    distinct = rows.filter("basket is not null and item is not null").select("basket", "item").distinct()
    marginals = distinct.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    possible = marginals.filter((F.col("n") >= least_shared) & (F.col("n").cast(_BIG) * least_lift <= F.lit(baskets)))
    # items in more than baskets / least_lift baskets number at most rows * least_lift / baskets, some for each item that a basket holds
    hot = marginals.filter(F.col("n").cast(_BIG) * least_lift > F.lit(baskets)).select("item")
    kept = session.cut(distinct.join(F.broadcast(hot), "item", "left_anti").join(possible, "item"), "cooccur")
    sizes = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    giants = sizes.filter(F.col("n") > most_items).count()
    if giants:
        counted = _candidates_beside_giants(kept.select("basket", "item"), sizes, giants, least_shared, most_items)
    else:
        counted = _pairs_of_lists(_lists(kept)).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("shared"))
    enough = counted.filter(F.col("shared") >= least_shared)
    totals = kept.groupBy("item").agg(F.first("n").alias("n"))
    pairs = enough.join(totals.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(totals.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    high = pairs.filter(F.col("shared").cast(_BIG) * F.lit(baskets).cast(_BIG) >= F.col("n_a").cast(_BIG) * F.col("n_b") * least_lift)
    lift = F.col("shared").cast("double") * F.lit(baskets) / (F.col("n_a").cast("double") * F.col("n_b"))
    return high.select("item_a", "item_b", "shared", "n_a", "n_b", F.lit(baskets).cast("long").alias("baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))
