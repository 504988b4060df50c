"""Items that appear together, against counting every pair."""

import random
from collections import Counter
from itertools import combinations

import pytest

from reelgrid.llm.cooccur import together


def brute(data, shared, lift):
    baskets = {}
    for basket, item in data:
        if basket is not None and item is not None:
            baskets.setdefault(basket, set()).add(item)
    one, two = Counter(), Counter()
    for items in baskets.values():
        one.update(items)
        two.update(combinations(sorted(items), 2))
    n = len(baskets)
    return sorted((a, b, k, one[a], one[b]) for (a, b), k in two.items() if k >= shared and k * n >= lift * one[a] * one[b]), n


@pytest.mark.parametrize("most_items", [1000, 12, 4])
@pytest.mark.parametrize("giants", [0, 2, 6])
def test_against_brute_force(spark, most_items, giants):
    draw = random.Random(giants)
    data = [(f"b{i}", f"i{draw.randrange(40)}") for i in range(400) for _ in range(draw.randrange(1, 6))]
    data += [(f"big{g}", f"i{k}") for g in range(giants) for k in range(0, 40, 2)]
    data += [(f"b{i}", "hot") for i in range(300)] + data[:50] + [(None, "i1"), ("b1", None)]
    want, n = brute(data, 4, 2)
    got = together(spark.createDataFrame([(b, i, 1) for b, i in data], "basket string, item string, shared int"), n, 4, 2, most_items).collect()
    assert sorted((r["item_a"], r["item_b"], r["shared"], r["n_a"], r["n_b"]) for r in got) == want
    assert all(abs(r["lift"] - r["shared"] * n / r["n_a"] / r["n_b"]) < 1e-9 for r in got)


def test_empty(spark):
    assert together(spark.createDataFrame([], "basket string, item string"), 0, 4, 2).count() == 0


def test_planted_pairs_beside_many_giants(spark):
    data = [(f"g{g}", f"i{k:03}") for g in range(5) for k in range(30)] + [(f"s{k}", "x") for k in range(100)]
    got = together(spark.createDataFrame(data, "basket string, item string"), 105, 4, 2, 10)
    assert got.count() == 30 * 29 // 2
