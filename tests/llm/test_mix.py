"""Mixing sources to target weights."""

import random

import pytest

from reelgrid.llm import mix

SOURCES = "source string, target_share double, max_repeats int, doc_id int"
DOCS = "doc_id long, source string, tokens long, share double"


def docs(spark, seed=0, long=False):
    draw = random.Random(seed)
    sizes = {"a": 1500, "b": 600, "c": 60, "unlisted": 100}
    data = [(k * 10 + n, s, (20_000 if long and k % 97 == 0 else draw.randrange(1, 400)), 0.5) for n, (s, m) in enumerate(sizes.items()) for k in range(m)]
    return spark.createDataFrame([*data, (9_999_999, None, 50, 0.5), (9_999_998, "a", 0, 0.5)], DOCS)


@pytest.mark.parametrize("long", [False, True])
def test_shares_and_caps(spark, long):
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.3, 2, 1), ("c", 0.2, 5, 1)], SOURCES)
    selection, wanted = mix.mixture(docs(spark, long=long), targets)
    caps = {"a": 1, "b": 2, "c": 5}
    got = selection.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies"] <= caps[r["source"]] and r["tokens"] > 0 for r in got)
    for r in mix.reached(selection, wanted).collect():
        assert abs(r["reached_share"] - r["target_share"]) < (0.02 if long else 0.002)
    if not long:  # long texts are neither favoured nor dropped
        a = [r["tokens"] for r in got if r["source"] == "b"]
        assert 150 < sum(a) / len(a) < 250


def test_deterministic_and_smaller_total(spark):
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.5, 2, 1)], SOURCES)
    one, _ = mix.mixture(docs(spark), targets, total=20_000)
    two, _ = mix.mixture(docs(spark).repartition(7), targets, total=20_000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert abs(sum(r["tokens"] * r["copies"] for r in one.collect()) - 20_000) < 400


def test_equal_lengths(spark):
    same = spark.createDataFrame([(k, "ab"[k % 2], 10, 0.1) for k in range(1000)], DOCS)
    selection, wanted = mix.mixture(same, spark.createDataFrame([("a", 0.25, 3, 1), ("b", 0.75, 3, 1)], SOURCES))
    assert {r["source"]: round(r["reached_share"], 2) for r in mix.reached(selection, wanted).collect()} == {"a": 0.25, "b": 0.75}


def test_missing_source_and_empty_mix(spark):
    with pytest.raises(ValueError, match="gone"):
        mix.mixture(docs(spark), spark.createDataFrame([("gone", 1.0, 1, 1)], SOURCES))
    selection, wanted = mix.mixture(docs(spark), spark.createDataFrame([], SOURCES))
    assert selection.count() == 0 and mix.reached(selection, wanted).count() == 0
    zero, _ = mix.mixture(docs(spark), spark.createDataFrame([("gone", 0.0, 1, 1), ("a", 1.0, 1, 1)], SOURCES))
    assert zero.count() > 0


def brute(lengths, goal, cap):
    """Tilt of one source by bisection, and its rates."""
    mean, low, high = sum(lengths) / len(lengths), -1e4, 1e6
    rate = lambda a, t: cap if a * t / mean > 300 else min(cap, 2.718281828459045 ** (a * t / mean))
    for _ in range(400):
        a = (low + high) / 2
        low, high = (a, high) if sum(t * rate(a, t) for t in lengths) < goal else (low, a)
    return {t: rate((low + high) / 2, t) for t in set(lengths)}


@pytest.mark.parametrize("total", [None, 60_000, 2_000_000])
def test_rates_are_tilted_and_match_brute_force(spark, total):
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 5)}
    data = docs(spark, long=True)
    rated, goal = mix.rates(data.filter("tokens > 0 and source is not null"), targets, total)
    got = {}
    for r in rated.collect():
        got.setdefault(r["source"], []).append((r["tokens"], r["rate"]))
    for s, (_, cap) in targets.items():
        want = brute([t for t, _ in got[s]], goal[s], cap)
        assert abs(sum(t * r for t, r in got[s]) - goal[s]) < 1e-6 * goal[s]
        assert max(abs(r - want[t]) for t, r in got[s]) < 1e-6
        if s != "c" or total == 60_000:
            assert len({round(r, 9) for _, r in got[s]}) > 20


def test_shares_of_many_documents(spark):
    draw = random.Random(3)
    data = spark.createDataFrame([(k, "abc"[k % 7 % 3], draw.randrange(1, 900), 0.1) for k in range(30_000)], DOCS)
    targets = spark.createDataFrame([("a", 0.6, 2, 1), ("b", 0.3, 1, 1), ("c", 0.1, 3, 1)], SOURCES)
    for r in mix.reached(*mix.mixture(data, targets)).collect():
        assert abs(r["reached_share"] - r["target_share"]) < 0.0002
