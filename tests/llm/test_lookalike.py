"""Visually identical text."""

import pytest

from reelgrid.llm.lookalike import classes, composed_mapping, confusables, members, mapping, same_looking, same_looking_children, variants

SAME = [
    ("Amélie", "Amélie"), ("ＡＢＣ１", "ABC1"), ("a b", "a b"), ("ab", "a​b"), ("Redine", "Реdine".replace("Р", "R")),
    ("Hope", "Норе"), ("Zeta", "Ζeta"), ("Zoëla", "Zoёla"), ("x　y", "x y"), ("й", "й"), ("Voyage", "οoyage".replace("ο", "V")),
]
OTHER = [("Abc", "abc"), ("é", "e"), ("a-b", "a–b"), ("a b", "ab"), ("a-b", "ab"), ("ß", "ss"), ("ø", "o"), ("l", "I"), ("O", "0"), ("!!!", "—"), ("#12.4", "#1.24")]


#: Pairs by code point: signs that are canonically equal, control characters, marks in another order, half-width kana, signs of width, blanks, letters of other scripts, fonts, ligatures, numerals, hyphens.
ALSO = [
    ("K", "\u212a"), (";", "\u037e"), ("`", "\u1fef"), ("ab", "a\u0001b"), ("a\u0323\u0302", "a\u0302\u0323"), ("\u30ac\u30d1", "\uff76\uff9e\uff8a\uff9f"), ("\u00a2", "\uffe0"), ("a b", "a\u1680b"), ("a", "\u0251"), ("g", "\u0261"),
    ("D", "\u13a0"), ("o", "\u0585"), ("n", "\u0578"), ("Y", "\u04ae"), ("i", "\u03b9"), ("\u03ba", "\u043a"), ("Hope", "\U0001d407\U0001d428\U0001d429\U0001d41e"), ("fit", "\ufb01t"), ("VIII", "\u2167"), ("a-b", "a\u2010b"), ("a-b", "a\u2011b"),
    ("y\u0306", "\u045e"), ("A\u0301", "\u0386"), ("I\u0308", "\u03aa"),
]


def test_look_alikes_of_many_kinds(spark):
    found = class_of(spark, {t for pair in ALSO for t in pair})
    assert [(a, b) for a, b in ALSO if found[a] != found[b]] == []


def test_mapping_is_of_the_relation_and_keeps_ascii_apart():
    table = mapping()
    assert len(confusables()) > 5000 and len(table) > 2000 and not any(0x20 <= c < 0x7F for c in table)
    assert composed_mapping()["\u0439"] != "\u0438" and table[0x430] == "a"
    assert all(table.get(ord(x), x) == x for to in table.values() for x in to)


def class_of(spark, texts):
    return {r["text"]: r["canonical"] for r in classes(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}


def test_same_and_other(spark):
    found = class_of(spark, {t for pair in SAME + OTHER for t in pair})
    assert [(a, b) for a, b in SAME if found[a] != found[b]] == []
    assert [(a, b) for a, b in OTHER if found[a] == found[b]] == []


def test_canonical_is_plain_and_does_not_depend_on_order(spark):
    texts = ["Ｈope", "Нope", "Hope", "H​ope"]
    assert set(class_of(spark, texts).values()) == set(class_of(spark, texts[::-1]).values()) == {"Hope"}


def test_nulls_empties_long_and_no_rows(spark):
    long = "é" * 50_000
    found = class_of(spark, [None, "", "​", long, long.replace("é", "é")])
    assert len(found) == 4 and found[""] == found["​"] and len({found[t] for t in found if len(t) > 9}) == 1
    assert class_of(spark, []) == {}


def test_pairs(spark, rows):
    data = [("k1", "Hope", 1), ("k2", "Нope", 1), ("k3", "Hope", 1), ("k3", "Hope", 1), ("k4", "Other", 1), (None, "H​ope", 1), ("k5", None, 1)]
    df = spark.createDataFrame(data, "rec_key string, text string, canonical2 int").select("rec_key", "text")
    varied = variants(classes(df))
    assert rows(same_looking(members(df, varied))) == [("k1", "k2"), ("k2", "k3")]
    kids = spark.createDataFrame([("k1", "k1#1", "H​ope"), ("k1", "k1#2", "Hope"), ("k2", "k2#1", "Hope"), ("k9", "k9#1", "Hope")], "parent_key string, rec_key string, text string")
    varied = variants(classes(df.select("text").unionAll(kids.select("text"))))
    assert rows(same_looking_children(members(df, varied), members(kids, varied))) == [("k1", "k1#1"), ("k2", "k2#1")]


@pytest.mark.parametrize("copies", [300])
def test_copies_never_meet_each_other(spark, copies):
    df = spark.createDataFrame([(f"k{i:04}", "Hope") for i in range(copies)] + [("z", "Нope")], "rec_key string, text string")
    assert same_looking(members(df, variants(classes(df)))).count() == copies
