"""The mapped form that Spark makes, and what classes cost."""

import re

from reelgrid.llm.lookalike import classes, mapping, shown


def test_texts_go_through_spark_once_and_not_through_python(spark):
    df = spark.createDataFrame([("Hope",), ("\u041dope",)], "text string")
    plan = classes(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert not re.search("Python|Join", plan)


def test_all_characters_are_mapped_as_outside_spark(spark):
    from reelgrid.llm.lookalike import with_mapped

    table = mapping()
    several = [chr(code) for code, to in table.items() if len(to) > 1]
    texts = [chr(code) for code in range(0x30000) if not 0xD800 <= code < 0xE000] + [f"a{chr(code)}\u0323\u0302b" for code in table]
    texts += ["".join(several), "".join(map(chr, table)), *(f"{a}\u0301{b}" for a, b in zip(several, several[1:])), "\uffff", "a\uffff\ufb01\u0430", ""]
    found = with_mapped(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(found) == len(texts) and [ascii(r["text"]) for r in found if r["mapped"] != shown(r["text"], table)] == []


def test_a_line_end_at_the_end_is_a_blank(spark):
    found = {r["text"]: r["canonical"] for r in classes(spark.createDataFrame([("abc\n",), ("abc ",), ("abc",), ("\n",), (" ",)], "text string")).collect()}
    assert found == {"abc\n": "abc ", "abc ": "abc ", "abc": "abc", "\n": " ", " ": " "}


def test_classes_that_differ_under_the_collation_only(spark):
    texts = ["ab", "a\ufdd0b", "a\u0378b", "ac", "Ab", "a b"]
    rows = classes(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    equal = {(a, b) for a in texts for b in texts if spark.sql("SELECT collate(:a, 'UNICODE') = collate(:b, 'UNICODE')", {"a": a, "b": b}).first()[0]}
    found = {r["text"]: (r["canonical"], r["n_forms"]) for r in rows}
    assert {(a, b) for a in texts for b in texts if found[a][0] == found[b][0]} == equal
    assert all(n == sum(found[t][0] == c for t in texts) for c, n in found.values())
