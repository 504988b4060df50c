"""Rows that fail to parse."""

import json
import random

import numpy as np
import pytest

from reelgrid.operators import rawlines as R

RAW = "raw_id long, file_name string, line_no long, line string, extra string"
HEAD = [(0, "title.episode.tsv.gz", 1, "tconst\tparentTconst\tseasonNumber\tepisodeNumber", "")]


def is_roles(text):
    try:
        x = json.loads(text, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return False
    return isinstance(x, list) and all(isinstance(v, str) for v in x)


@pytest.mark.parametrize("chunk", [3, 7, 256])
def test_machine_against_json(chunk, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", chunk)
    draw = random.Random(5)
    texts = ["[]", ' [ "a" , "b" ] ', '["a",]', '["a""b"]', "null", '"a"', '["\\u00e9"]', '["\\x"]', '["a', "[1]", '[["a"]]', '["a"] b', '["é"]']
    texts += ["".join(draw.choice('[]"",a\\u0 9e\n') for _ in range(draw.randrange(1, 24))) for _ in range(4000)]
    got = R.judge([t.encode() for t in texts], R.JSON_STRINGS, R.DONE, R.JSON_FAIL)
    assert [g < 0 for g in got] == [is_roles(t) for t in texts]


def test_composition_equals_a_plain_walk():
    draw = np.random.default_rng(3)
    data = draw.choice(np.frombuffer(b'[]",a\\u0 \xff', np.uint8), 5000)
    state, walked = 0, []
    for byte in data:
        state = R.JSON_STRINGS[state, byte]
        walked.append(state)
    assert R.states(data, R.JSON_STRINGS, 17).tolist() == walked
    assert R.states(data, R.JSON_STRINGS, 10_000).tolist() == walked


def test_offsets():
    assert R.judge([b'["a",1]', b'["a"', b"12x4", b""], R.JSON_STRINGS, R.DONE, R.JSON_FAIL)[:2] == [5, 4]
    assert R.judge([b"12x4", b"", b"007"], R.NUMBER, R.DIGITS, R.NUMBER_FAIL) == [2, 0, -1]


def test_lines(spark):
    cases = {
        "tt1\ttt9\t1\t2": None, "tt1\ttt9\t\\N\t2\r\r": None, "tt1\ttt9\t00000000000000000007\t2": None, "tt1\ttt9\t2147483647\t2": None,
        "tt1\ttt9\t2147483648\t2": "seasonNumber", "tt1\ttt9\t\t2": "seasonNumber", "tt1\ttt9\t+1\t2": "seasonNumber", "tt1\ttt9\t１\t2": "seasonNumber",
        "tt1\ttt9\t1": "line", "tt1\ttt9\tx\t2\t3": "line", "": "line", "tt1\ttt9\t99999999999999999999\t2": "seasonNumber",
    }
    data = HEAD + [(k, "title.episode.tsv.gz", k + 1, line, "x") for k, line in enumerate(cases, 1)] + [(90, "title.episode.tsv.gz", 90, None, "x"), (91, "what.tsv.gz", 2, "a\tb", "x"), (92, None, 2, "a", "x")]
    got = {r["raw_id"]: r for r in R.parse_lines(spark.createDataFrame(data, RAW)).collect()}
    assert {k: got[k]["bad_field"] for k in range(1, len(cases) + 1)} == dict(enumerate(cases.values(), 1))
    assert got[90]["bad_field"] == got[91]["bad_field"] == got[92]["bad_field"] == "line"
    assert got[5]["bad_offset"] == len("tt1\ttt9\t") and got[9]["reason"] == "3 fields, expected 4"
    assert 0 not in got


def test_typed_rows_and_no_header(spark, rows):
    data = [(1, "title.episode.tsv.gz", 2, "tt1\ttt9\t\\N\t2", ""), (2, "title.episode.tsv.gz", 3, "tt2\ttt9\t5\tz", "")]
    parsed = R.parse_lines(spark.createDataFrame(data, RAW))
    assert rows(R.loaded(parsed, "title.episode.tsv.gz")) == [(1, 2, "tt1", "tt9", None, 2), (2, 3, "tt2", "tt9", 5, None)]


def test_long_record_and_empty_table(spark):
    roles = json.dumps([f'a "{i}" \\' for i in range(50_000)])
    data = [(1, "title.principals.tsv.gz", 2, f"tt1\t1\tnm1\tactor\t\\N\t{roles}", ""), (2, "title.principals.tsv.gz", 3, f"tt1\t1\tnm1\tactor\t\\N\t{roles}]", "")]
    got = {r["raw_id"]: r["bad_field"] for r in R.parse_lines(spark.createDataFrame(data, RAW)).collect()}
    assert got == {1: None, 2: "characters"}
    assert R.parse_lines(spark.createDataFrame([], RAW)).count() == 0


def plain_walk(line, archive):
    """(bad_field, offset) of a record, field by field."""
    names = R.ARCHIVES[archive]
    fields = line.rstrip("\r").split("\t")
    if len(fields) != len(names):
        return "line", len("\t".join(fields[: len(names)]).encode())
    for name in sorted(names, key=lambda x: x != R.FIRST.get(archive)):
        kind, value = "json" if name == "characters" else R.TYPES.get(name, "text"), fields[names.index(name)]
        at = len("".join(f + "\t" for f in fields[: names.index(name)]).encode())
        if kind == "text" or value == "\\N" or (kind == "json" and not value):
            continue
        if value.startswith("\\"):  # the null mark is a way too
            return name, at + (2 if value.startswith("\\N") else 1)
        steps, good, fail, _ = R.VALUES[kind]
        state = 0
        for k, byte in enumerate(value.encode()):
            state = steps[state, byte]
            if state == fail:
                return name, at + k
        if state not in good:
            return name, at + len(value.encode())
        if kind == "int" and int(value) > R.LARGEST:
            return name, at
    return None


@pytest.mark.parametrize("chunk", [5, 64, 100_000])
def test_tokenizer_against_a_plain_walk(spark, chunk, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", chunk)
    import pyarrow as pa

    draw = random.Random(7)
    archives = sorted(R.ARCHIVES)
    bits = {"text": ["tt1", "", "\\N", "Ünï ,", '"'], "int": ["7", "0012", "99999999999", "2147483648", "", "1x", "\\N", "\\Nx", "é"], "boolean": ["0", "1", "2", "", "\\N", "01"], "double": ["1.5", "3", ".5", "3.", "\\N", "1.2.3"], "json": ["[]", '["a","\\\\"]', '["a"', "", "\\N", '["é",1]', "é"]}
    for archive in archives:
        kinds = ["json" if x == "characters" else R.TYPES.get(x, "text") for x in R.ARCHIVES[archive]]
        lines = ["\t".join([draw.choice(bits[k]) for k in kinds][: draw.choice([99] * 8 + [len(kinds) - 1])] + ["x"] * (draw.random() < 0.1)) + "\r" * draw.randrange(3) for _ in range(400)]
        names, _, offsets, fields, _ = R._tokenized(pa.array(lines), archive, len(kinds), True)
        want = [plain_walk(x, archive) for x in lines]
        assert [(n, o) if n else None for n, o in zip(names.to_pylist(), offsets.to_pylist(), strict=True)] == want
        assert fields.to_pylist() == [None if w else [None if f == "\\N" else f for f in x.rstrip("\r").split("\t")] for x, w in zip(lines, want, strict=True)]


def test_strict_and_lost_values(spark):
    data = [(1, "title.basics.tsv.gz", 2, "tt1\tmovie\tA\tA\tx\tabc\t\\N\t90\tDrama", ""), (2, "title.basics.tsv.gz", 3, "tt2\tmovie\tA\tA\t1\t2000\t\\N\t90\tDrama", "")]
    raw = spark.createDataFrame(data, RAW)
    strict = {r["raw_id"]: (r["bad_field"], r["bad_offset"]) for r in R.parse_lines(raw, strict=True).collect()}
    assert strict == {1: ("isAdult", 14), 2: (None, None)}
    lost = {r["raw_id"]: r["lost"] for r in R.parse_lines(raw).collect()}
    assert [(x["field"], x["reason"], x["at"]) for x in lost[1]] == [("isAdult", "not 0 or 1", 14), ("startYear", "not a whole number", 16)] and lost[2] is None
