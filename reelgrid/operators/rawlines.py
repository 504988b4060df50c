"""Rows that fail to parse (problem 3).

Method. One finite-state tokenizer runs over the bytes of the raw records of an Arrow batch: its states are the column a byte
lies in and the state of that column's value, so tabs, record ends, JSON quotes, escapes and digits are all its
transitions. The bytes are cut into chunks of fixed size regardless of record ends; for every chunk the whole transition
function (end state for each possible start state) is computed, the functions are composed by a prefix scan, which
gives each chunk its true start state, and the chunks are replayed. All steps, and the cutting of fields from the
positions where the machine changed columns, are array operations over a batch: no record is handled by itself, and one
of a gigabyte costs no more per byte than short ones. A record end resets the machine.

Output: one row per record with either its fields or the failing field, a reason, and the byte offset in the record
where the machine failed (the field's end where it ended too early).

Defined results. Carriage returns at the end of a line do not belong to it; fields are divided by tabs only; ``\\N`` is
null. A null line counts as an empty one (one empty field). A wrong number of fields is reported as ``line`` and nothing
else is checked. Headers (line_no 1) are not records. An archive without a header row is held to its registered header;
records of an archive that is not registered fail as ``line``. Fields of FIRST fail their record always, and come first;
other typed columns (numbers, flags) fail it if ``strict``, else the record loads without the value, which is
listed in ``lost``, so that no value goes without a word. Repeated rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.schema import ARCHIVES, TYPES

CHUNK = 256
_END = 0xFF  # never a byte of UTF-8

START, OPEN, COMMA, STRING, ESCAPE, AFTER, FAIL, DONE, HEX1, HEX2, HEX3, HEX4 = range(12)
DIGITS = 1


def _json_machine() -> np.ndarray:
    t = np.full((12, 256), FAIL, np.uint8)
    blanks = [ord(c) for c in " \t\n\r"]
    for state in (START, OPEN, COMMA, AFTER, DONE):
        t[state, blanks] = state
    t[START, ord("[")] = OPEN
    t[OPEN, ord("]")] = t[AFTER, ord("]")] = DONE
    t[OPEN, ord('"')] = t[COMMA, ord('"')] = STRING
    t[AFTER, ord(",")] = COMMA
    t[STRING, 0x20:] = STRING
    t[STRING, ord("\\")] = ESCAPE
    t[STRING, ord('"')] = AFTER
    t[ESCAPE, [ord(c) for c in '"\\/bfnrt']] = STRING
    t[ESCAPE, ord("u")] = HEX1
    digits = [ord(c) for c in "0123456789abcdefABCDEF"]
    for state, to in ((HEX1, HEX2), (HEX2, HEX3), (HEX3, HEX4), (HEX4, STRING)):
        t[state, digits] = to
    t[:, _END] = START
    return t


def _digit_machine() -> np.ndarray:
    t = np.full((3, 256), 2, np.uint8)
    t[0, 48:58] = t[1, 48:58] = DIGITS
    t[:, _END] = START
    return t


JSON_STRINGS, NUMBER = _json_machine(), _digit_machine()
JSON_FAIL, NUMBER_FAIL = FAIL, 2


def states(data: np.ndarray, machine: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """The machine's state after each byte, by composition of the chunks' transition functions."""
    n, kinds, chunk = len(data), machine.shape[0], chunk or CHUNK
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, _END, np.uint8)
    grid[:n] = data
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat = machine.reshape(-1)
    start = np.zeros(rows, np.uint8)
    if rows > 1:
        f = np.broadcast_to(np.arange(kinds, dtype=np.uint16), (rows, kinds)).copy()
        for byte in grid:
            f = flat[f * 256 + byte[:, None]].astype(np.uint16)
        step = 1
        while step < rows:  # f[i] becomes the composition of all chunks up to i
            g = f.copy()
            g[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
            f, step = g, 2 * step
        start[1:] = f[:-1, START]
    out, now = np.empty_like(grid), start.astype(np.uint16)
    for k, byte in enumerate(grid):
        out[k] = flat[now * 256 + byte]
        now = out[k].astype(np.uint16)
    return out.T.reshape(-1)[:n]


def judge(values: list[bytes], machine: np.ndarray, accept: int, fail: int) -> list[int]:
    """-1 for each accepted value, else the offset of the first byte that fails, or its length if it ends too early."""
    if not values:
        return []
    data = np.frombuffer(bytes([_END]).join(values) + bytes([_END]), np.uint8)
    after = states(data, machine)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    first = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    last = np.where(lengths > 0, after[np.maximum(first + lengths - 1, 0)], START)
    failed = np.flatnonzero((after == fail) & (np.concatenate([[START], after[:-1]]) != fail))
    at = np.searchsorted(failed, first)
    where = np.append(failed, len(data))[at]
    return np.where(last == accept, -1, np.where(last == fail, where - first, lengths)).tolist()


PARSED = "raw_id long, file_name string, line_no long, bad_field string, reason string, bad_offset long, fields array<string>, lost array<struct<field: string, reason: string, at: long>>"
_LOST = pa.list_(pa.struct([("field", pa.string()), ("reason", pa.string()), ("at", pa.int64())]))
_OUT = pa.schema([("raw_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int64()), ("bad_field", pa.string()), ("reason", pa.string()), ("bad_offset", pa.int64()), ("fields", pa.list_(pa.string())), ("lost", _LOST)])

#: Fields that always fail their record, by archive.
FIRST = {"title.basics.tsv.gz": "runtimeMinutes", "title.episode.tsv.gz": "seasonNumber", "title.principals.tsv.gz": "characters"}
LARGEST = 2147483647
REASONS = {"json": "not a JSON array of strings", "int": "not a whole number", "boolean": "not 0 or 1", "double": "not a number"}
_TAB = 9


def _flag_machine() -> np.ndarray:
    t = np.full((3, 256), 2, np.uint8)
    t[0, [48, 49]] = 1
    return t


def _decimal_machine() -> np.ndarray:
    """Digits, with a point and more digits if need be."""
    t = np.full((5, 256), 4, np.uint8)
    t[0, 48:58] = t[1, 48:58] = 1
    t[1, ord(".")] = 2
    t[2, 48:58] = t[3, 48:58] = 3
    return t


#: Value machines by kind: table, accepting states, failing state, whether an empty value is accepted.
VALUES = {
    "text": (np.zeros((1, 256), np.uint8), (0,), None, True), "json": (JSON_STRINGS, (DONE,), JSON_FAIL, True), "int": (NUMBER, (DIGITS,), NUMBER_FAIL, False),
    "boolean": (_flag_machine(), (1,), 2, False), "double": (_decimal_machine(), (1, 3), 4, False),
}


@dataclass(frozen=True)
class Machine:
    """The machine of an archive's records: transitions, and of each state its column, whether a field may end there, and whether it has failed."""

    table: np.ndarray
    column: np.ndarray
    accept: np.ndarray
    failed: np.ndarray
    kinds: tuple[str, ...]


@lru_cache(64)
def record_machine(archive: str, n: int) -> Machine:
    """The machine of records of ``n`` columns; columns that the archive is not known to have are texts."""
    names = ARCHIVES.get(archive, ())
    kinds = tuple("json" if x == "characters" else TYPES.get(x, "text") for x in (*names, *[""] * n)[:n])
    starts, size = [], 0
    for kind in kinds:
        starts.append(size)
        # two more states for the null mark, whose bytes no typed value begins with
        size += VALUES[kind][0].shape[0] + (0 if kind == "text" else 2)
    over = size  # more columns than there should be
    table, column = np.full((size + 1, 256), over, np.uint8), np.full(size + 1, n, np.int32)
    accept, failed = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    for c, kind in enumerate(kinds):
        steps, good, fail, empty = VALUES[kind]
        at, k = starts[c], steps.shape[0]
        table[at : at + k] = steps.astype(np.int64) + at
        column[at : at + k + (0 if kind == "text" else 2)] = c
        accept[[at + g for g in good]] = True
        accept[at] |= empty
        if kind != "text":
            failed[at + fail] = True
            table[at + k :, :] = np.where(np.arange(len(table) - at - k)[:, None] < 2, at + fail, table[at + k :, :])
            table[at, ord("\\")], table[at + k, ord("N")] = at + k, at + k + 1
            accept[at + k + 1] = True
        table[column == c, _TAB] = starts[c + 1] if c + 1 < n else over
    table[:, _END] = 0
    return Machine(table, column, accept, failed, kinds)


def _tokenized(lines: pa.Array, archive: str, n: int, strict: bool) -> list[pa.Array]:
    """The last five columns of PARSED for the records of one archive."""
    lines = pc.utf8_rtrim(pc.fill_null(lines, ""), characters="\r").cast(pa.large_binary())
    count = len(lines)
    data = np.frombuffer(bytes([_END]).join(lines.to_pylist()) + bytes([_END]), np.uint8)
    m = record_machine(archive, n)
    after = states(data, m.table)
    before = np.concatenate([np.zeros(1, after.dtype), after[:-1]])
    ends = np.flatnonzero((data == _TAB) | (data == _END))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = np.flatnonzero(data[ends] == _END)  # of each record its last field
    first = np.concatenate([[0], last[:-1] + 1])
    origin, whole = starts[first], (m.column[before[ends[last]]] == n - 1)
    bad: list[tuple[str, str, int] | None] = [None] * count
    lost: list[list[dict] | None] = [None] * count
    for k in np.flatnonzero(~whole):
        found = int(last[k] - first[k] + 1)
        at = ends[first[k] + n - 1] if found > n else ends[last[k]]
        bad[k] = ("line", f"{found} fields, expected {n}", int(at - origin[k]))
    rows = np.flatnonzero(whole)
    names = ARCHIVES.get(archive, ())
    failing = np.flatnonzero(m.failed[after] & ~m.failed[before])
    fields = first[rows]
    typed = sorted((c for c, kind in enumerate(m.kinds) if kind != "text"), key=lambda c: names[c] != FIRST.get(archive))
    for c in typed:
        f, kind = fields + c, m.kinds[c]
        ok = m.accept[before[ends[f]]]
        long = ok & (ends[f] - starts[f] >= 10) if kind == "int" else np.zeros(len(f), bool)
        for k in np.flatnonzero(~ok | long):
            a, z, row = int(starts[f[k]]), int(ends[f[k]]), int(rows[k])
            if ok[k]:
                digits = data[a:z].tobytes().lstrip(b"0")
                if len(digits) <= 10 and int(digits or b"0") <= LARGEST:
                    continue
                why, at = f"larger than {LARGEST}", a
            else:
                after_a = np.searchsorted(failing, a)
                why, at = REASONS[kind], min(int(failing[after_a]), z) if after_a < len(failing) else z
            if bad[row] is None:
                if strict or names[c] == FIRST.get(archive):
                    bad[row] = (names[c], why, at - int(origin[row]))
                else:
                    lost[row] = [*(lost[row] or []), {"field": names[c], "reason": why, "at": at - int(origin[row])}]
    good = np.array([b is None for b in bad], bool)
    # the fields of good records are all bytes but the dividers, cut where those stood
    keep = np.repeat(good, ends[last] - origin + 1) & (data != _TAB) & (data != _END)
    mine = np.repeat(good, last - first + 1)
    a, z = starts[mine], ends[mine]
    null = (z - a == 2) & (data[a] == ord("\\")) & (data[np.minimum(a + 1, len(data) - 1)] == ord("N"))
    bounds = np.concatenate([[0], np.cumsum(z - a)]).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(bounds), pa.py_buffer(data[keep].tobytes()), pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()))
    where = np.concatenate([[0], np.cumsum(np.where(good, n, 0))])
    lists = pa.ListArray.from_arrays(pa.array(where, pa.int32(), mask=np.append(~good, False)), values.cast(pa.string()))
    columns = list(zip(*[b or (None, None, None) for b in bad], strict=True)) or [(), (), ()]
    return [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), lists, pa.array(lost, _LOST)]


def _parser(strict: bool):  # noqa: ANN202
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose = pa.StructArray.from_arrays([batch.column(1).cast(pa.string()), batch.column(4).cast(pa.int32())], names=["file", "n"]).to_pandas().map(lambda x: (x["file"], x["n"]))
            codes, kinds = whose.factorize()
            for code, (archive, n) in enumerate(kinds):
                part = batch.take(pa.array(np.flatnonzero(codes == code)))
                if n is None or n != n:
                    none = pa.nulls(len(part))
                    told = [pa.array(["line"] * len(part)), pa.array(["unknown archive"] * len(part)), pa.array([0] * len(part), pa.int64()), none.cast(pa.list_(pa.string())), none.cast(_LOST)]
                else:
                    told = _tokenized(part.column(3).cast(pa.string()), archive, int(n), strict)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), part.column(2).cast(pa.int64()), *told], schema=_OUT)

    return parse


def parse_lines(raw: DataFrame, strict: bool = False) -> DataFrame:
    """PARSED rows of the records of (raw_id, file_name, line_no, line); ``strict`` fails records for any typed column."""
    known = raw.sparkSession.createDataFrame([(f, len(h)) for f, h in ARCHIVES.items()], "file_name string, registered int")
    heads = raw.filter((F.col("line_no") == 1) & F.col("file_name").isin(*ARCHIVES)).groupBy("file_name").agg(F.min(F.struct("raw_id", "line")).alias("h"))
    count = F.size(F.split(F.regexp_replace(F.coalesce(F.col("h.line"), F.lit("")), "\r+$", ""), "\t", -1))
    # one row per registered archive, seven at most
    expected = known.join(F.broadcast(heads), "file_name", "left").select("file_name", F.when(F.col("h").isNull(), F.col("registered")).otherwise(count).alias("n_fields"))
    records = raw.filter(F.col("line_no").isNull() | (F.col("line_no") != 1)).select("raw_id", "file_name", F.col("line_no").cast("long").alias("line_no"), "line")
    return records.join(F.broadcast(expected), "file_name", "left").select("raw_id", "file_name", "line_no", "line", "n_fields").mapInArrow(_parser(strict), PARSED)


def loaded(parsed: DataFrame, archive: str) -> DataFrame:
    """The typed rows of one archive, under the source's column names in lower case, with raw_id and line_no."""
    rows = parsed.filter(F.col("bad_field").isNull() & (F.col("file_name") == archive))
    cols = []
    for k, name in enumerate(ARCHIVES[archive]):
        text, kind = F.col("fields")[k], TYPES.get(name, "string")
        cols.append((F.coalesce(text == "1", F.lit(False)) if kind == "boolean" else text if kind == "string" else F.expr(f"try_cast(fields[{k}] as {kind})")).alias(name.lower()))
    return rows.select("raw_id", "line_no", *cols)
