"""Reading, validating and loading the seven archives.

An archive is a gzip text file: a header line, then one record per line; lines end at ``\\n`` only, fields are divided by
tabs only, ``\\N`` is null and an empty field stays empty. Text files are read as lines, not as CSV, since quotes and
backslashes have no meaning and empty fields are no nulls. gzip cannot be split, so a file is one partition, in which the
row index gives line numbers. That task only unpacks; the lines are dealt to all cores before they are parsed, and the
archives are unpacked side by side.

``load`` is all or nothing: every archive is validated first, all tables are written to a staging folder, their row counts
are compared with the validation's, and only then the folder takes the destination's place. A manifest records each step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.errors import DataAccessError
from reelgrid.functions import keys, text
from reelgrid.schema import ARCHIVES, DERIVED, ID_LISTS, IDS, TYPES, table_of
from reelgrid.sources.files import Files

MANIFEST = "reelgrid-manifest.json"

_STRING = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"'
#: A JSON array of strings only.
ROLES = rf"^[ \t]*\[[ \t]*(?:{_STRING}[ \t]*(?:,[ \t]*{_STRING}[ \t]*)*+)?\][ \t]*$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a file, line ends removed; the header is line 1."""
    raw = spark.read.option("lineSep", "\n").text(path)
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return raw.select(number.alias("line_no"), F.rtrim("value", F.lit("\r")).alias("value"))


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of an archive; an error names what is wrong with them."""
    name = path.rsplit("/", 1)[-1]
    try:
        first = spark.read.option("lineSep", "\n").text(path).select("value", F.is_valid_utf8("value").alias("ok")).head(1)
    except Exception as e:
        raise DataAccessError(f"{name}: unreadable gzip archive") from e
    if not first:
        raise DataAccessError(f"{name}: missing header")
    if not first[0]["ok"]:
        raise DataAccessError(f"{name}:1: header is not UTF-8")
    found = tuple(first[0]["value"].rstrip("\r\n").split("\t"))
    if found != ARCHIVES[name]:
        raise DataAccessError(f"{name}:1: unexpected header")
    return found


def field_value(name: str, raw: Column) -> Column:
    """Loaded value of a raw field."""
    value = F.nullif(raw, F.lit("\\N"))
    if name in IDS:
        return text.id_number(value)
    if name in ID_LISTS:
        return text.bare_ids(value)
    if name == "characters":
        return text.characters_text(value)
    if name == "titleType":
        return text.mapped_kind(value)
    kind = TYPES.get(name)
    if kind == "boolean":
        return F.coalesce(value == "1", F.lit(False))
    return value.try_cast(kind) if kind else value


def problem(archive: str, fields: Column, valid: Column) -> Column:
    """What keeps a record from loading, or null."""
    names = ARCHIVES[archive]
    out = F.when(~valid, F.lit("not UTF-8")).when(F.size(fields) != len(names), F.concat(F.lit(f"expected {len(names)} fields, found "), F.size(fields).cast("string")))
    for k, name in enumerate(names):
        raw = F.get(fields, F.lit(k))
        if name in IDS:
            out = out.when(text.id_number(raw).isNull(), F.lit(f"invalid {name}"))
        elif name == "characters":
            out = out.when(~raw.isin("\\N", "") & ~raw.rlike(ROLES), F.lit("invalid characters"))
    return out


def derived(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the phonetic keys that are stored with a table."""
    if table == "name_basics":
        # one struct for all three, as each key alone would turn the name again
        coded = rows.withColumn("__keys", keys.name_keys_struct(F.col("primaryName")))
        return coded.withColumns({c: F.col(f"__keys.{k}") for c, k in zip(DERIVED[table], ("given", "canonical", "family"), strict=True)}).drop("__keys")
    source = {"title_basics": "primaryTitle", "title_akas": "title"}.get(table)
    return rows.withColumn("t_soundex", keys.title_key(F.col(source))) if source else rows


def records(found: DataFrame, archive: str) -> DataFrame:
    """(line_no, error, fields) of the records of (line_no, value) lines."""
    # a column of its own first: a line is divided once, not for every test
    cut = found.filter("line_no > 1").select("line_no", F.is_valid_utf8("value").alias("valid"), F.split("value", "\t", -1).alias("fields"))
    return cut.select("line_no", problem(archive, F.col("fields"), F.col("valid")).alias("error"), "fields")


def typed(rows: DataFrame, archive: str) -> DataFrame:
    """The loaded relation of valid (fields) rows."""
    table = table_of(archive)
    base = rows.select(*[field_value(n, F.get("fields", F.lit(k))).alias(n) for k, n in enumerate(ARCHIVES[archive])])
    return derived(base, table)


def validate(spark: SparkSession, path: str, stage: str | None = None) -> dict:
    """Full read of one archive: its name, size and row count; an invalid or empty one is an error naming the line.

    With a ``stage`` the records are written there as they are read, so that loading need not unpack the archive again.
    """
    name = path.rsplit("/", 1)[-1]
    header(spark, path)
    try:
        found = lines(spark, path)
        if stage:
            # dealt by number, as the one task that unpacks should do nothing else
            found = records(found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "line_no"), name)
            found.write.parquet(f"{stage}/{name}")
            found = spark.read.schema(found.schema).parquet(f"{stage}/{name}")
        else:
            found = records(found, name)
        got = found.agg(F.count(F.lit(1)).alias("rows"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("error"), F.min(F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("line")).first()
    except Exception as e:
        raise DataAccessError(f"{name}: unreadable gzip archive") from e
    if got["error"]:
        raise DataAccessError(f"{name}:{got['line']}: {got['error']}")
    if not got["rows"]:
        raise DataAccessError(f"{name}: dataset contains no rows")
    return {"name": name, "size": Files(spark).size(path), "rows": got["rows"]}


def validate_folder(spark: SparkSession, folder: str, stage: str | None = None) -> list[dict]:
    """Validation of all seven archives of a folder."""
    files = Files(spark)
    if not files.is_folder(folder):
        raise DataAccessError(f"not a directory: {folder}")
    found = [n for n in files.names(folder) if n.endswith(".tsv.gz")]
    if not found:
        raise DataAccessError(f"no archives in directory: {folder}")
    if unknown := sorted({*found} - {*ARCHIVES}):
        raise DataAccessError(f"unsupported dataset archive: {', '.join(unknown)}")
    if missing := sorted({*ARCHIVES} - {*found}):
        raise DataAccessError(f"missing required dataset: {', '.join(missing)}")
    if odd := [n for n in found if not files.is_file(f"{folder}/{n}")]:
        raise DataAccessError(f"not a regular file: {', '.join(odd)}")
    return each(lambda n: validate(spark, f"{folder}/{n}", stage), found)


def each(do: Callable, items: Iterable) -> list:
    """``do`` of every item side by side, in order; the first item's error is the one that is raised."""
    with ThreadPoolExecutor(len(ARCHIVES)) as pool:
        return list(pool.map(do, items))


def check_destination(path: str) -> str:
    """The destination without a trailing slash; an empty or in-memory one is an error."""
    path = path.rstrip("/")
    if not path or path.startswith((":memory:", "memory:")):
        raise DataAccessError("the destination must be a folder that lasts")
    return path


def load(spark: SparkSession, folder: str, destination: str, cleanup: bool = False) -> dict:
    """Load a folder of archives into ``destination``; the manifest is returned and written beside the archives."""
    destination = check_destination(destination)
    files = Files(spark)
    raw = f"{destination}.raw-{uuid.uuid4().hex}"
    try:
        return _load(spark, files, folder, destination, raw, cleanup)
    finally:
        files.delete(raw)


def _load(spark: SparkSession, files: Files, folder: str, destination: str, raw: str, cleanup: bool) -> dict:
    checked = validate_folder(spark, folder, raw)
    manifest = {"status": "preflight-complete", "destination": destination, "files": [{"name": c["name"], "size": c["size"], "source_rows": c["rows"], "imported_rows": None} for c in checked], "removed": []}
    note = lambda **x: (manifest.update(x), files.write_text(f"{folder}/{MANIFEST}", json.dumps(manifest, indent=1)))
    note()
    staging, old = f"{destination}.staging-{uuid.uuid4().hex}", f"{destination}.old-{uuid.uuid4().hex}"
    try:

        def stored(entry: dict) -> None:
            name, table = entry["name"], table_of(entry["name"])
            out = f"{staging}/{table}.parquet"
            rows = typed(spark.read.schema("line_no long, error string, fields array<string>").parquet(f"{raw}/{name}"), name)
            if table in DERIVED:  # finding the ranges would compute the keys a second time
                rows.write.parquet(f"{raw}/{table}")
                rows = spark.read.schema(rows.schema).parquet(f"{raw}/{table}")
            # ranges of the key, so that a relation has as many files as it needs and lookups skip most of them
            rows.repartitionByRange(sort_key(table)).sortWithinPartitions(sort_key(table)).write.parquet(out)
            entry["imported_rows"] = spark.read.parquet(out).count()
            if entry["imported_rows"] != entry["source_rows"]:
                raise DataAccessError(f"{name}: {entry['imported_rows']} rows imported of {entry['source_rows']}")

        each(stored, manifest["files"])
        if files.exists(destination):
            files.rename(destination, old)
        try:
            files.rename(staging, destination)
        except Exception:
            if files.exists(old):
                files.rename(old, destination)
            raise
    except Exception as e:
        files.delete(staging)
        note(status="failed", error=str(e)[:500])
        raise
    files.delete(old)
    if cleanup:
        try:
            for entry in manifest["files"]:
                files.delete(f"{folder}/{entry['name']}")
                manifest["removed"].append(entry["name"])
        except Exception as e:
            note(status="database-complete-cleanup-failed", error=str(e)[:500])
            raise
    note(status="completed")
    return manifest


def sort_key(table: str) -> str:
    """Column by which a stored relation is sorted, so that lookups by it skip row groups."""
    return {"title_basics": "t_soundex", "title_akas": "titleId", "name_basics": "s_soundex", "title_episode": "parentTconst"}.get(table, "tconst")


def write_archive(rows: DataFrame, folder: str, name: str) -> None:
    """Write text columns, named as in the header and with null marks, as the archive ``name`` of a folder."""
    files = Files(rows.sparkSession)
    head = rows.sparkSession.createDataFrame([("\t".join(ARCHIVES[name]),)], "value string").coalesce(1)
    body = rows.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in ARCHIVES[name]]).alias("value"))
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    # one gzip file is what an archive is, but its members may be packed by many tasks; the header's comes first
    parts = []
    for k, part in enumerate((head, body)):
        part.write.option("compression", "gzip").option("lineSep", "\n").text(f"{beside}/{k}")
        parts += [f"{beside}/{k}/{n}" for n in files.names(f"{beside}/{k}") if n.startswith("part-")]
    files.joined(parts, f"{beside}/whole")
    if files.exists(f"{folder}/{name}"):
        files.delete(f"{folder}/{name}")
    files.rename(f"{beside}/whole", f"{folder}/{name}")
    files.delete(beside)


def sample(spark: SparkSession, folder: str, out: str, count: int | None = None, percent: int | None = None, tail: bool = True) -> dict[str, int]:
    """Reduced archives below ``out``: the first and last ``count`` lines, or ``percent`` of the lines half from each end.

    ``tail=False`` keeps the first ``count`` lines only. Headers count as lines. Returns the lines kept of each archive.
    """
    files, kept = Files(spark), {}
    for name in [n for n in files.names(folder) if n.endswith(".tsv.gz")]:
        found = lines(spark, f"{folder}/{name}")
        total = found.count()
        if percent is not None:
            keep = max(total * percent // 100, 1)
            first = max(keep // 2, 1)
            last = keep - first
        else:
            first, last = count or 0, (count or 0) if tail else 0
        part = found.filter((F.col("line_no") <= first) | (F.col("line_no") > max(total - last, first)))
        beside = f"{out}/.{name}-{uuid.uuid4().hex}"
        part.select("value").coalesce(1).write.option("compression", "gzip").option("lineSep", "\n").text(beside)
        piece = next(n for n in files.names(beside) if n.startswith("part-"))
        if files.exists(f"{out}/{name}"):
            files.delete(f"{out}/{name}")
        files.rename(f"{beside}/{piece}", f"{out}/{name}")
        files.delete(beside)
        kept[name] = min(total, first + last)
    return kept
