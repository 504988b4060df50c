"""Names, titles, keys, markup, summaries and XML."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import keys, linguistics, parse, render, similarity, text


@pytest.fixture
def ask(spark):
    """Values of a column expression over texts."""

    def run(values, f):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
        return [r["r"] for r in df.select("k", f(F.col("v")).alias("r")).orderBy("k").collect()]

    return run


def test_names(ask):
    cases = {
        "Cher": "Cher", "Fred Astaire": "Astaire, Fred", "Julia Fiona Roberts": "Roberts, Julia Fiona", "Robert De Niro": "De Niro, Robert", "de la Cruz": "de la, Cruz",
        "Ludwig van Beethoven Jr.": "van Beethoven Jr., Ludwig", "A B van der C": "der C, A B van", "De Niro, Robert": "De Niro, Robert", "": "", "A B C D": "D, A B C", "Juan de la Rosa": "la Rosa, Juan de",
    }
    assert ask(cases, text.canonical_name) == list(cases.values())
    assert ask([None], text.canonical_name) == [None]
    assert ask(["De Niro, Robert", "a, b, c", "Cher"], text.normalize_name) == ["Robert De Niro", "a, b, c", "Cher"]
    splits = {
        "Fred Astaire": ("Fred", "Astaire"), "Julia Fiona Roberts": ("Julia Fiona", "Roberts"), "Robert De Niro": ("Robert", "De Niro"), "Frederick Austerlitz Jr.": ("Frederick", "Austerlitz"),
        "Frank Sinatra III": ("Frank", "Sinatra"), "Sinatra Jr., Frank": ("Frank", "Sinatra"), "Cher": ("", "Cher"),
    }
    assert [tuple(r) for r in ask(splits, text.split_name)] == list(splits.values())
    got = ask(["John Doe (II)", "John Doe (1926-2004)", "John Doe aka JD", "(x) y", "", "Ann"], text.analyze_name)
    assert [r and tuple(r) for r in got] == [("John Doe", "II"), ("John Doe", None), ("John Doe", None), ("(x) y", None), None, ("Ann", None)]
    assert ask(["Ann"], lambda v: text.build_name(v, F.lit("II"))) == ["Ann (II)"]


def test_articles(ask):
    cases = {"The Matrix": "Matrix, The", "Matrix, The": "Matrix, The", "L'amour": "amour, L'", "Theatre": "Theatre", "A": "A", "Die Hard": "Hard, Die", "": "", "a B": "B, a"}
    assert ask(cases, keys.canonical_title) == list(cases.values())
    assert ask(["Matrix, The", "amour, L'", "A, B", "x, y, The"], keys.normalize_title) == ["The Matrix", "L'amour", "A, B", "The x, y"]
    assert ask(["The Matrix", "Matrix, The", "The", "L'amour", "Los Los", "x, y"], keys.strip_article) == ["Matrix", "Matrix", "", "amour", "Los", "x, y"]
    assert ask(["À la carte", "The x"], lambda v: keys.canonical_title(v, "French")) == ["carte, À la", "The x"]
    assert ask(["The x"], lambda v: keys.canonical_title(v, "Turkish")) == ["The x"]
    assert ask(["The x"], lambda v: keys.canonical_title(v, None, F.lit("II"))) == ["x (II), The"]


def test_phonetic_keys(ask):
    cases = {"Star Wars": "S3621"[:4], "Tatat": "T3", "small ring": "S5465", "42 Street": "S363", "!!!": None, "東京": None, "": None, None: None, "Example Movie": "E2514"}
    got = ask(cases, keys.phonetic)
    assert got == ["S362", "T3", "S5465", "S363", None, None, None, None, "E2514"]
    assert ask(["The Matrix", "Matrix, The"], keys.title_key) == ["M362", "M362"]
    assert [tuple(r) for r in ask(["Fred Astaire", "Cher"], keys.name_keys_struct)] == [("F6323", "A2361", "A236"), ("C6", None, None)]


def plain_key(s):
    """The phonetic rule, letter by letter."""
    import re

    s = re.sub("^[^a-zA-Z]*", "", s).upper()
    out = s[:1]
    for c in s[1:]:
        d = dict(zip(keys.CONSONANTS, keys.DIGITS, strict=True)).get(c)
        if d and out[-1] != d and len(out) < keys.KEY_LENGTH:
            out += d
    return out or None


def test_phonetic_keys_against_the_rule(ask):
    import random

    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz 019'") for _ in range(draw.randrange(12))) for _ in range(500)]
    assert ask(words, keys.phonetic) == [plain_key(w) for w in words]


def test_long_titles(ask):
    build = lambda v, k, y, i: text.build_title(v, F.lit(k), F.lit(y), F.lit(i))
    assert ask(["A"], lambda v: build(v, "movie", 1999, None)) == ["A (1999)"]
    assert ask(["A"], lambda v: build(v, "tv mini series", None, "II")) == ['"A" (II) (????) (mini)']
    assert ask(["A"], lambda v: build(v, "video game", 2000, "")) == ["A (2000) (VG)"]
    assert ask([""], lambda v: build(v, "movie", 2000, "")) == [""]
    assert ask(["(2005-04-12)", "x"], text.aired_as_text) == ["Episode dated 12 April 2005", "x"]
    assert ask(["Episode dated 2 April 2005", "x"], text.text_as_aired) == ["(2005-04-02)", "x"]
    assert ask(["Pilot"], lambda v: text.build_episode_title(F.lit("Lost"), F.lit("tv series"), v, F.lit(2004), F.lit(None).cast("string"))) == ['"Lost" Pilot (2004)']
    assert ask(["Pilot"], lambda v: text.build_episode_record(F.lit("Lost"), F.lit(2004), v, F.lit("2004-09-22"), F.lit(1), F.lit(2))) == ['"Lost" (2004) {Pilot (2004-09-22) (#1.2)}']
    assert ask(['"Lost" Pilot (2004)', '"Lost" (2004)', '"Lost" (2004) {Pilot (#1.2)}', "Lost", "x {{SUSPENDED}}"], text.is_series_episode) == [True, False, True, False, False]


PARSED = {
    "The Matrix (1999)": {"title": "The Matrix", "year": 1999, "kind": "movie"},
    "Foo (1986/II)": {"title": "Foo", "year": 1986, "roman_index": "II"},
    "Foo (II) (1986)": {"title": "Foo", "year": 1986, "roman_index": "II"},
    '"Bar" (2003) (mini)': {"title": "Bar", "kind": "tv mini series"},
    '"Bar" (2003-2005)': {"title": "Bar", "kind": "tv series", "year": 2003, "series_years": "2003-2005"},
    "Foo (????)": {"title": "Foo", "year": None},
    "Foo (TV) (1990)": {"title": "Foo", "kind": "tv movie"},
    '"Lost" (2004) {Pilot (2004-09-22) (#1.2)}': {"title": "Pilot", "kind": "episode", "season": 1, "episode": 2, "series_title": "Lost", "series_year": 2004, "aired": "2004-09-22"},
    '"Lost" (2004) {(2004-09-22)}': {"aired": "2004-09-22", "year": 2004},
    "Foo (1999) aka Bar": {"title": "Foo"},
    "!!! (2026)": {"title": "!!!", "year": 2026},
    "Pilot (TV Episode) - Season 1 | Episode 2 - Lost (2004)": {"title": "Pilot", "kind": "episode", "season": 1, "episode": 2, "series_title": "Lost", "series_year": 2004},
    "Pilot (2005) (TV Episode) - Lost": {"title": "Pilot", "year": 2005, "kind": "episode", "series_title": "Lost", "series_kind": "movie"},
    '"Lost" Pilot (2005)': {"title": "Pilot", "year": 2005, "kind": "episode", "series_title": "Lost", "series_kind": "tv series"},
    '"Lost" (2004) {Pilot (#1.2)}': {"title": "Pilot", "season": 1, "episode": 2, "aired": None},
    '"Lost" (2004) {(#1.2)}': {"title": "(#1.2)", "season": 1, "episode": 2},
    "Foo (Video Game) (2001/III)": {"title": "Foo", "kind": "video game", "year": 2001, "roman_index": "III"},
    "Foo (not a mark) (1980)": {"title": "Foo (not a mark)", "year": 1980},
}


def test_parsed_titles(spark, ask):
    for long, want in PARSED.items():
        assert {k: getattr(parse.analyze(long), k) for k in want} == want, long
    with pytest.raises(ValueError, match="no title"):
        parse.analyze("(1999)")
    rows = ask([*PARSED, "", None, "(1999)"], parse.analyze_title)
    assert [r["title"] for r in rows] == [parse.analyze(t).title for t in PARSED] + [None] * 3


def test_companies_notes_and_dates(ask):
    assert [tuple(r) for r in ask(["Acme (us) (x)", "Acme"], text.split_company_notes)] == [("Acme", "(us) (x)"), ("Acme", "")]
    assert [r and tuple(r) for r in ask(["Acme [us]", "[Acme] (x)", "Acme", " "], text.analyze_company)] == [("Acme", "[us]"), ("Acme x", None), ("Acme", None), None]
    assert ask(["Acme", ""], lambda v: text.build_company(v, F.lit("[us]"))) == ["Acme [us]", ""]
    dates = {"12 May 1960, London": ("12 May 1960", "London"), "May 1960": ("May 1960", ""), "London": ("", "London"), "????, x": ("", "x"), "": ("", "")}
    assert [tuple(r) for r in ask(dates, text.date_and_notes)] == list(dates.values())
    assert [tuple(r) for r in ask(["a::b::c", "a", "::n"], text.text_and_notes)] == [("a", "b::c"), ("a", None), ("", "n")]
    assert ask(["see _Foo (1999)_ (qv) by 'Ann B' (qv) as #C# (qv)"], text.clear_refs) == ["see Foo (1999) by Ann B as C"]
    assert ask(["<a href='x'>&amp; & \"</a>"], text.escape_xml)[0].startswith("&lt;a href=&apos;x&apos;&gt;")


def test_lists_ids_and_links(ask):
    assert ask(["a,b", "a\u0002b", "a", "", None, "a,b\u0002c"], text.split_list) == [["a", "b"], ["a", "b"], ["a"], [""], None, ["a", "b\u0002c"]]
    assert ask(['["Neo"]', '["Neo","Thomas"]', "[]", "", None, '["A\\"b"]'], text.characters_text) == ["Neo", "Neo / Thomas", "", "", None, 'A"b']
    assert ask(["tt0000012", "xx12", "tt", None], text.id_number) == [12, 12, None, None]
    assert ask(["nm1,nm22", "", None], text.bare_ids) == ["1,22", "", None]
    assert [r and tuple(r) for r in ask(["https://x/title/tt0133093/", "nm12345678?x", "tt123", "co0000001"], text.id_in_url)] == [("tt", "0133093"), ("nm", "12345678"), None, ("co", "0000001")]
    assert ask(["12", "12345678"], lambda v: text.padded_id("tt", v.cast("long"))) == ["tt0000012", "tt12345678"]
    assert ask(["https://i/a@._V1_SX3.jpg", "https://i/a._V1.jpg"], text.full_size_url) == ["https://i/a@.jpg", "https://i/a.jpg"]
    assert ask(["https://pictures.example/images/M/abc@@._V1_.jpg", "x"], lambda v: text.sized_url(v, 3, None, ("0", "1"))) == ["https://pictures.example/images/M/abc@@._V1_SX3_CR0,1_.jpg", None]
    assert ask(["tvSeries", "tvMovie"], text.mapped_kind) == ["tv series", "tvMovie"]
    assert ask(["Italy", "Nowhere"], lambda v: text.language_of(F.lit(None).cast("array<string>"), F.array(v))) == ["Italian", None]
    assert linguistics.language_of_countries()["Brazil"] == "Portuguese"


def test_templates_cards_and_xml(spark, ask):
    assert ask(["Foo", ""], lambda v: text.template("<if t>[%(t)s]</if t> %(t)s!", {"t": v})) == ["[Foo] Foo!", " !"]
    people = F.from_json(F.lit('[{"primaryname":"Ann","roles":["X","Y"]},{"primaryname":"Bob"}]'), "array<struct<primaryname: string, roles: array<string>>>")
    card = ask(["Foo (1999)"], lambda v: render.title_card(v, F.array(F.lit("drama")), people, F.slice(people, 1, 0), people, F.array(F.lit(95)), F.lit(7.5), F.lit(10)))[0]
    assert card == "Movie\n=====\nTitle: Foo (1999)\nGenres: drama.\nDirector: Ann (X / Y), Bob.\nCast: Ann (X / Y), Bob.\nRuntime: 95.\nRating: 7.5 (10 votes).\n"
    assert ask(["Ann"], lambda v: render.person_card(v, F.lit(1960), F.lit(None).cast("int"), F.array(F.lit("A (1)"), F.lit("B (2)")), F.array().cast("array<string>")))[0] == "Person\n=====\nName: Ann\nBirth date: 1960.\nLast movies directed: A (1); B (2).\n"
    assert ask(["Acme"], lambda v: render.company_card(v, {"distributor": F.array(F.lit("A"))}))[0] == "Company\n=======\nName: Acme\nLast movies from this company (distributor): A.\n"
    assert ask(["Neo"], lambda v: render.character_card(v, F.array(F.lit("A"))))[0] == "Character\n=====\nName: Neo\nLast movies with this character: A.\n"
    assert render.tag_of("long title") == ("long-title", ' key="long title"') and render.tag_of("1") == ("item", ' key="1"') and render.tag_of("title") == ("title", "")
    xml = ask(["A & 'B'::note"], lambda v: render.container("movie", "title", F.lit(7), v, [render.element("genres", F.array(F.lit("x"), F.lit("<y>")), "array<string>"), render.element("votes", F.lit(3), "int", "main"), render.element("gone", F.lit(None).cast("int"), "int")], "db"))[0]
    assert xml == '<movie id="7" access-system="db"><title>A &amp; &apos;B&apos;<notes>note</notes></title><genres><item>x</item><item>&lt;y&gt;</item></genres><votes infoset="main" type="int">3</votes></movie>'
    assert ask([xml], lambda v: render.parsed(v, "genres struct<item: array<string>>, votes struct<_VALUE: int>"))[0]["genres"]["item"] == ["x", "<y>"]


def test_similarity(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("the matrix", "matrix"), ("", "a"), (None, "a"), ("x" * 300, "x" * 300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(similarity.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [None if a is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    two = df.filter("a is not null").select(similarity.two_ratios(F.col("a"), F.col("b"), F.col("b"), F.col("a"), 0.5, 0.6).alias("r")).collect()
    want = [(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) for a, b in pairs if a is not None]
    assert all(x["r"][k] == w[k] or w[k] < least for x, w in zip(two, want, strict=True) for k, least in ((0, 0.5), (1, 0.6)))
    close = spark.createDataFrame([("abc", "abcd"), ("ab", "abcd"), ("", ""), (None, "a")], "a string, b string").select(similarity.close_in_length(F.col("a"), F.col("b")))
    assert [r[0] for r in close.collect()] == [True, False, False, False]


def test_links_and_labels(ask):
    got = ask(["see _Foo (1999)_ (qv) & 'Ann B' (qv) or 'No One' (qv) at http://x/y <b>", "plain", "", None], lambda v: render.linked_refs(v, F.create_map(F.lit("Foo (1999)"), F.lit("tt1")), F.create_map(F.lit("Ann B"), F.lit("nm2"))))
    assert got[0] == 'see <a href="https://films.example/title/tt1">Foo (1999)</a> & <a href="https://films.example/name/nm2">Ann B</a> or No One at <a href="http://x/y">http://x/y</a> &lt;b&gt;'
    assert got[1:] == ["plain", "", None]
    assert render.labels(["title", "year"], {"title": "Titel"}) == {"title": "Titel", "year": "year"}
