"""Template residue and error pages."""

from reelgrid.llm.residue import residue

FLAGGED = [
    "Hello {{name}}, welcome.", "The {{#each cast}}{{this}}{{/each}} plays.", "A {% if kind %}x{% endif %} here", "Dear %FIRST_NAME%,", "set in ${city} in 1999", "#{year} was", "<<title>> begins", "&lt;title&gt; begins",
    "__CITY__ sleeps", "@@NAME@@ vuelve", "[[genre]] asks", "[your city here] at night", "(insert plot here) starts", "the [PERSON_NAME] river", "wait for the {3} credits", "by {person.name}", "%(cast[0])s sings", "<if year>%(year)s</if year>", "<%= city %> at night", "a <insert name> of",
    "Real text.\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed do.\n\nMore.", "xxxx xxx XXXXX xx", "asdf jkl qwerasdf", "Blah blah Blah blah Blah blah.", "TBD", "Intro.\nTODO: write this section\nEnd.", "(empty draft)", "Dies ist ein Blindtext. Er füllt 20 Zeilen.",
    "404 Not Found", "<h1>The Film</h1>\n503 Service Temporarily Unavailable. Please try again in 3 seconds.\nRay 0a1b2c3d4e", "Access denied. You are not allowed to open this entry.\n\nBack to the start page", "You need to enable JavaScript to view The Film.",
    "Traceback (most recent call last):\n  File \"/srv/a.py\", line 3, in show\n    return row[\"x\"]\nKeyError: 'x'", "java.lang.NullPointerException\n\tat a.b.C.d(C.java:3)",
    "Home > Titles > The Film\nTraceback (most recent call last):\n  File \"/srv/a.py\", line 3, in show\n    return row[\"x\"]\nKeyError: 'x'", "Votre session a expiré, veuillez vous reconnecter.", '{"status":404,"error":"not_found","path":"/titles/3"}', "Loading…\nIf reviews does not appear, check that JavaScript is active.",
]
REAL = [
    "A prop newspaper repeats lorem ipsum across its columns, as Ann noticed.", 'The Latin over the gate, "sit tibi dolor levis", was chosen.', "I got a 404 on the page of The Film yesterday, it works again now.", "The joke about error 404 is that room 404 of the hotel does not exist.",
    'The terminal shows "access denied" and she faints.', "Ann learns JavaScript in this film, and to enable the robot needs a script and a cookie.", "The clerk writes [name withheld] and 79 % of the case is gone.", "The set list {1, 2, 3} was painted on the wall, with $ 50 and a blank line ____ for the winner.",
    "Something went wrong in Rome, and only Ann, the producer, can be asked to try again later.", "Something went wrong in the second act, and I liked it.", "oops i meant the other film", "Access denied, says the terminal, and Ann faints.", "ok that was fun\n404 not found lol\nyes",
    "[bridge rings]\n\n<i>Nobody tells.</i>", "Bob signs every letter with your name here, a running gag.", "En 1949, Ann empieza como actress, y todo cambia.", "He plays the service that is temporarily unavailable: a ferry.", "The makers denied on Friday that Ann will leave.", "lol ¯\\_(ツ)_/¯", "> the field was real",
    "Shot in spring at 50% of the budget, 100% real.", "ÜBER-MENSA 2000", "メラニセネヘナモス。ホソコレ。", "xxx", "2 < 3 and 5 > 4",
]
DOCS, TITLES = "doc_id long, text string, source string, tconst string, evidence string", "tconst string, title string"


def run(spark, texts):
    data = [(k, t, f"s{k % 3}", "tt1", "") for k, t in enumerate(texts)]
    return {r["doc_id"]: r["evidence"] for r in residue(spark.createDataFrame(data, DOCS), spark.createDataFrame([("tt1", "The Film"), ("tt1", "The Film"), (None, "x")], TITLES)).collect()}


def test_flagged(spark):
    got = run(spark, FLAGGED)
    assert [FLAGGED[k] for k in range(len(FLAGGED)) if k not in got] == []


def test_real(spark):
    got = run(spark, [*REAL, None, "", "  \n ", " ".join(REAL)])
    assert [(REAL[k], v) for k, v in got.items()] == []


def test_unknown_page_by_copies_and_hosts(spark):
    page = "Home > Titles > The Film\nNothing to see at the moment, call 55{0}."
    got = run(spark, [page.format(k) for k in range(6)] + ["Home > Titles > The Film\nThe film nobody saw.", "Nothing to see at the moment, call 55."])
    assert set(got) == set(range(6)) and set(got.values()) == {"recurring"}


def test_notices_of_any_length(spark):
    trace = "java.lang.NullPointerException\n" + "\n".join(f"\tat a.b.C.d(C.java:{k})" for k in range(60))
    warnings = "\n".join(f"Warning: Undefined index x in /srv/a.php on line {k}" for k in range(40))
    footer = "404 Not Found\n" + "\n".join(f"© {1990 + k} The Catalogue of all films and series" for k in range(40))
    long_json = '{"status":500,"trace":"' + "x" * 2000 + '"}'
    real = "Ann wrote to Bob.\n" * 30 + "404 Not Found"
    assert run(spark, [trace, warnings, footer, long_json, real]) == dict.fromkeys(range(4), "notice")


def test_unknown_page_that_is_long_or_of_one_source(spark):
    long = "Home > Titles > The Film\n" + "\n".join(f"Nothing to see at the moment in hall {k}, call us." for k in range(12))
    assert run(spark, [long] * 6) == dict.fromkeys(range(6), "recurring")
    alone = [(k, "Home > Titles > The Film\nNothing to see at the moment.", "s", "tt1", "") for k in range(20)]
    judge = lambda rows: residue(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("tt1", "The Film")], TITLES), least_share=0.5).count()
    assert judge(alone) == 20 and judge(alone[1:]) == 0
    assert judge(alone + [(100 + k, "A quiet evening with Ann.", "s", "tt1", "") for k in range(30)]) == 0


def test_long_text_is_read_whole(spark):
    long = "A quiet evening by the river with Ann. " * 30_000
    assert set(run(spark, [long, long + "{{name}}"])) == {1}


def test_empty_tables(spark):
    assert residue(spark.createDataFrame([], DOCS), spark.createDataFrame([], TITLES)).count() == 0
