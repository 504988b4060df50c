"""The ranked search of a table's titles compares a text without a key with all titles and alternate titles that have it."""

from reelgrid.operators import search
from reelgrid.plans import catalogue

BASICS = "tconst string, primarytitle string, titletype string, startyear int, isadult boolean"


def found(spark, tmp_path, basics, akas):
    spark.createDataFrame(basics, BASICS).write.parquet(f"{tmp_path}/title_basics.parquet")
    spark.createDataFrame(akas, "titleid string, ordering int, title string").write.parquet(f"{tmp_path}/title_akas.parquet")
    out = {}
    for r in catalogue.QUERIES["title_search_ranked"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["tconst"], r["kind"], round(r["score"], 9)))
    return out


def test_no_title_of_a_text_without_a_key_is_left_out(spark, tmp_path):
    name = "tt{:07d}".format
    # more equal titles than the bound come before those that rank above them
    basics = [(name(2 * k + 1003), "!!!", "short", 2001 if k % 3 else None, False) for k in range(search.EXACT_ROWS + 60)]
    basics += [(name(k), "!!!", "tvEpisode", 2002, False) for k in range(3, 3 + 2 * search.EXACT_ROWS + 60, 4)]
    basics += [(name(9000 + k), "!!!", "movie", None if k < 5 else 2001, False) for k in range(30) if k % 20]
    basics += [(name(20), "!!!", "short", 1950, False), (name(40), "!!!", "short", None, False), (name(60), "東京", "short", 1950, False), (name(9920), "!!!", "short", 2002, False)]
    basics += [(name(20_003 + 2 * k), "Other", "short", None, False) for k in range(130)] + [(name(30_001 + 2 * k), "東京", "movie", 1951, False) for k in range(3)]
    akas = [(name(20_003 + 2 * k), 1, "東京") for k in range(130)] + [(name(9010), 7, "!!!"), (name(3), 2, "!!!")]
    got = found(spark, tmp_path, basics, akas)

    weights = {"movie": 6, "short": 1}

    def wanted(text, year):
        held = {}
        for id_, title, kind, of_year, _ in basics:
            kind = "episode" if kind == "tvEpisode" else kind
            if title == text:
                held[id_] = (0.9 if kind == "episode" else 1.1, 0, kind, of_year, of_year)
        years = {b[0]: b[3] for b in basics}
        for id_, _, title in akas:
            if title == text and (id_ not in held or held[id_][0] < 1.1):
                held[id_] = (1.1, 1, None, None, years[id_])
        met = {i: h for i, h in held.items() if year is not None and h[4] == year} or held
        ranked = sorted(met.items(), key=lambda x: (-x[1][0], -weights.get(x[1][2], 0), x[1][3] is None, x[0]))
        return [(i, h[2], h[0]) for i, h in ranked[: search.DEFAULT_RESULTS]]

    for id_, text, year in ((name(20), "!!!", 1950), (name(40), "!!!", None), (name(60), "東京", 1950), (name(9920), "!!!", 2002)):
        assert got[id_] == wanted(text, year), id_
    assert all(kind == "movie" for _, kind, _ in got[name(40)])
