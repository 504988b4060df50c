"""Names, titles, companies and their markup as columns (no UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a family name of several words.
PARTICLES = ("de", "la", "der", "den", "del", "y", "da", "van", "e", "von", "the", "di", "du", "el", "al")
#: Generational suffixes of family names.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "vi")
ROMAN = "[IVXLCDM]+"

# ---------------------------------------------------------------- names


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a one-element array binds it, which keeps nested expressions small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_name(name: Column) -> Column:
    """``Given Family`` as ``Family, Given``.

    A name of one word, or that holds ``, `` already, stays. From three words on, a particle at the first, last but one or
    (of four words or more) last but two place opens a family name of two words, which a following ``Jr`` joins.
    """

    def of_words(words: Column) -> Column:
        n = F.size(words)
        particle = lambda at: F.lower(F.get(words, at)).isin(*PARTICLES)
        place = F.when(n < 3, F.lit(None).cast("int")).when(particle(F.lit(0)), F.lit(0)).when(particle(n - 2), n - 2).when((n > 3) & particle(n - 3), n - 3)
        return let(place, lambda at: F.when(at.isNotNull(), around(words, at)).otherwise(last_first(words)))

    def around(words: Column, at: Column) -> Column:
        junior = F.coalesce(F.lower(F.get(words, at + 2)).startswith("jr"), F.lit(False)).cast("int")
        family = lambda k: F.array_join(F.slice(words, at + 1, k + 2), " ")
        rest = lambda k: F.array_join(F.concat(F.slice(words, F.lit(1), at), F.slice(words, at + k + 3, F.size(words))), " ")
        return let(junior, lambda k: F.concat(family(k), F.lit(", "), rest(k)))

    def last_first(words: Column) -> Column:
        return F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))

    return F.when(name.contains(", ") | ~name.contains(" "), name).otherwise(let(F.split(name, " ", -1), of_words))


def normalize_name(name: Column) -> Column:
    """``Family, Given`` as ``Given Family``, of exactly two parts."""
    parts = F.split(name, ", ", -1)
    return F.when(F.size(parts) == 2, F.concat(parts[1], F.lit(" "), parts[0])).otherwise(name)


def analyze_name(name: Column) -> Column:
    """struct(name, roman_index): what follows `` aka `` and other parentheses go; a name that is empty then is null."""
    head = F.trim(F.substring_index(name, " aka ", 1))
    index = F.regexp_extract(head, rf"^.+\(({ROMAN})\)[^)]*$", 1)
    bare = F.rtrim(F.regexp_replace(head, rf"(?s)\({ROMAN}\)[^)]*$", ""))
    noted = head.rlike(r"^[^(].*\(.*\)")
    clean = F.when(index != "", bare).when(noted, F.trim(F.regexp_replace(head, r"\(.*\)", ""))).otherwise(head)
    return F.when(clean != "", F.struct(clean.alias("name"), F.nullif(index, F.lit("")).alias("roman_index")))


def build_name(name: Column, index: Column) -> Column:
    """Long form of a name."""
    return F.concat(F.coalesce(name, F.lit("")), F.when((F.length(name) > 0) & (F.length(index) > 0), F.concat(F.lit(" ("), index, F.lit(")"))).otherwise(""))


def strip_suffix(name: Column) -> Column:
    """The name without trailing generational suffixes, its blanks single."""
    single = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.regexp_replace(single, rf"(?i)(?:(?:^| )(?:{'|'.join(SUFFIXES)})[.,]*)+$", "")


def split_name(name: Column) -> Column:
    """struct(first, last) of a name; a name of one word is a family name."""
    parts = F.split(name, ", ", -1)
    comma = F.struct(F.get(parts, F.lit(1)).alias("first"), strip_suffix(parts[0]).alias("last"))
    other = lambda turned: F.struct(F.when(turned.contains(", "), F.regexp_replace(turned, "(?s)^.*?, ", "")).otherwise("").alias("first"), F.substring_index(turned, ", ", 1).alias("last"))
    return F.when(name.contains(", "), comma).otherwise(let(canonical_name(strip_suffix(name)), other))


# ---------------------------------------------------------------- titles


def build_title(title: Column, kind: Column, year: Column, index: Column) -> Column:
    """Long form of a title that is no episode: series in quotes, index, year and mark of the kind."""
    series = kind.isin("tv series", "tv mini series")
    named = F.when(F.coalesce(series, F.lit(False)), F.concat(F.lit('"'), title, F.lit('"'))).otherwise(title)
    counted = F.when(F.length(index) > 0, F.concat(F.lit(" ("), index, F.lit(")"))).otherwise("")
    dated = F.concat(F.lit(" ("), F.coalesce(year.cast("string"), F.lit("????")), F.lit(")"))
    mark = F.when(kind == "tv movie", " (TV)").when(kind == "video movie", " (V)").when(kind == "tv mini series", " (mini)").when(kind == "video game", " (VG)").otherwise("")
    return F.when(F.length(title) > 0, F.concat(named, counted, dated, mark)).otherwise("")


def build_episode_title(series: Column, series_kind: Column, title: Column, year: Column, index: Column) -> Column:
    """Long form of an episode: its series without year, then the episode with it."""
    top = F.when(F.coalesce(series_kind.isin("tv series", "tv mini series"), F.lit(False)), F.concat(F.lit('"'), series, F.lit('"'))).otherwise(series)
    mark = F.when(series_kind == "tv movie", " (TV)").when(series_kind == "video movie", " (V)").when(series_kind == "tv mini series", " (mini)").when(series_kind == "video game", " (VG)").otherwise("")
    return F.concat(top, mark, F.lit(" "), build_title(aired_as_text(title), F.lit(None).cast("string"), year, index))


def build_episode_record(series: Column, series_year: Column, title: Column, aired: Column, season: Column, episode: Column) -> Column:
    """Episode in the layout of plain text files: ``"Series" (year) {Title (date) (#season.episode)}``."""
    dated = F.when(aired.rlike(r"^.{4}-.{2}-.{2}$") & ~title.contains(aired), F.concat(F.lit(" ("), aired, F.lit(")"))).otherwise("")
    number = F.when(season.isNotNull(), F.concat(F.lit(" (#"), season.cast("string"), F.coalesce(F.concat(F.lit("."), episode.cast("string")), F.lit("")), F.lit(")"))).otherwise("")
    return F.concat(F.lit('"'), series, F.lit('" ('), F.coalesce(series_year.cast("string"), F.lit("????")), F.lit(") {"), text_as_aired(title), F.coalesce(dated, F.lit("")), number, F.lit("}"))


def is_series_episode(title: Column) -> Column:
    """Whether a long title is an episode's, in either notation."""
    t = F.trim(title)
    braces = t.rlike(r"^.*\S.*\{[^{]*\}$") & ~t.rlike(r"\{SUSPENDED\}\}$") & ~t.rlike(r"^\s*\{")
    quoted = ~t.endswith("}") & t.rlike(r'(?s)^"[^"]*"\s*[^\s(]')
    return F.coalesce(braces | quoted, F.lit(False))


def aired_as_text(title: Column) -> Column:
    """``(2005-04-12)`` as ``Episode dated 12 April 2005``; anything else stays."""
    day = F.try_to_timestamp(F.regexp_extract(title, r"^\((\d{4}-\d{2}-\d{2})\)$", 1), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.concat(F.lit("Episode dated "), F.date_format(day, "d MMMM yyyy")), title)


def text_as_aired(title: Column) -> Column:
    """``Episode dated 12 April 2005`` as ``(2005-04-12)``; anything else stays."""
    day = F.try_to_timestamp(F.regexp_extract(title, r"^Episode dated (\d{1,2} \p{L}+ \d{4})$", 1), F.lit("d MMMM yyyy"))
    return F.coalesce(F.date_format(day, "(yyyy-MM-dd)"), title)


# ---------------------------------------------------------------- companies


def split_company_notes(name: Column) -> Column:
    """struct(name, notes): notes run from the first parenthesis, if the name ends in one."""
    t = F.trim(name)
    noted = t.endswith(")") & t.contains("(")
    return F.struct(F.when(noted, F.rtrim(F.substring_index(t, "(", 1))).otherwise(t).alias("name"), F.when(noted, F.regexp_extract(t, r"(?s)(\(.*)$", 1)).otherwise("").alias("notes"))


def analyze_company(name: Column) -> Column:
    """struct(name, country) with the country in its brackets; a name that is empty then is null."""
    t = F.trim(name)
    bracketed = F.regexp_replace(t, r"[!@#$()\[\]]", "")
    tail = F.regexp_extract(t, r"(?s)(\[[^\[]*\])$", 1)
    bare = F.when(t.startswith("["), bracketed).when(tail != "", F.rtrim(F.regexp_replace(t, r"(?s)\[[^\[]*\]$", ""))).otherwise(t)
    return F.when(bare != "", F.struct(bare.alias("name"), F.when(~t.startswith("["), F.nullif(tail, F.lit(""))).alias("country")))


def build_company(name: Column, country: Column) -> Column:
    return F.when(F.length(name) > 0, F.concat(name, F.coalesce(F.concat(F.lit(" "), country), F.lit("")))).otherwise("")


# ---------------------------------------------------------------- markup, notes and dates

#: Fixed value: the notation of a reference to a title, with its year, index and kind.
TITLE_REF = r"_(.+?(?: \([0-9?]{4}(?:/[IVXLCDM]+)?\))?(?: \(mini\)| \(TV\)| \(V\)| \(VG\))?)_ \(qv\)"


def clear_title_refs(text: Column) -> Column:
    return F.regexp_replace(text, TITLE_REF, "$1")


def clear_name_refs(text: Column) -> Column:
    return F.regexp_replace(text, r"'([^']+?)' \(qv\)", "$1")


def clear_character_refs(text: Column) -> Column:
    return F.regexp_replace(text, r"#([^']+?)# \(qv\)", "$1")


def clear_refs(text: Column) -> Column:
    """Titles, then characters, then names without the marks of a reference."""
    return clear_name_refs(clear_character_refs(clear_title_refs(text)))


def modify_strings(values: Column, how) -> Column:  # noqa: ANN001
    """``how`` applied to every text of an array column."""
    return F.transform(values, how)


def text_and_notes(text: Column) -> Column:
    """struct(text, notes) of ``text::notes``; notes are null without the mark."""
    parts = F.split(text, "::", 2)
    return F.struct(parts[0].alias("text"), F.get(parts, F.lit(1)).alias("notes"))


#: Words, besides a digit, with which a date begins.
DATE_WORDS = ("c.", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "ca.", "circa", "????,")


def date_and_notes(text: Column) -> Column:
    """struct(date, notes) of a birth or death text."""
    t = F.trim(text)
    dated = t.rlike(r"^\p{Nd}") | F.lower(F.regexp_extract(t, r"^(\S+)", 1)).isin(*DATE_WORDS)
    head = F.substring_index(t, ",", 1)
    notes = F.trim(F.when(t.contains(","), F.regexp_replace(t, "(?s)^[^,]*,", "")).otherwise(""))
    return F.struct(F.when(dated & (head != "????"), head).otherwise("").alias("date"), F.when(dated, notes).otherwise(t).alias("notes"))


def escape_xml(text: Column) -> Column:
    """The text safe inside XML; character references keep their ampersand."""
    out = F.regexp_replace(text, "&(?![^a-zA-Z0-9_#]{1,5};)", "&amp;")
    for plain, safe in (('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def notes_as_xml(text: Column) -> Column:
    """``text::notes`` with the notes in a tag."""
    return F.regexp_replace(text, "(?s)^(.*?)::(.*)$", "$1<notes>$2</notes>")


# ---------------------------------------------------------------- lists, ids, links


def split_list(text: Column) -> Column:
    """Items of a list: by comma where there is one, else by the unit mark; null stays null."""
    return F.when(text.contains(","), F.split(text, ",", -1)).otherwise(F.split(text, "\u0002", -1))


def split_roles(text: Column) -> Column:
    return F.split(text, " / ", -1)


def characters_text(text: Column) -> Column:
    """JSON list of role names as one text; null and empty stay."""
    return F.when(text == "", text).otherwise(F.array_join(F.from_json(text, "array<string>"), " / "))


def id_number(text: Column) -> Column:
    """Number of an id with a two-letter prefix; null where it is none."""
    return F.substr(text, F.lit(3)).try_cast("bigint")


def bare_ids(text: Column) -> Column:
    """A list of ids without prefixes."""
    return F.regexp_replace(text, "(?<![0-9a-zA-Z])(?:nm|tt)(?=[0-9])", "")


def padded_id(prefix: str, number: Column) -> Column:
    """Prefix and number of at least seven digits."""
    return F.format_string(f"{prefix}%07d", number)


def id_in_url(url: Column) -> Column:
    """struct(kind, id) of the first title, person, character or company id in a text; null without one."""
    pattern = r"\b(nm|tt|ch|co)([0-9]{7,8})\b"
    kind = F.regexp_extract(url, pattern, 1)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.regexp_extract(url, pattern, 2).alias("id")))


def full_size_url(url: Column) -> Column:
    """Address of an image at full size: the size mark between the ``@`` (or the last dot but one) and the extension goes."""
    marked = F.regexp_replace(url, r"(?s)^(.*@).*(\.[^.]*)$", "$1$2")
    return F.when(url.contains("@"), marked).otherwise(F.regexp_replace(url, r"(?s)^(.*)\.[^.]*(\.[^.]*)$", "$1$2"))


#: What an image's address looks like up to its marks; a parameter, as it depends on the site.
PICTURE = r"https://[\w.-]+/images/\w/\w+"


def sized_url(url: Column, width: int | None = None, height: int | None = None, crop: tuple[str, ...] = (), picture: str = PICTURE) -> Column:
    """Address of an image at a given size; null where the address is no image's."""
    base = F.regexp_extract(url, f"({picture})", 1)
    marks = F.when(url.contains("@@"), "@@").when(url.contains("@"), "@").otherwise("")
    size = (f"SX{width}_" if width else "") + (f"SY{height}_" if height else "") + (f"CR{','.join(crop)}_" if crop else "")
    return F.when(base != "", F.concat(base, marks, F.lit(f"._V1_{size}.jpg")))


def mapped_kind(kind: Column) -> Column:
    from reelgrid.schema import KINDS

    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[kind], kind)


def language_of(languages: Column, countries: Column) -> Column:
    """First language of a title, else the main language of its first country."""
    from reelgrid.functions.linguistics import language_of_countries

    table = F.create_map(*[F.lit(x) for kv in language_of_countries().items() for x in kv])
    return F.coalesce(F.get(languages, F.lit(0)), table[F.get(countries, F.lit(0))])


def template(pattern: str, values: dict[str, Column]) -> Column:
    """Column of a ``%(key)s`` template with ``<if key>...</if key>`` parts; an empty or null value drops its part."""
    import re

    condition = re.search(r"<if\s+(?P<key>.+?)\s*>(?P<body>.+?)</if\s+(?P=key)\s*>", pattern, re.S)
    if condition:
        key, body = condition["key"], condition["body"]
        held = values.get(key, F.lit(None).cast("string")).cast("string")
        inner = F.when(F.length(held) > 0, template(body, values)).otherwise("")
        return F.concat(template(pattern[: condition.start()], values), inner, template(pattern[condition.end() :], values))
    pieces = []
    for literal, key in re.findall(r"(?s)(.*?)(?:%\((.+?)\)s|$)", pattern):
        if literal:
            pieces.append(F.lit(literal))
        if key:
            pieces.append(F.coalesce(values.get(key, F.lit(None)).cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")
