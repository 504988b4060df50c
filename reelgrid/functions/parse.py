"""Long titles taken apart.

Notation. A title is followed by marks in parentheses: its kind, its year (with a roman index behind a slash, or a span of
years), a roman index alone. A series stands in double quotes. An episode follows its series in one of three ways: plainly
behind the quotes; in braces, with its date and its number in parentheses; or before it, as an episode by its kind
mark, with a dash and perhaps season and episode numbers between them.

A text is scanned once into its marks, each with its role; the grammar above is then read off their places. As an
episode holds a series, and neither holds an episode again, no deeper nesting exists. It is a function for single
texts and an Arrow UDF over columns; search applies it to the few query texts only, never to a catalogue.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of a kind, in parentheses and in any case, and the kinds they stand for.
KIND_MARKS = {
    "tv": "tv movie",
    "tv episode": "episode",
    "v": "video movie",
    "video": "video movie",
    "vg": "video game",
    "mini": "tv mini series",
    "tv mini-series": "tv mini series",
    "tv mini series": "tv mini series",
    "tv special": "tv special",
    "tv series": "tv series",
    "video game": "video game",
    "short": "short",
    "tv movie": "tv movie",
    "tv short": "tv short",
}
#: What divides a title from its other names, marks a withdrawn series, and opens an episode known by its date.
OTHER_NAMES, SUSPENDED, DATED = " aka ", "{SUSPENDED}}", "Episode dated "
_ROMAN, _DIGITS, _UNSURE = set("IVXLCDM"), set("0123456789"), set("0123456789?")


@dataclass(frozen=True)
class Title:
    """Parts of a long title; parts that are not given are None."""

    title: str
    kind: str = "movie"
    year: int | None = None
    series_years: str | None = None
    roman_index: str | None = None
    season: int | None = None
    episode: int | None = None
    series_title: str | None = None
    series_kind: str | None = None
    series_year: int | None = None
    aired: str | None = None


@dataclass(frozen=True)
class Mark:
    """A group in parentheses: its role, its text, and where it lies."""

    role: str
    text: str
    start: int
    end: int


_NUMBERS = ("year", "season", "episode", "series_year")
SCHEMA = T.StructType([T.StructField(f.name, T.IntegerType() if f.name in _NUMBERS else T.StringType()) for f in fields(Title)])


def _role(text: str) -> str:
    """What a group in parentheses says; ``text`` of the title if nothing."""
    if text.lower() in KIND_MARKS:
        return "kind"
    if text and set(text) <= _ROMAN:
        return "index"
    season, dot, episode = text[1:].partition(".")
    if text.startswith("#") and dot and season and episode and set(season + episode) <= _DIGITS:
        return "number"
    parts = text.split("-")
    if len(parts) == 3 and len(parts[0]) == 4 and all(p and set(p) <= _UNSURE for p in parts) and len(parts[1]) < 3 and len(parts[2]) < 3:
        return "date"
    years, slash, index = text.partition("/")
    first, dash, last = years[:4], years[4:5], years[5:].rstrip()
    if len(first) == 4 and set(first) <= _UNSURE and dash in ("", "-", "–") and (not last or (len(last) == 4 and set(last) <= _UNSURE)) and (not slash or (index and set(index) <= _ROMAN)):
        return "year"
    return "text"


def marks(text: str) -> list[Mark]:
    """The innermost groups in parentheses, in order."""
    out, opened = [], -1
    for k, c in enumerate(text):
        if c == "(":
            opened = k
        elif c == ")" and opened >= 0:
            inner = text[opened + 1 : k]
            out.append(Mark(_role(inner), inner, opened, k + 1))
            opened = -1
    return out


def _whole(text: str) -> int | None:
    return int(text) if text and set(text) <= _DIGITS else None


def _without(text: str, gone: list[Mark], end: int) -> str:
    """The text before ``end`` without some marks."""
    at, kept = 0, []
    for m in gone:
        if m.end <= end:
            kept.append(text[at : m.start])
            at = m.end
    return ("".join(kept) + text[at:end]).strip()


def _plain(text: str) -> Title:
    """A title that is no episode. The last year ends it; kinds count wherever they stand, indexes before the year only."""
    found = marks(text)
    of = {role: [m for m in found if m.role == role] for role in ("kind", "year", "index")}
    kind = KIND_MARKS[of["kind"][-1].text.lower()] if of["kind"] else None
    end, year, span, index = len(text), None, None, None
    if of["year"]:
        last = of["year"][-1]
        shown, _, index = last.text.partition("/")
        end, year, span = last.start, _whole(shown[:4]), shown if "-" in shown else None
    gone = of["kind"]
    before = [m for m in of["index"] if m.end <= end]
    if not index and before:
        index, gone = before[-1].text, sorted([*gone, *before], key=lambda m: m.start)
    title = _without(text, gone, end)
    if len(title) > 1 and title.startswith('"') and title.endswith('"'):
        title, kind = title[1:-1].strip(), kind or "tv series"
    if not title:
        raise ValueError(f"no title in {text!r}")
    return Title(title, kind or "movie", year, span, index or None)


def _of_series(found: Title, series: Title) -> Title:
    return replace(found, kind="episode", series_title=series.title, series_kind=series.kind, series_year=series.year)


def _braced(text: str) -> Title:
    """An episode in braces: its title, then its date and number; without a title it is called by one of them."""
    dates, numbers = ([m for m in marks(text) if m.role == r] for r in ("date", "number"))
    told = sorted(dates[-1:] + numbers[-1:], key=lambda m: m.start)
    name = text[: told[0].start].strip() if told else text.strip()
    aired = dates[-1].text if dates else None
    if not name:
        name = f"({aired})" if aired else f"({numbers[-1].text})" if numbers else ""
        found = Title(name, year=_whole(aired[:4]) if aired else None) if name else _plain(name)
    else:
        found = _plain(name)
    season, _, episode = numbers[-1].text[1:].partition(".") if numbers else ("", "", "")
    return replace(found, season=_whole(season), episode=_whole(episode), aired=aired)


def _dated(text: str) -> Title:
    """An episode that is called by its date, if it is, with the date's year where it has none of its own."""
    found = _plain(text)
    if not text.startswith(DATED):
        return found
    day = text[len(DATED) :]
    return replace(found, aired=day[:-1] if day.endswith(")") else day, year=_whole(day[-4:]) if found.year is None else found.year)


def split_series(text: str) -> tuple[str, str]:
    """The series and the episode in an episode's long title, else two empty texts."""
    if text.endswith("}"):
        series, brace, rest = text.rpartition("{")
        return (series.rstrip(), f"{{{rest}".strip()) if brace and not f"{{{rest}".startswith(SUSPENDED) else ("", "")
    quoted, close, rest = text[1:].partition('"')
    rest = rest.lstrip()
    return (f'"{quoted}"', rest) if text.startswith('"') and close and rest and not rest.startswith("(") else ("", "")


def _before_series(text: str) -> Title | None:
    """An episode that its kind mark and a dash divide from the series behind it, else None."""
    for m in marks(text):
        rest = text[m.end :].lstrip()
        if m.role == "kind" and KIND_MARKS[m.text.lower()] == "episode" and rest.startswith("- ") and rest is not text[m.end :]:
            words = rest[2:].strip()
            season, bar, after = words.partition("|")
            episode, dash, series = after.partition(" -")
            numbers = [x.split() for x in (season, episode)]
            if bar and dash and [n[0].lower() for n in numbers if len(n) == 2] == ["season", "episode"] and all(_whole(n[1]) is not None for n in numbers):
                found = replace(_plain(text[: m.start].strip()), season=_whole(numbers[0][1]), episode=_whole(numbers[1][1]))
                return _of_series(found, _plain(series.strip()))
            return _of_series(_plain(text[: m.start].strip()), _plain(words))
    return None


def analyze(text: str) -> Title:
    """Parts of a long title. A text without any title raises ValueError."""
    text = text.partition(OTHER_NAMES)[0].strip().replace('""', '"')
    series, part = split_series(text)
    if series:
        return _of_series(_braced(part[1:-1]) if part.startswith("{") else _dated(part), _plain(series))
    return _before_series(text) or _plain(text)


@F.pandas_udf(SCHEMA)
def _analyzed(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            rows.append(asdict(analyze(text)) if text else {})
        except ValueError:
            rows.append({})
    frame = pd.DataFrame(rows, columns=SCHEMA.names, index=texts.index, dtype=object)
    for name in _NUMBERS:
        frame[name] = frame[name].astype("Int32")
    return frame


def analyze_title(text: Column) -> Column:
    """struct SCHEMA of a long title; all parts are null where there is no title."""
    return _analyzed(text)
