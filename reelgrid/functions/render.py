"""Summary cards and XML of titles and persons as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.text import escape_xml, notes_as_xml

#: How many people or titles a card names.
CAST_SHOWN, DIRECTED_SHOWN, ACTED_SHOWN = 5, 3, 5


def _line(label: str, value: Column, end: str = ".\n") -> Column:
    """``label: value`` where there is a value, else nothing."""
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), value, F.lit(end))).otherwise("")


def people_text(people: Column) -> Column:
    """Names with their roles in parentheses, from structs with primaryname and roles."""
    shown = lambda p: F.concat(F.coalesce(p["primaryname"], F.lit("")), F.when(F.size(p["roles"]) > 0, F.concat(F.lit(" ("), F.array_join(p["roles"], " / "), F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(people, shown), ", ")


#: The labels of the cards below are fixed values.
def title_card(long_title: Column, genres: Column, directors: Column, writers: Column, cast: Column, runtimes: Column, rating: Column, votes: Column) -> Column:
    """Summary of a title; people are arrays of structs (primaryname, roles)."""
    score = F.concat(rating.cast("string"), F.when(votes > 0, F.concat(F.lit(" ("), votes.cast("string"), F.lit(" votes)"))).otherwise(""))
    return F.concat(
        F.lit("Movie\n=====\n"), F.lit("Title: "), F.coalesce(long_title, F.lit("")), F.lit("\n"),
        _line("Genres", F.array_join(genres, ", ")), _line("Director", people_text(directors)), _line("Writer", people_text(writers)),
        _line("Cast", people_text(F.slice(cast, 1, CAST_SHOWN))), _line("Runtime", F.array_join(F.transform(runtimes, lambda r: r.cast("string")), ", ")),
        F.when(rating > 0, F.concat(F.lit("Rating: "), score, F.lit(".\n"))).otherwise(""),
    )


def person_card(name: Column, born: Column, died: Column, directed: Column, acted: Column) -> Column:
    """Summary of a person; films are arrays of long titles."""
    return F.concat(
        F.lit("Person\n=====\n"), F.lit("Name: "), F.coalesce(name, F.lit("")), F.lit("\n"),
        _line("Birth date", born.cast("string")), _line("Death date", died.cast("string")),
        _line("Last movies directed", F.array_join(F.slice(directed, 1, DIRECTED_SHOWN), "; ")), _line("Last movies acted", F.array_join(F.slice(acted, 1, ACTED_SHOWN), "; ")),
    )


def company_card(name: Column, films: dict[str, Column]) -> Column:
    """Summary of a company; ``films`` holds long titles by the company's part in them."""
    parts = [_line(f"Last movies from this company ({k})", F.array_join(F.slice(v, 1, ACTED_SHOWN), "; ")) for k, v in films.items()]
    return F.concat(F.lit("Company\n=======\nName: "), F.coalesce(name, F.lit("")), F.lit("\n"), *parts)


def character_card(name: Column, films: Column) -> Column:
    return F.concat(F.lit("Character\n=====\nName: "), F.coalesce(name, F.lit("")), F.lit("\n"), _line("Last movies with this character", F.array_join(F.slice(films, 1, ACTED_SHOWN), "; ")))


# ---------------------------------------------------------------- XML


def tag_of(key: str) -> tuple[str, str]:
    """Element name of a key and its attributes: the key itself where the name differs."""
    name = re.sub(r"[^a-z0-9-]", "", key.lower().replace(" ", "-"))
    if not name or name[0].isdigit() or name[0] == "-":
        name = "item"
    safe = key.replace("&", "&amp;").replace('"', "&quot;").replace("'", "&apos;").replace("<", "&lt;").replace(">", "&gt;")
    return name, f' key="{safe}"' if name != key else ""


def xml_text(value: Column) -> Column:
    return notes_as_xml(escape_xml(value))


def element(key: str, value: Column, kind: str, infoset: str | None = None) -> Column:
    """Element of a value, nothing for a null; numbers say their type, arrays hold item elements."""
    name, attrs = tag_of(key)
    attrs += f' infoset="{infoset}"' if infoset else ""
    mark = lambda k: ' type="int"' if k in ("int", "bigint", "smallint", "tinyint", "boolean") else ' type="float"' if k in ("double", "float") else ""
    if kind.startswith("array<"):
        inner_kind = kind[6:-1]
        item = lambda x: F.concat(F.lit(f"<item{mark(inner_kind)}>"), xml_text(x.cast("string")), F.lit("</item>"))
        return F.when(F.size(value) > 0, F.concat(F.lit(f"<{name}{attrs}>"), F.array_join(F.transform(value, item), ""), F.lit(f"</{name}>"))).otherwise("")
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}{attrs}{mark(kind)}>"), xml_text(value.cast("string")), F.lit(f"</{name}>"))).otherwise("")


def container(tag: str, what: str, key: Column, shown: Column, elements: list[Column], system: str | None = None) -> Column:
    """Element of a record: its id, shown name and the elements of its values."""
    access = f' access-system="{system}"' if system else ""
    return F.concat(F.lit(f"<{tag}"), F.coalesce(F.concat(F.lit(' id="'), key.cast("string"), F.lit(f'"{access}')), F.lit("")), F.lit(f"><{what}>"), xml_text(F.coalesce(shown, F.lit(""))), F.lit(f"</{what}>"), *elements, F.lit(f"</{tag}>"))


def parsed(xml: Column, schema: str) -> Column:
    """Values of a record's XML, by element name."""
    return F.from_xml(xml, schema)


# ---------------------------------------------------------------- links


def linked_refs(text: Column, titles: Column, names: Column, base: str = "https://films.example") -> Column:
    """A text as HTML: addresses become links, and so do references whose title or name is in a map to ids.

    References are taken apart in JVM expressions: the text is cut at the marks of references, and each piece is judged
    by itself. A reference that is in no map stays as its plain words.
    """
    safe = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    safe = F.regexp_replace(safe, r"(https?://[^\s<>\"']+)", '<a href="$1">$1</a>')
    pieces = F.regexp_extract_all(safe, F.lit(r"(?s)(?:_[^_]+_ \(qv\)|'[^']+' \(qv\)|.+?(?=_[^_]+_ \(qv\)|'[^']+' \(qv\)|\z))"), F.lit(0))

    def judged(p: Column) -> Column:
        title, name = F.regexp_extract(p, r"^_(.+)_ \(qv\)$", 1), F.regexp_extract(p, r"^'(.+)' \(qv\)$", 1)
        link = lambda kind, key, words: F.coalesce(F.concat(F.lit(f'<a href="{base}/{kind}/'), key.cast("string"), F.lit('">'), words, F.lit("</a>")), words)
        return F.when(title != "", link("title", titles[title], title)).when(name != "", link("name", names[name], name)).otherwise(p)

    return F.array_join(F.transform(pieces, judged), "")


def labels(keys: list[str], translated: dict[str, str]) -> dict[str, str]:
    """Shown labels of keys: a translation, else the key itself."""
    return {k: translated.get(k, k) for k in keys}
