"""Articles and phonetic keys as columns (no UDF).

The phonetic key of a text: everything before its first Latin letter goes, nothing left is null; the first letter stays,
upper-case; of the rest only coded consonants count, as digits, runs of one digit as one, four digits at most.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.linguistics import articles

#: Consonants and their digits.
CONSONANTS, DIGITS = "BCDFGJKLMNPQRSTVXZ", "123122245512623122"
KEY_LENGTH = 5


def _words(language: str | None) -> tuple[str, str]:
    """Alternations of the articles that stand apart, and of those that join the next word."""
    listed = articles(language)
    joined = [re.escape(a) for a in listed if a[-1] in "'-"]
    apart = [re.escape(a) for a in listed if a[-1] not in "'-"]
    never = "(?!)"
    return "|".join(apart) or never, "|".join(joined) or never


def has_trailing_article(title: Column, language: str | None = None) -> Column:
    """Whether the last of the title's ``, `` parts is an article."""
    apart, joined = _words(language)
    return title.rlike(f"(?ius)(?:^|, )(?:{apart}|{joined})$")


def canonical_title(title: Column, language: str | None = None, index: Column | None = None) -> Column:
    """``The Title`` as ``Title, The``; a title that ends in an article already stays as it is."""
    apart, joined = _words(language)
    tail = F.lit(", $1$2") if index is None else F.concat(F.when(F.length(index) > 0, F.concat(F.lit(" ("), index, F.lit(")"))).otherwise(""), F.lit(", $1$2"))
    moved = F.regexp_replace(title, F.lit(f"(?ius)^(?:({apart}) |({joined}))(.*)$"), F.concat(F.lit("$3"), tail))
    return F.when(has_trailing_article(title, language), title).otherwise(moved)


def normalize_title(title: Column, language: str | None = None) -> Column:
    """``Title, The`` as ``The Title``; no blank follows an apostrophe or hyphen."""
    apart, joined = _words(language)
    near = F.regexp_replace(title, f"(?ius)^(.*), ({joined})$", "$2$1")
    return F.regexp_replace(near, f"(?ius)^(.*), ({apart})$", "$2 $1")


def strip_article(title: Column, language: str | None = None) -> Column:
    """The title without a leading or trailing article."""
    apart, joined = _words(language)
    # a title that is one article has nothing left; a trailing article keeps a leading one in place
    cut = F.regexp_replace(title, f"(?ius)(?:^|, )(?:{apart}|{joined})$", "")
    led = F.regexp_replace(title, f"(?ius)^(?:(?:{apart}) |(?:{joined}))", "")
    return F.when(has_trailing_article(title, language), cut).otherwise(led)


def phonetic(text: Column) -> Column:
    from reelgrid.functions.text import let

    def coded(upper: Column) -> Column:
        digits = F.translate(F.regexp_replace(F.substr(upper, F.lit(2)), f"[^{CONSONANTS}]", ""), CONSONANTS, DIGITS)
        for d in sorted(set(DIGITS)):
            digits = F.regexp_replace(digits, f"{d}+", d)
        return F.when(upper != "", F.concat(F.substring(upper, 1, 1), F.substring(digits, 1, KEY_LENGTH - 1)))

    return let(F.upper(F.regexp_replace(text, "^[^a-zA-Z]*", "")), coded)


def title_key(title: Column) -> Column:
    """Phonetic key of a title without its article."""
    return phonetic(strip_article(title))


def name_keys_struct(name: Column) -> Column:
    """struct(given, canonical, family) of the phonetic keys of a name as given, of its canonical form and of its family name.

    A repeated key is null, and all are for an empty name.
    """
    from reelgrid.functions.text import canonical_name, let

    def distinct(k: Column) -> Column:
        second = F.when(~k["b"].eqNullSafe(k["a"]), k["b"])
        third = F.when(~k["c"].eqNullSafe(k["a"]) & ~k["c"].eqNullSafe(k["b"]), k["c"])
        return F.struct(k["a"].alias("given"), second.alias("canonical"), third.alias("family"))

    of_turned = lambda t: F.struct(phonetic(name).alias("a"), phonetic(t).alias("b"), phonetic(F.substring_index(t, ", ", 1)).alias("c"))
    return F.when(F.length(name) > 0, let(let(canonical_name(name), of_turned), distinct))


def name_keys(name: Column) -> tuple[Column, Column, Column]:
    """The three keys as columns; where all are needed, one struct computed first is cheaper."""
    keys = name_keys_struct(name)
    return keys["given"], keys["canonical"], keys["family"]
