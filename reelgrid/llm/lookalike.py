"""Visually identical text with different characters (problem 5).

Method. Texts are mapped first, then all mapped values are grouped by their sort key under the accent- and case-sensitive Unicode
collation ``UNICODE``: two values have one key if and only if they are equal under it. Each class gets a deterministic canonical member.
Every text is mapped once and gets its key once; one exchange makes texts distinct and a second one brings a class together.

The mapping is built by rules, not listed: full-width, half-width, font, no-break and ligature forms from the Unicode character
database, letters that look alike from the confusables relation of the ICU library that Spark ships (each to the member of
its class with the same case, a Latin one where there is any), blanks to an ordinary blank, invisible and control characters
to nothing. Texts are decomposed before and composed after it, which puts combining marks into canonical order and reaches the base
of composed letters. Spark has no normal forms, so both are called in the ICU library that it ships, by ``java_method``;
nothing goes through Python. Texts of printable ASCII are their own mapped form.

The canonical member of a class is the one that equals its mapped form, else the shortest, else the first by code point.

Defined results. Null texts are in no class. Case, visible accents (the dot of an i too), spelling, visible punctuation (dashes
but for the hyphen's own forms) and the presence of a blank make texts different. A mark on a letter of another script counts
as the same mark on its look-alike. Texts are used whole. Namesakes with the same characters give no pair.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNICODE = "UNICODE"
#: Characters without width that are not of the categories Cf and Cc.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: The hyphen's own forms; a small i without its dot and a long s are seen as such.
_HYPHENS, _SEEN = (0x2010, 0x2011), (0x0131, 0x017F)
_FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Stands for a character that becomes several; a noncharacter. A text that holds it itself is only looked at more closely.
_MARK = "\uffff"


def icu_jar() -> str:
    """The ICU library among Spark's own."""
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    found = sorted(glob.glob(f"{home}/jars/icu4j-*.jar")) or sorted(glob.glob(f"{os.path.dirname(pyspark.__file__)}/jars/icu4j-*.jar"))
    if not found:
        raise FileNotFoundError("no ICU library among Spark's jars")
    return found[-1]


@lru_cache(1)
def confusables() -> dict[int, str]:
    """Prototype of each character that looks like another one, as ICU's data file has it (keys, then indexes into a string table)."""
    with zipfile.ZipFile(icu_jar()) as jar:
        name = next(n for n in jar.namelist() if n.endswith("/confusables.cfu"))
        data = jar.read(name)
    data = data[struct.unpack_from(">H", data)[0] :]
    _, _, _, keys, n, index, _, table, length = struct.unpack_from(">9i", data)
    strings = data[table : table + 2 * length]
    out = {}
    for k in range(n):
        key, at = struct.unpack_from(">i", data, keys + 4 * k)[0], struct.unpack_from(">H", data, index + 2 * k)[0]
        size = (key >> 24 & 0xFF) + 1
        out[key & 0xFFFFFF] = chr(at) if size == 1 else strings[2 * at : 2 * (at + size)].decode("utf-16-be")
    return out


def _form(c: str) -> str | None:
    """What a width, font, no-break or ligature form stands for."""
    kind = unicodedata.decomposition(c).partition(" ")[0]
    plain = unicodedata.normalize("NFKC", c)
    if kind in _FORMS or (kind == "<compat>" and plain.isascii() and not plain.startswith(" ")):
        return plain
    return None


@lru_cache(1)
def mapping() -> dict[int, str]:
    """What each character is shown as, where it is not itself; keys are decomposed characters and forms."""
    alike, out = confusables(), {}
    looks: dict[str, list[str]] = {}
    for a in map(chr, range(0x21, 0x7F)):
        looks.setdefault(alike.get(ord(a), a), []).append(a)
    for code in range(0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs") or 0x20 <= code < 0x7F or code in _SEEN:
            continue
        if kind == "Cf" or code in _INVISIBLE or (kind == "Cc" and not c.isspace()):
            out[code] = ""
        elif kind == "Zs" or kind in ("Zl", "Zp") or c.isspace():
            out[code] = " "
        elif code in _HYPHENS:
            out[code] = "-"
        elif (form := _form(c)) is not None:
            out[code] = form
        elif kind in ("Lu", "Ll", "Lo") and (proto := alike.get(code)):
            same = [a for a in looks.get(proto, ()) if unicodedata.category(a) == kind]
            if same:
                out[code] = same[0]
            elif len(proto) == 1 and unicodedata.category(proto) == kind and ord(proto) not in _SEEN:
                out[code] = proto
    # letters that are prototypes themselves may share their look with a letter of ASCII by another way
    return {code: "".join(out.get(ord(x), x) for x in unicodedata.normalize("NFD", to)) for code, to in out.items()}


@lru_cache(1)
def composed_mapping() -> dict[str, str]:
    """``mapping`` with composed characters too, for SQL that cannot decompose."""
    table = mapping()
    out = {chr(code): unicodedata.normalize("NFC", to) for code, to in table.items()}
    for code in range(0x80, 0x30000):
        parts = unicodedata.normalize("NFD", chr(code))
        if chr(code) not in out and parts != chr(code) and not 0xAC00 <= code <= 0xD7A3:
            to = unicodedata.normalize("NFC", parts.translate(table))
            if to != chr(code):
                out[chr(code)] = to
    return out


def shown(text: str, table: dict[int, str]) -> str:
    """The mapped form of one text."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))


@lru_cache(1)
def _translation() -> tuple[str, str, dict[str, str]]:
    """``mapping`` for ``translate``: characters, what replaces them (none for those at the end), and those that become several, which are marked first."""
    table = mapping()
    several = {chr(code): to for code, to in table.items() if len(to) > 1}
    one = {chr(code): to for code, to in table.items() if len(to) == 1} | dict.fromkeys(several, _MARK)
    return "".join(one) + "".join(chr(code) for code, to in table.items() if not to), "".join(one.values()), several


def _normal(form: str, text: Column) -> Column:
    """The ``decompose``d or ``compose``d text (NFD, NFC); as Spark takes such calls for not deterministic, they are made where they stand, once."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(form), text, F.lit(False))


def with_mapped(texts: DataFrame) -> DataFrame:
    """``texts`` (text) with ``mapped``: look-alikes, widths, blanks and invisible characters made plain, composed and in canonical order."""
    old, new, several = _translation()
    rare = "".join(several)
    longer = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    # texts with a character that becomes several are few: these characters are replaced one after the other, the rest as in all texts
    there = F.split(F.call_function("translate", F.col("parts"), F.translate("parts", rare, ""), F.lit("")), "")
    spelled = F.aggregate(F.array_distinct(there), F.col("parts"), lambda text, c: F.replace(text, c, F.coalesce(F.element_at(longer, c), c)))
    split = texts.withColumn("parts", F.when(~F.col("text").rlike("^[\\x20-\\x7e]*\\z"), _normal("decompose", F.col("text"))))
    plain = split.withColumn("plain", F.translate("parts", old, new))
    plain = plain.withColumn("plain", F.when(F.contains("plain", F.lit(_MARK)), F.translate(spelled, old, new)).otherwise(F.col("plain")))
    return plain.withColumn("mapped", F.when(F.col("parts").isNull(), F.col("text")).otherwise(_normal("compose", F.col("plain")))).drop("parts", "plain")


def collation_key(spark: SparkSession, text: Column) -> Column:
    """The sort key of a text under the collation, which Spark's own joins of collated texts compare too; SQL has no name for it."""
    jvm = spark.sparkContext._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    key = jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(bridge.expression(F.collate(text, UNICODE)._jc))
    return type(text)(bridge.column(key))


def classes(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, canonical, n_forms) of every distinct non-null text; n_forms is the number of its class's distinct texts.

    The texts of a class meet in one task, which spills where they do not fit into memory.
    """
    forms = with_mapped(texts.select(F.col(f"`{text}`").alias("text")).filter("text is not null").distinct())
    keyed = forms.select("text", (F.col("text") != F.col("mapped")).alias("other"), collation_key(texts.sparkSession, F.col("mapped")).alias("key"))
    # the hash makes the sort cheap, the key decides
    own = Window.partitionBy(F.xxhash64("key"), "key")
    best = F.min(F.struct("other", F.length("text").alias("len"), "text")).over(own)
    return keyed.select("text", best["text"].alias("canonical"), F.count(F.lit(1)).over(own).alias("n_forms"))


def variants(classed: DataFrame) -> DataFrame:
    """(text, canonical) of the classes that hold different texts."""
    return classed.filter(F.col("n_forms") > 1).select("text", "canonical")


def members(records: DataFrame, varied: DataFrame) -> DataFrame:
    """The rows of ``records`` whose text is in a class of different texts, with its ``canonical``; one row each, no pairs."""
    return records.join(varied, "text")


def same_looking(found: DataFrame) -> DataFrame:
    """(key_a, key_b) of ``members`` (rec_key, text, canonical) whose texts differ but look the same, each pair once, key_a < key_b.

    Copies of one text never meet each other; what is emitted are the pairs themselves.
    """
    mine = found.filter("rec_key is not null").select("rec_key", "text", "canonical").distinct()
    a = mine.select(F.col("text").alias("text_a"), F.col("rec_key").alias("a"), "canonical")
    b = mine.select(F.col("text").alias("text_b"), F.col("rec_key").alias("b"), "canonical")
    both = a.join(b, "canonical").filter("text_a < text_b and a <> b")
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def same_looking_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(key_a, key_b): ``members`` of parents (rec_key) and of children (parent_key, rec_key) whose texts differ but look the same."""
    top = parents.select(F.col("rec_key").alias("parent_key"), F.col("text").alias("parent_text"), "canonical").distinct()
    low = children.select("parent_key", "rec_key", "text", "canonical").distinct()
    return low.join(top, ["parent_key", "canonical"]).filter("text <> parent_text").select(F.col("parent_key").alias("key_a"), F.col("rec_key").alias("key_b")).distinct()
