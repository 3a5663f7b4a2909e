"""Problem 10: one consistent form of text that looks the same, by quick-check and splicing.

The form: canonical composition (NFC); full-width forms as ordinary ones; characters without a glyph dropped; every blank
other than a line break a plain space; letters of other scripts that look like Latin letters as those. Case, punctuation,
digits, accents, the number of blanks and line breaks stay.

Most text is in that form already. A character is *unstable* if the form changes it by itself or if the NFC quick check
does not say yes for it (it may join or reorder with its neighbours); the class of unstable characters is made once from
the Unicode properties. A segment is a run of unstable characters with the one stable character before it as context (an
accent joins that one), and since what follows a segment is a stable starter, nothing outside it can take part. Only
segments are normalised, and the results are spliced into the unchanged rest; text without a match is returned as it is.

Defined results: null stays null; an empty text stays empty; any length, the work is linear; the form of a form is itself.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.operators.skew import HOT_ROWS, hot_counts, salted_join
from kinolith.session import stage

LINE_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
#: Letters of other scripts with the Latin letter they look like; where the table of `lookalikes` has another
#: letter or none, these hold (the capital I has the look of a small l there).
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝԌԚԜҮүӀӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwGQWYyIl"))
ARMENIAN = dict(zip("Օօոսհց", "Oonuhg"))
LOOKALIKES = GREEK | CYRILLIC | ARMENIAN


@lru_cache(maxsize=1)
def lookalikes() -> dict[str, str]:
    """Letters of other scripts with the Latin letter they look like, from the public confusables data.

    The data is that of the ICU library which Spark brings: a letter's skeleton is the prototype of all that look like it.
    Taken are letters that are not Latin, run from left to right, and have one ASCII letter of the same case as skeleton."""
    jvm = SparkSession.builder.getOrCreate().sparkContext._jvm
    letters = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L" and unicodedata.bidirectional(chr(c)) == "L"]
    letters = [c for c in letters if not re.match("LATIN |FULLWIDTH LATIN|CJK |HANGUL ", unicodedata.name(c, "CJK "))]
    skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    out = {}
    for c, s in zip(letters, skeletons, strict=True):
        if len(s) == 1 and "A" <= s <= "z" and s.isalpha():
            s = "I" if s == "l" and c.isupper() else s
            if not (c.isupper() and s.islower() or c.islower() and s.isupper()):
                out[c] = s
    return out | LOOKALIKES


#: Format characters that do have a glyph: they stand before and around digits.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Characters without a glyph that are not of the format category.
NO_GLYPH = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def single(ch: str, alike: dict[str, str]) -> str:
    """What the form makes of one character before composition: its own replacement, '' if dropped."""
    cp, kind = ord(ch), unicodedata.category(ch)
    if ch in LINE_BREAKS:
        return ch
    if kind == "Zs" or ch == "\t":
        return " "
    if kind == "Cc" or cp in NO_GLYPH or (kind == "Cf" and cp not in VISIBLE_FORMAT):
        return ""
    if 0xFF01 <= cp <= 0xFF5E:
        return chr(cp - 0xFEE0)
    if 0xFFE0 <= cp <= 0xFFE6:
        ch = unicodedata.normalize("NFKC", ch)[-1]
        return ch if ch != "̄" else "¯"
    return alike.get(ch, ch)


@lru_cache(maxsize=1)
def tables() -> tuple[dict[int, str], str]:
    """Single replacements, and the unstable characters as a regex class."""
    replace, unstable, seconds = {}, bytearray(sys.maxunicode + 1), set()
    alike = lookalikes()
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if cp < 0xAC00 or cp > 0xD7A3:
            parts = unicodedata.decomposition(ch)
            if parts and parts[0] != "<" and len(two := parts.split()) == 2:
                seconds.add(int(two[1], 16))
        if (new := single(ch, alike)) != ch:
            replace[cp] = new
    seconds |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if cp in replace or cp in seconds or unicodedata.combining(ch):
            unstable[cp] = 1
        elif cp > 127 and (not unicodedata.is_normalized("NFC", ch) or (cp < 0xAC00 and any(ord(x) in replace for x in unicodedata.normalize("NFD", ch)))):
            unstable[cp] = 1
    # all beyond the basic plane is one range: a class with single ranges there is searched one by one for every character
    ranges, cp = ["\\U00010000-\\U0010ffff"], 0
    while 0 <= (cp := unstable.find(1, cp)) < 0x10000:
        end = unstable.find(0, cp)
        end = min(end if end >= 0 else sys.maxunicode + 1, 0x10000)
        ranges.append(f"\\U{cp:08x}-\\U{end - 1:08x}")
        cp = end
    return replace, "".join(ranges)


def form_function() -> Callable[[str | None], str | None]:
    """A function from a text to its consistent form; carries its own tables."""
    replace, unstable = tables()
    pattern = f"[{unstable}]+(?:[^{unstable}]{{1,12}}[{unstable}]+)*"  # segments near each other are one: stable text between them stays as it is
    compiled: list[re.Pattern] = []

    def form(text: str | None) -> str | None:
        if not text:
            return text
        if not compiled:
            compiled.append(re.compile(pattern))
        out, done = [], 0
        for m in compiled[0].finditer(text):
            a, b = max(m.start() - 1, 0), m.end()  # with the stable character before it, which no earlier segment holds
            out.append(text[done:a])
            out.append(unicodedata.normalize("NFC", unicodedata.normalize("NFD", text[a:b]).translate(replace)))
            done = b
        if not out:
            return text
        out.append(text[done:])
        return "".join(out)

    return form


def consistent(text: str | Column, pushed: bool = True) -> Column:
    """The consistent form of a text column. pushed=False keeps filters on it from being moved below, as each use there
    would compute the form again."""
    form = form_function()

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([form(t) for t in x.to_pylist()], pa.string())

    return (run if pushed else run.asNondeterministic())(F.col(text) if isinstance(text, str) else text)


def form_keys(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, form_key, text_key (128-bit digests) of each document whose form is not blank; each document once.

    Texts end here: everything later moves digests only."""
    form = F.col("form_")
    keyed = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text_")).filter("text_ is not null").withColumn("form_", consistent("text_", pushed=False))
    keyed = keyed.filter(F.length(F.regexp_replace(form, r"[\s\x{85}\x{2028}\x{2029}]+", "")) > 0)
    return keyed.select("doc_id", F.unhex(F.md5(form)).alias("form_key"), F.unhex(F.md5("text_")).alias("text_key")).distinct()


def look_alikes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id_a < doc_id_b of documents whose texts differ but look the same.

    Classes with one text drop out by a combining aggregate. Pairs are made between the class's different texts first and
    then carried to their documents, so copies of one text are never paired with each other. A form or a text with very many
    documents is dealt to salts in every join."""
    keys = stage(form_keys(df, doc_id, text), "forms")
    mixed = keys.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter("lo <> hi").select("form_key")
    members = stage(salted_join(keys, mixed, ["form_key"], "inner", _hot(keys, "form_key", hot_rows)), "members")
    texts = members.select("form_key", "text_key").distinct()
    b = texts.select("form_key", F.col("text_key").alias("text_b"))
    pairs = texts.withColumnRenamed("text_key", "text_a").join(b, "form_key").filter("text_a < text_b").drop("form_key")
    hot = _hot(members, "text_key", hot_rows)
    docs = members.select("doc_id", "text_key")
    one = salted_join(docs.select(F.col("doc_id").alias("x"), F.col("text_key").alias("text_a")), pairs, ["text_a"], "inner", hot.withColumnRenamed("text_key", "text_a"))
    two = salted_join(docs.select(F.col("doc_id").alias("y"), F.col("text_key").alias("text_b")), one, ["text_b"], "inner", hot.withColumnRenamed("text_key", "text_b"))
    return two.filter("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def _hot(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """The hot keys of a staged table; none are looked for where the whole has too few rows for one."""
    few = df.count() <= hot_rows  # from the Parquet footers
    return df.sparkSession.createDataFrame([], f"{key} binary, salts_ int") if few else hot_counts(df, [key], hot_rows)


def look_alike_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, class_id (least document of the same look) and n_texts, the different texts of the class; one row per document."""
    keys = stage(form_keys(df, doc_id, text), "forms")
    classes = keys.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("first")).groupBy("form_key").agg(F.min("first").alias("class_id"), F.count("*").alias("n_texts"))
    return salted_join(keys, classes, ["form_key"], "inner", _hot(keys, "form_key", hot_rows)).select("doc_id", "class_id", "n_texts")
