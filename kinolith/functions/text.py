"""Text functions: normalisers, tokens, search predicates and similarity, as column expressions.

Null in, null out, unless said otherwise. What Spark has no built-in for (Unicode normal forms, cover density) runs as an
Arrow function; all the rest stays in generated code.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\s\x{A0}\x{3000}]+"
#: Letters that tell Vietnamese: d-stroke, and the twelve vowels with the five tones, but for those with neither mark nor tone.
VIETNAMESE = "đ" + "".join(c for v in "aăâeêioôơuưy" for tone in ["", "\u0301", "\u0300", "\u0309", "\u0303", "\u0323"] if (c := unicodedata.normalize("NFC", v + tone)) > "z")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mapped(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    def apply(c: str | Column) -> Column:
        @F.arrow_udf("string")
        def run(x: pa.Array) -> pa.Array:
            return pa.array([None if t is None else fn(t) for t in x.to_pylist()], pa.string())

        return run(_col(c))

    return apply


def collapse(c: str | Column) -> Column:
    """Blanks to one space, ends trimmed (captions)."""
    return F.trim(F.regexp_replace(_col(c), BLANKS, " "))


def nfkc(c: str | Column) -> Column:
    return _mapped(lambda t: unicodedata.normalize("NFKC", t))(c)


def retrieval_text(c: str | Column) -> Column:
    """NFKC, blanks collapsed, trimmed; keeps case (queries)."""
    return collapse(nfkc(c))


def ocr_text(c: str | Column) -> Column:
    """NFKC, collapsed, case-folded (refined OCR)."""
    return collapse(_mapped(lambda t: unicodedata.normalize("NFKC", t).casefold())(c))


def speech_text(c: str | Column) -> Column:
    """NFC, collapsed; keeps case and marks (speech and OCR at run time)."""
    return collapse(_mapped(lambda t: unicodedata.normalize("NFC", t))(c))


def _fold(t: str) -> str:
    base = "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn")
    return base.lower().replace("đ", "d")


def fold(c: str | Column) -> Column:
    """Marks stripped, d-stroke to d, lower case, all but letters and digits to one space (object labels)."""
    return F.trim(F.regexp_replace(_mapped(_fold)(c), r"[^\p{L}\p{N}]+", " "))


def language(c: str | Column) -> Column:
    """vi if Vietnamese letters occur, en if Latin letters do, else unknown."""
    c = F.lower(_col(c))
    return F.when(c.rlike(f"[{VIETNAMESE}]"), "vi").when(c.rlike("[a-z]"), "en").otherwise("unknown")


def quoted_phrases(c: str | Column, before: list[str] | None = None) -> Column:
    """Texts of at most 200 characters between quotes, straight or curly; with `before`, those with one of the words in the 60 characters in front."""
    c = _col(c)
    if before is None:
        return F.regexp_extract_all(c, F.lit("[\"“”']([^\"“”']{1,200})[\"“”']"), 1)

    @F.arrow_udf("array<string>")
    def run(x: pa.Array) -> pa.Array:
        quote = re.compile("[\"“”']([^\"“”']{1,200})[\"“”']")
        return pa.array([None if t is None else [m[1] for m in quote.finditer(t) if any(w in t[max(0, m.start() - 60) : m.start()].lower() for w in before)] for t in x.to_pylist()], pa.list_(pa.string()))

    return run(c)


def concept_tokens(c: str | Column, stopwords: list[str], longest: int = 16) -> Column:
    """The first distinct tokens longer than two characters that are no stopwords."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*[F.lit(s) for s in stopwords]), w))
    return F.slice(F.array_distinct(kept), 1, longest)


def tokens(c: str | Column) -> Column:
    """'simple' lexemes: lower case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def trigrams(c: str | Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class WebQuery:
    """A web-search query: alternatives of required and excluded terms, a term being a list of adjacent words."""

    any_of: tuple[tuple[tuple[tuple[str, ...], bool], ...], ...]


def parse_web_query(text: str) -> WebQuery:
    """Words are required, "a b" must be adjacent, `or` separates alternatives, -x excludes."""
    groups: list[list[tuple[tuple[str, ...], bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if not phrase and word.lower() == "or" and not minus:
            groups.append([])
            continue
        terms = tuple(re.findall(r"[^\W]+", (phrase or word).lower()))
        if terms:
            groups[-1].append((terms, minus == "-"))
    return WebQuery(tuple(tuple(g) for g in groups if g))


def _adjacent(lexemes: Column, words: tuple[str, ...]) -> Column:
    """Whether the words stand next to each other."""
    n, phrase = len(words), F.array(*[F.lit(w) for w in words])
    starts = F.sequence(F.lit(1), F.greatest(F.size(lexemes) - n + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.slice(lexemes, i, n) == phrase)


def matches(lexemes: Column, query: WebQuery) -> Column:
    """Whether an array of lexemes satisfies the query; an empty query matches nothing."""
    any_ = F.lit(False)
    for group in query.any_of:
        all_ = F.lit(True)
        for words, negated in group:
            if len(words) == 1:
                hit = F.array_contains(lexemes, words[0])
            else:
                hit = _adjacent(lexemes, words)
            all_ = all_ & (~hit if negated else hit)
        any_ = any_ | all_
    return any_


def cover_density(words: list[str], terms: list[str], weight: float = 0.1) -> float:
    """Cover-density rank: each minimal span that holds all terms adds weight / (1 + words in it that are no hits)."""
    need = set(terms)
    places = [(i, w) for i, w in enumerate(words) if w in need]
    if not need or need - {w for _, w in places}:
        return 0.0
    total, begin, count = 0.0, 0, {}
    for end, (at, w) in enumerate(places):
        count[w] = count.get(w, 0) + 1
        if len(count) < len(need):
            continue
        while count[places[begin][1]] > 1:
            count[places[begin][1]] -= 1
            begin += 1
        hits = end - begin + 1
        noise = at - places[begin][0] - (hits - 1)
        total += weight / (1 + noise)
        del count[places[begin][1]]
        begin += 1
    return total


def rank_cd(lexemes: str | Column, terms: list[str]) -> Column:
    """Cover density of an array of lexemes for required terms."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cover_density(t, terms) for t in x.to_pylist()], pa.float64())

    return run(_col(lexemes))


def natural_key(c: str | Column) -> Column:
    """Sort key in which runs of digits compare as numbers of any length: each run behind its number of digits, without leading zeros."""
    parts = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    bare = lambda p: F.ltrim(p, F.lit("0"))
    number = lambda p: F.concat(F.lit("\x01"), F.lpad(F.length(bare(p)).cast("string"), 10, "0"), bare(p), F.lit("\x01"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), number(p)).otherwise(p)), "")


def csv_cell(c: str | Column) -> Column:
    """A cell that no spreadsheet runs: formula starts get an apostrophe; quotes, commas and blanks are quoted."""
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    safe = F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(safe.rlike(r'[",\s]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def safe_id(c: str | Column) -> Column:
    """Ids that are safe as a path step."""
    return _col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~_col(c).contains("..")


def uri_parts(c: str | Column) -> Column:
    """scheme, bucket and key of file, r2 and s3 addresses; null for others."""
    c = _col(c)
    ok = c.rlike(r"^(file|r2|s3)://")
    part = lambda i: F.regexp_extract(c, r"^(\w+)://([^/]*)/?(.*)$", i)
    return F.when(ok, F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key")))


def without_secrets(c: str | Column) -> Column:
    """An address without user, password and query string (failure logs)."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(://)[^/@\s]+@", "$1"), r"\?[^\s]*", "?***")


def model_json(c: str | Column, ddl: str) -> Column:
    """The JSON of a model's answer: fences taken off, first object read by the given schema."""
    bare = F.regexp_replace(_col(c), r"(?s)```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), ddl)


def model_answer(c: str | Column, name: str) -> Column:
    """value and how (json, label or none) of one field of a model's answer: from its JSON, else from a line `name: value`."""
    c = _col(c)
    found = F.get_json_object(F.regexp_extract(F.regexp_replace(c, r"(?s)```(?:json)?", ""), r"(?s)(\{.*\})", 1), f"$.{name}")
    label = F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^\s*{re.escape(name)}\s*:[ \t]*(.+?)[ \t]*$", 1)), F.lit(""))
    how = F.when(found.isNotNull(), "json").when(label.isNotNull(), "label").otherwise("none")
    return F.struct(F.coalesce(found, label).alias("value"), how.alias("how"))


def byte_range(header: str | Column) -> Column:
    """start and end of `bytes=a-b`; either may be open."""
    h = _col(header)
    part = lambda i: F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", i), F.lit("")).cast("long")
    return F.when(h.rlike(r"^bytes=\d*-\d*$") & ~h.rlike(r"^bytes=-$"), F.struct(part(1).alias("start"), part(2).alias("end")))


def text_branch(df: DataFrame, key: str, column: str, query: str, k: int, least: float = 0.15) -> DataFrame:
    """key and score of the k best rows that match the web-search query or are alike by trigrams: the greater of cover density and
    similarity, and 0.25 where the text holds the query. The query is a string, so `%` and `_` in it are plain characters."""
    q = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", query)).strip().lower()
    web = parse_web_query(q)
    needed = [w for group in web.any_of for words, negated in group if not negated for w in words]
    x = df.withColumn("t_", F.lower(column)).withColumn("lex_", tokens(column))
    sim = similarity(trigrams("t_"), F.array(*[F.lit(t) for t in probe_trigrams(q)]))
    hit = matches(F.col("lex_"), web)
    x = x.select(key, "t_", "lex_", sim.alias("sim_"), hit.alias("hit_")).filter((F.col("sim_") > least) | F.col("hit_"))
    rank = F.when(F.col("hit_"), rank_cd("lex_", list(dict.fromkeys(needed)))).otherwise(0.0)
    score = F.round(F.greatest(rank, F.col("sim_")) + F.when(F.contains("t_", F.lit(q)), 0.25).otherwise(0.0), 6)
    return x.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def probe_trigrams(s: str) -> list[str]:
    """The trigrams of a text on the driver, as `trigrams` gives them."""
    return list(dict.fromkeys(f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for i in range(len(w) + 1)))


def write_postings(df: DataFrame, key: str, column: str, path: str, buckets: int = 64) -> None:
    """Store the trigram postings of texts: gram, id and the number of the text's trigrams, in folders by the gram's hash and sorted by gram."""
    grams = trigrams(column)
    p = df.select(F.col(key).alias("id"), grams.alias("g_")).select("id", F.size("g_").alias("n"), F.explode("g_").alias("gram"))
    p = p.withColumn("b", F.pmod(F.hash("gram"), F.lit(buckets)))
    p.repartition("b", F.pmod(F.hash("id"), F.lit(4))).sortWithinPartitions("b", "gram").write.partitionBy("b").parquet(path)


def search_postings(spark: SparkSession, path: str, probe: list[str], least: float, buckets: int = 64) -> DataFrame:
    """id and sim of the texts whose similarity with the probe's trigrams is above `least` (not below 0): the filter on gram and bucket
    reaches the files, and the shared trigrams are counted before the exchange. buckets: as the postings were written."""
    p = spark.read.parquet(path)
    held = spark.range(1).select(F.array_distinct(F.array(*[F.pmod(F.hash(F.lit(g)), F.lit(buckets)) for g in probe]))).first()[0]
    hits = p.filter(F.col("b").isin(held) & F.col("gram").isin(probe)).groupBy("id").agg(F.count("*").alias("i"), F.first("n").alias("n"))
    return hits.select("id", (F.col("i") / (F.col("n") + len(probe) - F.col("i"))).alias("sim")).filter(F.col("sim") > least)


def label_branch(df: DataFrame, label: str, confidence: str, terms: list[str], keys: list[str], order: list[str], k: int, least: float = 0.2) -> DataFrame:
    """keys and score of the k best rows by label: exact labels count 1, and only if there are none those that are alike by trigrams.

    The score is weighted by the confidence, the best of a row's terms counts. Distinct labels, not rows, meet the terms."""
    weight = 0.75 + 0.25 * F.col(confidence)
    exact = df.filter(F.col(label).isin(terms))
    if not exact.take(1):
        labels = df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("g_", trigrams(label))
        sims = [F.when(F.col(label) == t, 1.0).otherwise(similarity(F.col("g_"), F.array(*[F.lit(g) for g in probe_trigrams(t)]))) for t in terms]
        alike = labels.select(label, F.greatest(*sims, F.lit(0.0)).alias("sim_")).filter(F.col("sim_") > least)
        scored = df.join(alike, label).withColumn("s_", F.col("sim_") * weight)
    else:
        scored = exact.withColumn("s_", weight)
    best = scored.groupBy(*keys).agg(F.round(F.max("s_"), 6).alias("score"))
    return best.orderBy(F.col("score").desc(), *order).limit(k)


def clean_json(*columns: str) -> Column:
    """Columns as a JSON object with sorted keys; NaN and infinite values are null and left out."""
    def value(c: str) -> Column:
        x = F.col(c)
        return F.when(~F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)), x).alias(c)

    return F.to_json(F.struct(*[value(c) for c in sorted(columns)]))
