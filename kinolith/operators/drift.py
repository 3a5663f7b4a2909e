"""Problem 7: schemas that drift between files, by rescue-column ingestion.

`ingest` enforces a target schema on JSON records: a field under its target name that casts goes into its typed column,
everything else of the record (unknown names, nested objects, values that do not cast) stays as JSON in `rescued`.
`promote` takes approved spellings (raw name -> field), replays the rescued values into the typed columns and takes
what fitted out of the rescue. `load` does both for new records in one parse, with the same result. Each step notes in
`seen` which raw name and JSON type gave a field, and `layout_changes` reports every change between the files of a
producer from those notes.

A record is parsed once, in an Arrow function: Spark's VARIANT writes 5.0 and 5 as the same number, and here the two are
different types. The function walks a record's own keys down a trie of the names, so its work does not grow with the number
of names; it fills Arrow columns, not rows. Names come in blocks of at most MAX_NAMES: the first goes with the parse, each
further block is one more replay over what is still in the rescue. All the rest are built-in expressions.

Defined results: a null, empty, broken or non-object payload is not readable: typed columns and rescue are null; a JSON
null is no value; of a key twice in one object the last counts; NaN and Infinity are no JSON; repeated rows do not change
the layout; empty tables give empty tables; columns of the input that clash with added ones are kept under their name
and `_in`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.operators.skew import previous_in_entity
from kinolith.session import stage

SEEN = "array<struct<field:string,raw_name:string,json_type:string>>"
MAX_NAMES = 10_000


@dataclass(frozen=True)
class Spelling:
    """An approved raw name of a field; a dot is a step into a nested object."""

    raw_name: str
    field: str


def spelling_blocks(names: DataFrame, raw: str = "raw_name", field: str = "field_name", most: int = MAX_NAMES) -> list[list[Spelling]]:
    """The approved spellings of a names table in order of their raw name, in blocks of at most `most`."""
    rows = names.select(F.col(raw).alias("r"), F.col(field).alias("f")).filter("r is not null and f is not null").distinct()
    blocks: list[list[Spelling]] = []
    last = None
    while True:
        ahead = rows if last is None else rows.filter((F.col("r") > last[0]) | ((F.col("r") == last[0]) & (F.col("f") > last[1])))
        got = [Spelling(x.r, x.f) for x in ahead.orderBy("r", "f").limit(most).collect()]
        if got:
            blocks.append(got)
            last = (got[-1].raw_name, got[-1].field)
        if len(got) < most:
            return blocks


def _no_constant(text: str) -> None:
    raise ValueError(text)


def parse_object(text: str | None) -> dict | None:
    """The record, or None if the text is not one complete JSON object."""
    if not text:
        return None
    try:
        doc = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def json_type(v: object) -> str:
    """string, boolean, integer, decimal (written with a point or exponent), object or array."""
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "decimal"), (str, "string"), (dict, "object")):
        if isinstance(v, kind):
            return name
    return "array"


def cast_value(v: object, kind: str) -> object:
    """The value in the column's type, or None: numbers in strings cast, a decimal only to an integer it equals, 0 and 1 to booleans."""
    if isinstance(v, (dict, list)):
        return None
    if kind == "string":
        return v if isinstance(v, str) else json.dumps(v)
    if kind == "boolean":
        known = {"true": True, "false": False, "1": True, "0": False}
        return known.get(json.dumps(v) if not isinstance(v, str) else v.strip().lower())
    if isinstance(v, bool):
        return None
    try:
        if kind == "double":
            x = float(v)
            return x if math.isfinite(x) else None
        n = Decimal(v.strip()) if isinstance(v, str) else Decimal(v)
        return int(n) if n.is_finite() and n == n.to_integral_value() and -(1 << 63) <= n < 1 << 63 else None
    except (ValueError, OverflowError, InvalidOperation):
        return None


def _remove(doc: dict, path: tuple[str, ...]) -> None:
    """Take a leaf out, and the objects that it leaves empty."""
    chain = [doc]
    for step in path[:-1]:
        chain.append(chain[-1][step])
    del chain[-1][path[-1]]
    for holder, step in reversed(list(zip(chain, path[:-1]))):
        if not holder[step]:
            del holder[step]


class Trie:
    """The names of fields by their steps; `order` tells which of several values of a record is tried first."""

    def __init__(self):
        self.next: dict[str, Trie] = {}
        self.ends: list[tuple[tuple, str, str, tuple[str, ...]]] = []  # (order, field, raw name, path)

    def add(self, path: tuple[str, ...], order: tuple, field: str, raw: str) -> None:
        node = self
        for step in path:
            node = node.next.setdefault(step, Trie())
        node.ends.append((order, field, raw, path))

    def values(self, doc: dict, out: list) -> list:
        """(order, field, raw name, path, value) of all of a record's values that have a name."""
        for key, v in doc.items():
            node = self.next.get(key)
            if node is not None and v is not None:
                out += [(*end, v) for end in node.ends]
                if node.next and isinstance(v, dict):
                    node.values(v, out)
        return out


def _names(target: dict[str, str], own: bool, names: list[Spelling]) -> Trie:
    """own: the target's own names, in which a dot is no step, before all spellings."""
    trie = Trie()
    if own:
        for f in target:
            trie.add((f,), (0, f), f, f)
    for x in names:
        if x.field in target and x.raw_name != x.field:
            trie.add(tuple(x.raw_name.split(".")), (1, x.raw_name, x.field), x.field, x.raw_name)
    return trie


def _kind(target: dict[str, str]) -> str:
    return "struct<" + ",".join([*[f"`{f}`:{k}" for f, k in target.items()], "readable:boolean", f"seen:{SEEN}", "rescued:string"]) + ">"


def _arrow_type(target: dict[str, str]) -> pa.DataType:
    of = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    seen = pa.list_(pa.struct([(c, pa.string()) for c in ("field", "raw_name", "json_type")]))
    return pa.struct([*[(f, of[k]) for f, k in target.items()], ("readable", pa.bool_()), ("seen", seen), ("rescued", pa.string())])


def _arrow(target: dict[str, str], trie: Trie) -> Callable:
    kind = _arrow_type(target)
    of = {f: i for i, f in enumerate(target)}
    kinds = list(target.values())

    @F.arrow_udf(_kind(target))
    def run(text: pa.Array, filled: pa.Array) -> pa.Array:
        columns: list[list] = [[None] * len(text) for _ in of]
        readable, rescued, ends = [False] * len(text), [None] * len(text), [0]
        seen: tuple[list, list, list] = ([], [], [])
        for i, (raw, full) in enumerate(zip(text.to_pylist(), filled.to_pylist())):
            doc = parse_object(raw)
            if doc is not None:
                readable[i] = True
                found = trie.values(doc, [])
                found.sort(key=lambda x: x[0])
                taken = set()  # a value that two names give is taken once
                for _, field, name, path, v in found:
                    seen[0].append(field)
                    seen[1].append(name)
                    seen[2].append(json_type(v))
                    j = of[field]
                    if columns[j][i] is None and path not in taken and field not in (full or ()) and (c := cast_value(v, kinds[j])) is not None:
                        columns[j][i] = c
                        taken.add(path)
                        _remove(doc, path)
                rescued[i] = json.dumps(doc, ensure_ascii=False) if doc else None
            ends.append(len(seen[0]))
        fields = list(kind)
        notes = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in seen], ["field", "raw_name", "json_type"])
        arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
        return pa.StructArray.from_arrays([*arrays, pa.array(readable), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), notes).cast(fields[-2].type), pa.array(rescued, pa.string())], [f.name for f in fields])

    return run.asNondeterministic()  # else a filter on `readable` would move below and parse every record again


def load(df: DataFrame, payload: str, target: dict[str, str], names: list[list[Spelling]] | None = None) -> DataFrame:
    """Add the target's typed columns (bigint, double, string or boolean), `readable`, `seen` and `rescued` (JSON), with the
    approved spellings (`spelling_blocks`) promoted: `ingest` and `promote` in one parse."""
    for c in [*target, "readable", "rescued", "seen"]:
        if c in df.columns:
            df = df.withColumnRenamed(c, f"{c}_in")
            payload = f"{payload}_in" if payload == c else payload
    blocks = list(names or [])
    run = _arrow(target, _names(target, True, blocks[0] if blocks else []))
    x = df.withColumn("x_", run(F.col(f"`{payload}`").cast("string"), F.array().cast("array<string>")))
    out = x.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"x_.`{c}`").alias(c) for c in [*target, "readable", "seen", "rescued"]])
    for block in blocks[1:]:
        out = promote(stage(out, "replay"), block, target)
    return out


def ingest(df: DataFrame, payload: str, target: dict[str, str]) -> DataFrame:
    """The target's own names only; everything else stays in the rescue."""
    return load(df, payload, target)


def promote(df: DataFrame, names: list[Spelling], target: dict[str, str]) -> DataFrame:
    """Replay the rescued values of approved spellings into the typed columns; the rescue keeps what still does not fit.

    A value that a column already holds stays and the other remains in the rescue; of several spellings in one record the first by name is taken. A spelling
    equal to its field was tried at ingestion and is not tried again."""
    run = _arrow(target, _names(target, False, names))
    keep = [c for c in df.columns if c not in target and c not in ("seen", "rescued")]
    filled = F.array_compact(F.array(*[F.when(F.col(f"`{f}`").isNotNull(), F.lit(f)) for f in target]))
    x = df.withColumn("x_", run("rescued", filled))
    notes = F.concat(F.coalesce("seen", F.array().cast(SEEN)), F.coalesce("x_.seen", F.array().cast(SEEN)))
    typed = [F.coalesce(f"`{f}`", F.col(f"x_.`{f}`")).alias(f) for f in target]
    return x.select(*[F.col(f"`{c}`") for c in keep], *typed, notes.alias("seen"), F.col("x_.rescued").alias("rescued"))


def file_layouts(df: DataFrame, file: list[str]) -> DataFrame:
    """One row per file with a readable record: the file's columns and `layout`, a map from field to (raw_name, json_type).

    A file's notes are few (fields times spellings) and combine before the exchange, so a file with most rows stays small."""
    notes = df.filter("readable").select(*file, F.explode_outer("seen").alias("x")).distinct()
    sets = notes.groupBy(*file).agg(F.array_sort(F.collect_set("x")).alias("xs"))
    one = F.filter("xs", lambda x, i: (i == 0) | (x["field"] != F.get(F.col("xs"), i - 1)["field"]))
    return sets.select(*file, F.map_from_arrays(F.transform(one, lambda x: x["field"]), one).alias("layout"))


def layout_changes(layouts: DataFrame, producer: str, order: str, file_id: str) -> DataFrame:
    """file_id, field_name, change, and what it was and is, against the producer's previous file in `order`."""
    prev = previous_in_entity(layouts, [producer], order, F.col("layout"), "before").filter("before is not null")
    field = F.explode(F.array_union(F.map_keys("layout"), F.map_keys("before"))).alias("field_name")
    pair = prev.select(F.col(file_id), "layout", "before", field)
    pair = pair.withColumn("now", F.try_element_at("layout", F.col("field_name"))).withColumn("was", F.try_element_at("before", F.col("field_name")))
    kinds = F.array(
        F.when(F.col("was").isNull(), "added"),
        F.when(F.col("now").isNull(), "removed"),
        F.when(F.col("now.raw_name") != F.col("was.raw_name"), "renamed"),
        F.when(F.col("now.json_type") != F.col("was.json_type"), "retyped"),
    )
    out = pair.withColumn("change", F.explode(F.array_compact(kinds)))
    return out.select(file_id, "field_name", "change", F.col("was.raw_name").alias("raw_name_was"), F.col("now.raw_name").alias("raw_name_now"), F.col("was.json_type").alias("type_was"), F.col("now.json_type").alias("type_now"))
