import json

from kinolith.operators.drift import Spelling, cast_value, file_layouts, ingest, layout_changes, load, parse_object, promote, spelling_blocks

TARGET = {"n": "bigint", "fps": "string", "s": "double", "ok": "boolean"}
NAMES = [Spelling("n", "n"), Spelling("nn", "n"), Spelling("c.n", "n"), Spelling("sec", "s"), Spelling("fps", "fps")]
DDL = "producer string, file_no int, file_id long, payload string, n int, seen string"


def test_values():
    assert parse_object(None) is None and parse_object("") is None and parse_object("[1]") is None and parse_object('{"a": 1') is None
    assert parse_object('{"a": NaN}') is None and parse_object("[" * 100_000) is None
    assert cast_value("443", "bigint") == 443 and cast_value(5.0, "bigint") == 5 and cast_value(5.5, "bigint") is None
    assert cast_value(True, "bigint") is None and cast_value("x", "double") is None and cast_value(3, "string") == "3"
    assert cast_value(1 << 70, "bigint") is None and cast_value("true", "boolean") is True and cast_value(1, "boolean") is True and cast_value(2, "boolean") is None


def test_rescue_promote_replay(spark):
    pay = ['{"n": 1, "x": [1], "fps": "25/1"}', '{"c": {"n": 7.0, "k": 2}, "sec": "1.5"}', '{"n": "bad", "nn": 4}', '{"n": null, "ok": true}', "", None, '{"n": 3', '{"n": 1, "nn": 2}']
    df = spark.createDataFrame([("p", i, i, x, 9, "z") for i, x in enumerate(pay)], DDL)
    first = ingest(df, "payload", TARGET)
    assert "n_in" in first.columns and "seen_in" in first.columns
    out = {r.file_id: r for r in promote(first, NAMES, TARGET).collect()}
    assert (out[0].n, out[0].fps, json.loads(out[0].rescued)) == (1, "25/1", {"x": [1]})
    assert (out[1].n, out[1].s, json.loads(out[1].rescued)) == (7, 1.5, {"c": {"k": 2}})
    assert (out[2].n, json.loads(out[2].rescued)) == (4, {"n": "bad"})
    assert (out[3].n, out[3].ok, json.loads(out[3].rescued)) == (None, True, {"n": None})
    assert not out[4].readable and not out[5].readable and not out[6].readable and out[6].rescued is None
    assert (out[7].n, json.loads(out[7].rescued)) == (1, {"nn": 2})


def test_changes(spark):
    pay = [(1, '{"n": 1}'), (1, '{"n": 1}'), (3, None), (4, '{"nn": 2.0, "fps": "a"}'), (7, '{"c": {"n": 2.5}}')]
    df = spark.createDataFrame([("p", i, i, x, 9, "z") for i, x in pay], DDL)
    layouts = file_layouts(promote(ingest(df, "payload", TARGET), NAMES, TARGET), ["producer", "file_no", "file_id"])
    got = {(r.file_id, r.field_name, r.change) for r in layout_changes(layouts, "producer", "file_no", "file_id").collect()}
    assert got == {(4, "n", "renamed"), (4, "n", "retyped"), (4, "fps", "added"), (7, "n", "renamed"), (7, "fps", "removed")}
    assert file_layouts(promote(ingest(df.limit(0), "payload", TARGET), NAMES, TARGET), ["producer", "file_no", "file_id"]).count() == 0


def test_one_parse_equals_two_steps_and_blocks(spark):
    pay = ['{"n": "bad", "nn": 4, "c": {"n": 1}}', '{"sec": 2, "s": "x", "zz": {"q": {"w": 1}}}', '{"c": {"n": 3, "m": {}}}', '{"nn": null, "a": {"a": {"n": 9}}}', "[]", None, '{"n": 1.5, "c": {"n": 2}}', '{"c.n": 5}', "{}"]
    df = spark.createDataFrame([("p", i, i, x, 9, "z") for i, x in enumerate(pay)], DDL)
    names = [*NAMES, Spelling("a.a.n", "n"), Spelling("zz.q", "s"), Spelling("other", "unknown")]
    table = spark.createDataFrame([(x.raw_name, x.field) for x in names] + [(None, "n"), ("nn", "n")], "raw_name string, field_name string")
    rows = lambda x: sorted([tuple(r[c] for c in ("file_id", *TARGET, "readable", "seen", "rescued")) for r in x.collect()])
    want = rows(promote(ingest(df, "payload", TARGET), sorted(names, key=lambda x: x.raw_name), TARGET))
    assert [len(b) for b in spelling_blocks(table, most=3)] == [3, 3, 2]
    assert rows(load(df, "payload", TARGET, spelling_blocks(table))) == want
    blocks = rows(load(df, "payload", TARGET, spelling_blocks(table, most=1)))  # more names than a block holds
    assert [r[:6] for r in blocks] == [r[:6] for r in want] and [r[-1] for r in blocks] == [r[-1] for r in want]
