import json
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from kinolith.operators.orphans import OrphanStore
from kinolith.sources import readers, writers
from kinolith.streaming import flows


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"key", "score"} <= set(df.columns)


def test_names_have_columns():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 4, 7):
        assert f"p{n}_found" in entry.queries()


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    assert got == sorted((tuple(norm(r[at.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_counts_of_the_vector_table(spark, sf):
    got = {r.table_name: (r.n_rows, r.n_distinct) for r in entry.queries()["table_counts"](spark, sf).collect()}
    con = duckdb.connect()
    assert got["embedding_result"] == con.execute(f"SELECT count(*), (SELECT count(*) FROM (SELECT DISTINCT * FROM '{sf}/embedding_result.parquet')) FROM '{sf}/embedding_result.parquet'").fetchone()
    assert got["embedding_result"][0] > got["embedding_result"][1] and len(got) == 10


def test_readers(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string").coalesce(1).write.mode("overwrite").parquet(f"{d}/t.parquet")
    assert readers.read_table(spark, f"{d}/t.parquet", columns=["i"]).columns == ["i"]
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{d}/t.parquet", columns=["nope"])
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{d}/t.xls")
    (tmp_path / "s.json").write_text('{"3": 0.5, "9": 1.0}')
    assert sorted(map(tuple, readers.scores_from_json(spark, f"{d}/s.json").collect())) == [(3, 0.5), (9, 1.0)]
    maps = tmp_path / "maps" / "x"
    maps.mkdir(parents=True)
    (maps / "V1.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,25,0\n2,1.0,25,25\n")
    (maps / "V2.json").write_text('[{"keyframe_no": 1, "source_frame_idx": 7}]')
    assert sorted((r.video_id, r.keyframe_no, r.source_frame_idx) for r in readers.read_source_maps(spark, f"{d}/maps").collect()) == [("V1", 1, 0), ("V1", 2, 25), ("V2", 1, 7)]
    assert readers.read_frame_map(spark, f"{d}/maps/x/V1.csv").first().video_id == "V1"
    (tmp_path / "o.jsonl").write_text(json.dumps({"video_id": "v", "keyframe_no": 1, "texts": [{"text": "a", "confidence": 0.9}, {"text": "b", "confidence": 0.1}, {"text": "c", "confidence": 0.1, "accepted": True}]}))
    assert [r.text for r in readers.read_ocr(spark, f"{d}/o.jsonl").collect()] == ["a", "c"]
    (tmp_path / "v.asr.json").write_text(json.dumps({"video_id": "v", "duration_ms": 1000, "chunks": [{"start": 0.0005, "end": 1.05, "text": "x"}, {"start_ms": 1, "end_ms": 2, "text": " "}]}))
    assert [(r.start_ms, r.end_ms) for r in readers.read_transcripts(spark, f"{d}/*.asr.json").collect()] == [(0, 1000)]
    np.save(tmp_path / "m.npy", np.eye(2, dtype=np.float16))
    assert [r.vector for r in readers.read_vectors(spark, d).orderBy("embedding_row_index").collect()] == [[1.0, 0.0], [0.0, 1.0]]
    (maps / "kf_0007.webp").write_bytes(b"x")
    assert [(r.video_id, r.keyframe_no) for r in readers.index_keyframes(spark, f"{d}/maps").collect()] == [("x", 7)]
    (tmp_path / "a.csv").write_text('v,1\n"q,r",x,3\n')
    good, broken = readers.read_answers(spark, f"{d}/a.csv", "video string, frame int")
    assert [r.video for r in good.collect()] == ["v"] and broken.count() == 1


def test_versioned_table(spark, tmp_path):
    t = writers.VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    t.upsert(rows, ["k"])
    t.upsert(rows, ["k"])
    assert sorted(map(tuple, t.current().collect())) == [(1, "a"), (2, "b")]
    t.insert_absent(spark.createDataFrame([(1, "z"), (3, "c")], "k int, x string"), ["k"])
    assert sorted(map(tuple, t.current().collect())) == [(1, "a"), (2, "b"), (3, "c")] and len(t.versions()) == 3
    r = writers.VersionedTable(spark, str(tmp_path / "r"))
    for _ in range(2):
        r.append_revision(rows.limit(1), ["k"])
    assert sorted((x.k, x.revision) for x in r.current().collect()) == [(1, 1), (1, 2)]
    assert writers.markdown_table(rows).count() == 4
    assert writers.ledger_row(rows, "r1", ["k"]).first().n_rows == 2


def test_streamed_references(spark, tmp_path):
    ddl = "ref_table string, ref_key string, ref_field string, parent_table string, target_key string, ref_at timestamp"
    par = "parent_table string, target_key string, born_at timestamp, gone_at timestamp"
    spark.createDataFrame([("t", "a", "f", "p", "x", None), ("t", "b", "f", "p", "y", None)], ddl).write.parquet(str(tmp_path / "refs"))
    spark.createDataFrame([("p", "x", None, None)], par).write.parquet(str(tmp_path / "parents"))
    spark.createDataFrame([("t", "b", "f", "p", "y", None)], ddl).write.parquet(str(tmp_path / "withdrawn"))
    store = OrphanStore(spark)
    for kind, schema in (("parents", par), ("refs", ddl), ("withdrawn", ddl)):
        for attempt in range(2):  # the second has lost its checkpoint and brings the batch again
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / kind))
            flows.follow(store, stream, kind).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{kind}{attempt}")).start().awaitTermination()
    assert [(r.ref_key, r.state) for r in store.refs.collect()] == [("a", "ok")] and len(store.commits) == 3
    assert sorted((r.version, r.n_refs, r.n_missing) for r in store.snapshots().collect()) == [(2, 2, 1), (3, 1, 0)]
