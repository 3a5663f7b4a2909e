import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolith.operators import curation
from kinolith.plans import planner, ports
from kinolith.sources import files, writers


class Words:
    name = "caption"

    def __init__(self, spark):
        self.spark = spark

    def search(self, text, plan):
        return self.spark.createDataFrame([(w,) for w in text.split()], "w string")


def test_branches_and_registry(spark):
    plan = planner.plan_query("red car", {})
    calls = ports.searches([Words(spark), ports.UnavailableBranch("clip")], plan, lambda b: plan.text)
    assert {r.branch: (r.status, r.rows and len(r.rows)) for r in planner.run_branches(spark, calls, 20_000)} == {"clip": ("unavailable", None), "caption": ("completed", 2)}
    r = ports.Registry()
    r.register("kis", len)
    assert r.resolve("kis") is len and r.names() == ["kis"]
    with pytest.raises(KeyError):
        r.resolve("vqa")
    with pytest.raises(ValueError):
        r.register("kis", len)


def test_nodes():
    seen, held = [], {}
    nodes = [ports.Node("b", lambda c: seen.append("b"), ("a",), ("x",)), ports.Node("a", lambda c: seen.append("a"))]
    assert ports.run_nodes(nodes, {"x": 1}, ["b"], held) == {"a": "completed", "b": "completed"}
    assert ports.run_nodes(nodes, {"x": 2}, ["b"], held) == {"a": "skipped", "b": "completed"} and seen == ["a", "b", "b"]


def test_models_in_tasks(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "t string").coalesce(1)
    v = [r.v for r in df.select(ports.embedded("t", ports.hash_embedder(8)).alias("v")).collect()]
    assert v[0] == v[3] != v[1] and v[2] is None and abs(np.linalg.norm(v[0]) - 1) < 1e-6
    p = spark.createDataFrame([(1, "x", "yes"), (2, "bad", "no"), (3, "bad", "bad")], "i int, image_prompt string, text_prompt string")

    def model():
        def say(x):
            if x == "bad":
                raise RuntimeError("no")
            return x.upper()

        return say

    assert {(r.i, r.answer, r.how) for r in ports.answered_from_evidence(p, model, model).collect()} == {(1, "X", "vision"), (2, "NO", "language"), (3, None, "abstained")}
    assert {r.how for r in ports.answered_from_evidence(p, None, None).collect()} == {"abstained"}
    q = ports.rewritten(p, "text_prompt", model, lambda a, b: b != "NO")
    assert {(r.i, r.rewrite, r.rewrite_used) for r in q.collect()} == {(1, "YES", True), (2, "no", False), (3, "bad", False)}
    assert ports.bounded(p, 2).rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        ports.bounded(p, 9)
    found = ports.recognised(p.select("i", "image_prompt"), "image_prompt", lambda: lambda x: [{"label": c, "n": i} for i, c in enumerate(x)], "label string, n long")
    assert sorted(map(tuple, found.filter("i = 2").collect())) == [(2, "a", 1), (2, "b", 0), (2, "d", 2)]


def test_shot_model_over_windows(spark):
    f = spark.createDataFrame([("v", i) for i in range(0, 240, 2)], "video_id string, original_frame_id long")
    w = curation.inference_windows(f)
    seen = {(r.window_id, r.offset): r.original_frame_id for r in w.collect()}
    assert sum(r.kept for r in w.collect()) == 120 and seen[1, 0] == 50 and max(o for k, o in seen if k == 0) == 99
    s = ports.shot_scores(w.withColumn("px", F.col("original_frame_id")), "px", lambda: lambda xs: [x / 2 for x in xs])
    assert sorted((r.original_frame_id, r.score) for r in s.collect()) == [(i, i / 2) for i in range(0, 240, 2)]


def test_batches_are_bounded(spark):
    rng = np.random.default_rng(1)
    for n, rows, most in ((60, 2, 10), (500, 7, 100), (41, 1, 5), (9, 100, 1000), (1, 3, 3)):
        sizes = [None if x > 28 else int(x) for x in rng.integers(1, 30, n)]
        want, batch, held, count = [], -1, 0, 0
        for s in sizes:
            s = most if s is None else s
            if batch < 0 or count >= rows or held + s > most:
                batch, held, count = batch + 1, 0, 0
            held, count = held + s, count + 1
            want.append(batch)
        df = spark.createDataFrame(list(enumerate(sizes)), "i int, s int").repartition(5)
        got = curation.bounded_batches(df, [F.col("i")], F.col("s"), most, rows)
        assert [r.batch for r in got.orderBy("i").collect()] == want
    assert curation.bounded_batches(df.limit(0), [F.col("i")], F.col("s"), 5, 5).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(bytes(range(256)) * 40)
    r = files.RangeReader(str(tmp_path / "a" / "x.bin"), chunk=100, chunks=3)
    raw = bytes(range(256)) * 40
    assert r.read(95, 330) == raw[95:425] and r.read(10_200, 999) == raw[10_200:] and r.read(99_999, 1) == b"" and len(r.held) <= 3
    (tmp_path / "a" / "x.bin").write_bytes(b"changed")
    with pytest.raises(OSError):
        r.read(5_000, 10)
    paths = spark.createDataFrame([(f"{tmp_path}/a/x.bin", f"{tmp_path}/b/x.bin"), (f"{tmp_path}/a/none", f"{tmp_path}/b/none")], "source string, target string")
    assert sorted(x.status for x in files.copy_verified(paths, delete=True).collect()) == ["copied", "failed"] and sorted(x.status for x in files.copy_verified(paths, delete=True).collect()) == ["failed", "skipped"]
    assert not (tmp_path / "a" / "x.bin").exists() and (tmp_path / "b" / "x.bin").read_bytes() == b"changed"
    staged = files.by_content(spark.createDataFrame([(f"{tmp_path}/b/x.bin",)], "path string"), str(tmp_path / "cache"))
    assert [x.status for x in files.copy_verified(staged).collect()] == ["copied"] and [x.status for x in files.copy_verified(staged).collect()] == ["skipped"]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(3), path)
    with pytest.raises(Exception):
        writers.write_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.parquet(path).count() == 3
    writers.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_upserts_touch_their_own_buckets(spark, tmp_path):
    t = writers.VersionedTable(spark, str(tmp_path / "v"), buckets=8)
    t.upsert(spark.createDataFrame([(i, "a") for i in range(100)], "k int, x string"), ["k"])
    t.upsert(spark.createDataFrame([(5, "b")], "k int, x string"), ["k"])
    a, b = t.versions()
    assert sum(a["parts"][k] != b["parts"][k] for k in a["parts"]) == 1
    assert {r.k for r in t.current().filter("x = 'b'").collect()} == {5} and t.current().count() == 100


def test_micro_batches_and_deadlines(spark, tmp_path):
    from kinolith.streaming import flows

    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = []
    q = flows.micro_batches(stream, "200 milliseconds", lambda b, n: seen.append(sorted(r.id for r in b.collect())), str(tmp_path / "ck"))
    assert not flows.until(q, 12) and not q.isActive and sorted(x for s in seen for x in s) == [0, 1, 2] and all(len(s) <= 1 for s in seen)


def test_image_functions(spark):
    from kinolith.functions import num, text

    flat, ramp = bytes([7] * 144), bytes(range(16)) * 9
    df = spark.createDataFrame([(1, flat), (2, ramp), (3, b"x"), (4, None), (5, ramp[::-1])], "i int, px binary")
    got = {r.i: (r.m, r.h) for r in df.select("i", num.gray_metrics("px", F.lit(16)).alias("m"), num.dhash("px", F.lit(16)).alias("h")).collect()}
    assert got[1][0].asDict() == {"brightness": 7.0, "contrast": 0.0, "entropy": 0.0, "blur": 0.0} and got[1][1] == 0
    assert got[2][0].entropy == pytest.approx(4.0) and got[2][1] == -1 and got[5][1] == 0 and got[3] == (None, None) and got[4] == (None, None)
    q = spark.createDataFrame([('a sign "EXIT" and "x"',), ("he said 'hi'",), (None,)], "t string").select(text.quoted_phrases("t").alias("a"), text.quoted_phrases("t", ["sign"]).alias("b")).collect()
    assert [(r.a, r.b) for r in q] == [(["EXIT", "x"], ["EXIT", "x"]), (["hi"], []), (None, None)]


def test_merges_and_moves(spark):
    from kinolith.functions import num
    from kinolith.operators import contracts, mapping

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = F.array(*map(F.lit, "abcd"))
    for s, t in ((0, 3), (3, 0), (1, 2), (2, 2), (4, 0), (0, -1)):
        want = list("abcd")
        if 0 <= s < 4 and 0 <= t < 4:
            want.insert(t, want.pop(s))
        assert one(num.moved(arr, F.lit(s), F.lit(t))) == want
    rows = spark.createDataFrame([("q", 1, "k", f"e{i}", "y" * 600 if i else "  ") for i in range(30)], "q string, r int, k string, e string, s string")
    lines = contracts.evidence_lines(rows, ["q"], ["r", "e"], "k", "e", "s").orderBy("nth").collect()
    assert len(lines) == 15 and all(len(x.line) <= 500 + 10 for x in lines) and sum(len(x.line) for x in lines) + len(lines) - 1 <= 8000
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, x string, y int")
    n = writers.merge_counters(t, spark.createDataFrame([(1, "a", 1), (2, "c", 1), (3, "d", 1), (None, "e", 1)], "k int, x string, y int"), ["k"]).first()
    assert tuple(n) == (4, 1, 1, 1)
    d = mapping.ordered_distinct(spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 3), ("g", "c", 4)], "g string, k string, p int"), ["g"], "k", ["p"], 2)
    assert sorted((r.k, r.p, r.place) for r in d.collect()) == [("a", 2, 2), ("b", 1, 1)]
