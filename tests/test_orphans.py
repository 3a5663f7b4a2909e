from datetime import datetime as D

from kinolith.operators.orphans import OrphanStore, replay

REF = "ref_table string, ref_key string, ref_field string, parent_table string, target_key string, ref_at timestamp, extra int"
PAR = "parent_table string, target_key string, born_at timestamp, gone_at timestamp, extra int"


def ref(key, target, at):
    return ("t", key, "f", "p", target, at, 1)


def states(store):
    return {(r.ref_key, r.target_key): r.state for r in store.refs.collect()}


def test_waiting_resolved_reopened(spark):
    store = OrphanStore(spark)
    refs = spark.createDataFrame([ref("a", "x", D(2026, 1, 1)), ref("b", "y", D(2026, 1, 5)), ref("b", "y", D(2026, 1, 5)), ref("n", None, D(2026, 1, 5))], REF)
    parents = spark.createDataFrame([("p", "y", D(2026, 1, 2), None, 0)], PAR)
    store.advance(refs, parents)
    assert states(store) == {("a", "x"): "missing", ("b", "y"): "ok"}
    store.advance(None, spark.createDataFrame([("p", "x", D(2026, 2, 1), None, 0)], PAR))
    assert states(store) == {("a", "x"): "late", ("b", "y"): "ok"}
    store.advance(refs, spark.createDataFrame([("p", "y", None, D(2026, 3, 1), 0)], PAR))
    assert states(store) == {("a", "x"): "late", ("b", "y"): "deleted"}
    counts = {r.period: (r.n_refs, r.n_missing, r.n_deleted, r.n_late) for r in store.snapshot().collect()}
    assert counts == {"2026-01": (2, 0, 1, 1)}
    assert store.snapshots().select("version").distinct().count() == 3
    again = OrphanStore(spark, store.root)  # a new process opens the same folder
    assert states(again) == states(store) and sorted(map(tuple, again.snapshot().collect())) == sorted(map(tuple, store.snapshot().collect()))


def test_replay_equals_one_delta_with_hot_keys(spark):
    refs = spark.createDataFrame([ref(str(i), "hot" if i % 3 else f"k{i % 7}", D(2026, 1 + i % 9, 1)) for i in range(300)], REF)
    parents = spark.createDataFrame([("p", "hot", D(2026, 3, 1), None, 0), ("p", "k1", None, None, 0), ("p", "k1", None, None, 0), ("p", "k2", D(2025, 1, 1), D(2026, 4, 1), 0)], PAR)
    one = OrphanStore(spark).advance(refs, parents)
    counts = lambda s: sorted(map(tuple, s.snapshot().collect()))
    for epochs in (1, 2, 5):
        many = replay(spark, refs, parents, epochs=epochs, hot_rows=20)
        assert states(one) == states(many) and counts(one) == counts(many)
    before = states(many)
    assert states(many.compact()) == before and many.advance(parents=parents.limit(0)).snapshot().count() == len(counts(one))
    assert set(states(one).values()) == {"ok", "late", "missing", "deleted"}


def test_empty_tables(spark):
    store = replay(spark, spark.createDataFrame([], REF), spark.createDataFrame([], PAR))
    assert store.orphans().count() == 0 and store.snapshot().count() == 0


def test_withdrawn_repeated_and_resolved_references(spark):
    who = "ref_table string, ref_key string, ref_field string, parent_table string, target_key string"
    store = OrphanStore(spark, compact_every=3)
    store.advance(spark.createDataFrame([ref("a", "x", D(2026, 1, 5)), ref("b", "x", D(2026, 1, 9)), ref("c", "z", None)], REF), batch="r0")
    gone = spark.createDataFrame([("t", "a", "f", "p", "x"), ("t", "none", "f", "p", "x")], who)
    store.advance(withdrawn=gone, batch="w0").advance(withdrawn=gone, batch="w0").advance(withdrawn=gone, batch="w1")
    assert states(store) == {("b", "x"): "missing", ("c", "z"): "missing"}
    store.advance(parents=spark.createDataFrame([("p", "x", D(2026, 1, 7), None, 0)], PAR), batch="p0")
    store.advance(spark.createDataFrame([ref("a", "x", D(2026, 1, 8)), ref("b", "x", D(2026, 1, 1))], REF), batch="r1")
    assert states(store) == {("a", "x"): "ok", ("b", "x"): "ok", ("c", "z"): "missing"}
    assert {tuple(r) for r in store.snapshot().collect()} == {("t", "f", "2026-01", 2, 0, 0, 0), ("t", "f", None, 1, 1, 0, 0)}
    store.advance(parents=spark.createDataFrame([("p", "x", None, D(2026, 3, 1), 0), ("p", "z", None, None, 0)], PAR), batch="p1")
    assert states(store) == {("a", "x"): "deleted", ("b", "x"): "deleted", ("c", "z"): "ok"} and store.orphans().count() == 2
    assert any(c["base"] for c in store.commits[1:])


def test_a_delta_reads_its_own_buckets(spark):
    refs = spark.createDataFrame([ref(str(i), f"k{i}", D(2026, 1, 1)) for i in range(400)], REF)
    store = OrphanStore(spark, buckets=40).advance(refs, spark.createDataFrame([("p", f"k{i}", None, None, 0) for i in range(300)], PAR))
    plan = store._open([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(b#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.advance(parents=spark.createDataFrame([("p", "k7", None, D(2026, 2, 1), 0)], PAR))
    moved = store._read("moves", "ref_key string, b int", None, store.commits[-1:]).collect()
    assert [r.ref_key for r in moved] == ["7"] and store.orphans().count() == 101
