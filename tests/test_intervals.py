import random

from kinolith.operators.intervals import gaps, merge_intervals

DDL = "v string, s long, e long, ent string, blk int, starts int"


def brute(rows):
    out = []
    by = {}
    for v, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(v, []).append((s, e))
    for v, spans in by.items():
        spans.sort()
        prev = None
        cur = None
        for s, e in spans:
            if cur and s <= cur[1]:
                cur = [cur[0], max(cur[1], e), cur[2] + 1]
                continue
            if cur:
                out.append((v, *cur, prev))
                prev = cur[1]
            cur = [s, e, 1]
        out.append((v, *cur, prev))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.v, r.start_ms, r.end_ms, r.n_spans, r.prev_end_ms) for r in df.collect()], key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(-500, 3000), s + rng.choice([-5, 0, 1, 7, 40, 900])) for _ in range(400)]
    rows += [("a", 0, 10), ("a", 0, 10), ("c", 5, 6), ("c", 6, 7), ("d", None, 4), ("d", 4, None)]
    df = spark.createDataFrame([(v, s, e, "clash", 1, 2) for v, s, e in rows], DDL).repartition(5)
    for block, salts in ((10, 1), (100, 3), (600_000, 8)):
        assert rows_of(merge_intervals(df, "v", "s", "e", block, salts)) == brute(rows)


def test_gaps_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 5, "", 0, 0), ("a", 9, 12, "", 0, 0), ("a", 12, 20, "", 0, 0)], DDL)
    periods = merge_intervals(df, "v", "s", "e")
    assert [tuple(r) for r in gaps(periods, "v").collect()] == [("a", 5, 9)]
    assert merge_intervals(df.limit(0), "v", "s", "e").count() == 0
