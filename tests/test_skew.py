from pyspark.sql import functions as F

from kinolith.operators.skew import hot_counts, numbered, previous_in_entity, salted_join, scan_entity


def test_salted_join_equals_plain(spark):
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(200)] + [(None, 1)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (4, "b"), (999, "c")], "k int, y string")
    hot = hot_counts(left, ["k"], 10)
    assert [(r.k, r.salts_) for r in hot.collect()] == [(1, 10)]
    for how in ("left", "inner"):
        a = salted_join(left, right, ["k"], how, hot).select("k", "x", "y")
        assert sorted(a.collect(), key=repr) == sorted(left.join(right, "k", how).select("k", "x", "y").collect(), key=repr)


def test_previous_across_blocks(spark):
    df = spark.createDataFrame([("a", i * 7) for i in range(50)] + [("b", 5)], "e string, o int")
    got = {(r.e, r.o): r.p for r in previous_in_entity(df, ["e"], "o", F.col("o"), "p", block=20).collect()}
    assert all(got["a", i * 7] == ((i - 1) * 7 if i else None) for i in range(50)) and got["b", 5] is None


def test_scan_equals_plain_windows(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("a" if i % 3 else "b", i * 5 % 101, None if i % 4 == 0 else i % 7) for i in range(101)], "e string, o int, x int").withColumn("keep", F.lit(1))
    w = Window.partitionBy("e").orderBy("o")
    upto, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    plain = {"lag": F.lag("x").over(w), "lead": F.lead("x").over(w), "last": F.last("x", True).over(upto), "next": F.first("x", True).over(rest), "first": F.first("x").over(upto), "max": F.max("x").over(upto), "sum": F.coalesce(F.sum("x").over(upto), F.lit(0)), "before": F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    want = sorted(df.withColumns(plain).collect(), key=repr)
    for block in (7, 1000):
        got = scan_entity(df.unionByName(df), ["e"], "o", {k: (k, F.col("x")) for k in plain}, block, distinct=True)
        assert sorted(got.select("e", "o", "x", "keep", *plain).collect(), key=repr) == want


def test_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 1009, i % 5) for i in range(1009)], "k int, s int").repartition(7)
    rows = sorted(numbered(df, [F.col("k")], "n", F.col("s")).collect(), key=lambda r: r.k)
    assert [r.n for r in rows] == list(range(1009)) and [r.before_ for r in rows] == [sum(x.s for x in rows[:i]) for i in range(1009)]
    assert numbered(df.limit(0), [F.col("k")], "n").count() == 0
