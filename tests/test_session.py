from pyspark.sql import functions as F

from tidemark.session import cut, free_name, salted_join


def test_salted_join_is_a_join(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v int")
    for how in ("left", "inner"):
        want, got = (sorted(map(tuple, df.select("id", "k", "v").collect()), key=str) for df in (big.join(small, "k", how), salted_join(big, small, ["k"], F.col("id"), how)))
        assert want == got


def test_cut_and_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, _A int")
    assert free_name(df, "b") == "b" and free_name(df, "a") == "__a"
    assert [tuple(r) for r in cut(df).collect()] == [(1, 2)]
    assert cut(df.limit(0)).count() == 0


def test_hot_key_of_a_third(spark):
    from tidemark.operators.snapshots import change_events

    rows = spark.range(6000).select((F.col("id") % 2 + 1).cast("int").alias("s"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("b"), F.expr("id div 2").alias("j"), F.when(F.col("id") % 4 == 1, "x").otherwise("y").alias("t"))
    got = change_events(rows, "s", "b", ["j"], ["t"], F.lit(1).cast("bigint"))
    plain = rows.groupBy("b").agg(F.count_distinct("s").alias("n")).where("n = 2").select("b")
    r = rows.join(plain, "b").groupBy("b", "j").agg(F.max(F.when(F.col("s") == 1, F.col("t"))).alias("a"), F.max(F.when(F.col("s") == 2, F.col("t"))).alias("z"))
    want = r.where("NOT (a <=> z)").select("b", "j", F.expr("CASE WHEN a IS NULL THEN 'added' WHEN z IS NULL THEN 'removed' ELSE 'changed' END").alias("k"))
    assert sorted(map(tuple, got.select("b", "j", "change_kind").collect())) == sorted(map(tuple, want.collect()))
