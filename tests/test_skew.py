from pyspark.sql import functions as F

from ionloom.operators.skew import heavy_keys, salted_aggregate, salted_join


def test_salted_aggregate_is_plain_aggregate(spark):
    rows = [("hot", f"m{i % 7}" if i % 5 else None, float(i % 3)) for i in range(900)] + [(f"k{i}", f"m{i}", None) for i in range(60)] + [(None, "m", 1.0)] * 40
    df = spark.createDataFrame(rows, "key string, salt string, n double")  # names that the operator uses itself
    got = {r.key: (r.n, r.n_distinct, r.mean_value, r.is_heavy) for r in salted_aggregate(df, F.col("key"), F.col("salt"), F.col("n"), heavy_share=0.1, salts=8).collect()}
    plain = {r.key: (r.a, r.b, r.c) for r in df.groupBy("key").agg(F.count("*").alias("a"), F.countDistinct("salt").alias("b"), F.avg("n").alias("c")).collect()}
    assert {k: v[:3] for k, v in got.items()} == plain
    assert [k for k, v in got.items() if v[3]] == ["hot"]


def test_empty(spark):
    df = spark.createDataFrame([], "key string, d string, v double")
    assert salted_aggregate(df, F.col("key"), F.col("d"), F.col("v")).collect() == []
    assert heavy_keys(df, F.col("key"), 0.1).collect() == []


def test_salted_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 500), (None, 501), ("none", 502)], "k string, i int")
    right = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("b", "z"), (None, "n")], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(str, salted_join(left, right, "k", how=how, heavy_share=0.1, salts=4).select("k", "i").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "i").collect()))
