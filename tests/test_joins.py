import random

from pyspark.sql import functions as F

from cloneflow.operators.joins import first_rows, fits, join_unique, number_rows


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}" if i % 3 == 1 else f"only{i}") for i in range(n)]
    big = spark.createDataFrame(rows, "id long, k string")
    keys = sorted({k for _, k in rows if k != "k7"})
    return big, spark.createDataFrame([(k, f"v_{k}") for k in keys], "k string, v string")


def test_salted_join_equals_plain_join(spark):
    big, unique = skewed(spark)
    for how in ("inner", "left"):
        want = sorted((r.id, r.k, r.v or "") for r in big.join(unique, "k", how).collect())
        salted = join_unique(big, unique, ["k"], ["id"], how=how, broadcast_bytes=0, min_hot_rows=100)
        assert sorted((r.id, r.k, r.v or "") for r in salted.collect()) == want
        known = big.groupBy("k").agg(F.count("*").alias("n"))
        counted = join_unique(big, unique, ["k"], ["id"], how=how, counts=known, broadcast_bytes=0, min_hot_rows=100)
        assert sorted((r.id, r.k, r.v or "") for r in counted.collect()) == want
        small = join_unique(big, unique, ["k"], ["id"], how=how)
        assert sorted((r.id, r.k, r.v or "") for r in small.collect()) == want


def test_hot_key_is_split_and_small_side_is_broadcast(spark):
    big, unique = skewed(spark)
    plan = join_unique(big, unique, ["k"], ["id"], broadcast_bytes=0, min_hot_rows=100)._jdf.queryExecution().toString()
    assert "_salt" in plan
    plan = join_unique(big, unique, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_salt" not in plan
    assert fits(unique) and not fits(unique, 100)


def test_first_rows_and_numbers(spark):
    rows = [(i, f"g{i % 5}", f"x{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, x string")
    assert sorted(r.id for r in first_rows(df, "g", "id").collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.idx for r in number_rows(df, "x").collect()) == list(range(400))
    per_group = {}
    for r in number_rows(df, "x", by=["g"], name="n").collect():
        per_group.setdefault(r.g, []).append(r.n)
    assert {g: sorted(v) for g, v in per_group.items()} == {f"g{i}": list(range(80)) for i in range(5)}


def test_guard_sees_the_bytes_inside_nested_values(spark):
    token = "x" * 1_000_000
    bag = spark.createDataFrame([(1, [(token, 2)])], "id long, bag array<struct<tok:string,n:int>>")
    assert not fits(bag, 1_000) and not fits(bag, 900_000) and fits(bag, 1_100_000)
    nested = spark.createDataFrame([({"k": [token]}, (bytearray(10), None))], "m map<string,array<string>>, s struct<b:binary,t:string>")
    assert not fits(nested, 900_000) and fits(nested, 1_100_000)
    assert fits(spark.createDataFrame([(None, None)], "a array<struct<t:string>>, m map<string,string>"), 200)


def test_few_but_large_rows_are_split(spark):
    big = spark.createDataFrame([(i, "hot", "x" * 10_000) for i in range(40)] + [(99, "cold", "y")], "id long, k string, t string")
    unique = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    joined = join_unique(big, unique, ["k"], ["id"], broadcast_bytes=0, min_hot_bytes=50_000)
    assert "_salt" in joined._jdf.queryExecution().toString()
    assert sorted((r.id, r.v) for r in joined.collect()) == [(i, 1) for i in range(40)] + [(99, 2)]
