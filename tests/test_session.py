from pyspark.sql import functions as F

from cloneflow.operators.joins import number_rows
from cloneflow.session import SHUFFLE_CLEANUP, materialize


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffled(spark), spark.conf.get(SHUFFLE_CLEANUP)
    kept = materialize(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert shuffled(spark) <= before
    assert {r["count"] for r in kept.collect()} == {142, 143}
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_rows_of_a_lower_level_have_the_lower_numbers(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("tok"), (F.col("id") % 3).cast("int").alias("n"))
    got = [(r.idx, r.n) for r in number_rows(rows, "tok", level=F.col("n")).collect()]
    assert [n for _, n in sorted(got)] == [0] * 100 + [1] * 100 + [2] * 100
    assert sorted(i for i, _ in got) == list(range(300))
