"""Joins on keys that may be hot: the rows of other keys pass no join to be told from them."""

from pyspark.sql import functions as F

from skein.llm.common import join_hot


def test_cold_rows_pass_no_anti_join(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id") % 700).cast("int").alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 2).alias("s"), F.col("id").alias("n"))
    keys = rows.where("k % 5 <> 0 AND s IS NOT NULL").groupBy(F.col("k").cast("long").alias("k"), "s").agg(F.count("*").alias("w"), F.min("n").alias("first"))
    for floor in (256, 1, 10_000):
        got = join_hot(rows, keys, ["k", "s"], "w", floor)
        want = rows.join(keys.drop("w"), ["k", "s"])
        assert got.columns == ["k", "s", "n", "first"] and sorted(got.collect()) == sorted(want.collect())
        assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
