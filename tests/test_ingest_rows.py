"""New mail is not dealt out again for each table."""

from pyspark.sql import functions as F

from epistola.streaming import ingest


def test_rows_that_are_new_are_not_dealt_out(spark):
    rows = spark.range(9).select(F.col("id").alias("hash"), F.lit("long").alias("raw"))
    assert ingest.lacking(rows, rows.select("hash").where("hash > 99")) is rows
    left = ingest.lacking(rows, rows.select("hash").where("hash > 5"))
    assert sorted(r["hash"] for r in left.collect()) == [0, 1, 2, 3, 4, 5] and "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
