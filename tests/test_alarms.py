"""What is told of runs, as a table and as a stream of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from epistola.streaming import alarms

RUN = "archive string, ts timestamp, seq long, problem string, mails long"
DAY = dt.datetime(2026, 10, 7)


def at(hours, day=0):
    return DAY + dt.timedelta(days=day, hours=hours)


# A night's disturbance that comes twice, its all-clear, and the report in the morning; another archive is quiet.
STORY = [("a", at(0), 1, None, 10), ("a", at(2), 2, "two skipped", 12), ("a", at(3), 3, "two skipped", 12), ("a", at(4), 4, "chain broken", 12), ("a", at(6), 5, "", 15), ("a", at(8), 6, "", 20), ("a", at(9), 7, "", 21), ("a", at(8, 1), 8, "", 30), ("b", at(8), 1, "", 5)]
TOLD = [("a", 2, "disturbance", "two skipped", None), ("a", 4, "disturbance", "chain broken", None), ("a", 5, "all-clear", "chain broken", None), ("a", 6, "report", "", 20), ("a", 8, "report", "", 10), ("b", 1, "report", "", 5)]


def rows(told):
    return sorted((r["archive"], r["seq"], r["notice"], r["problem"], r["added"]) for r in told.collect())


def streamed(spark, tmp_path, batches, **options):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, RUN).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        # One batch a folder, oldest first.
    source = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"told_{random.randrange(10**9)}"
    query = alarms.watch(source, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_a_table_of_runs(spark):
    assert rows(alarms.notices(spark.createDataFrame(STORY, RUN))) == sorted(TOLD)


def test_a_stream_of_runs(rocks, tmp_path):
    assert rows(streamed(rocks, tmp_path, [STORY[:3], STORY[3:5], STORY[5:]])) == sorted(TOLD)


def test_silence_is_told_by_a_timer(rocks, tmp_path):
    runs = [[("a", at(8), 1, "", 5)], [("b", at(8, 1), 1, "", 5)], [("b", at(9, 1), 2, "", 5)], [("a", at(10, 1), 2, "", 5)]]
    told = rows(streamed(rocks, tmp_path, runs, silence=12 * 3600, watermark="0 seconds").where("archive = 'a'").withColumn("seq", F.coalesce("seq", F.lit(-1))))
    assert told == [("a", -1, "disturbance", alarms.SILENT, None), ("a", 1, "report", "", 5), ("a", 2, "all-clear", alarms.SILENT, None)]


def test_a_report_every_three_days(rocks, tmp_path):
    runs = [[("a", at(8, d), d, "", d)] for d in range(5)]
    assert [r[1] for r in rows(streamed(rocks, tmp_path, runs, days=3))] == [0, 3]
