"""What a purge needs beside the archive itself, and what it leaves."""

import os

from epistola.operators import lifecycle, packed, postings, runs
from epistola.operators.policy import Policy
from epistola.streaming import ingest
from tests.test_archive import ROWS
from tests.test_journal import fill
from tests.test_lifecycle import OLD
from tests.test_packed import TEXTS, rows_of


def test_a_purge_leaves_no_run_that_it_wrote_anew(spark, tmp_path):
    root = f"file://{tmp_path}/archive"
    fill(spark, root, [*ROWS, *ROWS, OLD])
    assert not os.listdir(f"{tmp_path}/archive/staged")
    old = ingest.archive(spark, root).matches("jahr:2001").select("hash")
    assert lifecycle.delete(spark, root, old, "frist_abgelaufen", "2026-01-04T00:00:00", 2026, Policy(), "anna").count() == 1
    lifecycle.compact(spark, root, purge=True)
    for table in ("words", "pieces", "texts", "store", "messages"):
        there = sorted(x for x in os.listdir(f"{tmp_path}/archive/{table}") if x.startswith("run="))
        assert there == [r["run"] for r in runs.state(root, table)["runs"]], table
    assert [ingest.archive(spark, root).count(x).first()["n"] for x in ("jahr:2001", "betrag", "")] == [0, 0, 3]


def test_what_was_deleted_is_left_out_of_packed_rows_as_they_are(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "hash string, subject string, body string").coalesce(1)
    postings.build(texts, f"file://{tmp_path}/i", ("subject", "body"), buckets=4)
    stored = spark.read.schema(packed.stored("token", "string")).parquet(f"file://{tmp_path}/i")
    left = packed.without(stored, spark.createDataFrame([("a",), ("d",)], "hash string"), "token")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    names = ("hash", "column", "position", "token")
    assert rows_of(packed.unpack(left, "token"), *names) == rows_of(postings.occurrences(texts.where("hash in ('b', 'c')"), ("subject", "body")), *names)
