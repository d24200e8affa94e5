"""Packed rows against a row for each occurrence."""

import pytest
from pyspark.sql import functions as F

from epistola.operators import packed, pieces, postings

TEXTS = [("a", "Neue neue Rechnung", "x"), ("b", "eine 𝒳𝒳𝒳 Rechnung, neue", None), ("c", "ab", ""), ("d", None, "Neue Ähren")]


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


@pytest.mark.parametrize("index, key", [(postings, "token"), (pieces, "piece")])
def test_a_key_of_a_task_is_one_row(spark, tmp_path, index, key):
    texts = spark.createDataFrame(TEXTS, "hash string, subject string, body string").coalesce(1)
    index.build(texts, f"file://{tmp_path}/i", ("subject", "body"), buckets=4)
    stored = spark.read.schema(packed.stored(key, "string")).parquet(f"file://{tmp_path}/i")
    want = index.occurrences(texts, ("subject", "body"))
    names = ("hash", "column", "position", key)
    assert stored.count() == want.select("column", key).distinct().count() < want.count()
    assert rows_of(packed.unpack(stored, key), *names) == rows_of(want, *names)
    assert stored.agg(F.sum("n")).first()[0] == want.count()
    out = spark.createDataFrame([("a",), ("a",), ("z",)], "hash string")
    for most in (10, 0):  # read by all tasks, and joined
        left = packed.without(stored, out, key, most)
        assert rows_of(packed.unpack(left, key), *names) == rows_of(want.where("hash <> 'a'"), *names)
        assert left.agg(F.sum("n")).first()[0] == want.where("hash <> 'a'").count()
