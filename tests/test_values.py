"""Fields of repeated values: an index of each different value, against the texts themselves."""

import pytest
from pyspark.sql import functions as F

from epistola.lang import terms as T
from epistola.operators import packed, pieces
from epistola.operators.archive import Archive, text_test
from epistola.plans import tables

SF = "/root/testdata/sf0.001"
ROWS = [("a", "anna.schmidt@x.example"), ("a", "Bärbel@y.example"), ("b", "anna.schmidt@x.example"), ("c", "aebel, otto"), ("c", None), ("d", "ab")]


@pytest.mark.parametrize("most", [10, 0])
@pytest.mark.parametrize("asked", ["schmidt@x", "baerbel", "Bärbel@", "example", "nowhere", "example, b", "ele, ann", "bel, ot", "bel o", "le,"])
def test_same_hits_as_the_texts(spark, tmp_path, asked, most):
    links = spark.createDataFrame(ROWS, "hash string, recipients string")
    texts = links.groupBy("hash").agg(F.array_join(F.sort_array(F.collect_list("recipients")), ", ").alias("recipients"))

    def index(values):
        pieces.build(values, f"file://{tmp_path}/i/rows", ("recipients",), 4)
        pieces.count(spark.read.schema(packed.stored("piece", "long")).parquet(f"file://{tmp_path}/i/rows"), f"file://{tmp_path}/i/counts")
        return pieces.Pieces.at(spark, f"file://{tmp_path}/i", "long", 4)

    own = pieces.Values("recipients", links, links, index, most=most)
    archive = Archive(texts.select("hash"), links, links, links, texts, pieces=own)
    want = {r[0] for r in texts.where(text_test(T.parse(f'an:"{asked}"')[0])).select("hash").collect()}
    assert {r[0] for r in archive.matches(f'an:"{asked}"').select("hash").collect()} == want
    assert own.answers("schmidt@x", "recipients") and not own.answers("example, b", "recipients") and not own.answers("schmidt", "sender")


@pytest.mark.parametrize("field, source, most", [("recipients", "supplier", 1), ("sender", "customer", 1), ("attachment_names", "part", 1)])
def test_index_grows_with_values_and_not_with_mails(spark, field, source, most):
    """Packed occurrences of pieces are at most those of the table that has each value once."""
    rows = tables.orders(spark, SF, field).pieces.index.rows
    assert rows.select("hash").distinct().count() <= most * spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert {r[0] for r in rows.select("column").distinct().collect()} == {field}
