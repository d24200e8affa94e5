"""What a search for words hands on: texts, not occurrences."""

import pytest

from epistola.operators import postings


@pytest.mark.parametrize("asked, want", [("the", ["a", "b"]), ("the cat", ["a", "b"]), ("strasse", ["b"]), ("dog", [])])
def test_each_text_is_found_once(spark, tmp_path, asked, want):
    texts = spark.createDataFrame([("a", "the cat, the cat, then the cat", "the cat"), ("b", "the cats", "Straße strasse"), ("c", None, "a")], "hash string, subject string, body string")
    postings.build(texts, f"file://{tmp_path}/i", ("subject", "body"), 4)
    index = postings.Postings.at(spark, f"file://{tmp_path}/i", "string", 4)
    assert sorted(r[0] for r in index.find(asked).collect()) == want
