"""A passage that two texts share is in both fingerprints, however long the texts are."""

import random

import pytest
from pyspark.sql import functions as F

from epistola.llm import fingerprints


@pytest.mark.parametrize("size", [100, 600, 20000])
def test_shared_passage_is_seen(spark, size):
    random.seed(8)
    words = lambda n: [f"t{random.randrange(10**9)}" for _ in range(n)]
    passage = words(60)
    one, other = words(size) + passage + words(size), words(size // 3) + passage + words(size)
    rows = spark.createDataFrame([(" ".join(one), " ".join(other), " ".join(passage))], "one string, other string, passage string")
    for name in ("one", "other", "passage"):
        rows = fingerprints.add_anchors(rows, name, f"{name}_a")
    got = fingerprints.add_likeness(rows, "one_a", "other_a", "near").select("near", "one_a", "other_a", "passage_a").first()
    hashes = {x: {v >> fingerprints.PLACE_BITS for v in got[f"{x}_a"]} for x in ("one", "other", "passage")}
    assert len(hashes["passage"]) > 15 and hashes["passage"] <= hashes["one"] & hashes["other"]
    assert got["near"] == pytest.approx(len(hashes["one"] & hashes["other"]) / len(hashes["one"] | hashes["other"]))
    assert len(hashes["one"]) > 0.4 * len(one)


def test_places_that_disagree_do_not_count(spark):
    random.seed(8)
    parts = [[f"t{random.randrange(10**9)}" for _ in range(200)] for _ in range(2)]
    rows = spark.createDataFrame([(" ".join(parts[0] + parts[1]), " ".join(parts[1] + parts[0]))], "one string, other string")
    rows = fingerprints.add_anchors(fingerprints.add_anchors(rows, "one", "a"), "other", "b")
    near = fingerprints.add_likeness(fingerprints.add_likeness(rows, "a", "b", "near"), "a", "a", "own").select("near", "own").first()
    assert 0.3 < near["near"] < 0.7 and near["own"] == 1
