"""Mixes whose targets a fixed number of steps does not reach, and one that cannot be reached."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from epistola.llm import mixing
from tests.llm.test_pipeline import SF, brute_copies


def labelled_texts(spark, tokens, size=40):
    """Documents of `size` words of one language each, with so many tokens of each language."""
    random.seed(2)
    rows = [(lang, " ".join(f"{lang}{random.randrange(60)}" for _ in range(size))) for lang, n in tokens.items() for _ in range(n // size)]
    return spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")


CORPORA = {"fifth language": {"en": 32000, "de": 6400, "fr": 4800, "es": 4000, "it": 960}, "one of 97 %": {"en": 38800, "de": 400, "fr": 400, "es": 400}}


@pytest.mark.parametrize("least", [0.0, 1.0])
@pytest.mark.parametrize("corpus", CORPORA)
def test_mixing_meets_its_targets(spark, corpus, least):
    docs = labelled_texts(spark, CORPORA[corpus])
    mix = mixing.fit(docs, docs.select("doc_id", F.col("lang").alias("domain")), mixing.DOMAINS, least=least)
    named = sum(mix.reached[x] for x in mixing.DOMAINS)
    assert all(abs(mix.reached[x] / named - w) < 0.002 for x, w in mixing.DOMAINS.items()), mix.reached
    at = enumerate(mix.classifier.names)
    got = mix.add_copies(mix.scored).agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.get("posteriors", F.lit(d))).alias(x) for d, x in at]).first().asDict()
    assert got == pytest.approx(mix.reached)  # the rates that are given are those that were fitted
    if "it" in got:  # has no weight: it goes, or where no document may be dropped it stays as it was, and the miss is told
        assert got["it"] == pytest.approx(CORPORA[corpus]["it"] * least, abs=10)
        assert (mix.gap["it"] > mixing.MISSED) == (least == 1.0)


def test_mixing_tells_a_gap(spark):
    docs = labelled_texts(spark, {"en": 400, "de": 400})
    with pytest.warns(UserWarning, match="missed"):
        mix = mixing.fit(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"en": 0.5, "de": 0.5}, total=400, least=1.0)
    assert mix.gap["en"] == pytest.approx(0.5, abs=0.01) and mix.reached["en"] == pytest.approx(400, abs=4)


def test_rates_are_those_of_gradient_steps_without_a_cap(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = Counter(r["doc_id"] for r in mixing.repeat_documents(docs).collect())
    monkeypatch.setattr(mixing, "STEPS", 100_000)  # of the brute-force version, which stops at EXACT
    want = brute_copies(docs.collect())
    assert {d for d, w in want.items() if not math.floor(w - 0.005) <= copies[d] <= math.floor(w + 0.005)} == set()
