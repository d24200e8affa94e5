"""The index of pieces against a look at the texts themselves."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from epistola.functions.text import fold, has_part, spellings
from epistola.operators import pieces
from epistola.operators.archive import text_test
from epistola.lang import terms as T
from epistola.sources import folders
from epistola.streaming import ingest
from tests.test_archive import ROWS
from tests.test_lifecycle import OLD

TEXTS = [(1, "Bahnhofstraße 7, Zürich"), (2, "aaaaaa"), (3, "ab"), (4, None), (5, ""), (6, "Neue Rechnung\tund mehr"), (7, "ein Kuß, zwei Küsse; ΣΑΣ 日本語 bahn hof"), (7, "zweite Zeile desselben"), (8, "Rechnung neue"), (9, "muller Mueller Müller")]
VALUES = ["bahn", "hofstr", "n h", "straße", "strasse", "aaa", "aaaa", "aaaaaaa", "e rech", "nung\tund", "kuss", "日本語", "üller", "uller", "ueller", "RECHNUNG", "neue rechnung und", "xyz", "ab", "σας", "zzzbahn", "bahnzzz", "ein kuß, zwei küsse"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    texts = spark.createDataFrame([(h, t, None, None, None) for h, t in TEXTS], "hash long, subject string, sender string, recipients string, attachment_names string")
    path = f"file://{tmp_path_factory.mktemp('pieces')}/p"
    for part in (texts.where("hash < 6"), texts.where("hash >= 6")):  # as two batches of ingest
        pieces.build(part, f"{path}/rows", buckets=4, parts=2)
        pieces.count(pieces.occurrences(part, pieces.COLUMNS), f"{path}/counts")
    return texts, path


@pytest.mark.parametrize("value", VALUES)
def test_same_as_the_texts(spark, index, value):
    texts, path = index
    want = {h for v in spellings(value) for h in (r["hash"] for r in texts.where(has_part(fold(F.col("subject")), v)).collect())}
    assert {r["hash"] for r in pieces.Pieces.at(spark, path, "long", 4).find(value, "subject").collect()} == want
    assert pieces.Pieces.at(spark, path, "long", 4).find(value, "sender").count() == 0


def test_cover_has_the_fewest_rows():
    random.seed(1)
    for _ in range(300):
        value = "".join(random.choice("abc") for _ in range(random.randrange(3, 12)))
        counts = {"".join(p): random.randrange(50) for p in itertools.product("abc", repeat=3)}
        got, last = pieces.cover(value, counts), len(value) - 3
        rows = lambda offsets: sum(counts[value[i : i + 3]] for i in offsets)
        inner = [c for n in range(last) for c in itertools.combinations(range(1, last), n)] if last else []
        covers = [o for c in inner + [()] for o in [sorted({0, *c, last})] if all(b - a <= 3 for a, b in itertools.pairwise(o))]
        assert sorted(got) in covers and rows(got) == min(map(rows, covers))
        assert [counts[value[i : i + 3]] for i in got] == sorted(counts[value[i : i + 3]] for i in got)


def test_an_archive_searches_pieces_without_texts(spark, tmp_path):
    root = f"file://{tmp_path}/archive"
    ingest.add_batch(spark.createDataFrame([*ROWS, OLD], folders.RAW), root, "2026-01-01T00:00:00")
    a = ingest.archive(spark, root)
    plan = a.matches("betreff:chnung von:bank -an:nirgends")._jdf.queryExecution().toString()
    assert "attachment_text" not in plan and "EqualTo(piece,chn)" in plan.replace("EqualTo(piece,nun)", "EqualTo(piece,chn)")
    without = replace(a, pieces=None)
    for asked in ("betreff:chnung", "von:müll", "von:mueller", "an:nna@exa", "anhang:nung.p", "-betreff:letter", "betreff:ab", 'betreff:"zur best"', "von:@x", "betreff:0042 jahr:2025"):
        assert sorted(r["hash"] for r in a.matches(asked).collect()) == sorted(r["hash"] for r in without.matches(asked).collect()), asked
    ingest.rebuild(spark, root, f"file://{tmp_path}/anew")
    assert ingest.archive(spark, f"file://{tmp_path}/anew").count("betreff:chnung").first()["n"] == a.count("betreff:chnung").first()["n"] == 2


def test_a_part_is_looked_for_in_its_column():
    assert "subject" in str(text_test(T.parse("betreff:abc")[0]))
