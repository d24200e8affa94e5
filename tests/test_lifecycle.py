"""An archive from ingest to deletion: every step is in the journal, and the tables can be made anew from it."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from epistola.functions import mail
from epistola.operators import audit, journal, lifecycle
from epistola.operators.policy import Policy, Rule
from epistola.sources import folders
from epistola.streaming import ingest
from tests.test_archive import ROWS, raw

OLD = ("firma", "Archiv/2001", 7, "", raw("Alte Rechnung", "Bank <info@bank.example>", "Mon, 05 Mar 2001 09:30:00 +0100", "Betrag", None, "old@x"))
RULES = [Rule("von", "*@bank.example", "buchungsbeleg"), Rule("ordner", "Gesendet", "handelsbrief")]


@pytest.fixture
def root(spark, tmp_path):
    return f"file://{tmp_path}/archive"


def entries(spark, root):
    return journal.parsed(journal.read(spark, f"{root}/journal"))


def tables(spark, root):
    return {n: sorted(map(str, ingest.load(spark, root, n).collect())) for n in ("messages", "recipients", "attachments", "texts")} | {"places": sorted(map(str, ingest.load(spark, root, "locations").select("hash", "account", "folder").collect()))}


def fill(spark, root, batch_id=None):
    rows = spark.createDataFrame([*ROWS, OLD, ("firma", "INBOX", 8, "", b"")], folders.RAW)
    return ingest.add_batch(rows, root, "2026-01-01T00:00:00", RULES, batch_id)


def test_ingest_journals(spark, root):
    assert fill(spark, root, 0) == {"rows": 6, "unreadable": 1, "messages": 4, "places": 5}
    before = tables(spark, root)
    assert fill(spark, root, 1) == {"rows": 6, "unreadable": 1, "messages": 0, "places": 0}
    assert tables(spark, root) == before and ingest.load(spark, root, "quarantine").count() == 1
    e = entries(spark, root)
    assert e.groupBy("op").count().collect() and {r["op"]: r["count"] for r in e.groupBy("op").count().collect()} == {"add": 5, "classify": 2}
    assert {r["actor"] for r in e.where("op = 'classify'").collect()} == {"Regel"}
    found = audit.verify(ingest.load(spark, root, "store"), journal.read(spark, f"{root}/journal"))
    assert {k: v.count() for k, v in found.items()} == {"chain": 0, "missing": 0, "unexpected": 0, "incomplete": 0}
    assert ingest.archive(spark, root).count("kategorie:handelsbrief").first()["n"] == 1


def test_a_batch_that_failed_is_not_told_twice(spark, root, monkeypatch):
    monkeypatch.setattr(ingest, "save", lambda rows, to, name, save=ingest.save: save(rows, to, name) if name == "store" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        fill(spark, root, 4)
    monkeypatch.undo()
    fill(spark, root, 4)
    assert entries(spark, root).where("op = 'add'").count() == 5 and ingest.load(spark, root, "locations").count() == 5


def test_stream(spark, root, tmp_path):
    spark.createDataFrame(ROWS, folders.RAW).write.parquet(f"{tmp_path}/raw")
    for _ in range(2):
        ingest.ingest(spark.readStream.schema(folders.RAW).parquet(f"{tmp_path}/raw"), root, "2026-01-01", f"{tmp_path}/check", RULES).start().awaitTermination()
    assert ingest.load(spark, root, "messages").count() == 3 and entries(spark, root).where("op = 'add'").count() == 4


def test_classify_delete_seal_rebuild(spark, root, tmp_path):
    fill(spark, root)
    a = ingest.archive(spark, root)
    changed = lifecycle.classify(spark, root, a.matches("sonderangebote"), "privat", "2026-01-02T00:00:00", "anna", "Suche: sonderangebote").collect()
    assert [r["previous"] for r in changed] == ["unbestimmt"]
    assert lifecycle.classify(spark, root, ingest.archive(spark, root).matches("sonderangebote"), "privat", "2026-01-03T00:00:00", "anna").count() == 0
    assert ingest.archive(spark, root).count("kategorie:privat").first()["n"] == 1

    everything = ingest.load(spark, root, "messages").select("hash").unionByName(spark.createDataFrame([("nichts",)], "hash string"))
    outcome = {r["hash"]: r["outcome"] for r in lifecycle.delete(spark, root, everything, "frist_abgelaufen", "2026-01-04T00:00:00", 2026, Policy(), "anna").collect()}
    assert sorted(outcome.values()) == ["deleted", "deleted", "locked", "locked", "unknown"]  # the private one and that of 2001 go
    for name in ("messages", "texts", "store", "recipients", "words"):
        assert ingest.load(spark, root, name).select("hash").distinct().count() == 2, name
    assert ingest.archive(spark, root).count("sonderangebote").first()["n"] == 0 and ingest.archive(spark, root).count("jahr:2001").first()["n"] == 0
    gone = entries(spark, root).where("op = 'delete'")
    assert gone.where("file_existed and reason = 'frist_abgelaufen'").count() == 2

    assert lifecycle.seal(spark, root, "2026-01-05T00:00:00")["count"] == entries(spark, root).count() - 1
    assert [r["holds"] for r in lifecycle.seals(entries(spark, root)).collect()] == [True]
    assert journal.pack(spark, root) > 0 and journal.verify(journal.read(spark, f"{root}/journal")).count() == 0
    lifecycle.seal(spark, root, "2026-01-06T00:00:00")  # after packed segments
    assert journal.verify(journal.read(spark, f"{root}/journal")).count() == 0 and entries(spark, root).where("op = 'seal'").count() == 2
    found = audit.verify(ingest.load(spark, root, "store"), journal.read(spark, f"{root}/journal"))
    assert {k: v.count() for k, v in found.items()} == {"chain": 0, "missing": 0, "unexpected": 0, "incomplete": 0}

    to = f"file://{tmp_path}/anew"
    ingest.rebuild(spark, root, to)
    assert tables(spark, to) == tables(spark, root)


def test_years_are_pruned(spark, root):
    fill(spark, root)
    plan = ingest.archive(spark, root).matches("jahr:2001")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_a_word_is_found_without_reading_texts(spark, root):
    fill(spark, root)
    a = ingest.archive(spark, root)
    plan = a.matches("rechnung -sonderangebote")._jdf.queryExecution().toString()
    assert "attachment_text" not in plan and "StringStartsWith(token,rechnung)" in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    without = replace(a, index=None)
    for asked in ("rechnung", "-sonderangebote", '"neue rechnung"', '"rückfrage zur best"', "text:bahnhofstrasse", "von:mü", "muller", '"zur rückfrage"', "*", "ruckfrage bestellung"):
        assert sorted(r["hash"] for r in a.matches(asked).collect()) == sorted(r["hash"] for r in without.matches(asked).collect()), asked


def test_one_bad_message_is_put_aside(spark, root, monkeypatch):
    assert mail.try_parse(b"")["problem"] == "empty" and mail.try_parse(None)["problem"] == "empty"
    monkeypatch.setattr(mail, "parse_message", lambda raw: 1 / 0)
    assert mail.try_parse(b"x")["problem"].startswith("ZeroDivisionError")


def test_folders_renamed_more_than_once(spark):
    note = lambda seq, old, new: (seq, "note", None, "k", None, None, "ordner_umbenannt", old, new)
    add = lambda seq, key, folder: (seq, "add", key, "k", folder, seq, None, None, None)
    rows = [add(1, "a", "A"), note(2, "A", "B"), add(3, "b", "A"), note(4, "B", "C"), note(5, "A", "D"), add(6, "c", "A"), note(7, "C", "A")]
    e = spark.createDataFrame(rows, "seq long, op string, hash string, account string, folder string, uid long, kind string, old string, new string")
    assert {r["hash"]: r["folder"] for r in journal.locations(e).collect()} == {"a": "A", "b": "D", "c": "A"}


def test_a_table_that_cannot_be_read_is_no_empty_table(spark, tmp_path):
    (tmp_path / "messages").mkdir()
    (tmp_path / "messages" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017
        ingest.load(spark, f"file://{tmp_path}", "messages").collect()
    assert ingest.load(spark, f"file://{tmp_path}/none", "messages").where(F.lit(True)).count() == 0
