"""Mail that is given back: runs that are done again, given up, or go on."""

import os

import pytest
from pyspark.sql import functions as F

from epistola.functions import mail
from epistola.operators import journal
from epistola.sources import folders, restore
from epistola.streaming import ingest
from tests.test_archive import ROWS
from tests.test_journal import MORE, fill


@pytest.fixture
def rows(spark):
    return mail.parse(spark.createDataFrame([*ROWS[:3], *MORE], folders.RAW)).select("hash", "account", "folder", "flags", "date_text", "raw").cache()


def everything(path):
    return sorted(f"{d}/{f}"[len(str(path)) + 1 :] for d, _, names in os.walk(path) for f in names if not f.startswith(".part"))


@pytest.mark.parametrize("write", [restore.to_maildir, restore.to_eml, restore.to_mbox])
def test_a_second_run_writes_nothing(spark, rows, tmp_path, write):
    to = f"file://{tmp_path}/to"
    first = write(rows.limit(4), to)
    assert first.count() == 4 and {r["hash"] for r in first.collect()} == {r["hash"] for r in rows.limit(4).collect()}
    before = {f: (tmp_path / "to" / f).read_bytes() for f in everything(tmp_path / "to")}
    assert write(rows.limit(4), to).count() == 0
    after = {f: (tmp_path / "to" / f).read_bytes() for f in everything(tmp_path / "to") if not f.startswith("_restored")}
    assert after == {f: x for f, x in before.items() if not f.startswith("_restored")}
    assert write(rows, to).count() == 2 and restore.restored(spark, to).count() == 6  # what is new is added
    assert all((tmp_path / "to" / f).read_bytes() == x for f, x in after.items())
    read = {restore.to_maildir: folders.read_maildir, restore.to_eml: folders.read_eml, restore.to_mbox: folders.read_mbox}[write]
    back = read(spark, to, "k")
    assert back.count() == 6
    if write is not restore.to_mbox:
        assert {r["h"] for r in back.select(F.sha2("raw", 256).alias("h")).collect()} == {r["hash"] for r in rows.collect()}
    assert not [f for f in everything(tmp_path / "to") if ".tmp-" in f]


@pytest.mark.parametrize("write", [restore.to_eml, restore.to_mbox])
def test_a_run_that_is_given_up_leaves_nothing(spark, rows, tmp_path, write):
    bad = rows.withColumn("raw", F.when(F.col("folder") == "Gesendet", F.lit(None)).otherwise(F.col("raw")))  # a row that cannot be written
    with pytest.raises(Exception):  # noqa: B017
        write(bad.repartition(3, "hash"), f"file://{tmp_path}/to")
    assert everything(tmp_path / "to") == [] and restore.restored(spark, f"file://{tmp_path}/to").count() == 0
    assert write(rows, f"file://{tmp_path}/to").count() == 6


def test_a_run_lost_when_it_was_staged_is_ended(spark, rows, tmp_path, monkeypatch):
    to = f"file://{tmp_path}/to"
    with monkeypatch.context() as m:
        m.setattr(restore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            restore.to_mbox(rows, to)
    (tmp_path / "to" / "_stage-other" / "files").mkdir(parents=True)  # one that was lost before
    assert restore.restored(spark, to).count() == 0
    assert restore.to_mbox(rows, to).count() == 0 and restore.restored(spark, to).count() == 6
    assert folders.read_mbox(spark, to, "k").count() == 6 and not [x for x in os.listdir(tmp_path / "to") if x.startswith("_stage")]


def test_a_run_from_the_archive(spark, tmp_path):
    root, to = f"file://{tmp_path}/archive", f"file://{tmp_path}/to"
    fill(spark, root, ROWS)
    chosen = ingest.archive(spark, root).matches("").select("hash")
    assert restore.restore_run(spark, root, chosen, to, "2026-02-01T00:00:00", "anna") == {"chosen": 3, "written": 3, "skipped": 0, "several": 1}
    assert restore.restore_run(spark, root, chosen, to, "2026-02-02T00:00:00", "anna")["skipped"] == 3
    assert {r["folder"] for r in folders.read_maildir(spark, to, "k").collect()} == {"firma/INBOX", "firma/Gesendet", "privat/INBOX"}
    notes = journal.parsed(journal.read(spark, f"{root}/journal")).where("op = 'note'").orderBy("seq").collect()
    assert [(r["kind"], r["count"], r["actor"]) for r in notes] == [("zurueckgespielt", 3, "anna"), ("zurueckgespielt", 0, "anna")]
    assert journal.verify(journal.read(spark, f"{root}/journal")).count() == 0
