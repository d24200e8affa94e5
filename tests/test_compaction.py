"""Runs, deletions that write no table, and compactions that are broken off: what is found stays the same."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from epistola.operators import audit, journal, lifecycle, postings, runs
from epistola.operators.policy import Policy
from epistola.sources import folders
from epistola.streaming import ingest
from tests.test_archive import ROWS
from tests.test_journal import MORE, REPO, fill
from tests.test_lifecycle import OLD, entries

TABLES = ("messages", "recipients", "attachments", "texts", "locations", "store", "words", "pieces")


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/archive"


def all_rows(spark, root):
    return {n: sorted(map(str, ingest.load(spark, root, n).collect())) for n in TABLES}


def all_runs(root):
    return {n: sorted(r["run"] for r in runs.state(root, n)["runs"]) for n in TABLES}


def delete(spark, root, chosen):
    return {r["hash"]: r["outcome"] for r in lifecycle.delete(spark, root, chosen, "frist_abgelaufen", "2026-01-04T00:00:00", 2026, Policy(), "anna").collect()}


def test_a_deletion_writes_a_line_and_a_row(spark, root):
    fill(spark, root, [*ROWS, OLD])
    before, told = all_runs(root), entries(spark, root).count()
    old = ingest.archive(spark, root).matches("jahr:2001").select("hash")
    (key,) = [r["hash"] for r in old.collect()]
    assert delete(spark, root, old) == {key: "deleted"}
    assert all_runs(root) == before and entries(spark, root).count() == told + 1 and ingest.raw(spark, root, "gone").count() == 1
    a = ingest.archive(spark, root)
    assert [a.count(x).first()["n"] for x in ("jahr:2001", "betrag", "betreff:chnung", "")] == [0, 0, 1, 3]
    assert ingest.raw(spark, root, "store").where(F.col("hash") == key).count() == 1  # the bytes go later
    same = all_rows(spark, root)
    assert sum(lifecycle.compact(spark, root).values()) == 0
    assert lifecycle.compact(spark, root, purge=True)["store"] == 1 and all_rows(spark, root) == same
    assert all(ingest.raw(spark, root, n).where(F.col("hash") == key).count() == 0 for n in TABLES) and runs.paths(root, "gone") == []
    found = audit.verify(ingest.load(spark, root, "store"), journal.read(spark, f"{root}/journal"))
    assert {k: v.count() for k, v in found.items()} == {"chain": 0, "missing": 0, "unexpected": 0, "incomplete": 0}


def test_deleted_mail_that_comes_again(spark, root):
    fill(spark, root, [*ROWS, OLD])
    delete(spark, root, ingest.archive(spark, root).matches("jahr:2001").select("hash"))
    assert fill(spark, root, [OLD])["messages"] == 1
    a = ingest.archive(spark, root)
    assert [a.count(x).first()["n"] for x in ("jahr:2001", "betrag", "")] == [1, 1, 4] and ingest.raw(spark, root, "store").count() == 4


@pytest.mark.parametrize("step", ["written", "commit", "append", "end"])
def test_a_deletion_broken_off_is_finished(spark, root, monkeypatch, step):
    fill(spark, root, [*ROWS, OLD])
    chosen = ingest.archive(spark, root).matches("jahr:2001").select("hash")

    def lost(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "written":
            m.setattr(lifecycle, "_tell", lost)
        elif step == "commit":
            m.setattr(journal, "commit", lost)
        elif step == "append":
            m.setattr(runs, "append", lost)
        else:
            m.setattr(lifecycle, "_end", lost)
        with pytest.raises(OSError):
            delete(spark, root, chosen)
    assert lifecycle.resume(spark, root) == 1 and lifecycle.resume(spark, root) == 0
    gone = entries(spark, root).where("op = 'delete'").collect()
    assert len(gone) == 1 and gone[0]["file_existed"] and gone[0]["actor"] == "anna"
    assert ingest.load(spark, root, "messages").count() == 3 and ingest.raw(spark, root, "gone").count() == 1
    found = audit.verify(ingest.load(spark, root, "store"), journal.read(spark, f"{root}/journal"))
    assert sum(v.count() for v in found.values()) == 0


def test_categories_are_kept_beside_and_worked_in(spark, root):
    fill(spark, root, [*ROWS, OLD])
    before = all_runs(root)
    for i, category in enumerate(("privat", "handelsbrief", "privat")):
        lifecycle.classify(spark, root, ingest.archive(spark, root).matches("sonderangebote"), category, f"2026-01-0{i + 2}T00:00:00", "anna")
    assert all_runs(root) == before and ingest.raw(spark, root, "filed").count() == 3
    assert ingest.archive(spark, root).count("kategorie:privat").first()["n"] == 1
    same = all_rows(spark, root)
    lifecycle.compact(spark, root, purge=True)
    assert all_rows(spark, root) == same and runs.paths(root, "filed") == [] and all_runs(root)["texts"] == before["texts"]


@pytest.mark.parametrize("step", ["write", "commit", "end"])
def test_a_merge_broken_off_is_taken_up(spark, root, monkeypatch, step):
    fill(spark, root, [*ROWS, OLD])
    fill(spark, root, MORE)
    delete(spark, root, ingest.archive(spark, root).matches("jahr:2001").select("hash"))
    same, one = all_rows(spark, root), {"write": (runs, "dealt"), "commit": (runs, "commit"), "end": (lifecycle, "_end")}[step]

    def lost(*a, **k):
        raise OSError("lost")

    monkeypatch.setattr(runs, "FAN", 2)
    with monkeypatch.context() as m:
        m.setattr(*one, lost)
        with pytest.raises(OSError):
            lifecycle.compact(spark, root)
    assert all_rows(spark, root) == same
    lifecycle.compact(spark, root)
    assert all_rows(spark, root) == same and all(len(x) == 1 for x in all_runs(root).values())
    assert not os.listdir(f"{root[7:]}/log/open")
    lifecycle.compact(spark, root, purge=True)  # runs that were merged before go with the next merge
    assert all_rows(spark, root) == same


def test_many_batches_leave_few_runs(spark, root, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 3)
    texts = lambda i: spark.createDataFrame([(f"h{i}", f"wort{i} gemeinsam", "", "", f"text {i} gemeinsam", "", "")], "hash string, subject string, sender string, recipients string, body string, attachment_names string, attachment_text string")
    most = 0
    for i in range(13):
        runs.append(spark, root, "words", lambda path, i=i: postings.build(texts(i), path, ("subject", "body"), 4))
        lifecycle.compact(spark, root)
        most = max(most, len(runs.state(root, "words")["runs"]))
    assert most <= 2 * 3 and [r["tier"] for r in runs.state(root, "words")["runs"]].count(2) == 1
    found = postings.Postings(ingest.load(spark, root, "words"), 4)
    assert {r["hash"] for r in found.find("gemeinsam").collect()} == {f"h{i}" for i in range(13)} and found.find("wort12").count() == 1
    kept = [x for x in os.listdir(f"{root[7:]}/words") if x.startswith("run=")]
    assert len(kept) <= most + 3  # and those that the last merge took


def test_no_task_gets_more_than_its_share(spark):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("hash"), F.when(F.col("id") % 10 < 8, 3).otherwise((F.col("id") % 7).cast("int")).alias("bucket"))
    sizes = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    got = runs.dealt(rows, "bucket", sizes, 1000).groupBy(F.spark_partition_id().alias("p"), "bucket").count().collect()
    assert max(r["count"] for r in got) < 1300 and len({r["p"] for r in got}) == len(got)  # a bucket each
    assert sum(r["count"] for r in got) == 40_000


def test_writers_of_runs_at_once(tmp_path):
    code = "import sys; from epistola.operators import runs\nfor i in range(30): runs.commit(sys.argv[1], 't', [{'run': f'run={sys.argv[2]}{i}', 'tier': 0, 'bytes': 1, 'files': 1}])"
    running = [subprocess.Popen([sys.executable, "-c", code, str(tmp_path), name], env={**os.environ, "PYTHONPATH": REPO}) for name in "ab"]
    assert [p.wait(120) for p in running] == [0, 0]
    assert {r["run"] for r in runs.state(str(tmp_path), "t")["runs"]} == {f"run={n}{i}" for n in "ab" for i in range(30)}
    with pytest.raises(runs.Conflict):
        runs.commit(str(tmp_path), "t", [], ["run-none"])


def test_pieces_have_counts_as_large_as_their_rows(spark, root, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 2)
    fill(spark, root, [*ROWS, OLD])
    fill(spark, root, MORE)
    want = {r["piece"]: r["count"] for r in ingest.load(spark, root, "pieces").groupBy("piece").count().collect()}
    lifecycle.compact(spark, root)
    assert {r["piece"]: r["n"] for r in ingest.load(spark, root, "piece_counts").collect()} == want and len(runs.paths(root, "piece_counts")) == 1
