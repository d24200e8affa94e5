"""The journal's commits: writers at once, streams with equal numbers, and batches that are broken off at any step."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from epistola.operators import audit, commits, journal, policy, upkeep
from epistola.sources import folders
from epistola.streaming import ingest
from tests.test_archive import ROWS, raw
from tests.test_lifecycle import OLD, RULES, entries, tables

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MORE = [("anna", "INBOX", 50 + i, "", raw(f"Brief {i}", "Otto <otto@x.example>", "Mon, 01 Jan 2024 10:00:00 +0000", f"Text {i}", None, f"m{i}@x")) for i in range(3)]


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/archive"


def fill(spark, root, rows, number=None, stream=""):
    return ingest.add_batch(spark.createDataFrame(rows, folders.RAW), root, "2026-01-01T00:00:00", RULES, number, stream)


def whole(spark, root):
    found = audit.verify(ingest.load(spark, root, "store"), journal.read(spark, f"{root}/journal"))
    return {k: v.count() for k, v in found.items()} == {"chain": 0, "missing": 0, "unexpected": 0, "incomplete": 0}


def test_equal_numbers_of_two_streams(spark, root, tmp_path):
    fill(spark, root, ROWS, 0, "a")
    fill(spark, root, MORE, 0, "b")
    fill(spark, root, [OLD], 0)
    assert ingest.load(spark, root, "messages").count() == 7 and whole(spark, root)
    assert entries(spark, root).where("op = 'add'").count() == ingest.load(spark, root, "locations").count() == 8
    ingest.rebuild(spark, root, f"file://{tmp_path}/anew")
    assert tables(spark, f"file://{tmp_path}/anew") == tables(spark, root)


def test_a_new_checkpoint_is_another_stream(spark, root, tmp_path):
    for i, rows in enumerate((ROWS, MORE)):
        spark.createDataFrame(rows, folders.RAW).write.parquet(f"{tmp_path}/raw{i}")
        ingest.ingest(spark.readStream.schema(folders.RAW).parquet(f"{tmp_path}/raw{i}"), root, "2026-01-01", f"{tmp_path}/check{i}").start().awaitTermination()
    assert entries(spark, root).where("op = 'add'").count() == 7 and whole(spark, root)


def test_two_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/journal"
    code = "import sys; from epistola.operators import journal\nfor i in range(40): journal.commit(sys.argv[1], [{'op': 'note', 'note': f'{sys.argv[2]} {i} {k}'} for k in range(3)], '2026-01-01')"
    running = [subprocess.Popen([sys.executable, "-c", code, path, name], env={**os.environ, "PYTHONPATH": REPO}) for name in "ab"]
    assert [p.wait(120) for p in running] == [0, 0]
    read = journal.read(spark, path)
    assert read.count() == 240 and journal.verify(read).count() == 0
    lines = [r["note"] for r in journal.parsed(read).orderBy("seq").collect()]
    for name in "ab":
        assert [x for x in lines if x.startswith(name)] == [f"{name} {i} {k}" for i in range(40) for k in range(3)]


def test_a_name_is_taken_once(tmp_path):
    path = f"file://{tmp_path}/d/000001.jsonl"
    assert commits.put_new(path, b"a") and not commits.put_new(path, b"b") and commits.get(path) == b"a"
    assert os.listdir(tmp_path / "d") == ["000001.jsonl"] and commits.get(f"file://{tmp_path}/d/none") is None
    commits.put(path, b"c")
    assert commits.get(path) == b"c"


def test_a_number_that_was_packed_stays_taken(spark, tmp_path):
    path = f"{tmp_path}/journal"
    for i in range(3):
        journal.commit(path, [{"op": "note", "note": str(i)}], "2026-01-01")
    assert journal.pack(spark, str(tmp_path)) == 2 and journal.commit(path, [{"op": "note"}], "2026-01-01") == 4
    assert journal.verify(journal.read(spark, path)).count() == 0 and journal.read(spark, path, 2).count() == 2


@pytest.mark.parametrize("step", ["journal-1", "journal-3", "locations", "recipients", "attachments", "texts", "messages", "end"])
def test_a_batch_broken_off_at_any_step(spark, root, monkeypatch, step):
    fill(spark, root, MORE, 6, "s")
    want = {"add": 8, "classify": 2}
    monkeypatch.setattr(journal, "ROLL", 400)  # some segments for a batch
    made = []

    def broken(*a, f, at, **k):
        made.append(at)
        if f"journal-{len(made)}" == step or at == step:
            raise OSError("lost")
        return f(*a, **k)

    with monkeypatch.context() as m:
        m.setattr(journal, "commit", lambda *a, f=journal.commit: broken(*a, f=f, at="journal"))
        m.setattr(ingest, "save", lambda rows, to, name, f=ingest.save: broken(rows, to, name, f=f, at=name) if name != "store" else f(rows, to, name))
        m.setattr(journal, "end_batch", lambda *a, f=journal.end_batch: broken(*a, f=f, at="end"))
        with pytest.raises(OSError, match="lost"):
            fill(spark, root, [*ROWS, OLD], 7, "s")
    fill(spark, root, [("otto", "INBOX", 1, "", MORE[0][4])], 7, "other")  # another stream goes on meanwhile
    fill(spark, root, [*ROWS, OLD], 7, "s")
    told = {r["op"]: r["count"] for r in entries(spark, root).groupBy("op").count().collect()}
    assert told == {**want, "add": want["add"] + 1} and whole(spark, root)
    assert ingest.load(spark, root, "locations").count() == 9 and ingest.load(spark, root, "messages").count() == 7


def test_a_merge_broken_off_goes_on(spark, root, tmp_path, monkeypatch):
    other = f"file://{tmp_path}/other"
    fill(spark, other, [*ROWS, OLD])
    with monkeypatch.context() as m:
        m.setattr(ingest, "save", lambda rows, to, name, f=ingest.save: f(rows, to, name) if name == "store" else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            upkeep.merge(spark, other, root, "2026-01-02T00:00:00")
    upkeep.merge(spark, other, root, "2026-01-02T00:00:00")
    assert entries(spark, root).where("op = 'add'").count() == 5 and whole(spark, root)


def test_lines_name_their_batch(spark, root):
    fill(spark, root, MORE, 3, "s")
    assert {json.loads(r["line"]).get("batch") for r in journal.read(spark, f"{root}/journal").collect()} == {"s/3"}


def test_rules_beyond_ascii(spark):
    rows = spark.createDataFrame([("Ärzte/x",), ("ÄRZTE/x",), ("ärzte/",), ("Arzte/x",), ("",), (None,)], "folder string")
    made = rows.select("folder", policy.classify([policy.Rule("ordner", " Ärzte/* ", "privat")], F.col("folder"), F.lit(""), F.lit("")).alias("c")).collect()
    assert [r["c"] for r in made] == ["privat"] * 3 + [None] * 3
    marked = spark.createDataFrame([("STRASSE: x",), (" Straße: y",), ("Gasse",), (None,)], "subject string").select(policy.has_marker(F.col("subject"), ["straße:"]).alias("m")).collect()
    assert [r["m"] for r in marked] == [True, True, False, None]
