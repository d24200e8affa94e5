"""The state of fetching as a stream's offset: new mail, changed epochs, broken mail and batches that fail."""

import pytest

from epistola.sources import spool
from epistola.streaming import ingest
from tests.test_archive import raw


def mail(i):
    return raw(f"Brief {i}", "a@b.example", "Mon, 01 Jan 2024 10:00:00 +0000", f"Text {i}", None, f"s{i}@x")


@pytest.fixture
def box(tmp_path):
    def put(account, folder, epoch, mails):
        at = tmp_path / "spool" / account / folder
        (at / f"@{epoch}").mkdir(parents=True, exist_ok=True)
        for n, data in mails.items():
            (at / f"@{epoch}" / f"{n}.eml").write_bytes(data)
        (at / "epoch").write_text(str(epoch))

    return put


def places(spark, root):
    return {(r["account"], r["folder"], r["uid"]) for r in ingest.load(spark, root, "locations").collect()}


def test_only_what_is_new_is_fetched(spark, tmp_path, box, monkeypatch):
    root, at, check = f"file://{tmp_path}/archive", f"file://{tmp_path}/spool", f"{tmp_path}/check"
    seen = []
    monkeypatch.setattr(ingest, "add_batch", lambda batch, *a, f=ingest.add_batch: (seen.append(sorted(r["uid"] for r in batch.select("uid").collect())), f(batch, *a)))
    run = lambda day: spool.fetch(spark, at, root, day, check)
    box("anna", "INBOX", 7, {1: mail(1), 2: mail(2)})
    box("anna", "Archiv/2024", 3, {9: mail(3)})
    run("2026-01-01")
    assert seen[-1] == [1, 2, 9] and places(spark, root) == {("anna", "INBOX", 1), ("anna", "INBOX", 2), ("anna", "Archiv/2024", 9)}
    box("anna", "INBOX", 7, {5: mail(5)})
    run("2026-01-02")
    assert seen[-1] == [5]
    box("anna", "INBOX", 8, {1: mail(2), 2: mail(6)})  # numbers mean other mail now
    run("2026-01-03")
    assert seen[-1] == [1, 2] and ingest.load(spark, root, "messages").count() == 5
    n = len(seen)
    run("2026-01-04")
    assert len(seen) == n or seen[-1] == []  # read anew once


def test_a_batch_that_fails_is_fetched_whole_again(spark, tmp_path, box, monkeypatch):
    root, at, check = f"file://{tmp_path}/archive", f"file://{tmp_path}/spool", f"{tmp_path}/check"
    box("anna", "INBOX", 7, {1: mail(1)})
    spool.fetch(spark, at, root, "2026-01-01", check)
    box("anna", "INBOX", 8, {1: mail(1), 2: mail(2), 3: mail(3)})
    with monkeypatch.context() as m:
        m.setattr(ingest, "add_batch", lambda *a: 1 / 0)
        with pytest.raises(Exception):  # noqa: B017
            spool.fetch(spark, at, root, "2026-01-02", check)
    spool.fetch(spark, at, root, "2026-01-03", check)
    assert ingest.load(spark, root, "messages").count() == 3


def test_broken_mail_is_asked_for_again(spark, tmp_path, box):
    root, at, check = f"file://{tmp_path}/archive", f"file://{tmp_path}/spool", f"{tmp_path}/check"
    box("anna", "INBOX", 7, {1: mail(1), 2: b""})
    spool.fetch(spark, at, root, "2026-01-01", check)
    assert places(spark, root) == {("anna", "INBOX", 1)} and spool._lists(at) == ["000000001"]
    box("anna", "INBOX", 7, {2: mail(2)})
    spool.fetch(spark, at, root, "2026-01-02", check)
    assert places(spark, root) == {("anna", "INBOX", 1), ("anna", "INBOX", 2)} and spool._lists(at) == ["000000001"]


def test_shares_are_bounded(tmp_path, box, monkeypatch):
    monkeypatch.setattr(spool, "SHARE", 3)
    box("k", "A", 1, {i: b"x" for i in (1, 2, 5, 6, 9, 10, 11)})
    reader = spool.SpoolReader(str(tmp_path / "spool"))
    end = reader.latestOffset()
    assert end == {"folders": {"k/A": [1, 11]}, "again": 0}
    parts = reader.partitions({"folders": {"k/A": [1, 2]}, "again": 0}, end)
    assert [[n for *_, n, _, _ in reader.read(p)] for p in parts] == [[5, 6, 9], [10, 11]]
    assert [[n for *_, n, _, _ in reader.read(p)] for p in reader.partitions({"folders": {"k/A": [2, 99]}, "again": 0}, end)] == [[1, 2, 5], [6, 9, 10], [11]]
    assert list(reader.read(reader.partitions(end, end)[0])) == []
