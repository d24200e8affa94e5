"""MBOX files by ranges of bytes against a look at the whole file; restored folders of several accounts."""

import io
import random
import re

import pytest

from epistola.functions import mail
from epistola.sources import folders, mbox, restore, servers
from tests.test_archive import ROWS, raw


def split_whole(data):
    for part in re.split(rb"(?:\A|(?<=\n))From [^\n]*\n", data)[1:]:
        yield re.sub(rb"(?m)^>(>*From )", rb"\1", part[:-1] if part.endswith(b"\n\n") else part)


def by_ranges(data, size):
    out = []
    for start in range(0, len(data), size):
        file = io.BytesIO(data)
        file.seek(max(0, start - 1))
        out += mbox.messages(file.read, start, min(len(data), start + size))
    assert [at for at, _ in out] == sorted({at for at, _ in out})
    return [m for _, m in out]


EDGES = [b"", b"From ", b"From a", b"From a\n", b"From a\nFrom b\n", b"x\nFrom a\ny\n\nFrom b\nz", b"\nFrom a\nb\n\n\nFrom c\n", b"From a\n>From b\n>>From c\nx From d\n\n", b"From a\nb\nFrom c without an end", b"From a\r\nb\r\n\r\nFrom c\r\nd\r\n", b"no mail at all\n", b"From a\n\nFrom b\n\n"]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 20])
def test_ranges_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(mbox, "CHUNK", chunk)
    random.seed(chunk)
    lines = [b"From ", b"From x\n", b"\n", b">From y\n", b"text\n", b"F", b"rom ", b"\nFro", b"m z\n", b"\n\n"]
    for data in EDGES + [b"".join(random.choice(lines) for _ in range(random.randrange(25))) for _ in range(60)]:
        want = list(split_whole(data))
        for size in {1, 2, 3, 5, 6, 7, 11, 30, len(data) or 1}:
            assert by_ranges(data, size) == want, (data, size)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    random.seed(9)
    box = tmp_path / "box"
    (box / "Archiv.sbd").mkdir(parents=True)
    each = [raw(f"Brief {i}", "a@b.example", "Mon, 01 Jan 2024 10:00:00 +0000", f"{'wort ' * random.randrange(400)}\nFrom here\n").replace(b"\r\n", b"\n") for i in range(3000)]
    data = b"".join(b"From - x\n" + re.sub(rb"(?m)^(>*From )", rb">\1", m) + b"\n" for m in each)
    (box / "Archiv.sbd" / "2024.mbox").write_bytes(data)
    (box / "klein").write_bytes(b"From - x\nSubject: y\n\nz\n\n")
    rows = folders.read_mbox(spark, str(box), "k", size=100_000)
    assert rows.rdd.getNumPartitions() == -(-len(data) // 100_000) + 1
    got = rows.collect()
    assert sorted(bytes(r["raw"]) for r in got if r["folder"] == "Archiv/2024") == sorted(split_whole(data)) == sorted(each)
    assert {r["folder"] for r in got} == {"Archiv/2024", "klein"} and {r["account"] for r in got} == {"k"}
    assert [r["folder"] for r in folders.read_mbox(spark, str(box / "klein"), "k").collect()] == ["klein"]
    (tmp_path / "leer").mkdir()
    assert folders.read_mbox(spark, f"file://{tmp_path}/leer", "k").count() == 0


def test_accounts_stay_apart(spark, tmp_path):
    rows = [*ROWS[:2], ("zweite", "INBOX", 5, "", ROWS[0][4]), ("..", "../../oben", 6, "", ROWS[1][4])]
    made = mail.parse(spark.createDataFrame(rows, folders.RAW)).select("hash", "account", "folder", "flags", "date_text", "raw").cache()
    for write, read in ((restore.to_eml, folders.read_eml), (restore.to_mbox, folders.read_mbox)):
        at = tmp_path / write.__name__
        assert write(made, f"file://{at}").count() == 4
        found = [r["folder"] for r in read(spark, f"file://{at}", "k").collect()]
        assert sorted(found) == ["-../-../-../oben", "firma/Gesendet", "firma/INBOX", "zweite/INBOX"]
        assert {p.name for p in tmp_path.iterdir()} <= {"to_eml", "to_mbox"}


def test_mailboxes_however_deep(spark):
    boxes = spark.createDataFrame([(str(i), f"n{i}", str(i - 1) if i else None, None) for i in range(40)], "id string, name string, parent string, role string")
    paths = {r["id"]: r["path"] for r in servers.folder_paths(boxes, cut=5).collect()}
    assert paths["39"] == "/".join(f"n{i}" for i in range(40)) and len(paths) == 40
