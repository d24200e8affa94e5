"""Sources of several kinds, what is asked of servers, attachments, and upkeep."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from epistola.functions import attachments, mail
from epistola.operators import journal, upkeep
from epistola.sources import folders, restore, servers
from epistola.streaming import ingest
from tests.test_archive import ROWS, raw


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


DOCX = zipped(**{"word__document.xml": "<d><p>Vertrag</p><p>Nr. <b>7</b></p></d>", "word__header1.xml": "<h>Kopf</h>", "word__other.xml": "<x>nicht</x>"})


@pytest.mark.parametrize(
    ("name", "data", "text", "kind"),
    [
        ("v.docx", DOCX, "Vertrag Nr. 7 Kopf", "office"),
        ("V.DOCM", DOCX, "Vertrag Nr. 7 Kopf", "office"),
        ("t.ods", zipped(**{"content.xml": "<t><c>Summe</c> <c>12</c></t>"}), "Summe 12", "office"),
        ("x.xlsx", b"PK\x03\x04broken", "", "passed over"),
        ("r.rtf", rb"{\rtf1\ansi{\*\generator x;}\b Gr\'fc\'dfe\b0  aus {\i Bonn}\par}", "Grüße aus Bonn", "rtf"),
        ("a.html", "<p>a</p>b".encode(), "a b", "html"),
        ("notiz", "kein Name für sich\n".encode(), "kein Name für sich\n", "text"),
        ("b.bin", b"text", "", "passed over"),
        ("dings.xyz", b"\x00\x01\x02", "", "passed over"),
        ("s.asc", b"signature", "", "passed over"),
        ("scan.pdf", b"%PDF-1.4", "", "pdf"),
        ("l.txt", b"", "", "empty"),
        ("w.csv", "Stra\xdfe;1".encode("cp1252"), "Straße;1", "text"),
    ],
)
def test_attachments(name, data, text, kind):
    assert attachments.read(name, data, mail.html_to_text) == (text, kind)


def test_attachment_texts_are_searched(spark):
    message = b'Subject: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="G"\r\n\r\n--G\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="notiz.md"\r\n\r\nHandelsregister\r\n--G--\r\n'
    rows = spark.createDataFrame([("k", "A", 1, "", message)], folders.RAW)
    made = mail.tables(mail.parse(rows), "2026")
    assert made["texts"].first()["attachment_text"] == "notiz.md\nHandelsregister"
    assert [(r["kind"], r["n"]) for r in upkeep.attachment_kinds(made["attachments"]).collect()] == [("text", 1)]


@pytest.mark.parametrize(("name", "form"), [("Entwürfe", "Entw&APw-rfe"), ("A & B", "A &- B"), ("INBOX", "INBOX"), ("日本", "&ZeVnLA-"), ("", "")])
def test_names_of_folders(spark, name, form):
    assert servers.to_utf7(name) == form and servers.from_utf7(form) == name
    row = spark.createDataFrame([(form, name), (None, None)], "f string, n string").select(servers.decode_name("f").alias("f"), servers.encode_name("n").alias("n")).collect()
    assert [tuple(r) for r in row] == [(name, form), (None, None)] and servers.from_utf7("a&A-b") == "a&A-b"


def test_requests(spark):
    rows = spark.createDataFrame([("k", "A", i, 10) for i in range(1, 8)] + [("k", "A", 8, None), ("k", "B", 1, 99), ("k", "B", 2, 1)], "account string, folder string, uid long, size long")
    got = {(r["folder"], r["uid"]): r["block"] for r in servers.requests(rows, mails=3, size=25).collect()}
    assert [got["A", i] for i in range(1, 9)] == [0, 0, 1, 1, 2, 2, 3, 3] and (got["B", 1], got["B", 2]) == (0, 1)


def test_mailboxes(spark):
    boxes = spark.createDataFrame([("1", "INBOX", None, "inbox"), ("2", "Rechnungen", "1", None), ("3", "Papierkorb", None, "Trash"), ("4", "X", "5", None), ("5", "Y", "4", None), ("6", "Alle", None, "all"), ("7", "Fern", "99", None), (None, "z", None, None)], "id string, name string, parent string, role string")
    paths = servers.folder_paths(boxes, ("Fern",))
    assert {r["id"]: r["path"] for r in paths.collect()} == {"1": "INBOX", "2": "INBOX/Rechnungen", "4": "Y/X", "5": "X/Y"}
    mails = spark.createDataFrame([("a", ["3", "2", "1"]), ("b", ["3"]), ("c", [])], "id string, mailboxes array<string>")
    assert {r["id"]: r["folder"] for r in servers.first_folder(mails, paths).collect()} == {"a": "INBOX"}


def test_what_lies_where(spark, tmp_path):
    message = raw("Betreff", "a@b.example", "Mon, 01 Jan 2024 10:00:00 +0000", "Text")
    profile = tmp_path / "profile"
    (profile / "Mail" / "server" / "Archiv.sbd").mkdir(parents=True)
    box = b"From - x\n" + message.replace(b"\r\n", b"\n") + b"\n"
    for name in ("Inbox", "Trash", "popstate.dat", "x.sqlite", "Archiv.sbd/2024", ".versteckt", "Drafts"):
        (profile / "Mail" / "server" / name).write_bytes(box)
    assert folders.kind_of(str(profile)) == "profile"
    assert sorted(r["folder"] for r in folders.read_any(spark, str(profile), "k").collect()) == ["server/Archiv/2024", "server/Inbox"]
    assert folders.read_any(spark, str(profile), "k", everything=True).count() == 3
    (tmp_path / "eml").mkdir()
    (tmp_path / "eml" / "a.eml").write_bytes(message)
    rows = mail.parse(spark.createDataFrame(ROWS, folders.RAW)).select("hash", "account", "folder", "flags", "date_text", "raw")
    restore.to_maildir(rows, str(tmp_path / "maildirs")).collect()
    assert (folders.kind_of(str(tmp_path / "eml")), folders.kind_of(str(tmp_path / "maildirs")), folders.kind_of(str(tmp_path / "eml" / "a.eml"))) == ("eml", "collection", "mbox")
    both = folders.read_all(spark, [str(tmp_path / "eml"), str(tmp_path / "maildirs")], "k")
    assert both.count() == 5 and {f.split("/")[0] for (f,) in both.select("folder").collect()} == {"eml", "maildirs"}
    with pytest.raises(FileNotFoundError):
        folders.kind_of(str(tmp_path / "none"))
    (tmp_path / "leer").mkdir()
    with pytest.raises(ValueError, match="no mail"):
        folders.kind_of(str(tmp_path / "leer"))


def test_merge_of_two_archives(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    ingest.add_batch(spark.createDataFrame(ROWS[:2], folders.RAW), a, "2026-01-01")
    ingest.add_batch(spark.createDataFrame(ROWS[1:], folders.RAW), b, "2026-01-01")
    assert upkeep.merge(spark, b, a, "2026-02-01")["messages"] == 1
    assert ingest.load(spark, a, "locations").count() == 4 and journal.verify(journal.read(spark, f"{a}/journal")).count() == 0


def test_recent_searches(spark):
    typed = ["r", "re", "rechnung", "", "telekom", "tele", "rechnung", "a", "b", "c"]
    rows = spark.createDataFrame([("u", i, x) for i, x in enumerate(typed)] + [("v", 0, "x"), ("v", 1, None)], "user string, at int, expression string")
    got = {}
    for r in sorted(upkeep.recent(rows, 4).collect(), key=lambda r: (r["user"], r["rank"])):
        got.setdefault(r["user"], []).append(r["expression"])
    assert got == {"u": ["c", "b", "a", "rechnung"], "v": ["x"]}


def test_saved_searches():
    kept = upkeep.keep_search([], "  Alte   Rechnungen ", "jahr:2001")
    assert kept == [{"name": "Alte Rechnungen", "expression": "jahr:2001"}]
    for name, asked in (("alte rechnungen", "x"), ("", "x"), ("n" * 61, "x"), ("neu", "jahr:x"), ("neu", " ")):
        with pytest.raises(ValueError):
            upkeep.keep_search(kept, name, asked)
    assert upkeep.keep_search(kept, "Neu", "x", at=0) == [{"name": "Neu", "expression": "x"}]


def test_recognised_text_is_added(spark):
    texts = spark.createDataFrame([("a", "alt"), ("b", ""), ("c", None)], "hash string, attachment_text string")
    more = spark.createDataFrame([("a", "2.pdf", "zwei"), ("a", "1.pdf", "eins"), ("b", "x", "neu"), ("c", "y", " ")], "hash string, filename string, text string")
    assert {r["hash"]: r["attachment_text"] for r in upkeep.with_recognised(texts, more).collect()} == {"a": "alt\neins\nzwei", "b": "neu", "c": None}


def test_paths_are_checked(spark):
    with pytest.raises(Exception, match="no payload"):
        spark.range(1).select(upkeep.stored_path(F.lit("../x"), F.lit("2024/01"))).collect()


def test_a_turn_of_paths_is_no_chain_of_joins(spark):
    boxes = spark.createDataFrame([(i, f"F{i}", i // 3 if i else None, None) for i in range(200)], "id int, name string, parent int, role string")
    paths = servers.folder_paths(boxes)
    assert paths._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0 and paths.count() == 200
    assert {r["id"]: r["path"] for r in paths.collect()}[100] == "F0/F1/F3/F11/F33/F100"
