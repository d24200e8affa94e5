import pytest
from pyspark.sql import functions as F

from epistola import schemas
from epistola.functions import mail
from epistola.operators.archive import Archive, View
from epistola.sources import folders, restore
from epistola.streaming import ingest


def raw(subject, sender, day, body="", attached=None, message_id=None, refs=None):
    head = f"From: {sender}\r\nTo: Anna <anna@example.org>\r\nSubject: {subject}\r\nDate: {day}\r\n"
    head += f"Message-ID: <{message_id}>\r\n" if message_id else ""
    head += f"References: <{refs}>\r\n" if refs else ""
    if not attached:
        return (head + "Content-Type: text/plain; charset=utf-8\r\n\r\n" + body + "\r\n").encode()
    return (head + 'MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="G"\r\n\r\n--G\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n' + body + f'\r\n--G\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="{attached}"\r\n\r\nx\r\n--G--\r\n').encode()


ROWS = [
    ("firma", "INBOX", 1, "\\Seen", raw("Schlussrechnung 2025-0042", "Jörg Müller <jm@example.com>", "Wed, 12 Mar 2025 09:30:00 +0100", "Guten Tag", "Rechnung.pdf", "a@x")),
    ("firma", "Gesendet", 2, "", raw("Rückfrage zur Bestellung", "Anna <anna@example.org>", "Thu, 14 Mar 2024 09:30:00 +0000", "Bahnhofstraße 7", None, "b@x", "a@x")),
    ("privat", "INBOX", 3, "", raw("Newsletter März", "Laden <news@example.net>", "Sat, 01 Mar 2025 08:00:00 +0000", "Sonderangebote")),
    ("privat", "Kopie", 9, "", raw("Newsletter März", "Laden <news@example.net>", "Sat, 01 Mar 2025 08:00:00 +0000", "Sonderangebote")),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, folders.RAW)


@pytest.fixture(scope="module")
def archive(spark, rows):
    return Archive(**{k: v.cache() for k, v in mail.tables(mail.parse(rows), "2026-01-01T00:00:00").items()})


@pytest.mark.parametrize(
    ("expression", "n"),
    [("sonderangebote", 1), ("betreff:rechnung", 1), ("von:müller", 1), ("von:muller", 1), ("von:mueller", 1), ("jahr:2024", 1), ("jahr:2024-2025", 3), ("typ:pdf", 1), ("hat:anhang", 1), ("konto:privat", 1), ("-sonderangebote", 2), ("von:müller jahr:2025", 1), ("von:müller jahr:2024", 0), ("", 3), ("*", 0), ("text:bahnhofstrasse", 1), ("ordner:gesendet", 1), ("datei:rech*", 1), ("-typ:pdf", 2), ("am:01.03.2025", 1), ("archiviert:2026", 3)],
)
def test_search(archive, expression, n):
    assert archive.count(expression).first()["n"] == n


def test_view(archive):
    seen = archive.seen_by(View(("privat",)))
    assert seen.count().first()["n"] == 1 and seen.count("konto:firma").first()["n"] == 0
    assert archive.seen_by(View(())).count().first()["n"] == 0
    assert View.of({"active": False}) == View(()) and View.of(None) == View() and View.of({"all": True}) == View()
    assert seen.statistics().first()["places"] == 2 and archive.statistics().first()["mails"] == 3


def test_thread_and_places(archive):
    key = archive.matches("hat:anhang").first()["hash"]
    assert [r["subject"] for r in archive.thread(key).collect()] == ["Rückfrage zur Bestellung", "Schlussrechnung 2025-0042"]
    key = archive.matches("sonderangebote").first()["hash"]
    assert [r["folder"] for r in archive.places(key).collect()] == ["INBOX", "Kopie"]
    assert archive.search("", limit=2).count() == 2


def test_ingest_twice(spark, rows, tmp_path):
    root = f"file://{tmp_path}/archive"
    for _ in range(2):
        ingest.add_batch(rows, root, "2026-01-01")
    assert ingest.load(spark, root, "store").count() == 3 and ingest.load(spark, root, "locations").count() == 4
    assert {t for t in schemas.TABLES} == {"messages", "recipients", "locations", "attachments", "texts"}


def test_round_trip(spark, rows, tmp_path):
    kept = mail.parse(rows).orderBy("account", "folder").select("hash", "account", "folder", "flags", "date_text", "raw").dropDuplicates(["hash"])
    before = {r["hash"] for r in kept.collect()}
    restore.to_maildir(kept, f"file://{tmp_path}/m").collect()
    restore.to_mbox(kept, f"file://{tmp_path}/b").collect()
    restore.to_eml(kept, f"file://{tmp_path}/e").collect()
    back = folders.read_maildir(spark, f"file://{tmp_path}/m", "k")
    assert {r["h"] for r in back.select(F.sha2("raw", 256).alias("h")).collect()} == before
    assert {(r["folder"], r["flags"]) for r in back.collect()} >= {("firma/INBOX", "\\Seen"), ("firma/Gesendet", "")}
    assert {r["h"] for r in folders.read_eml(spark, f"file://{tmp_path}/e", "k").select(F.sha2("raw", 256).alias("h")).collect()} == before
    assert folders.read_mbox(spark, f"file://{tmp_path}/b", "k").count() == 3


def test_parse_never_raises():
    for data in (b"", b"\xff\xfe", b"Subject: =?x?q?=ff?=\r\n\r\n", b"Date: gestern\r\n\r\nx"):
        mail.parse_message(data)
    assert mail.html_to_text("<p>a<script>b</script></p>c") == "a c"
    assert mail.html_to_text("<td>a</td><td>b</td><b>c</b><i>d</i>") == "a b c d"
    assert mail.html_to_text("<head><title>t</title></head><p>a <b>b</b>c</p><pre>d</pre><br><br><br><br>e", paragraphs=True) == "a bc\n\nd\n\ne"
    assert folders.unwrap_emlx(b"3\nabcdef") == b"abc" and folders.unwrap_emlx(b"x\nabc") == b"x\nabc"


def test_fetch(spark):
    server = spark.createDataFrame([("k", "A", i, 1) for i in (1, 5, 6, 7)] + [("k", "B", 3, 2)], "account string, folder string, uid long, uidvalidity long")
    held = spark.createDataFrame([("k", "A", 5, 1), ("k", "B", 3, 1)], "account string, folder string, max_uid long, uidvalidity long")
    retry = spark.createDataFrame([("k", "A", 1), ("k", "A", 2)], "account string, folder string, uid long")
    assert sorted((r["folder"], r["uid"]) for r in folders.to_fetch(server, held, retry).collect()) == [("A", 1), ("A", 6), ("A", 7), ("B", 3)]
