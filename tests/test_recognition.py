"""Recognition runs over a small archive: scans that hang on several mails, failures, claims, and what a search then finds."""

import shutil
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from epistola.operators import lifecycle, recognition, runs
from epistola.operators.policy import Policy
from epistola.sources import folders
from epistola.streaming import ingest

AT, UNTIL, LATER = "2026-02-01T00:00:00", "2026-02-01T06:00:00", "2026-02-02T00:00:00"


def mail(n: int, *scans: tuple[str, bytes], text: str = "") -> tuple:
    m = EmailMessage()
    m["Subject"], m["From"], m["Date"], m["Message-ID"] = f"mail {n}", "anna@firma.example", "Mon, 05 Mar 2001 09:30:00 +0100", f"<{n}@x>"
    m.set_content("see attachment")
    for name, data in scans:
        m.add_attachment(data, "application", "pdf", filename=name)
    if text:
        m.add_attachment(text, filename="note.txt")
    return ("anna", "INBOX", n, "", bytes(m))


def reader():
    """Scans of these tests hold what is to be seen on them."""

    def read(payload: bytes) -> tuple[str, int]:
        if b"broken" in payload:
            raise ValueError("torn page")
        return payload[5:].decode(), 2

    return read


CONTRACT, BILL, BROKEN, EMPTY = b"%PDF Mietvertrag Haus am See", b"%PDF Rechnung ueber Holz", b"%PDF broken", b"%PDF "
MAILS = [mail(1, ("a.pdf", CONTRACT)), mail(2, ("b.pdf", CONTRACT), ("c.pdf", BILL), text="am Anfang Haus"), mail(3, ("d.pdf", BROKEN)), mail(4, ("e.pdf", BROKEN)), mail(5, ("f.pdf", EMPTY))]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("archive")
    ingest.add_batch(spark.createDataFrame(MAILS, folders.RAW), f"file://{path}", "2026-01-01T00:00:00")
    return path


@pytest.fixture
def root(filled, tmp_path):
    return f"file://{shutil.copytree(filled, tmp_path / 'archive')}"


def go(spark, root, at=AT, until=UNTIL, recognise=None, budget=None):
    return recognition.run(spark, root, recognise or reader(), at, until, budget, least=0, parts=2)


def asked(spark, root):
    return {r["text"] or r["problem"]: r["count"] for r in ingest.load(spark, root, "recognised").groupBy("text", "problem").count().collect()}


def found(spark, root, expression):
    return sorted(r["subject"] for r in ingest.archive(spark, root).matches(expression).collect())


def test_each_payload_is_asked_for_once_over_runs(spark, root):
    assert go(spark, root) == {"done": 3, "copies": 1, "failed": 2, "pages": 4}
    assert recognition.queue(spark, root, 0).count() == 1  # the other mail with the broken scan
    assert go(spark, root, LATER, "2026-02-02T06:00:00") == {"done": 0, "copies": 0, "failed": 1, "pages": 0}
    assert go(spark, root, LATER, "2026-02-02T06:00:00") == {"done": 0, "copies": 0, "failed": 0, "pages": 0}
    assert asked(spark, root) == {"Mietvertrag Haus am See": 1, "Rechnung ueber Holz": 1, "ValueError: torn page": 2, recognition.NO_TEXT: 1}
    assert runs.paths(root, "claims") == []
    states = {(r["filename"], r["state"], r["reason"]) for r in recognition.notes(spark, root).collect()}
    assert states == {*((n, "erledigt", None) for n in ("a.pdf", "b.pdf", "c.pdf")), ("d.pdf", "gescheitert", "ValueError: torn page"), ("e.pdf", "gescheitert", "ValueError: torn page"), ("f.pdf", "gescheitert", recognition.NO_TEXT)}


def test_failures_come_again_and_succeed(spark, root):
    go(spark, root), go(spark, root)
    assert recognition.retry_failed(spark, root, LATER) == 3 and recognition.queue(spark, root, 0).count() == 3
    better = lambda payload: ("endlich lesbar", 1)
    assert go(spark, root, LATER, "2026-02-02T06:00:00", better) == {"done": 3, "copies": 1, "failed": 0, "pages": 2}
    assert found(spark, root, "lesbar") == ["mail 3", "mail 4", "mail 5"]
    assert recognition.retry_failed(spark, root, LATER) == 0


def test_search_finds_it_by_index_as_by_text(spark, root):
    assert found(spark, root, "Mietvertrag") == []
    go(spark, root)
    a = ingest.archive(spark, root)
    plain = type(a)(a.messages, a.recipients, a.locations, a.attachments, a.texts)
    for q in ("mietvertrag", '"haus am see"', '"am anfang haus"', '"see c.pdf rechnung"', '"anfang mietvertrag"', "holz -see", "b.pdf"):
        assert sorted(r["hash"] for r in a.matches(q).collect()) == sorted(r["hash"] for r in plain.matches(q).collect()), q
    assert found(spark, root, '"haus am see"') == ["mail 1", "mail 2"]
    text = a.texts.join(a.messages.where("subject = 'mail 2'").select("hash"), "hash").first()["attachment_text"]
    assert text.split("\n")[-4:] == ["b.pdf", "Mietvertrag Haus am See", "c.pdf", "Rechnung ueber Holz"] and text.startswith("note.txt\n")


def test_budget_takes_the_smallest_first(spark, root):
    sizes = {len(EMPTY), len(BROKEN)}
    assert go(spark, root, budget=sum(sizes)) == {"done": 0, "copies": 0, "failed": 2, "pages": 0}
    assert go(spark, root) == {"done": 3, "copies": 1, "failed": 1, "pages": 4}


def test_claims(spark, root):
    """A payload that another run is at is left to it; a claim that is over, or was given back, is none."""
    places = recognition.fingerprints(ingest.load(spark, root, "store"), ingest.load(spark, root, "attachments").where("filename in ('a.pdf', 'c.pdf')").select("hash", "filename")).persist()
    other, own = runs.new_run(), runs.new_run()
    assert recognition.claim(spark, root, other, places.where("filename = 'a.pdf'"), AT, UNTIL).count() == 1
    assert recognition.claim(spark, root, own, places, AT, UNTIL).count() == 1
    recognition.release(spark, root, [own])
    assert go(spark, root) == {"done": 1, "copies": 0, "failed": 2, "pages": 2}  # the contract is the other run's
    assert go(spark, root, LATER, "2026-02-02T06:00:00") == {"done": 2, "copies": 1, "failed": 1, "pages": 2}


def test_a_run_that_dies_loses_nothing(spark, root, monkeypatch):
    whole = recognition.publish
    monkeypatch.setattr(recognition, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        go(spark, root)
    monkeypatch.setattr(recognition, "publish", whole)
    assert recognition.notes(spark, root).count() == 0
    # What it read is known; what it failed at is asked for again once its claim is over.
    assert go(spark, root) == {"done": 3, "copies": 3, "failed": 0, "pages": 0}
    assert go(spark, root, LATER, "2026-02-02T06:00:00") == {"done": 0, "copies": 0, "failed": 2, "pages": 0}
    assert asked(spark, root)["Mietvertrag Haus am See"] == 1


def test_notes_of_two_runs_at_once(spark, root, monkeypatch):
    """Notes that come between are seen: words are counted on from those of the other run."""
    first, calls = recognition.outcomes, []

    def between(spark, root, name, places):
        made = first(spark, root, name, places)
        if not calls:
            calls.append(1)
            made = made.persist()
            made.count()
            go(spark, root, budget=len(EMPTY))
        return made

    monkeypatch.setattr(recognition, "outcomes", between)
    go(spark, root)
    assert recognition.notes(spark, root).count() == 5
    assert found(spark, root, '"haus am see"') == ["mail 1", "mail 2"]


def test_deletion_takes_texts_that_no_mail_has(spark, root):
    go(spark, root)
    keys = {r["subject"]: r["hash"] for r in ingest.load(spark, root, "messages").collect()}
    lifecycle.delete(spark, root, spark.createDataFrame([(keys["mail 2"],)], "hash string"), "frist_abgelaufen", LATER, 2026, Policy(), "anna")
    lifecycle.compact(spark, root, purge=True)
    texts = {r["text"] for r in ingest.raw(spark, root, "recognised").collect()}
    assert texts == {"Mietvertrag Haus am See"} and ingest.raw(spark, root, "notes").where(F.col("hash") == keys["mail 2"]).isEmpty()
    assert found(spark, root, "mietvertrag") == ["mail 1"] and found(spark, root, "holz") == []


def test_rebuild_keeps_what_was_recognised(spark, root, tmp_path):
    go(spark, root)
    to = f"file://{tmp_path}/anew"
    ingest.rebuild(spark, root, to)
    for q in ("holz", '"haus am see"', '"am anfang haus"'):
        assert found(spark, to, q) == found(spark, root, q) != []
    both = [sorted(map(str, ingest.load(spark, r, "texts").collect())) for r in (root, to)]
    assert both[0] == both[1]


def test_lengths_that_were_not_noted(spark):
    notes = spark.createDataFrame([("h", "a.pdf", "f", None), ("h", "b.pdf", "g", 3)], "hash string, filename string, fingerprint string, chars long")
    heard = spark.createDataFrame([("f", "four", 1, None, "r"), ("g", "other", 1, None, "r"), ("f", None, 0, "torn", "s")], "fingerprint string, text string, pages int, problem string, asker string")
    assert sorted((r["filename"], r["chars"]) for r in recognition.fill_lengths(notes, heard).collect()) == [("a.pdf", 4), ("b.pdf", 3)]


def test_answers_come_in_frames_of_several(spark, monkeypatch):
    """A frame for each answer took longer than most answers; long ones are still given back one by one."""
    from epistola.operators import recognition

    sizes, made = [], recognition.pd.DataFrame
    monkeypatch.setattr(recognition.pd, "DataFrame", lambda rows, columns: sizes.append(len(rows)) or made(rows, columns=columns))
    head = 'MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="G"\r\n\r\n--G\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="s.pdf"\r\n\r\n'
    batch = made({"hash": list("abcde"), "raw": [f"{head}{t}\r\n--G--\r\n".encode() for t in ("x", "", "bad", "yyyy", "z")], "wanted": [[{"filename": "s.pdf", "fingerprint": f"f{i}"}] for i in range(5)]})

    class Rows:
        """What `ask` asks of the table of mails, on one frame."""

        def __getattr__(self, name):
            return lambda *args, **kw: self

        def mapInPandas(self, work, schema):
            return list(work(iter([batch])))

    def read(payload):
        if payload == b"bad":
            raise ValueError("bad")
        return payload.decode(), 1

    for most, want in ((100, [5]), (3, [4, 1])):
        monkeypatch.setattr(recognition, "FRAME_CHARS", most)
        sizes.clear()
        got = recognition.ask(Rows(), Rows(), read, 1)
        assert sizes == want
        rows = [tuple(r) for frame in got for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)]
        assert [(r[0], r[1], r[3]) for r in rows] == [("f0", "x", None), ("f1", None, recognition.NO_TEXT), ("f2", None, "ValueError: bad"), ("f3", "yyyy", None), ("f4", "z", None)]
