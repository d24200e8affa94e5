import pytest
from pyspark.sql import functions as F

from epistola.functions import formats, mail
from epistola.operators import policy


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("flags", "letters", "back"), [("\\Seen \\Deleted", "ST", "\\Seen"), ("SR", "RS", "\\Answered \\Seen"), ("\\seen", "S", "\\Seen"), ("\\Flagged \\Draft \\Recent", "DF", "\\Draft \\Flagged"), ("", "", ""), (None, "", ""), ("xPS", "PS", "\\Seen")])
def test_flags(spark, flags, letters, back):
    flags = F.lit(flags).cast("string")
    assert one(spark, formats.maildir_letters(flags)) == letters and one(spark, formats.server_flags(flags)) == back


@pytest.mark.parametrize(("size", "shown"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "2 KB"), (2560, "2 KB"), (1_048_000, "1023 KB"), (7_130_316, "6,8 MB"), (5 << 30, "5,0 GB"), (5 << 40, "5,0 TB"), (5000 << 40, "5000,0 TB"), (None, None)])
def test_sizes(spark, size, shown):
    assert one(spark, formats.german_size(F.lit(size).cast("long"))) == shown


@pytest.mark.parametrize(("iso", "shown"), [("2026-08-25T09:46:12+02:00", "25.08.2026, 09:46"), ("2026-08-25", "25.08.2026, 00:00"), ("2026-13-25T09:46:00", "2026-13-25T09:46:00"), ("gestern", "gestern"), ("", ""), (None, "")])
def test_times(spark, iso, shown):
    assert one(spark, formats.german_time(F.lit(iso).cast("string"))) == shown


def test_folders_of_two_accounts_stay_apart(spark):
    name = lambda account, folder: one(spark, formats.maildir_folder(F.lit(account), F.lit(folder)))
    assert name("firma", "INBOX") == ".firma.INBOX" and name("privat", "INBOX/Alt.2") == ".privat.INBOX.Alt_2"


@pytest.mark.parametrize(("folder", "out"), [("Gelöschte Objekte", True), ("INBOX/bulk-mail/alt", True), ("Werbung", True), ("Werbung 2024", False), ("UNERWÜNSCHTE E-MAIL", True), ("Spam-Archiv", False), ("INBOX", False)])
def test_excluded(spark, folder, out):
    assert one(spark, policy.is_excluded(F.lit(folder))) is out


@pytest.mark.parametrize(("html", "text"), [("a &amp b", "a &amp b"), ("a &amp; b &lt;c&gt;", "a & b <c>"), ("x&copy", "x&copy"), ("&#65; &#65 &&", "A &#65 &&"), (None, "")])
def test_a_reference_has_its_semicolon_in_a_strict_page(html, text):
    assert mail.html_to_text(html, strict=True) == text
