"""Tables of an archive. SCHEMA_VERSION is kept beside them and must match."""

from __future__ import annotations

SCHEMA_VERSION = 1

MESSAGES = "hash string, bucket string, date_text string, year int, from_addr string, from_name string, subject string, size long, has_attachments boolean, category string, message_id string, thread string, captured string, importance string"
RECIPIENTS = "hash string, addr string, kind string"
LOCATIONS = "hash string, account string, folder string, uid long, flags string"
ATTACHMENTS = "hash string, filename string, extension string, mime_type string, size long, text_chars long, inline boolean, kind string"
TEXTS = "hash string, subject string, sender string, recipients string, body string, attachment_names string, attachment_text string"
STORE = "hash string, bucket string, raw binary, size long"
JOURNAL = "segment string, line_no long, line string"
ENTRY = "seq long, ts string, op string, prev string, self string, hash string, bucket string, account string, folder string, uid long, size long, category string, previous string, actor string, reason string, kind string, place string, number long, old string, new string, date string, subject string, sender string, attachments long, note string, count long, covers string, file_existed boolean, batch string"
#: Messages that could not be read, with the reason.
QUARANTINE = "account string, folder string, uid long, raw binary, problem string, captured string"

TABLES = {"messages": MESSAGES, "recipients": RECIPIENTS, "locations": LOCATIONS, "attachments": ATTACHMENTS, "texts": TEXTS}

#: Deletions and classifications by number of their journal line, until a compaction has worked them into the tables.
GONE, FILED = "hash string, seq long", "hash string, category string, seq long"

#: What was recognised in payloads, where it belongs, and who is at it.
RECOGNISED = "fingerprint string, text string, pages int, problem string, place_hash string, place_name string, asker string, at string"
NOTES = "hash string, filename string, fingerprint string, state string, reason string, pages int, chars long, at string, turn long"
CLAIMS = "fingerprint string, until string"
