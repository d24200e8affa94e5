"""Keys, flags, file names and numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Flags of a mail server and the letters of a Maildir file name, fixed values.
LETTERS = {"\\Answered": "R", "\\Flagged": "F", "\\Seen": "S", "\\Draft": "D", "\\Deleted": "T"}
KEYWORDS = {"$seen": "\\Seen", "$flagged": "\\Flagged", "$answered": "\\Answered", "$draft": "\\Draft"}


def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def month_bucket(date_text: Column) -> Column:
    """YYYY/MM of the sender's own day; 0000/00 without a date."""
    return F.coalesce(F.concat(F.substring(date_text, 1, 4), F.lit("/"), F.substring(date_text, 6, 2)), F.lit("0000/00"))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))


def maildir_letters(flags: Column) -> Column:
    """Letters in order, once each: of server flags with blanks between, whatever their case, or of letters as a Maildir has them. What is neither is dropped."""
    flags = F.coalesce(flags, F.lit(""))
    known = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k.lower(), v)])
    named = F.transform(F.split(F.lower(flags), r"\s+"), lambda f: F.element_at(known, f))
    plain = F.filter(F.split(flags, ""), lambda x: x.isin(*LETTERS.values(), "P"))
    letters = F.when(F.contains(flags, F.lit("\\")), F.filter(named, lambda x: x.isNotNull())).otherwise(plain)
    return F.array_join(F.array_sort(F.array_distinct(letters)), "")


def server_flags(flags: Column) -> Column:
    """Server flags, in the order of their letters, for either form; a mark of deletion is not given back."""
    named = F.create_map(*[F.lit(x) for k, v in LETTERS.items() if v != "T" for x in (v, k)])
    return F.array_join(F.filter(F.transform(F.split(maildir_letters(flags), ""), lambda x: F.element_at(named, x)), lambda x: x.isNotNull()), " ")


def flags_of_keywords(keywords: Column) -> Column:
    """Server flags, sorted, for the true keywords of a map."""
    known = F.create_map(*[F.lit(x) for kv in KEYWORDS.items() for x in kv])
    names = F.filter(F.map_keys(keywords), lambda k: F.element_at(keywords, k))
    return F.array_join(F.array_sort(F.filter(F.transform(names, lambda k: F.element_at(known, k)), lambda x: x.isNotNull())), " ")


def german_number(n: Column) -> Column:
    """1234567 as 1.234.567."""
    return F.translate(F.format_number(n, 0), ",", ".")


def german_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB, with one decimal from MB on. Halves go to the even neighbour; thousands are not marked."""
    whole = lambda unit: F.bround(size / F.lit(float(unit)), 0).cast("long").cast("string")
    tenth = lambda unit: F.translate(F.format_string("%.1f", F.bround(size / F.lit(float(unit)), 1)), ".", ",")
    shown = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(whole(1 << 10), F.lit(" KB")))
    shown = shown.when(size < 1 << 30, F.concat(tenth(1 << 20), F.lit(" MB"))).when(size < 1 << 40, F.concat(tenth(1 << 30), F.lit(" GB")))
    return shown.when(size.isNotNull(), F.concat(tenth(1 << 40), F.lit(" TB")))


def german_time(iso: Column) -> Column:
    """25.08.2026, 09:46 for an ISO time, in the zone it is written in; midnight where it has only a day. Other text stays as it is, null is empty."""
    day = F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?$", 1)
    minute = F.coalesce(F.nullif(F.regexp_extract(iso, r"^\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2})", 1), F.lit("")), F.lit("00:00"))
    valid = (day != "") & F.try_to_timestamp(F.concat(day, F.lit(" "), minute), F.lit("yyyy-MM-dd HH:mm")).isNotNull()
    shown = F.concat(F.substring(day, 9, 2), F.lit("."), F.substring(day, 6, 2), F.lit("."), F.substring(day, 1, 4), F.lit(", "), minute)
    return F.when(valid, shown).otherwise(F.coalesce(iso, F.lit("")))


def safe_name(name: Column) -> Column:
    """A folder's name without what file systems do not take."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]+', "_")), F.lit("")), F.lit("_"))


def maildir_folder(account: Column, folder: Column) -> Column:
    """The directory of an account's folder in a Maildir++ collection: .account.A.B, so that accounts restored to one place stay apart."""
    parts = F.filter(F.concat(F.array(account), F.split(F.coalesce(folder, F.lit("")), "/")), lambda p: p != "")
    return F.concat(F.lit("."), F.array_join(F.transform(parts, lambda p: F.translate(safe_name(p), ".", "_")), "."))


def file_name(date_text: Column, hash: Column) -> Column:
    return F.concat(F.coalesce(F.substring(date_text, 1, 10), F.lit("0000-00-00")), F.lit("-"), F.substring(hash, 1, 16))


def thread_root(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    """The first reference, or what is replied to, or the message itself, without brackets; empty if there is none."""
    bare = lambda c: F.nullif(F.regexp_replace(F.trim(c), "^<+|>+$", ""), F.lit(""))
    return F.coalesce(bare(F.get(references, F.lit(0))), bare(in_reply_to), bare(message_id), F.lit(""))


def useful(attachment: Column) -> Column:
    """Whether an attachment is more than a picture or signature of the mail itself."""
    small_picture = attachment["inline"] & attachment["mime_type"].startswith("image/") & (attachment["size"] <= 512 * 1024)
    return ~small_picture & ~F.lower(F.coalesce(attachment["filename"], F.lit(""))).isin("smime.p7s", "smime.p7m", "signature.asc", "winmail.dat")


def in_pause(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in a pause, which may run over midnight."""
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
