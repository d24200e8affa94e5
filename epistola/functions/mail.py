"""Messages as rows: one Arrow pass at ingest, so that queries never leave the JVM."""

from __future__ import annotations

import email
import email.header
import email.policy
import re
from collections.abc import Iterator
from datetime import UTC
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from epistola.functions import attachments, formats

BODY_MOST, ATTACHED_MOST = 1_000_000, 600_000
#: Elements that begin a line, and those whose text is not shown, fixed values.
_BLOCKS = {"p", "br", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "ul", "ol", "hr", "section"}
_HIDDEN = {"script", "style", "head"}


class _Text(HTMLParser):
    """Pieces of text between tags; the text flows on in one line, or breaks where a block begins or ends."""

    def __init__(self, between: str, at_blocks: str) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.between, self.at_blocks = [], 0, between, at_blocks

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _BLOCKS:
            self.out.append(self.at_blocks)

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        if tag in _BLOCKS:
            self.out.append(self.at_blocks)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data + self.between)


def html_to_text(html: str | None, paragraphs: bool = False, strict: bool = False) -> str:
    """The text that a page shows: its pieces with a blank between; in paragraphs, blocks keep their lines with one empty line between at most. strict: a reference without its semicolon is text."""
    if strict:
        html = re.sub(r"&(?!#?[0-9A-Za-z]+;)", "&amp;", html or "")
    parser = _Text("", "\n") if paragraphs else _Text(" ", "")
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.out)
    if not paragraphs:
        return " ".join(text.split())
    lines = [" ".join(x.split()) for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def decode(data: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8", "cp1252"):
        try:
            return data.decode(name) if name else data.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("latin-1")


def _importance(message) -> str:
    """hoch, normal or niedrig: by how the first of these headers that says anything begins."""
    named = {"Importance": {"high": "hoch", "low": "niedrig"}, "X-Priority": {"1": "hoch", "2": "hoch", "3": "normal", "4": "niedrig", "5": "niedrig"}, "Priority": {"urgent": "hoch", "non-urgent": "niedrig"}}
    for header, levels in named.items():
        value = str(message.get(header, "") or "").strip().lower()
        for begin, level in levels.items():
            if value.startswith(begin):
                return level
    return "normal"


def _date(message) -> str | None:
    received = message.get_all("Received") or [""]
    for value in (str(message.get("Date", "") or ""), str(received[0]).rpartition(";")[2]):
        try:
            when = parsedate_to_datetime(value.strip())
            return (when if when.tzinfo else when.replace(tzinfo=UTC)).isoformat()
        except (TypeError, ValueError, IndexError):
            pass
    return None


def parse_message(raw: bytes) -> dict:
    """Fields, addresses, body and attachments of a message; what cannot be read is empty and never raises."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    name_of = {k.lower(): k for k, _ in m.raw_items()}

    def header(name: str) -> str:
        value = m.get(name)
        if value is None:
            return ""
        plain = decode(dict(m.raw_items())[name_of[name.lower()]].encode("ascii", "surrogateescape"), None)  # bytes beyond ASCII, against the rules but common
        try:
            return " ".join(str(email.header.make_header(email.header.decode_header(plain))).split())
        except (LookupError, ValueError, UnicodeError):  # a header may hold anything
            return " ".join(plain.split())

    people = {k: [a for _, a in getaddresses([header(k)]) if a] for k in ("to", "cc", "bcc")}
    name, addr = next(iter(getaddresses([header("From")])), ("", ""))
    plain, html, attached = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, file = part.get_content_type(), part.get_filename()
        data = part.get_payload(decode=True) or b""
        disposition = part.get_content_disposition()
        if file or disposition == "attachment" or not kind.startswith("text/"):
            inline = disposition == "inline" or bool(part.get("Content-ID"))
            # Once texts are too long together, no more attachments are read.
            text, how = attachments.read(str(file or ""), data, html_to_text) if sum(len(x["text"]) for x in attached) <= ATTACHED_MOST else ("", "not read")
            attached.append({"filename": str(file or ""), "mime_type": kind, "size": len(data), "text": text, "inline": inline, "kind": how})
        elif kind == "text/plain":
            plain.append(decode(data, part.get_content_charset()))
        elif kind == "text/html":
            html.append(html_to_text(decode(data, part.get_content_charset())))
    ids = re.findall(r"<([^<>\s]+)>", str(m.get("References", "") or ""))
    return {
        "subject": header("Subject"), "from_name": name, "from_addr": addr, "to": people["to"], "cc": people["cc"], "bcc": people["bcc"], "date_text": _date(m),
        "message_id": header("Message-ID"), "in_reply_to": next(iter(re.findall(r"<([^<>\s]+)>", str(m.get("In-Reply-To", "") or ""))), ""), "references": ids, "importance": _importance(m),
        "body": "\n".join(plain or html)[:BODY_MOST], "attached": attached,
    }


#: What is returned for a message that cannot be read.
NOTHING = {"subject": "", "from_name": "", "from_addr": "", "to": [], "cc": [], "bcc": [], "date_text": None, "message_id": "", "in_reply_to": "", "references": [], "importance": "normal", "body": "", "attached": []}


def try_parse(raw: bytes | None) -> dict:
    """The message, with `problem` telling why it could not be read: one bad message must not hold up the others."""
    if not raw:
        return NOTHING | {"problem": "empty"}
    try:
        return parse_message(raw) | {"problem": None}
    except Exception as error:  # noqa: BLE001 - a message may hold anything
        return NOTHING | {"problem": f"{type(error).__name__}: {error}"[:500]}


PARSED = "problem string, subject string, from_name string, from_addr string, to array<string>, cc array<string>, bcc array<string>, date_text string, message_id string, in_reply_to string, references array<string>, importance string, body string, attached array<struct<filename:string,mime_type:string,size:long,text:string,inline:boolean,kind:string>>"


def parse(messages: DataFrame) -> DataFrame:
    """Adds the parsed fields to rows with a column `raw`, and hash, bucket, year, thread and has_attachments made from them; `problem` is null but for what could not be read."""

    @F.pandas_udf(PARSED)
    def read(raws: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in PARSED.split(", ")]
        for raw in raws:
            yield pd.DataFrame([try_parse(bytes(x) if x is not None else None) for x in raw], columns=columns)

    rows = messages.withColumn("p", read("raw")).select(*messages.columns, "p.*")
    return rows.withColumns({
        "hash": formats.content_hash(F.col("raw")), "size": F.length("raw").cast("long"), "bucket": formats.month_bucket(F.col("date_text")), "year": F.substring("date_text", 1, 4).cast("int"),
        "thread": formats.thread_root(F.col("references"), F.col("in_reply_to"), F.col("message_id")), "has_attachments": F.exists("attached", formats.useful),
    })


def tables(parsed: DataFrame, captured: str, once: DataFrame | None = None, also: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The archive's tables from parsed rows with account, folder, uid and flags: a message once, a place once. once: a row a message, where the caller keeps such rows. also: columns of a message that all tables but that of messages get too."""
    once = parsed.dropDuplicates(["hash"]) if once is None else once
    names = F.array_join(F.transform(F.filter("attached", formats.useful), lambda a: a["filename"]), " ")
    texts = F.substring(F.array_join(F.transform(F.filter("attached", lambda a: F.trim(a["text"]) != ""), lambda a: F.concat(a["filename"], F.lit("\n"), a["text"])), "\n\n"), 1, ATTACHED_MOST)
    of_kind = lambda k: F.transform(k, lambda a: F.struct(F.lower(a).alias("addr"), F.lit(k).alias("kind")))
    kinds = F.array(*map(of_kind, ("to", "cc", "bcc")))
    return {
        "messages": once.select("hash", "bucket", "date_text", "year", "from_addr", "from_name", "subject", "size", "has_attachments", F.lit("unbestimmt").alias("category"), "message_id", "thread", F.lit(captured).alias("captured"), "importance"),
        "recipients": once.select("hash", F.explode(F.flatten(kinds)).alias("r"), *also).select("hash", "r.addr", "r.kind", *also).distinct(),
        "locations": parsed.groupBy("hash", "account", "folder").agg(F.min_by(F.struct("uid", "flags"), F.coalesce("uid", F.lit(2**62))).alias("l"), *[F.first(c).alias(c) for c in also]).select("hash", "account", "folder", "l.uid", "l.flags", *also),
        "attachments": once.select("hash", F.explode("attached").alias("a"), *also).select("hash", "a.filename", formats.extension(F.col("a.filename")).alias("extension"), "a.mime_type", "a.size", F.when(F.col("a.text") != "", F.length("a.text")).otherwise(F.lit(0)).cast("long").alias("text_chars"), "a.inline", "a.kind", *also),
        "texts": once.select("hash", "subject", F.concat_ws(" ", "from_name", "from_addr").alias("sender"), F.array_join(F.concat("to", "cc"), " ").alias("recipients"), "body", names.alias("attachment_names"), texts.alias("attachment_text"), *also),
    }
