"""An archive's tables, what a reader may see of them, and search.

A view restricts the tables first; predicates are then compiled against what is left, so a reader cannot learn of places
that are hidden. Conditions on other tables become semi and anti joins, all others filters that reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from epistola.functions.text import ascii_lower, fold, glob_pattern, has_part, has_phrase, like_pattern, spellings
from epistola.lang import terms as T
from epistola.operators.pieces import Pieces, Values
from epistola.operators.postings import Postings

TEXT_COLUMNS = ("subject", "sender", "recipients", "body", "attachment_names", "attachment_text")
ORDERS = {"datum": "date_text", "absender": "sender_key", "betreff": "subject_key", "groesse": "size", "anhang": "has_attachments"}


@dataclass(frozen=True)
class View:
    """Accounts that a reader may see: None for all of them."""

    accounts: tuple[str, ...] | None = None

    @classmethod
    def of(cls, user: dict | None) -> View:
        """No user sees all, one who is not active nothing, others all or their accounts."""
        if user is None:
            return cls()
        if not user.get("active", True):
            return cls(())
        return cls() if user.get("all") else cls(tuple(sorted(user.get("accounts", ()))))


@dataclass(frozen=True)
class Archive:
    """messages, recipients, locations, attachments and texts share the column `hash`, and so do the indexes of words and of pieces of short fields, where there are any."""

    messages: DataFrame
    recipients: DataFrame
    locations: DataFrame
    attachments: DataFrame
    texts: DataFrame
    index: Postings | None = None
    pieces: Pieces | Values | None = None

    def seen_by(self, view: View) -> Archive:
        """The archive as this reader has it: places in their accounts, and what belongs to messages with such a place."""
        if view.accounts is None:
            return self
        places = self.locations.where(F.col("account").isin(*view.accounts) if view.accounts else F.lit(False))
        only = lambda t: t.join(places.select("hash"), "hash", "left_semi")
        return replace(self, messages=only(self.messages), recipients=only(self.recipients), locations=places, attachments=only(self.attachments), texts=only(self.texts))

    def matches(self, expression: str) -> DataFrame:
        """The messages that an expression of the search language asks for."""
        return compile_terms(self, T.parse(expression))

    def search(self, expression: str = "", order: str = "datum", descending: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Hits in a total order: the chosen column, then later dates first, then the key. A limit with an order is a top-k."""
        column = F.col(ORDERS.get(order, "date_text"))
        hits = self.matches(expression).withColumns({"sender_key": ascii_lower(F.coalesce(F.nullif("from_name", F.lit("")), "from_addr")), "subject_key": ascii_lower(F.col("subject"))})
        first = column.desc_nulls_last() if descending else column.asc_nulls_first()
        hits = hits.orderBy(first, F.col("date_text").desc_nulls_last(), "hash").drop("sender_key", "subject_key")
        hits = hits.offset(offset) if offset else hits
        return display(hits.limit(limit) if limit is not None else hits)

    def count(self, expression: str = "") -> DataFrame:
        return self.matches(expression).agg(F.count(F.lit(1)).alias("n"))

    def message(self, key) -> DataFrame:
        """One message; one that is hidden looks like one that is not there."""
        return display(self.messages.where(F.col("hash") == key))

    def thread(self, key) -> DataFrame:
        """The messages of the conversation that a message is in, oldest first; none where it has no conversation."""
        own = self.messages.where((F.col("hash") == key) & (F.col("thread") != "")).select("thread").distinct()
        return display(self.messages.join(own, "thread", "left_semi").orderBy(F.col("date_text").asc_nulls_first(), "hash"))

    def places(self, key) -> DataFrame:
        return self.locations.where(F.col("hash") == key).orderBy("account", "folder")

    def folders(self) -> DataFrame:
        """Places in each folder."""
        return self.locations.groupBy("account", "folder").agg(F.count(F.lit(1)).alias("n")).orderBy("account", "folder")

    def folder_tree(self) -> DataFrame:
        """Folders, accounts and the whole in one pass: nulls stand for all."""
        return self.locations.rollup("account", "folder").agg(F.count(F.lit(1)).alias("n"))

    def account_totals(self) -> DataFrame:
        """Different messages in each account."""
        return self.locations.groupBy("account").agg(F.countDistinct("hash").alias("n"))

    def statistics(self) -> DataFrame:
        """One row: mails, attachments, places, bytes."""
        mails = self.messages.agg(F.count(F.lit(1)).alias("mails"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
        one = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
        return mails.crossJoin(one(self.attachments, "attachments")).crossJoin(one(self.locations, "places"))  # rows of one

    def max_uid(self) -> DataFrame:
        return self.locations.groupBy("account", "folder").agg(F.coalesce(F.max("uid"), F.lit(0)).cast("long").alias("max_uid"))

    def first_places(self) -> DataFrame:
        """One place for each message: the first by account and folder."""
        return self.locations.groupBy("hash").agg(F.min(F.struct("account", "folder")).alias("p")).select("hash", "p.account", "p.folder")

    def only_in(self, account: str) -> DataFrame:
        """Messages that lie in this account and nowhere else."""
        return self.locations.groupBy("hash").agg(F.bool_and(F.col("account") == account).alias("only")).where("only").select("hash")

    def rename_folder(self, account: str, old: str, new: str) -> Archive:
        """Places of a folder under its new name; where both names had a message, the renamed place stays."""
        moved = (F.col("account") == account) & (F.col("folder") == old)
        rows = self.locations.withColumn("moved", moved).withColumn("folder", F.when(moved, F.lit(new)).otherwise(F.col("folder")))
        values = [c for c in rows.columns if c not in ("hash", "account", "folder", "moved")]
        best = rows.groupBy("hash", "account", "folder").agg(F.max_by(F.struct(*values), F.col("moved").cast("int")).alias("v"))
        return replace(self, locations=best.select("hash", "account", "folder", "v.*"))


def display(hits: DataFrame) -> DataFrame:
    """Fields with what is shown where they are empty."""
    shown = {"subject": "(ohne Betreff)", "category": "unbestimmt"}
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in shown.items()}
    fill |= {c: F.coalesce(F.col(c), F.lit("")) for c in ("from_name", "from_addr", "date_text")}
    return hits.withColumns({c: v for c, v in fill.items() if c in hits.columns})


def sender_display() -> Column:
    return F.when(F.col("from_name") == "", F.col("from_addr")).when(F.col("from_addr") == "", F.col("from_name")).otherwise(F.concat("from_name", F.lit(" <"), "from_addr", F.lit(">")))


_COMPARE = {"=": lambda c, v: c == v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "starts": lambda c, v: F.like(c, F.concat(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("%")))}


def compare(p: T.Compare) -> Column:
    column = F.col(p.column)
    test = column.between(p.value, p.high) if p.op == "between" else _COMPARE[p.op](column, F.lit(p.value))
    return ~test if p.negated else test


def text_test(p) -> Column:
    """A test on folded text columns. Spellings are alternatives; a phrase does not run over two columns."""
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    if isinstance(p, T.Free):
        test = any_of(has_phrase(fold(F.col(c)), v) for c in TEXT_COLUMNS for v in spellings(p.value))
    elif isinstance(p, T.Part):
        test = any_of(has_part(fold(F.col(p.column)), v) for v in spellings(p.value))
    else:
        test = any_of(has_phrase(fold(F.col(p.column)), v) for v in spellings(p.value))
    return ~test if p.negated else test


def exists_rows(archive: Archive, p: T.Exists) -> DataFrame:
    rows = getattr(archive, p.table)
    if p.kind:
        rows = rows.where(F.col("kind") == p.kind)
    if p.how == "equal":
        rows = rows.where(F.col(p.column) == p.value)
    elif p.how == "like":
        rows = rows.where(ascii_lower(F.col(p.column)).like(like_pattern(p.value.translate({i: i + 32 for i in range(65, 91)}))))
    else:
        rows = rows.where(ascii_lower(F.col(p.column)).rlike(glob_pattern(p.value)))
    return rows.select("hash")


def compile_terms(archive: Archive, predicates: list) -> DataFrame:
    """All predicates hold: comparisons first, then words and pieces of words by their indexes, or one pass over the texts where there are none, then semi and anti joins."""
    hits = archive.messages
    for p in predicates:
        if isinstance(p, T.Compare):
            hits = hits.where(compare(p))
    by_word = [p for p in predicates if isinstance(p, (T.Free, T.Phrase))] if archive.index else []
    for p in by_word:
        found = archive.index.find(p.value, None if isinstance(p, T.Free) else (p.column,))
        hits = hits.join(found, "hash", "left_anti" if p.negated else "left_semi")
    by_piece = [p for p in predicates if isinstance(p, T.Part) and archive.pieces.answers(p.value, p.column)] if archive.pieces else []
    for p in by_piece:
        hits = hits.join(archive.pieces.find(p.value, p.column), "hash", "left_anti" if p.negated else "left_semi")
    tests = [text_test(p) for p in predicates if isinstance(p, (T.Free, T.Part, T.Phrase)) and p not in by_word and p not in by_piece]
    if tests:
        hits = hits.join(archive.texts.where(reduce(lambda a, b: a & b, tests)).select("hash"), "hash", "left_semi")
    for p in predicates:
        if isinstance(p, T.Exists):
            hits = hits.join(exists_rows(archive, p), "hash", "left_anti" if p.negated else "left_semi")
    return hits
