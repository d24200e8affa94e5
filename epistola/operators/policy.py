"""Retention, rules and classification as columns and filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from epistola.functions.text import glob_pattern

#: Years that a category is kept in each jurisdiction, fixed values; a category that is not named has no deadline.
YEARS = {
    "DE": {"handelsbrief": 6, "buchungsbeleg": 8, "unbestimmt": 8},
    "AT": {"handelsbrief": 7, "buchungsbeleg": 7, "unbestimmt": 7},
    "CH": {"handelsbrief": 10, "buchungsbeleg": 10, "unbestimmt": 10},
}
SUPERVISED = {"buchungsbeleg": 10, "unbestimmt": 10}
CATEGORIES = ("handelsbrief", "buchungsbeleg", "privat", "unbestimmt")


@dataclass(frozen=True)
class Policy:
    jurisdiction: str = "DE"
    supervised: bool = False
    business: bool = True

    def table(self) -> dict[str, int]:
        return YEARS[self.jurisdiction] | (SUPERVISED if self.supervised and self.jurisdiction == "DE" else {})

    def years(self, category: Column) -> Column:
        return reduce(lambda c, kv: c.when(category == kv[0], F.lit(kv[1])), self.table().items(), F.when(F.lit(False), F.lit(0)))

    def expires(self, category: Column, year: Column) -> Column:
        """The year at whose end the deadline passes; null without one."""
        return year + self.years(category)

    def is_locked(self, category: Column, year: Column, today_year: int) -> Column:
        """Whether a message must not be deleted yet. One without a date is locked; outside business nothing is."""
        if not self.business:
            return F.lit(False)
        return F.when(year.isNull(), F.lit(True)).otherwise(F.coalesce(self.expires(category, year) >= today_year, F.lit(False)))

    def due(self, messages: DataFrame, today_year: int) -> DataFrame:
        """Messages whose deadline has passed: a bound on the year for each category, so that old partitions alone are read."""
        tests = [(F.col("category") == c) & (F.col("year") <= today_year - n - 1) for c, n in self.table().items()]
        return messages.where((F.col("year") >= 1900) & reduce(lambda a, b: a | b, tests))

    def old(self, messages: DataFrame, today_year: int, years: int = 10) -> DataFrame:
        return messages.where(F.col("year") <= today_year - max(1, years))


def per_year(messages: DataFrame) -> DataFrame:
    """Messages of each year, ???? for those without a date."""
    return messages.groupBy(F.coalesce(F.substring("date_text", 1, 4), F.lit("????")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Rule:
    """A pattern of * ? [..] [!..] that the whole of a field has to match: ordner, von or an."""

    field: str
    pattern: str
    category: str
    active: bool = True


def classify(rules: list[Rule], folder: Column, sender: Column, recipients: Column) -> Column:
    """The category of the first active rule that matches; null if none does. An empty value matches nothing."""
    values = {"ordner": folder, "von": sender, "an": recipients}
    tests = []
    for r in rules:
        if r.active:
            value = F.lower(values[r.field])
            tests.append(F.when((value != "") & value.rlike(glob_pattern(r.pattern.strip().lower(), "!")), F.lit(r.category)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def reapply(messages: DataFrame, locations: DataFrame, rules: list[Rule]) -> DataFrame:
    """hash and category of messages that a rule gives another category: that of the first place, by account and folder, at which any matches. Recipients are not asked."""
    rows = locations.join(messages.select("hash", "from_addr", F.col("category").alias("now")), "hash")
    rows = rows.withColumn("made", classify(rules, F.col("folder"), F.col("from_addr"), F.lit(""))).where("made is not null")
    first = rows.groupBy("hash", "now").agg(F.min_by("made", F.struct("account", "folder")).alias("category"))
    return first.where("category <> now").select("hash", "category")


#: Folders that are not archived, fixed values. Case, blanks and signs do not count.
EXCLUDED = (
    "Trash", "Papierkorb", "Deleted Items", "Gelöschte Elemente", "Deleted Messages", "Gelöschte Objekte",
    "Junk", "Spam", "Junk E-Mail", "Junk-E-Mail", "Bulk Mail", "Werbung", "Unerwünschte E-Mail", "Drafts", "Entwürfe",
)


def is_excluded(folder: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether any part of a folder's path is one of the names, whatever its case, blanks and signs; ß counts as ss."""
    plain = lambda p: F.regexp_replace(F.replace(F.lower(p), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")
    known = sorted({"".join(c for c in n.casefold() if c.isalnum()) for n in names})
    return F.exists(F.split(folder, "/"), lambda p: plain(p).isin(*known))


def has_marker(subject: Column, markers: list[str]) -> Column:
    """Whether a subject begins with a marker, apart from case and blanks before it; ß counts as ss."""
    plain = F.replace(F.lower(F.ltrim(subject)), F.lit("ß"), F.lit("ss"))
    return reduce(lambda a, b: a | b, [plain.startswith(m.casefold()) for m in markers], F.lit(False))
