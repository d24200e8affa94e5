"""Upkeep: backups, statistics of runs, reports, reviews, searches that are kept."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from epistola.lang import terms
from epistola.operators import journal, postings
from epistola.operators.archive import TEXT_COLUMNS, Archive
from epistola.streaming import ingest


def merge(spark: SparkSession, other: str, root: str, captured: str, rules: tuple = ()) -> dict[str, int]:
    """Takes over what another archive holds, from its store and the places its journal tells, and this one lacks.

    A merge that is broken off and done again goes on: it is the one batch of a stream named by the other archive's path and last line.
    """
    entries = journal.parsed(journal.read(spark, f"{other}/journal"))
    places = journal.locations(entries).join(journal.live(entries).select("hash"), "hash", "left_semi")
    rows = ingest.load(spark, other, "store").select("hash", "raw").join(places, "hash")
    return ingest.add_batch(rows.select("account", "folder", "uid", F.lit("").alias("flags"), "raw"), root, captured, rules, 0, f"merge {other} {(journal.last_entry(f'{other}/journal') or {}).get('self', '')}")


def to_remove(backups: DataFrame, keep: int, by: str = "account") -> DataFrame:
    """Backups (name, modified) beyond the `keep` newest of each group; of equal times the later name is newer."""
    w = Window.partitionBy(by).orderBy(F.desc("modified"), F.desc("name"))
    return backups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > max(1, keep)).drop("rank")


def merged_statistics(runs: DataFrame, sums: list[str], counters: str) -> DataFrame:
    """One row of many runs: whole numbers are summed, and maps of counters key by key, in partial sums."""
    whole = runs.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums])
    keys = runs.select(F.explode(counters).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))  # one row a counter
    return whole.crossJoin(keys.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(counters)))  # one row each


def attachment_kinds(attachments: DataFrame) -> DataFrame:
    """How many attachments were read in which way."""
    return attachments.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def disk_usage(store: DataFrame, by: str = "bucket") -> DataFrame:
    """Bytes and payloads of each month, from sizes that are kept beside the payloads."""
    return store.groupBy(by).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))


def restore_report(chosen: DataFrame, written: DataFrame) -> DataFrame:
    """folder, written, skipped, several and without_id of what was chosen (hash, folder, message_id) and written (hash, folder): several are messages with more than one place."""
    places = chosen.groupBy("hash").agg(F.count(F.lit(1)).alias("places"))
    rows = chosen.join(written.select("hash", "folder", F.lit(True).alias("done")).distinct(), ["hash", "folder"], "left").join(places, "hash")
    done = F.coalesce("done", F.lit(False))
    return rows.groupBy("folder").agg(F.count_if(done).alias("written"), F.count_if(~done).alias("skipped"), F.count_if(F.col("places") > 1).alias("several"), F.count_if(F.coalesce("message_id", F.lit("")) == "").alias("without_id"))


def review_due(last_year: Column, today: Column, month: int = 1, day: int = 15) -> Column:
    """Whether the yearly question about expired deadlines is due: from a day of the year on, once a year."""
    return (today >= F.make_date(F.year(today), F.lit(month), F.lit(day))) & (last_year.isNull() | (last_year < F.year(today)))


def cut_off(today: Column, days: Column) -> Column:
    """The day that is so many days ago."""
    return F.date_sub(today, days)


def stored_path(digest: Column, bucket: Column) -> Column:
    """Where a payload lies; anything but a hash and a month raises."""
    good = digest.rlike("^[0-9a-f]{64}$") & bucket.rlike(r"^\d{4}/\d{2}$")
    return F.when(good, F.concat_ws("/", bucket, F.substring(digest, 1, 2), digest)).otherwise(F.raise_error(F.concat(F.lit("no payload: "), F.coalesce(digest, F.lit("null")))))


def empty_alarm(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: whether nothing can be found though the journal tells of more than its first line."""
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    return n(messages, "messages").crossJoin(n(entries, "entries")).select("messages", "entries", ((F.col("messages") == 0) & (F.col("entries") > 1)).alias("alarm"))  # rows of one


def recent(searches: DataFrame, most: int = 10) -> DataFrame:
    """user, rank and expression of the last searches (user, at, expression): of what was typed bit by bit only the longest is kept, and each once.

    A search that goes on from the one before, or back, takes its place. Rows pass in order; what is held is a user's list.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []

        def told() -> pd.DataFrame:
            return pd.DataFrame({"user": [now] * len(kept), "rank": range(1, len(kept) + 1), "expression": kept})

        for batch in batches:
            for user, asked in zip(batch["user"], batch["expression"]):
                if user != now:
                    if kept:
                        yield told()
                    now, kept = user, []
                asked = (asked or "").strip()
                if asked:
                    kept = [x for x in kept if x != asked]
                    if kept and (kept[0].startswith(asked) or asked.startswith(kept[0])):
                        kept = kept[1:]
                    kept = [asked, *kept[: most - 1]]
        if kept:
            yield told()

    parts = int(searches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = searches.select(F.col("user").cast("string").alias("user"), "at", "expression").repartition(parts, "user").sortWithinPartitions("user", "at", "expression")
    return rows.mapInPandas(fold, "user string, rank int, expression string")


#: Longest name of a search, a fixed value.
NAME_MOST = 60


def keep_search(saved: list[dict], name: str, expression: str, at: int | None = None) -> list[dict]:
    """The saved searches with one more, or with that at a place changed; a name that is empty, too long or taken, or an expression that cannot be understood, raises."""
    name = " ".join(name.split())
    if not 0 < len(name) <= NAME_MOST:
        raise ValueError(f"a name has 1 to {NAME_MOST} letters")
    if any(s["name"].casefold() == name.casefold() for i, s in enumerate(saved) if i != at):
        raise ValueError(f"the name is taken: {name}")
    if not terms.parse(expression):
        raise ValueError("nothing is asked for")
    made = {"name": name, "expression": expression.strip()}
    return [*saved, made] if at is None else [made if i == at else s for i, s in enumerate(saved)]


def counts_of_searches(archive: Archive, saved: list[dict]) -> DataFrame:
    """name and n of each saved search, in order."""
    rows = [archive.matches(s["expression"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("place"), F.lit(s["name"]).alias("name"), "n") for i, s in enumerate(saved)]
    return reduce(DataFrame.unionAll, rows).orderBy("place").select("name", "n")


def with_recognised(texts: DataFrame, recognised: DataFrame) -> DataFrame:
    """Texts with what was recognised in attachments (hash, filename, text) behind what they had; nothing is replaced."""
    more = recognised.where("trim(text) <> ''").groupBy("hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("filename", "text"))), lambda x: x["text"]), "\n").alias("more"))
    rows = texts.join(more, "hash", "left")
    joined = F.concat_ws("\n", F.nullif(F.coalesce("attachment_text", F.lit("")), F.lit("")), "more")
    return rows.withColumn("attachment_text", F.when(F.col("more").isNull(), F.col("attachment_text")).otherwise(joined)).select(*texts.columns)


def index_recognised(texts: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds words of texts that changed to a word index; those they had before may be there twice, which a search does not show."""
    postings.build(texts, path, TEXT_COLUMNS, buckets)


def accounts(locations: DataFrame) -> DataFrame:
    """Names of accounts, whatever their case, in order."""
    return locations.select("account").distinct().orderBy(F.lower("account"), "account")


def notes_of_messages(notes: DataFrame, messages: DataFrame) -> DataFrame:
    """Notes on recognised attachments with the subject, sender and date of their message; those of deleted messages are left out."""
    return notes.join(messages.select("hash", "subject", "from_addr", "date_text"), "hash")


def to_retry(notes: DataFrame, failed: str = "fehler") -> DataFrame:
    """Notes without those of failures, so that these attachments are taken up again."""
    return notes.where(F.col("state").isNull() | (F.col("state") != failed))
