"""Store against journal, mailbox against archive, disclosures, restores and the queue of attachments to recognise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from epistola.operators import journal as J
from epistola.operators.archive import Archive


def store_against_journal(store: DataFrame, expected: DataFrame) -> DataFrame:
    """hash and state of each payload: there, missing or unexpected."""
    a, b = expected.select("hash", F.lit(True).alias("told")).distinct(), store.select("hash", F.lit(True).alias("held")).distinct()
    state = F.when(F.col("held").isNull(), "missing").when(F.col("told").isNull(), "unexpected").otherwise("there")
    return a.join(b, "hash", "full_outer").select("hash", state.alias("state"))


def describe_missing(missing: DataFrame, entries: DataFrame) -> DataFrame:
    """Missing hashes with what their first add entry told."""
    first = entries.where("op = 'add'").groupBy("hash").agg(F.min_by(F.struct("seq", "account", "folder", "ts"), "seq").alias("f"))
    return missing.select("hash").join(first, "hash", "left").select("hash", "f.*")


def damaged(store: DataFrame) -> DataFrame:
    """Payloads whose bytes no longer have their hash."""
    return store.where(F.sha2("raw", 256) != F.col("hash"))


def verify(store: DataFrame, journal: DataFrame) -> dict[str, DataFrame]:
    """Everything that is wrong: breaks of the chain, missing and unexpected payloads, adds without a hash."""
    entries = J.parsed(journal)
    states = store_against_journal(store, J.live(entries))
    return {"chain": J.verify(journal), "missing": describe_missing(states.where("state = 'missing'"), entries), "unexpected": states.where("state = 'unexpected'"), "incomplete": entries.where("op = 'add' and hash is null")}


def reconcile(server: DataFrame, archive: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """account, folder, present, missing, verdict: what of a mailbox the archive has.

    server and archive: account, folder, uid. state: account, folder, uidvalidity (as fetched) and server_validity; where
    they differ, or were never fetched, the folder's numbers say nothing and it is unclear.
    """
    side = lambda t, there: t.select("account", "folder", "uid", F.lit(there).alias("there"), F.lit(not there).alias("held"))
    # One table of both sides: rows of a number are brought together once, after partial sums.
    numbers = side(server, True).unionAll(side(archive, False)).groupBy("account", "folder", "uid").agg(F.bool_or("there").alias("there"), F.bool_or("held").alias("held")).where("there")
    sums = numbers.groupBy("account", "folder").agg(F.count_if("held").alias("present"), F.count_if(~F.col("held")).alias("missing"))
    clear = F.lit(True)
    if state is not None:
        sums = sums.join(state, ["account", "folder"], "left")
        clear = F.coalesce(F.col("uidvalidity") == F.col("server_validity"), F.lit(False))
    verdict = F.when(~clear, "unclear").when(F.col("missing") > 0, "missing").otherwise("all present")
    return sums.select("account", "folder", "present", "missing", verdict.alias("verdict"))


def overall(folders: DataFrame) -> DataFrame:
    """One row for the mailbox: it is safe only if every folder is clear and nothing is missing."""
    sums = folders.agg(F.coalesce(F.sum("present"), F.lit(0)).alias("present"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.coalesce(F.count_if(F.col("verdict") == "unclear"), F.lit(0)).alias("unclear"))
    verdict = F.when(F.col("unclear") > 0, "unclear").when(F.col("missing") > 0, "missing").when(F.col("present") == 0, "nothing that old").otherwise("all present")
    return sums.withColumn("verdict", verdict)


def disclosure(archive: Archive, address: str, in_text: bool = True) -> DataFrame:
    """hash and bucket (sender, recipient, text) of all that concerns a person: the first bucket that a message is found in."""
    asked = [f'von:"{address}"', f'an:"{address}"'] + ([f'"{address}"'] if in_text else [])
    found = [archive.matches(q).select("hash", F.lit(i).alias("rank")) for i, q in enumerate(asked)]
    union = reduce(DataFrame.unionByName, found).groupBy("hash").agg(F.min("rank").alias("rank"))
    return union.select("hash", F.element_at(F.array(*map(F.lit, ("sender", "recipient", "text"))), F.col("rank") + 1).alias("bucket"))


def missing_at_target(chosen: DataFrame, target: DataFrame) -> DataFrame:
    """Messages that a target folder lacks, by folder and Message-ID without brackets; those without an id are always written."""
    there = target.select("folder", plain_id(F.col("message_id")).alias("k")).distinct()
    rows = chosen.withColumn("k", F.nullif(plain_id(F.col("message_id")), F.lit("")))
    return rows.join(there, ["folder", "k"], "left_anti").drop("k")


def plain_id(message_id: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(message_id, F.lit(""))), "^<+|>+$", "")


#: When a PDF is thought to be scanned, fixed values.
SCANNED_BYTES, TEXT_LEAST, THIN = 100_000, 200, 50


def recognition_queue(attachments: DataFrame, texts: DataFrame, notes: DataFrame, least: int = SCANNED_BYTES) -> DataFrame:
    """PDF attachments of more bytes than `least` that seem to be scanned and have no note yet, smallest first."""
    lengths = texts.select("hash", F.length(F.coalesce("attachment_text", F.lit(""))).alias("chars"))
    rows = attachments.where((F.col("extension") == "pdf") & (F.col("size") > least) & (F.col("text_chars") <= 0)).join(lengths, "hash", "left")
    rows = rows.where((F.col("text_chars") == 0) | (F.coalesce("chars", F.lit(0)) < TEXT_LEAST)).drop("chars")
    return rows.join(notes.select("hash", "filename"), ["hash", "filename"], "left_anti").orderBy("size", "hash", "filename")


def within_budget(queue: DataFrame, budget: int, buckets: int = 64) -> DataFrame:
    """The smallest attachments whose sizes together stay within a budget.

    Sizes are summed by quantiles first; rows are numbered within a quantile, so no task sorts the whole queue.
    """
    bounds = sorted(set(queue.agg(F.percentile_approx("size", [i / buckets for i in range(1, buckets)])).first()[0] or []))
    at = reduce(lambda a, b: a + b, [F.when(F.col("size") > b, 1).otherwise(0) for b in bounds], F.lit(0))
    rows = queue.withColumn("q", at)
    # As many rows as quantiles.
    sums = rows.groupBy("q").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("size").over(Window.partitionBy("q").orderBy("size", "hash", "filename").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", own).join(F.broadcast(sums.select("q", "before")), "q").where(F.col("own") + F.col("before") <= budget).drop("q", "own", "before")


def thin(notes: DataFrame) -> DataFrame:
    """Recognised attachments with few characters a page."""
    return notes.where("pages > 0").withColumn("per_page", F.col("chars") / F.col("pages")).where(F.col("per_page") < THIN)


def recognise_once(attachments: DataFrame, payload: str = "payload") -> DataFrame:
    """One attachment for each different payload, with all the places its text goes to."""
    return attachments.groupBy(F.sha2(payload, 256).alias("fingerprint")).agg(F.min(F.struct("hash", "filename")).alias("asked"), F.count(F.lit(1)).alias("places"))


def common_domain(addresses: DataFrame, column: str = "address", least: int = 3) -> DataFrame:
    """The most frequent domain, the first by name among equals, if it is frequent enough and names stay different without it."""
    parts = addresses.select(F.lower(F.substring_index(column, "@", 1)).alias("name"), F.lower(F.substring_index(column, "@", -1)).alias("domain")).where(F.instr(column, "@") > 0)
    return parts.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names")).where((F.col("n") >= least) & (F.col("n") == F.col("names"))).orderBy(F.desc("n"), "domain").limit(1).select("domain", "n")
