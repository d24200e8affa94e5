"""Recognising text in scanned attachments: each payload is asked for once, whichever mails it hangs on and whichever run takes it.

A run chooses places (a mail and a name of an attachment) that have no note, takes fingerprints of their payloads, claims those
that nobody has read, asks, and notes the outcome at all places. What was recognised is kept by fingerprint, and stands behind
the text that a mail's attachments had; its words are added to the index.

Claims are runs of a small table, in the order in which they were committed: of two runs that want the same payload the earlier
one has it, until its claim is over. A run that died leaves a claim that expires, so nothing is lost and nothing waits for good.
"""

from __future__ import annotations

import email
import email.policy
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from epistola import schemas
from epistola.operators import audit, postings, runs
from epistola.streaming import ingest

#: States of a note, fixed values; a note that was taken back is open again.
DONE, FAILED, OPEN = "erledigt", "gescheitert", "offen"
#: What is told of an attachment that its mail does not have, and of one that nothing was recognised in.
NOT_FOUND, NO_TEXT = "attachment not found", "no text recognised"

#: Characters that answers are given back by, about: a frame for each of them would cost more than most of them.
FRAME_CHARS = 1 << 22

#: Returns text and number of pages of a payload; empty text or an exception is a failure.
Recogniser = Callable[[bytes], tuple[str, int]]


def payloads(raw: bytes, names: set[str]) -> dict[str, bytes]:
    """The first attachment of each name that a message has and that is asked for."""
    found: dict[str, bytes] = {}
    for part in email.message_from_bytes(raw, policy=email.policy.compat32).walk():
        name = "" if part.is_multipart() else str(part.get_filename() or "")
        if not part.is_multipart() and name in names and name not in found:
            found[name] = part.get_payload(decode=True) or b""
    return found


def fingerprints(store: DataFrame, places: DataFrame) -> DataFrame:
    """hash, filename and fingerprint of the payloads at places (hash, filename); null where a mail has no such attachment. Payloads stay in their tasks."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = [(h, n, hashlib.sha256(p).hexdigest()) for h, raw, names in zip(batch["hash"], batch["raw"], batch["names"]) for n, p in payloads(bytes(raw), set(names)).items()]
            yield pd.DataFrame(rows, columns=["hash", "filename", "fingerprint"])

    mails = places.groupBy("hash").agg(F.collect_set("filename").alias("names"))  # attachments of one mail
    taken = store.select("hash", "raw").join(mails, "hash").mapInPandas(take, "hash string, filename string, fingerprint string")
    return places.join(taken, ["hash", "filename"], "left")


def ask(store: DataFrame, asked: DataFrame, recognise: Recogniser, parts: int) -> DataFrame:
    """fingerprint, text, pages, problem, place_hash and place_name for each asked place (hash, filename, fingerprint). Mails are dealt out to `parts` tasks: the work is in the recognising."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["fingerprint", "text", "pages", "problem", "place_hash", "place_name"]
        for batch in batches:
            rows, chars = [], 0
            for h, raw, wanted in zip(batch["hash"], batch["raw"], batch["wanted"]):
                prints = {w["filename"]: w["fingerprint"] for w in wanted}
                for name, payload in payloads(bytes(raw), set(prints)).items():
                    text, pages, problem = "", 0, None
                    try:
                        text, pages = recognise(payload)
                        problem = None if text and text.strip() else NO_TEXT
                    except Exception as error:  # noqa: BLE001 - one payload must not hold up the others
                        problem = f"{type(error).__name__}: {error}"[:500]
                    rows.append((prints[name], None if problem else text, pages, problem, h, name))
                    chars += len(text or "")
                    if chars > FRAME_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    mails = asked.groupBy("hash").agg(F.collect_list(F.struct("filename", "fingerprint")).alias("wanted"))  # attachments of one mail
    rows = store.select("hash", "raw").join(mails, "hash").repartition(parts, "hash")
    return rows.mapInPandas(work, "fingerprint string, text string, pages int, problem string, place_hash string, place_name string")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """The last note of each place that is not open: hash, filename, fingerprint, state, reason, pages, chars and at."""
    return ingest.settled(ingest.load(spark, root, "notes"))


def queue(spark: SparkSession, root: str, least: int = audit.SCANNED_BYTES) -> DataFrame:
    """Places that wait, smallest first: attachments that seem to be scanned and have no note."""
    return audit.recognition_queue(ingest.load(spark, root, "attachments"), ingest.kept(spark, root, "texts"), notes(spark, root), least)


def _put(spark: SparkSession, root: str, table: str, name: str, rows: DataFrame, expected: int | None = None) -> None:
    """A run under a name that was chosen before."""
    rows.write.parquet(f"{root}/{table}/{name}")
    runs.commit(root, table, [{"run": name, "tier": 0, **runs.measured(spark, f"{root}/{table}/{name}")}], expected=expected)


def claim(spark: SparkSession, root: str, name: str, wanted: DataFrame, at: str, until: str) -> DataFrame:
    """Of the wanted fingerprints those that are this run's: no earlier claim that still holds has them, and nobody has read them."""
    _put(spark, root, "claims", name, wanted.select("fingerprint").distinct().withColumn("until", F.lit(until)))
    there = [r["run"] for r in runs.state(root, "claims")["runs"]]
    own, before = (runs.read(spark, root, "claims", schemas.CLAIMS, x) for x in ([name], there[: there.index(name)]))
    mine = own.select("fingerprint")
    if before is not None:
        mine = mine.join(before.where(F.col("until") > at).select("fingerprint"), "fingerprint", "left_anti")
    # Only now: what a run read that has let go of its claims is there.
    return mine.join(ingest.load(spark, root, "recognised").where("problem is null").select("fingerprint"), "fingerprint", "left_anti")


def release(spark: SparkSession, root: str, names: list[str]) -> None:
    """Takes claims back, and deletes what was taken back the time before."""
    old = runs.state(root, "claims")["retired"]
    runs.commit(root, "claims", [], names, retired=True)
    for x in old:
        runs.remove(spark, f"{root}/claims/{x}")


def run(spark: SparkSession, root: str, recognise: Recogniser, at: str, until: str, budget: int | None = None, least: int = audit.SCANNED_BYTES, parts: int = 64) -> dict[str, int]:
    """Asks for what waits, within a budget of bytes, smallest first; returns how many places are done, copies among them, failed, and pages of what was read with success.

    A payload that is known from any run is not asked for again. Where it fails, the place that was asked has a note of it, and
    another place of the same payload comes in the next run. Times are ISO texts of one zone: claims hold until `until`.
    """
    name, work = runs.new_run(), f"{root}/log/recognise-{uuid.uuid4().hex}"
    store = ingest.load(spark, root, "store")
    wanted = queue(spark, root, least)
    wanted = (wanted if budget is None else audit.within_budget(wanted, budget)).select("hash", "filename").distinct()
    fingerprints(store, wanted).write.parquet(f"{work}/places")
    places = spark.read.schema("hash string, filename string, fingerprint string").parquet(f"{work}/places")
    if places.isEmpty():
        runs.remove(spark, work)
        return {"done": 0, "copies": 0, "failed": 0, "pages": 0}
    mine = claim(spark, root, name, places.where("fingerprint is not null"), at, until)
    asked = places.join(mine, "fingerprint").groupBy("fingerprint").agg(F.min(F.struct("hash", "filename")).alias("p")).select("p.hash", "p.filename", "fingerprint")
    _put(spark, root, "recognised", name, ask(store, asked, recognise, parts).withColumns({"asker": F.lit(name), "at": F.lit(at)}))
    counts = publish(spark, root, name, places, at)
    release(spark, root, [name])
    runs.remove(spark, work)
    return counts


def publish(spark: SparkSession, root: str, name: str, places: DataFrame, at: str) -> dict[str, int]:
    """Notes what is known at places, and puts its words into the index, before the notes that tell of them. Where another run's notes came between, it begins anew."""
    while True:
        version, new = runs.state(root, "notes")["version"], runs.new_run()
        made = outcomes(spark, root, name, places).withColumns({"at": F.lit(at), "turn": F.lit(version + 1).cast("long")}).persist()
        sums = made.agg(F.count_if(F.col("state") == DONE).alias("done"), F.count_if((F.col("state") == DONE) & ~F.col("asked")).alias("copies"), F.count_if(F.col("state") == FAILED).alias("failed"), F.coalesce(F.sum(F.when(F.col("asked") & (F.col("state") == DONE), F.col("pages"))), F.lit(0)).alias("pages"), F.coalesce(F.sum("chars"), F.lit(0)).alias("letters")).first().asDict()
        few = 1 + sums.pop("letters") // ingest.TASK_CHARS  # a task writes a file to each bucket
        if sums["done"]:
            runs.append(spark, root, "words", lambda path, done=made.where(F.col("state") == DONE): postings.write(new_words(spark, root, done).coalesce(few), path, ingest.BUCKETS))
        try:
            _put(spark, root, "notes", new, made.select(*[x.split()[0] for x in schemas.NOTES.split(", ")]), version)
            return sums
        except runs.Conflict:
            runs.remove(spark, f"{root}/notes/{new}")
        finally:
            made.unpersist()


def outcomes(spark: SparkSession, root: str, name: str, places: DataFrame) -> DataFrame:
    """hash, filename, fingerprint, state, reason, pages, chars and asked for places that can be noted now: mail that is there, and places that another run has not noted."""
    rows = places.join(ingest.kept(spark, root, "texts").select("hash"), "hash", "left_semi").join(notes(spark, root).select("hash", "filename"), ["hash", "filename"], "left_anti")
    heard = ingest.load(spark, root, "recognised")
    own = heard.where(F.col("asker") == name).select(F.col("place_hash").alias("hash"), F.col("place_name").alias("filename"), "problem", F.lit(True).alias("asked"), F.col("pages").alias("own_pages"))
    rows = rows.join(own, ["hash", "filename"], "left").join(ingest.readings(heard), "fingerprint", "left")
    asked, good = F.coalesce("asked", F.lit(False)), F.col("text").isNotNull()
    reason = F.when(F.col("fingerprint").isNull(), NOT_FOUND).when(good, None).otherwise(F.col("problem"))
    state = F.when(good, DONE).when(asked | F.col("fingerprint").isNull(), FAILED)
    return rows.select("hash", "filename", "fingerprint", state.alias("state"), reason.alias("reason"), F.coalesce("pages", "own_pages", F.lit(0)).alias("pages"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), asked.alias("asked")).where("state is not null")


def new_words(spark: SparkSession, root: str, done: DataFrame) -> DataFrame:
    """Words of what was recognised at new places, counted on from those that the mail's attachments had."""
    heard = ingest.load(spark, root, "recognised")
    own = done.select("hash").distinct()
    before = ingest.load(spark, root, "texts").join(own, "hash", "left_semi").select("hash", postings.count_words("attachment_text").alias("had"))
    more = ingest.heard_of(done, heard).select("hash", F.col("more").alias("attachment_text"))
    return postings.by_text(more, ("attachment_text",)).join(before, "hash").withColumn("first", F.col("had")).drop("had")


def retry_failed(spark: SparkSession, root: str, at: str) -> int:
    """Takes notes of failures back, so that these places come again; returns how many there were."""
    while True:
        version, new = runs.state(root, "notes")["version"], runs.new_run()
        rows = notes(spark, root).where(F.col("state") == FAILED).withColumns({"state": F.lit(OPEN), "at": F.lit(at), "turn": F.lit(version + 1).cast("long")})
        if rows.isEmpty():
            return 0
        try:
            _put(spark, root, "notes", new, rows.select(*[x.split()[0] for x in schemas.NOTES.split(", ")]), version)
            return spark.read.parquet(f"{root}/notes/{new}").count()
        except runs.Conflict:
            runs.remove(spark, f"{root}/notes/{new}")


def fill_lengths(notes: DataFrame, recognised: DataFrame) -> DataFrame:
    """Notes with the number of characters where it was not written down, from the text that is kept for their fingerprint."""
    lengths = ingest.readings(recognised).select("fingerprint", F.length("text").cast("long").alias("_chars"))
    return notes.join(lengths, "fingerprint", "left").withColumn("chars", F.coalesce("chars", "_chars")).select(*notes.columns)
