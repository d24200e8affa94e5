"""Ingest as a stream: every batch is parsed once, only what is new is appended, and each new place gets its line in the journal."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from epistola import schemas
from epistola.functions import mail
from epistola.operators import journal, packed, pieces, policy, postings, runs
from epistola.operators.archive import TEXT_COLUMNS, Archive

KEYS = {"messages": ["hash"], "recipients": ["hash", "addr", "kind"], "locations": ["hash", "account", "folder"], "attachments": ["hash"], "texts": ["hash"], "store": ["hash"]}
SCHEMAS = {**schemas.TABLES, "store": schemas.STORE, "quarantine": schemas.QUARANTINE, "words": postings.SCHEMA.format(hash="string"), "pieces": pieces.SCHEMA.format(hash="string"), "piece_counts": pieces.COUNTS, "gone": schemas.GONE, "filed": schemas.FILED, "recognised": schemas.RECOGNISED, "notes": schemas.NOTES, "claims": schemas.CLAIMS}
#: Tables of packed rows, by what a row has a key of.
PACKED = {"words": "token", "pieces": "piece"}


def raw(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a table's runs, those that count as deleted too; empty where nothing was written yet. What is there and cannot be read raises."""
    names = [x.split()[0] for x in SCHEMAS[name].split(", ")]
    found = runs.read(spark, root, name, packed.stored(PACKED[name], "string") if name in PACKED else SCHEMAS[name])
    if found is not None:
        return (packed.unpack(found, PACKED[name]) if name in PACKED else found).select(*names)
    if not runs.is_new(spark, root, name):
        raise ValueError(f"{root}/{name} holds files that are no runs: make the archive anew with rebuild")
    return spark.createDataFrame([], SCHEMAS[name])


def gone(spark: SparkSession, root: str) -> DataFrame | None:
    """hash and seq of deletions whose rows may still be there; None without any."""
    return raw(spark, root, "gone") if runs.paths(root, "gone") else None


def kept(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's rows without what was deleted, as they were written."""
    rows, out = raw(spark, root, name), gone(spark, root)
    if out is not None and "hash" in rows.columns and name not in ("gone", "filed"):
        rows = rows.join(out.select("hash"), "hash", "left_anti")
    return rows.select(*[x.split()[0] for x in SCHEMAS[name].split(", ")])


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the archive as it is now: without what was deleted, messages in their last category, and texts with what was recognised."""
    rows = kept(spark, root, name)
    if name == "texts" and runs.paths(root, "notes"):
        rows = heard(rows, load(spark, root, "notes"), load(spark, root, "recognised"))
    if name == "messages" and runs.paths(root, "filed"):
        rows = filed(rows, raw(spark, root, "filed"))
    return rows.select(*[x.split()[0] for x in SCHEMAS[name].split(", ")])


def filed(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """Messages in the category of their last change."""
    last = changes.groupBy("hash").agg(F.max_by("category", "seq").alias("_now"))
    return messages.join(last, "hash", "left").withColumn("category", F.coalesce("_now", "category")).select(*messages.columns)


def settled(notes: DataFrame) -> DataFrame:
    """The last note of each place, but those that were taken back."""
    values = [c for c in notes.columns if c not in ("hash", "filename")]
    return notes.groupBy("hash", "filename").agg(F.max_by(F.struct(*values), "turn").alias("n")).select("hash", "filename", "n.*").where("state <> 'offen'")


def readings(recognised: DataFrame) -> DataFrame:
    """fingerprint, text and pages of what was recognised, one reading for each payload."""
    return recognised.where("problem is null").groupBy("fingerprint").agg(F.min_by(F.struct("text", "pages"), "asker").alias("r")).select("fingerprint", "r.text", "r.pages")


def heard_of(notes: DataFrame, recognised: DataFrame) -> DataFrame:
    """hash and more: what was recognised in a mail's attachments, in the order of the runs that noted it, and of names."""
    rows = notes.where("state = 'erledigt'").select("hash", "filename", "fingerprint", "turn").join(readings(recognised), "fingerprint")
    # Attachments of one mail.
    parts = F.array_sort(F.collect_list(F.struct("turn", "filename", "text")))
    return rows.groupBy("hash").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["filename"], F.lit("\n"), x["text"])), "\n").alias("more"))


def heard(texts: DataFrame, notes: DataFrame, recognised: DataFrame) -> DataFrame:
    """Texts with what was recognised behind what their attachments had."""
    more = heard_of(settled(notes), recognised)
    joined = F.concat_ws("\n", F.nullif(F.coalesce("attachment_text", F.lit("")), F.lit("")), "more")
    return texts.join(more, "hash", "left").withColumn("attachment_text", F.when(F.col("more").isNull(), F.col("attachment_text")).otherwise(joined)).select(*texts.columns)


def archive(spark: SparkSession, root: str) -> Archive:
    """The archive as it is now, with its indexes."""
    index = postings.Postings(load(spark, root, "words")) if runs.paths(root, "words") else None
    parts = pieces.Pieces(load(spark, root, "pieces"), load(spark, root, "piece_counts")) if runs.paths(root, "pieces") else None
    return Archive(**{name: load(spark, root, name) for name in schemas.TABLES}, index=index, pieces=parts)


#: What rows of a table lie in folders by; the rest by the year of their message.
FOLDERS = {"messages": "year", "words": "bucket", "pieces": "bucket"}


def save(rows: DataFrame, root: str, name: str) -> None:
    """Appends rows as a run, below a folder for each year: messages by their column `year`, so that a condition on it skips the other years' files, and the rest by `part`."""
    runs.append(rows.sparkSession, root, name, lambda path: rows.write.partitionBy(FOLDERS.get(name, "part")).parquet(path))


#: Characters of texts that a task packs, about, in words and in pieces; buckets of an index.
TASK_CHARS, PIECE_CHARS, BUCKETS = 1 << 24, 1 << 20, 64


def save_indexes(texts: DataFrame, root: str) -> None:
    """Words and pieces of texts as a run each, in as many tasks as their length asks for."""
    length = lambda columns: F.sum(sum((F.length(F.coalesce(F.col(c), F.lit(""))).cast("long") for c in columns), F.lit(0)))
    spark, (words, parts) = texts.sparkSession, texts.agg(length(TEXT_COLUMNS), length(pieces.COLUMNS)).first()
    runs.append(spark, root, "words", lambda path: postings.build(texts.coalesce(1 + (words or 0) // TASK_CHARS), path, TEXT_COLUMNS, BUCKETS))

    def write(path: str) -> None:
        pieces.build(texts, path, pieces.COLUMNS, BUCKETS, 1 + (parts or 0) // PIECE_CHARS)
        # Counts are told first: without them a piece is thought to be nowhere.
        runs.append(spark, root, "piece_counts", lambda to: pieces.count(spark.read.schema(packed.stored("piece", "string")).parquet(path), to))

    runs.append(spark, root, "pieces", write)


def part_of(bucket) -> object:
    """The year of a month's bucket, 0 without one."""
    return F.substring(bucket, 1, 4).cast("int")


#: Keys at most that all tasks read; some 250 MB.
MOST = 2_000_000


def read_by_all(keys: DataFrame) -> DataFrame:
    """Keys that are joined where the other rows lie if they are not more than MOST, so that those are not dealt out."""
    return F.broadcast(keys) if keys.count() <= MOST else keys


def lacking(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among some, which are few or none in most batches; long rows are not dealt out then."""
    keys = keys.distinct()
    return rows if keys.isEmpty() else rows.join(read_by_all(keys), keys.columns, "left_anti")


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Parsed rows, written once and read as often as needed, each time the columns that are asked for: texts are not held in memory, nor as they are on local disks. `row` numbers them."""
    made = mail.parse(rows).withColumns({"row": F.monotonically_increasing_id(), "part": part_of("bucket")})
    made.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def one_each(good: DataFrame) -> DataFrame:
    """The first row of each message."""
    first = good.groupBy("hash").agg(F.min("row").alias("first"))
    return lacking(good, good.select("hash", "row").join(first, "hash").where("row <> first").select("row"))


def add_batch(batch: DataFrame, root: str, captured: str, rules: Sequence[policy.Rule] = (), batch_id: int | None = None, stream: str = "") -> dict[str, int]:
    """Appends what the archive lacks of a batch (account, folder, uid, flags, raw); returns how much of it was new.

    Payloads come first, then the journal, then the tables: what the journal tells of is there. Each new place is an `add`
    line; a new message that a rule puts into another category gets it, and a `classify` line by the rule. A message that
    cannot be read goes to `quarantine` with the reason, and the rest go on. Doing a batch again appends nothing. A batch with a
    number that failed half way tells what it has not told yet, place by place: numbers are those of its stream alone.
    """
    spark = batch.sparkSession
    after = journal.begin_batch(root, stream, batch_id) if batch_id is not None else None
    path = f"{root}/staged/{uuid.uuid4().hex}"
    try:
        counts = _add(spark, staged(batch, path), root, captured, rules, after, batch_id, stream)
    finally:
        runs.remove(spark, path)
    if batch_id is not None:
        journal.end_batch(root, stream, batch_id)
    return counts


def _add(spark: SparkSession, parsed: DataFrame, root: str, captured: str, rules: Sequence[policy.Rule], after: int | None, batch_id: int | None, stream: str) -> dict[str, int]:
    bad = parsed.where("problem is not null").select("account", "folder", "uid", "raw", "problem", F.lit(captured).alias("captured"), F.lit(0).alias("part")).join(load(spark, root, "quarantine").select("raw"), "raw", "left_anti").select(*[x.split()[0] for x in schemas.QUARANTINE.split(", ")], "part")
    good = parsed.where("problem is null")
    settle(spark, root, good)
    places = good.select("hash", "account", "folder").distinct().join(load(spark, root, "locations").select("hash", "account", "folder"), ["hash", "account", "folder"], "left_anti").persist()
    once = one_each(good)
    new = lacking(once, once.select("hash").join(load(spark, root, "store").select("hash"), "hash", "left_semi"))
    counts = {"rows": parsed.count(), "unreadable": parsed.where("problem is not null").count(), "messages": new.count(), "places": places.count()}
    if counts["unreadable"]:
        save(bad, root, "quarantine")
    save(new.select("hash", "bucket", "raw", "size", "part"), root, "store")

    first = good.groupBy("hash").agg(F.min_by(F.struct("account", "folder", "from_addr", "to"), F.struct("account", "folder")).alias("f"))
    made = first.select("hash", policy.classify(list(rules), F.col("f.folder"), F.lower(F.coalesce("f.from_addr", F.lit(""))), F.array_join("f.to", " ")).alias("made")) if rules else first.select("hash", F.lit(None).cast("string").alias("made"))
    ruled = made.where("made is not null and made <> 'unbestimmt'").join(load(spark, root, "messages").select("hash"), "hash", "left_anti").persist()
    tables = mail.tables(good, captured, once, ("part",))
    tables["messages"] = tables["messages"].join(ruled, "hash", "left").withColumn("category", F.coalesce("made", "category")).drop("made")

    about = good.groupBy("hash", "account", "folder").agg(F.min_by(F.struct("bucket", "uid", "size", "date_text", "subject", "from_addr", F.size("attached").alias("attachments")), F.coalesce("uid", F.lit(2**62))).alias("a"))
    adds = places.join(about, ["hash", "account", "folder"]).select("hash", F.lit(0).alias("turn"), F.struct(F.lit("add").alias("op"), "hash", "a.bucket", "account", "folder", "a.uid", "a.size", F.col("a.date_text").alias("date"), F.substring("a.subject", 1, 200).alias("subject"), F.col("a.from_addr").alias("sender"), "a.attachments", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("previous"), F.lit(None).cast("string").alias("actor")).alias("e"), "account", "folder")
    null = lambda t="string": F.lit(None).cast(t)
    by_rule = ruled.select("hash", F.lit(1).alias("turn"), F.struct(F.lit("classify").alias("op"), "hash", null().alias("bucket"), null().alias("account"), null().alias("folder"), null("long").alias("uid"), null("long").alias("size"), null().alias("date"), null().alias("subject"), null().alias("sender"), null("int").alias("attachments"), F.col("made").alias("category"), F.lit("unbestimmt").alias("previous"), F.lit("Regel").alias("actor")).alias("e"), null().alias("account"), null().alias("folder"))
    untold, name = adds.unionAll(by_rule), None
    if batch_id is not None:
        name = f"{stream}/{batch_id}"
        known = journal.told(spark, root, name, after).select(F.col("op").alias("o"), F.col("hash").alias("h"), F.col("account").alias("a"), F.col("folder").alias("f"))
        same = (F.col("e.op") == F.col("o")) & (F.col("hash") == F.col("h")) & F.col("account").eqNullSafe(F.col("a")) & F.col("folder").eqNullSafe(F.col("f"))
        untold = untold.join(known, same, "left_anti")
    journal.write(untold.orderBy("turn", "hash", "account", "folder").select("e.*"), root, captured, name)

    for name in ("locations", "recipients", "attachments", "texts", "messages"):  # the message last
        key = KEYS[name] if name in ("locations", "recipients") else ["hash"]
        rows = lacking(tables[name], tables[name].select(*key).join(kept(spark, root, name).select(*key), key, "left_semi"))
        if name == "texts":  # words before the texts they are of, so that none is left without
            save_indexes(rows, root)
        save(rows, root, name)
    for held in (places, ruled):
        held.unpersist()
    return counts


def settle(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Mail that was deleted and comes again: what is left of it has to go before, as its new rows have the same keys."""
    out = gone(spark, root)
    if out is not None and not rows.select("hash").join(out.select("hash"), "hash", "left_semi").isEmpty():
        from epistola.operators import lifecycle

        lifecycle.compact(spark, root, purge=True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The number that Spark gives a stream when its checkpoint is made; a new checkpoint in the same folder is another stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def ingest(rows: DataFrame, root: str, captured: str, checkpoint: str, rules: Sequence[policy.Rule] = ()) -> DataStreamWriter:
    """A stream of raw messages into an archive, until what is there now is read. Runs are merged between batches."""
    from epistola.operators import lifecycle

    def take(batch: DataFrame, n: int) -> None:
        add_batch(batch, root, captured, rules, n, stream_id(batch.sparkSession, checkpoint))
        lifecycle.compact(batch.sparkSession, root)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def rebuild(spark: SparkSession, root: str, to: str) -> None:
    """All tables anew from the store and the journal alone, below `to`: messages that are live, at the places the journal tells, as captured then and in their last category."""
    path = f"{to}/staged/{uuid.uuid4().hex}"
    try:
        _rebuild(spark, root, to, path)
    finally:
        runs.remove(spark, path)


def _rebuild(spark: SparkSession, root: str, to: str, path: str) -> None:
    entries = journal.parsed(journal.read(spark, f"{root}/journal")).drop("line")
    entries.write.parquet(f"{path}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{path}/entries")
    live = journal.live(entries).select("hash")
    places = journal.locations(entries).join(live, "hash", "left_semi")
    captured = entries.where("op = 'add' and hash is not null").groupBy("hash").agg(F.min_by("ts", "seq").alias("told"))
    store = load(spark, root, "store")
    once = one_each(staged(lacking(store, store.select("hash").join(places, "hash", "left_anti")).select("raw"), f"{path}/parsed"))
    rows = places.select("hash", "account", "folder", "uid", F.lit("").alias("flags")).join(once.select("hash", "part"), "hash")
    tables = mail.tables(rows, "", once, ("part",))
    own = tables["messages"].drop("captured").join(captured, "hash").join(journal.categories(entries).withColumnRenamed("category", "told_category"), "hash", "left")
    tables["messages"] = own.withColumns({"captured": F.col("told"), "category": F.coalesce("told_category", "category")}).select(*tables["messages"].columns)
    texts = tables["texts"]
    if runs.paths(root, "notes"):
        own = {"notes": kept(spark, root, "notes").join(live, "hash", "left_semi"), "recognised": kept(spark, root, "recognised")}
        for name, table in own.items():
            runs.append(spark, to, name, lambda path, table=table: table.write.parquet(path))
        texts = heard(texts, own["notes"], own["recognised"])
    save_indexes(texts, to)
    for name, table in tables.items():
        save(table, to, name)


def capture_rate(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Events of each kind in windows of time; with a watermark for streams."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Stretches of a user's events with pauses shorter than the gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str, watermark: str) -> DataFrame:
    """Late repeats of a key within the watermark are dropped."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
