"""What happens to an archive after ingest: classifying, deleting behind a guard, sealing. Each is a line in the journal first."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from epistola.operators import commits, journal, packed, runs
from epistola.operators.policy import CATEGORIES, Policy, reapply
from epistola.streaming import ingest


def to_classify(messages: DataFrame, chosen: DataFrame, category: str) -> DataFrame:
    """hash, previous and category of the chosen messages that have another category; what is not in the archive is left out."""
    if category not in CATEGORIES:
        raise ValueError(f"not a category: {category}")
    rows = messages.join(chosen.select("hash").distinct(), "hash", "left_semi")
    previous = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("unbestimmt"))
    return rows.select("hash", previous.alias("previous"), F.lit(category).alias("category")).where(F.col("previous") != category)


def deletion(messages: DataFrame, chosen: DataFrame, policy: Policy, today_year: int) -> DataFrame:
    """hash, bucket and outcome of each chosen message: deleted, locked (its deadline runs, or has no date to run from), or unknown.

    There is no way past the lock; what is not business mail has to be classified as private first.
    """
    rows = chosen.select("hash").distinct().join(messages.select("hash", "bucket", "category", "year", F.lit(True).alias("here")), "hash", "left")
    locked = policy.is_locked(F.coalesce("category", F.lit("unbestimmt")), F.col("year"), today_year)
    return rows.select("hash", "bucket", F.when(F.col("here").isNull(), "unknown").when(locked, "locked").otherwise("deleted").alias("outcome"))


def _written(rows: DataFrame, root: str, name: str) -> str:
    """The rows as a table below log/: what is decided must not be worked out again when the tables it came from have changed."""
    path = f"log/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{path}")
    return path


def _open_operations(root: str) -> list[str]:
    where, base = commits.opened(f"{root}/log/open")
    return sorted(x.base_name for x in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.base_name.endswith(".json"))


def _begin(root: str, what: dict) -> tuple[str, dict]:
    """Notes an operation before its first step; returns its name, and it with the journal's end of now."""
    what = {**what, "segment": journal.end(root)}
    name = f"{what['segment']:09d}-{uuid.uuid4().hex}.json"
    commits.put(f"{root}/log/open/{name}", json.dumps(what).encode())
    return name, what


def _end(root: str, name: str) -> None:
    where, base = commits.opened(f"{root}/log/open")
    where.delete_file(f"{base}/{name}")


def resume(spark: SparkSession, root: str) -> int:
    """Finishes operations that were broken off, in the order of their beginning; returns how many there were. Each may be done again."""
    names = _open_operations(root)
    for name in names:
        what = commits.note(f"{root}/log/open/{name}")
        if what is not None:
            {"delete": _delete, "classify": _classify, "merge": _merge}[what["kind"]](spark, root, name, what)
    return len(names)


def _tell(spark: SparkSession, root: str, name: str, what: dict, lines: DataFrame, note: Callable[[DataFrame], DataFrame], table: str) -> None:
    """Lines of an operation that are not in the journal yet, then a row each of what they say, by their numbers, in a small table."""
    batch = f"{what['kind']}/{name}"
    known = journal.told(spark, root, batch, what["segment"]).select("hash")
    journal.write(lines.join(known, "hash", "left_anti").orderBy("hash"), root, what["ts"], batch)
    own = journal.parsed(journal.read(spark, f"{root}/journal", what["segment"])).where(F.col("batch") == batch)
    new = note(own).join(ingest.raw(spark, root, table).select("hash", "seq"), ["hash", "seq"], "left_anti")
    runs.append(spark, root, table, lambda path: new.coalesce(1).write.parquet(path))
    _end(root, name)


def classify(spark: SparkSession, root: str, chosen: DataFrame, category: str, ts: str, actor: str, note: str = "") -> DataFrame:
    """Puts the chosen messages (hash) into a category, with a line and a row for each that changes; returns hash and previous, so that it can be taken back."""
    resume(spark, root)
    rows = _written(to_classify(ingest.load(spark, root, "messages"), chosen, category), root, "classify")
    changed = spark.read.schema("hash string, previous string, category string").parquet(f"{root}/{rows}")
    if not changed.isEmpty():
        _classify(spark, root, *_begin(root, {"kind": "classify", "rows": rows, "ts": ts, "actor": actor, "note": note}))
    return changed.select("hash", "previous")


def _classify(spark: SparkSession, root: str, name: str, what: dict) -> None:
    changed = spark.read.schema("hash string, previous string, category string").parquet(f"{root}/{what['rows']}")
    lines = changed.select(F.lit("classify").alias("op"), "hash", "category", "previous", F.lit(what["actor"]).alias("actor"), F.lit(what["note"]).alias("note"))
    _tell(spark, root, name, what, lines, lambda own: own.select("hash", "category", "seq"), "filed")


def delete(spark: SparkSession, root: str, chosen: DataFrame, reason: str, ts: str, today_year: int, policy: Policy, actor: str, note: str = "") -> DataFrame:
    """Removes the chosen messages (hash) that are not locked, and leaves a line for each: that it was stays provable. Returns hash and outcome.

    A deletion writes its line and a row that every read leaves out by; no table is written anew. The bytes go when tables are
    compacted with `purge`, or when their runs are merged.
    """
    resume(spark, root)
    rows = _written(deletion(ingest.load(spark, root, "messages"), chosen, policy, today_year), root, "delete")
    outcomes = spark.read.schema("hash string, bucket string, outcome string").parquet(f"{root}/{rows}")
    if not outcomes.where("outcome = 'deleted'").isEmpty():
        _delete(spark, root, *_begin(root, {"kind": "delete", "rows": rows, "ts": ts, "actor": actor, "note": note, "reason": reason}))
    return outcomes.select("hash", "outcome")


def _delete(spark: SparkSession, root: str, name: str, what: dict) -> None:
    dead = spark.read.schema("hash string, bucket string, outcome string").parquet(f"{root}/{what['rows']}").where("outcome = 'deleted'")
    held = ingest.load(spark, root, "store").select("hash", F.lit(True).alias("held"))
    lines = dead.join(held, "hash", "left").select(F.lit("delete").alias("op"), "hash", "bucket", F.lit(what["reason"]).alias("reason"), F.lit(what["actor"]).alias("actor"), F.lit(what["note"]).alias("note"), F.coalesce("held", F.lit(False)).alias("file_existed"))
    _tell(spark, root, name, what, lines, lambda own: own.select("hash", "seq"), "gone")


NOTED = ("gone", "filed")
#: Tables that lie in no folders.
WHOLE = (*NOTED, "piece_counts", "notes", "recognised")
TABLES = ("words", "pieces", "texts", "recipients", "attachments", "locations", "store", "messages", "quarantine", "piece_counts", "notes", "recognised", *NOTED)


def compact(spark: SparkSession, root: str, purge: bool = False) -> dict[str, int]:
    """Merges runs: those of a tier that has runs.FAN of them, until none has. purge: also every run that holds what was deleted, so that its bytes are gone, and then the rows that told so. Returns how many merges each table had.

    Results before and after are the same. A merge that is broken off is finished or forgotten by the next call.
    """
    resume(spark, root)
    done = {}
    out = ingest.gone(spark, root)
    noted = {t: [r["run"] for r in runs.state(root, t)["runs"]] for t in NOTED}
    for table in TABLES:
        done[table] = 0
        if purge and table in NOTED:
            if noted[table]:  # all that these rows said is in the tables now
                runs.commit(root, table, [], noted[table])
            continue
        while chosen := runs.to_merge(runs.state(root, table)["runs"]):
            _start_merge(spark, root, table, [r["run"] for r in chosen[0]], chosen[1])
            done[table] += 1
        if purge:
            for r in runs.state(root, table)["runs"]:
                if _holds_noted(spark, root, table, r["run"], out):
                    _start_merge(spark, root, table, [r["run"]], r["tier"], purge=True)
                    done[table] += 1
    return done


def _run(spark: SparkSession, root: str, table: str, names: list[str]) -> DataFrame:
    if table in ingest.PACKED:
        return runs.read(spark, root, table, packed.stored(ingest.PACKED[table], "string"), names).drop("run")
    part = ingest.FOLDERS.get(table, "part")
    schema = ingest.SCHEMAS[table] + ("" if table in WHOLE or f"{part} int" in ingest.SCHEMAS[table].split(", ") else f", {part} int")
    return runs.read(spark, root, table, schema, names).drop("run")


def _holds_noted(spark: SparkSession, root: str, table: str, run: str, out: DataFrame | None) -> bool:
    if table in ("quarantine", "piece_counts"):
        return False
    if table == "recognised":
        rows = _run(spark, root, table, [run])
        return not rows.join(_in_use(spark, root), "fingerprint", "left_anti").isEmpty()
    rows = _run(spark, root, table, [run])
    rows = rows.select(F.explode("hashes").alias("hash")) if table in ingest.PACKED else rows.select("hash")
    changed = table == "messages" and runs.paths(root, "filed") and not rows.join(ingest.raw(spark, root, "filed").select("hash"), "hash", "left_semi").isEmpty()
    return bool(changed) or out is not None and not rows.join(ingest.read_by_all(out.select("hash")), "hash", "left_semi").isEmpty()


def _in_use(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints whose text a mail has, or that a run is at."""
    noted = ingest.load(spark, root, "notes").where("state = 'erledigt'").select("fingerprint")
    return noted.unionAll(ingest.load(spark, root, "claims").select("fingerprint")).distinct()


def _start_merge(spark: SparkSession, root: str, table: str, names: list[str], tier: int, purge: bool = False) -> None:
    _merge(spark, root, *_begin(root, {"kind": "merge", "table": table, "from": names, "to": runs.new_run(), "tier": tier, "purge": purge}))


def _merge(spark: SparkSession, root: str, name: str, what: dict) -> None:
    """Writes runs as one, in order, and puts it in their place; done again, it begins its run anew, or finds it in place."""
    table, names, to = what["table"], what["from"], f"{root}/{what['table']}/{what['to']}"
    gone = names if what.get("purge") else []  # a purge leaves nothing to readers that have just looked
    now = runs.state(root, table)
    if what["to"] not in {r["run"] for r in now["runs"]}:
        runs.remove(spark, to)
        rows, out, part = _run(spark, root, table, names), ingest.gone(spark, root), ingest.FOLDERS.get(table, "part")
        if table in NOTED:
            rows.distinct().coalesce(1).write.parquet(to)
        elif table == "piece_counts":
            rows.groupBy("piece").agg(F.sum("n").alias("n")).repartition(1).sortWithinPartitions("piece").write.parquet(to)
        elif table in ("notes", "recognised"):
            key = "hash" if table == "notes" else "fingerprint"
            if table == "recognised":
                rows = rows.join(_in_use(spark, root), key, "left_semi")
            elif out is not None:
                rows = rows.join(out.select("hash"), "hash", "left_anti")
            size = sum(r["bytes"] for r in now["runs"] if r["run"] in names)
            rows.repartition(max(1, -(-size // runs.MOST)), key).sortWithinPartitions(key).write.parquet(to)
        elif table in ingest.PACKED:
            key = ingest.PACKED[table]
            rows = rows if out is None else packed.without(rows, out, key)
            if len(names) > 1:
                rows = runs.dealt(rows, part, runs.bucket_bytes(spark, [f"{root}/{table}/{n}" for n in names], part), by_rows="hashes").sortWithinPartitions(part, key)
            packed.write(rows, to, ingest.BUCKETS)
        else:
            if out is not None and table != "quarantine":
                rows = ingest.lacking(rows, out.select("hash")).select(*rows.columns)
            if table == "messages" and runs.paths(root, "filed"):
                rows = ingest.filed(rows, ingest.raw(spark, root, "filed"))
            sizes = runs.bucket_bytes(spark, [f"{root}/{table}/{n}" for n in names], part)
            # What is left of a single run stays in the tasks that read it.
            made = rows if table == "quarantine" else (runs.dealt(rows, part, sizes) if len(names) > 1 else rows).sortWithinPartitions(part, "hash")
            made.write.partitionBy(part).parquet(to)
        old = now["retired"]
        try:
            runs.commit(root, table, [{"run": what["to"], "tier": what["tier"], **runs.measured(spark, to)}], names, retired=True)
        except runs.Conflict:  # another writer has merged them
            runs.remove(spark, to)
            old = gone = []
        for run in old:
            runs.remove(spark, f"{root}/{table}/{run}")
    for run in gone:
        runs.remove(spark, f"{root}/{table}/{run}")
    _end(root, name)


def apply_rules(spark: SparkSession, root: str, rules: list, ts: str) -> int:
    """Puts messages that are there already into the category of the first rule that matches; returns how many changed."""
    resume(spark, root)
    path = _written(reapply(ingest.load(spark, root, "messages"), ingest.load(spark, root, "locations"), rules), root, "rules")
    made = spark.read.schema("hash string, category string").parquet(f"{root}/{path}")
    return sum(classify(spark, root, made.where(F.col("category") == c), c, ts, "Regel").count() for c in CATEGORIES)


def seal(spark: SparkSession, root: str, ts: str) -> dict:
    """A line that holds how many lines there were and the hash of the last: later changes before it lie between two seals."""
    last = journal.last_entry(f"{root}/journal") or {}
    line = {"op": "seal", "count": last.get("seq", 0), "covers": last.get("self", journal.START)}
    journal.write(spark.createDataFrame([(line["op"], line["count"], line["covers"])], "op string, count long, covers string"), root, ts)
    return line


def seals(entries: DataFrame) -> DataFrame:
    """seq, ts, count, covers of each seal, and whether the line it covers is still as it was."""
    own = entries.where("op = 'seal'").select("seq", "ts", "count", "covers")
    before = entries.select(F.col("seq").alias("count"), F.col("self").alias("now"))
    return own.join(before, "count", "left").select("seq", "ts", "count", "covers", F.coalesce(F.col("now") == F.col("covers"), (F.col("count") == 0) & (F.col("covers") == journal.START)).alias("holds"))
