"""Writers that give messages back as files: Maildir, single files, MBOX.

A job writes its files into a folder of its own, with a list for each task of what is in them. When all tasks have ended the job
is staged, and its files are moved to their places, by tasks too; then the lists are put beside the mail. A job that is given
up before takes its folder away; one that is lost after is ended by the next run. A run reads the lists and writes what is not
there yet.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from epistola.functions import formats

#: The folder of lists, the front of a job's folder, and what is told of a file's message.
LISTS, STAGE, TOLD = "_restored", "_stage-", "hash string, path string"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    where, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return where, base.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """The list of what a task has written, under the name that it has till the job ends."""

    pending: str
    final: str


class MailWriter(DataSourceWriter):
    """Rows (hash, path, raw): a file each, or one of many messages where several rows in a row have one path that ends in .mbox."""

    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, rows: Iterator) -> Written:
        where, base = _opened(f"{self.root.rstrip('/')}/{STAGE}{self.job}")
        told: list[str] = []
        for path, group in itertools.groupby(rows, key=lambda r: r["path"]):
            for same in [group] if path.endswith(".mbox") else ([r] for r in group):
                where.create_dir(f"{base}/files/{path}".rpartition("/")[0], recursive=True)
                temporary = f"{base}/files/{path}.{uuid.uuid4().hex}"  # a task may be run twice
                with where.open_output_stream(temporary, compression=None) as out:
                    for r in same:
                        out.write(_framed(bytes(r["raw"])) if path.endswith(".mbox") else bytes(r["raw"]))
                        told.append(json.dumps({"hash": r["hash"], "path": path}))
                where.move(temporary, f"{base}/files/{path}")
        where.create_dir(f"{base}/lists", recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.log"
        with where.open_output_stream(f"{base}/lists/.{name}", compression=None) as out:
            out.write("".join(x + "\n" for x in told).encode())
        return Written(f"{base}/lists/.{name}", f"{base}/lists/{name}")

    def commit(self, messages: list) -> None:
        """One list for each task, and the mark that all are there."""
        where, base = _opened(f"{self.root.rstrip('/')}/{STAGE}{self.job}")
        for m in messages:
            if m is not None:
                where.move(m.pending, m.final)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/staged", compression=None) as out:
            out.write(b"")

    def abort(self, messages: list) -> None:
        where, base = _opened(f"{self.root.rstrip('/')}/{STAGE}{self.job}")
        if where.get_file_info(base).type == fs.FileType.Directory:
            where.delete_dir(base)


def _publish(spark: SparkSession, root: str, job: str) -> None:
    """Moves a staged job's files to their places, then its lists; done again, it moves what is left."""
    where, base = _opened(root)
    stage = f"{base}/{STAGE}{job}"
    lists = [x.base_name for x in where.get_file_info(fs.FileSelector(f"{stage}/lists", allow_not_found=True)) if not x.base_name.startswith(".")]

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = _opened(root)
        for batch in batches:
            for path in batch["path"]:
                if own.get_file_info(f"{stage}/files/{path}").is_file:
                    own.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                    own.move(f"{stage}/files/{path}", f"{base}/{path}")
            yield batch

    if lists:
        spark.read.schema(TOLD).json(f"{root.rstrip('/')}/{STAGE}{job}/lists").select("path").distinct().mapInPandas(move, "path string").count()
        where.create_dir(f"{base}/{LISTS}", recursive=True)
        for name in lists:
            where.move(f"{stage}/lists/{name}", f"{base}/{LISTS}/{name}")
    where.delete_dir(stage)


def _settle(spark: SparkSession, root: str) -> None:
    """Ends jobs that were lost when they were staged, and takes away what is left of others."""
    where, base = _opened(root)
    for x in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if x.base_name.startswith(STAGE):
            if where.get_file_info(f"{x.path}/staged").is_file:
                _publish(spark, root, x.base_name[len(STAGE) :])
            else:
                where.delete_dir(x.path)


def _save(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (hash, path, raw) as a job; returns what its lists tell."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(MailFiles)
    try:
        rows.select("hash", "path", "raw").write.format("mailfiles").mode("append").option("job", job).save(root)
    except BaseException:
        where, base = _opened(root)
        if where.get_file_info(f"{base}/{STAGE}{job}").type == fs.FileType.Directory:  # tasks may have gone on after the job was given up
            where.delete_dir(f"{base}/{STAGE}{job}")
        raise
    _publish(spark, root, job)
    return restored(spark, root, job)


def _framed(raw: bytes) -> bytes:
    """A message as MBOX has it: behind a From line, with lines that begin with From marked."""
    body = re.sub(rb"(?m)^(>*From )", rb">\1", raw)
    return b"From - Thu Jan  1 00:00:00 1970\n" + body + (b"\n" if body.endswith(b"\n") else b"\n\n")


class MailFiles(DataSource):
    """df.write.format("mailfiles").option("job", ...).save(root)"""

    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def schema(self) -> str:
        return "hash string, path string, raw binary"

    def writer(self, schema, overwrite: bool) -> MailWriter:
        return MailWriter(self.options["path"], self.options["job"])


def restored(spark: SparkSession, root: str, job: str = "") -> DataFrame:
    """hash and path of what lists tell, of all runs or of one."""
    where, base = _opened(root)
    names = [x.base_name for x in where.get_file_info(fs.FileSelector(f"{base}/{LISTS}", allow_not_found=True)) if x.is_file]
    if not any(n.startswith(f"part-{job}") for n in names):
        return spark.createDataFrame([], TOLD)
    return spark.read.schema(TOLD).option("pathGlobFilter", f"part-{job}*").json(f"{root.rstrip('/')}/{LISTS}")


def _write(rows: DataFrame, root: str) -> DataFrame:
    """Writes each row's raw to its path, if it is not there from an earlier run; returns hash and path of what was written now."""
    _settle(rows.sparkSession, root)
    return _save(rows.join(restored(rows.sparkSession, root), ["hash", "path"], "left_anti"), root)


def to_maildir(rows: DataFrame, root: str) -> DataFrame:
    """rows: hash, account, folder, flags, date_text, raw. Seen mail goes to cur with its letters, other mail to new."""
    letters = formats.maildir_letters(F.col("flags"))
    name = formats.file_name(F.col("date_text"), F.col("hash"))
    own = F.when(letters == "", F.concat(F.lit("new/"), name)).otherwise(F.concat(F.lit("cur/"), name, F.lit(":2,"), letters))
    return _write(rows.withColumn("path", F.concat(formats.maildir_folder(F.col("account"), F.col("folder")), F.lit("/"), own)), root)


def to_eml(rows: DataFrame, root: str) -> DataFrame:
    name = F.concat(formats.file_name(F.col("date_text"), F.col("hash")), F.lit(".eml"))
    """rows: hash, account, folder, date_text, raw. A directory for each account, and in it one for each folder."""
    return _write(rows.withColumn("path", F.concat(_place(), F.lit("/"), name)), root)


def _place() -> Column:
    """account/folder as a path, each part of it a name that is safe, that leads nowhere up and that readers do not take for a hidden one."""
    part = lambda p: F.regexp_replace(formats.safe_name(p), r"^(?=[._])", "-")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(part(text("account")), F.lit("/"), F.array_join(F.transform(F.split(text("folder"), "/"), part), "/"))


#: What stands behind the name of a folder's second file and those that follow.
_MORE = r"(~\d+)?\.mbox$"


def to_mbox(rows: DataFrame, root: str, part_rows: int = 100_000) -> DataFrame:
    """Files of a folder's messages in order of date, each of about part_rows at most, below a directory for each account. A later run adds files for what was not there."""
    spark = rows.sparkSession
    _settle(spark, root)
    before = restored(spark, root).select("hash", F.regexp_replace("path", _MORE, "").alias("place"), F.regexp_extract("path", _MORE, 1).alias("n"))
    rows = rows.withColumn("place", _place()).join(before.select("hash", "place"), ["hash", "place"], "left_anti")
    known = before.groupBy("place").agg((F.max(F.coalesce(F.substring("n", 2, 9).try_cast("int"), F.lit(0))) + 1).alias("first"))  # a row a folder, like the next
    parts = rows.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts")).join(known, "place", "left")
    number = F.pmod(F.xxhash64("hash"), F.col("parts")) + F.coalesce("first", F.lit(0))
    rows = rows.join(parts, "place").withColumn("path", F.concat("place", F.when(number > 0, F.concat(F.lit("~"), number.cast("string"))).otherwise(""), F.lit(".mbox")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _save(rows.repartition(n, "path").sortWithinPartitions("path", "date_text", "hash"), root)


def restore_run(spark: SparkSession, root: str, chosen: DataFrame, to: str, ts: str, actor: str, write=to_maildir) -> dict[str, int]:
    """Gives the chosen messages (hash) of an archive back, each at the first of its places, and notes the run in the journal.

    Returns chosen, written, skipped and several, the messages with more than one place. What an earlier run wrote is skipped.
    """
    from epistola.operators import journal
    from epistola.streaming import ingest

    a = ingest.archive(spark, root)
    own = chosen.select("hash").distinct()
    places = a.locations.join(own, "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("account", "folder", "flags")).alias("p"), F.count(F.lit(1)).alias("n")).persist()
    rows = places.select("hash", "p.*").join(a.messages.select("hash", "date_text"), "hash").join(ingest.load(spark, root, "store").select("hash", "raw"), "hash")
    counts = places.agg(F.count(F.lit(1)).alias("chosen"), F.count_if(F.col("n") > 1).alias("several")).first()
    n = write(rows, to).count()
    places.unpersist()
    report = {"chosen": counts["chosen"], "written": n, "skipped": counts["chosen"] - n, "several": counts["several"]}
    journal.commit(f"{root}/journal", [{"op": "note", "kind": "zurueckgespielt", "place": to, "count": n, "actor": actor, "note": json.dumps(report)}], ts)
    return report
