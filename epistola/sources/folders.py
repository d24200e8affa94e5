"""Mail folders of several kinds as rows (account, folder, uid, flags, raw), by Spark's own file readers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epistola.functions.formats import LETTERS
from epistola.functions.text import glob_pattern
from epistola.sources import mbox

RAW = "account string, folder string, uid long, flags string, raw binary"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Name relative to the path, and bytes, of all files below it that match."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = re.sub(r"^file:/+", "/", path.rstrip("/")) + "/"
    return rows.where("length > 0").select(F.substring_index("path", root, -1).alias("name"), "content")


def _leaves(path: str) -> list[str]:
    """The directories cur and new below a path, without a look into them."""
    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    base, found, look = base.rstrip("/"), [], [""]
    while look:
        at = look.pop()
        for x in where.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/"))):
            name = f"{at}/{x.base_name}".lstrip("/")
            if x.type == fs.FileType.Directory:
                if x.base_name in ("cur", "new"):
                    found.append(name)
                elif x.base_name != "tmp":
                    look.append(name)
    return sorted(found)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Name and content of the files in all directories cur and new: names with colons are none that Hadoop's readers open, so tasks list a directory and read their share of it."""
    shares = max(1, spark.sparkContext.defaultParallelism)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for batch in batches:
            for leaf, share in zip(batch["leaf"], batch["share"]):
                for x in own.get_file_info(fs.FileSelector(f"{top.rstrip('/')}/{leaf}")):
                    if x.is_file and x.size and zlib.crc32(x.base_name.encode("utf-8", "surrogateescape")) % shares == share:
                        with own.open_input_stream(x.path, compression=None) as file:
                            yield pd.DataFrame({"name": [f"{leaf}/{x.base_name}"], "content": [file.read()]})

    rows = [(leaf, share) for leaf in _leaves(path) for share in range(shares)]
    return spark.createDataFrame(rows, "leaf string, share int").repartition(shares, "share").mapInPandas(fetch, "name string, content binary")


def flags_of_name(name: Column) -> Column:
    """Server flags for the letters after :2, in a file's name."""
    known = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (v, k)])
    letters = F.split(F.regexp_extract(name, r":2,([A-Za-z]*)$", 1), "")
    return F.array_join(F.array_sort(F.filter(F.transform(letters, lambda x: F.element_at(known, x)), lambda x: x.isNotNull())), " ")


def read_maildir(spark: SparkSession, path: str, account: str) -> DataFrame:
    """A Maildir with subfolders: .A.B is A/B, and the top INBOX."""
    rows = _listed(spark, path).where(F.col("name").rlike(r"(^|/)(cur|new)/[^/]+$"))
    folder = F.regexp_extract("name", r"^(?:\.?([^/]+)/)?(?:cur|new)/", 1)
    return rows.select(F.lit(account).alias("account"), F.when(folder == "", "INBOX").otherwise(F.translate(folder, ".", "/")).alias("folder"), F.lit(None).cast("long").alias("uid"), flags_of_name(F.col("name")).alias("flags"), F.col("content").alias("raw"))


def unwrap_emlx(raw: bytes) -> bytes:
    """The message inside an .emlx file; what has no valid length stays as it is."""
    first, _, rest = raw.partition(b"\n")
    n = int(first) if first.strip().isdigit() else -1
    return rest[:n] if 0 < n <= len(rest) else raw


def read_eml(spark: SparkSession, path: str, account: str) -> DataFrame:
    """All .eml and .emlx files below a directory; the folder is their own directory, or the account at the top."""

    @F.pandas_udf("binary")
    def unwrap(raws: pd.Series) -> pd.Series:
        return raws.map(lambda r: unwrap_emlx(bytes(r)))

    rows = _files(spark, path, "*.{eml,emlx}")
    folder = F.regexp_extract("name", r"^(.*)/[^/]+$", 1)
    raw = F.when(F.col("name").endswith(".emlx"), unwrap("content")).otherwise(F.col("content"))
    return rows.select(F.lit(account).alias("account"), F.when(folder == "", account).otherwise(folder).alias("folder"), F.lit(None).cast("long").alias("uid"), F.lit("").alias("flags"), raw.alias("raw"))


#: Files beside folders that hold no mail, fixed values.
NO_MAIL = r"^\.|\.(msf|dat|json|sqlite|log|bak|tmp)$"
PASSED_OVER = ("msgFilterRules.dat", "filterlog.html", "Trash", "Junk")


def read_mbox(spark: SparkSession, path: str, account: str, pattern: str = "*", size: int = mbox.RANGE) -> DataFrame:
    """MBOX files below a path, one folder each: A.sbd/B is A/B; index and hidden files are passed over. A task reads about `size` bytes."""
    spark.dataSource.register(mbox.MboxSource)
    base = F.substring_index("name", "/", -1)
    parts = spark.read.format("mbox").option("range", size).load(path).where(~base.rlike(NO_MAIL) & ~base.isin(*PASSED_OVER) & base.rlike(glob_pattern(pattern)))
    folder = F.regexp_replace(F.regexp_replace("name", r"\.sbd(?=/)", ""), r"(~\d+)?\.mbox$", "")
    return parts.select(F.lit(account).alias("account"), folder.alias("folder"), F.lit(None).cast("long").alias("uid"), F.lit("").alias("flags"), "raw")


def kind_of(path: str) -> str:
    """What lies at a path: profile, maildir, folders, collection, eml or mbox, in this order; anything else raises."""
    where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    own = where.get_file_info(base)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if own.is_file:
        return "mbox"
    inside = where.get_file_info(fs.FileSelector(base))
    dirs = {x.base_name for x in inside if x.type == fs.FileType.Directory}
    if dirs & {"Mail", "ImapMail"}:
        return "profile"
    if "cur" in dirs:
        return "maildir"
    if any(x.base_name.endswith((".msf", ".sbd")) for x in inside):
        return "folders"
    below = [x for d in dirs for x in where.get_file_info(fs.FileSelector(f"{base}/{d}"))]
    if any(x.base_name == "cur" and x.type == fs.FileType.Directory for x in below):
        return "collection"
    if any(x.is_file and x.base_name.lower().endswith((".eml", ".emlx")) for x in [*inside, *below]):
        return "eml"
    raise ValueError(f"no mail that is known at {path}")


def read_any(spark: SparkSession, path: str, account: str, everything: bool = False) -> DataFrame:
    """The mail at a path, whatever kind of source it is; without `everything`, folders of rubbish, drafts and the like are left out."""
    from epistola.operators.policy import is_excluded

    kind, path = kind_of(path), path.rstrip("/")
    if kind == "profile":
        where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        there = [d for d in ("Mail", "ImapMail") if where.get_file_info(f"{base}/{d}").type == fs.FileType.Directory]
        rows = reduce(DataFrame.unionByName, [read_mbox(spark, f"{path}/{d}", account) for d in there])
    elif kind in ("maildir", "collection"):
        rows = read_maildir(spark, path, account)
    else:
        rows = read_eml(spark, path, account) if kind == "eml" else read_mbox(spark, path, account)
    return rows if everything else rows.where(~is_excluded(F.col("folder")))


def read_all(spark: SparkSession, paths: list[str], account: str, everything: bool = False, together: bool = False) -> DataFrame:
    """Several sources as one account's mail: each below the name of its directory, unless they are to be put together."""
    each = [(p.rstrip("/").rpartition("/")[2], read_any(spark, p, account, everything)) for p in paths]
    return reduce(DataFrame.unionByName, [rows if together or len(paths) == 1 else with_origin(rows, name) for name, rows in each])


def with_origin(rows: DataFrame, origin: str) -> DataFrame:
    """Folders below the name of where they came from; mail at the top goes into it."""
    return rows.withColumn("folder", F.when(F.coalesce("folder", F.lit("")) == "", origin).otherwise(F.concat(F.lit(f"{origin}/"), "folder")))


# Fetching by number: what a server has against what is held.


def to_fetch(server: DataFrame, held: DataFrame, retry: DataFrame) -> DataFrame:
    """account, folder, uid to fetch: above the highest number held, and those to try again that still exist.

    A folder is read anew if its validity has changed, or if the server's highest number lies below that held.
    server: account, folder, uid, uidvalidity. held: account, folder, max_uid, uidvalidity. retry: account, folder, uid.
    """
    keys = ["account", "folder"]
    top = server.groupBy(*keys).agg(F.max("uid").alias("top"))
    rows = server.join(top, keys).join(held.select(*keys, "max_uid", F.col("uidvalidity").alias("known")), keys, "left")
    anew = F.col("known").isNull() | (F.col("known") != F.col("uidvalidity")) | (F.col("top") < F.col("max_uid"))
    fresh = rows.where(anew | (F.col("uid") > F.col("max_uid"))).select(*keys, "uid")
    again = retry.select(*keys, "uid").join(server, [*keys, "uid"], "left_semi")
    return fresh.unionByName(again).distinct()


def renamed(before: DataFrame, now: DataFrame) -> DataFrame:
    """account, old, new: where just one folder went and one came with the same validity."""
    gone = before.join(now, ["account", "folder"], "left_anti")
    come = now.join(before, ["account", "folder"], "left_anti")
    one = lambda t, name: t.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.min("folder").alias(name), F.min("uidvalidity").alias(f"{name}_v")).where("n = 1").drop("n")
    return one(gone, "old").join(one(come, "new"), "account").where("old_v = new_v").select("account", "old", "new")
