"""What is known of servers as tables: names of folders, where they lie, what to ask for and in which portions."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: Most messages and bytes of one request, fixed values.
BLOCK_MAILS, BLOCK_BYTES = 50, 32 << 20
#: Roles of mailboxes that are not archived, fixed values; `all` holds everything a second time.
ROLES = ("trash", "junk", "drafts", "all")


def from_utf7(name: str) -> str:
    """A folder's name from the form of RFC 3501, 5.1.3; a part that is not in it stays as it is."""

    def part(m: re.Match) -> str:
        if not m[1]:
            return "&"
        try:
            return base64.b64decode(m[1].replace(",", "/") + "=" * (-len(m[1]) % 4)).decode("utf-16-be")
        except ValueError:
            return f"&{m[1]}-"

    return re.sub(r"&([^-]*)-?", part, name)


def to_utf7(name: str) -> str:
    """The form of RFC 3501, 5.1.3, for a folder's name."""
    other = lambda m: "&-" if m[0] == "&" else "&" + base64.b64encode(m[0].encode("utf-16-be")).decode().rstrip("=").replace("/", ",") + "-"
    return re.sub(r"&|[^\x20-\x7e]+", other, name)


@F.pandas_udf(StringType())
def decode_name(names: pd.Series) -> pd.Series:
    return names.map(from_utf7, na_action="ignore")


@F.pandas_udf(StringType())
def encode_name(names: pd.Series) -> pd.Series:
    return names.map(to_utf7, na_action="ignore")


def before(server: DataFrame, day: Column) -> DataFrame:
    """account, folder, uid of what arrived at the server before a day."""
    return server.where(F.col("received").cast("date") < day).select("account", "folder", "uid")


def requests(rows: DataFrame, mails: int = BLOCK_MAILS, size: int = BLOCK_BYTES) -> DataFrame:
    """Adds `block` to rows (account, folder, uid, size): in order of the uid, a folder's rows fill a request until one more would be too many or too large.

    Unknown sizes count nothing. Rows pass in order, so no folder is held whole.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block, n, total = None, 0, 0, 0
        for batch in batches:
            made = []
            for account, folder, own in zip(batch["account"], batch["folder"], batch["size"]):
                own = 0 if pd.isna(own) else int(own)
                if (account, folder) != now:
                    now, block, n, total = (account, folder), 0, 0, 0
                elif n >= mails or total + own > size:
                    block, n, total = block + 1, 0, 0
                n, total = n + 1, total + own
                made.append(block)
            yield batch.assign(block=made)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select("account", "folder", F.col("uid").cast("long").alias("uid"), F.col("size").cast("long").alias("size"))
    return own.repartition(parts, "account", "folder").sortWithinPartitions("account", "folder", "uid").mapInPandas(pack, "account string, folder string, uid long, size long, block long")


def folder_paths(mailboxes: DataFrame, excluded: tuple[str, ...] = (), cut: int = 1) -> DataFrame:
    """id and path of each mailbox (id, name, parent, role) that is archived; a parent that is not there, or leads round, ends a path.

    Each turn joins the mailboxes that still have a parent to it: a table of folders, not of mail. After each `cut` turns the plan is
    cut: what was met is written and read again, where the session has a folder for checkpoints, so that no task has the sorts of many joins at once and no turn is done again.
    """
    boxes = mailboxes.where("id is not null").select("id", F.coalesce("name", F.lit("")).alias("name"), "parent", F.lower(F.coalesce("role", F.lit(""))).alias("role"))
    up = boxes.select(F.col("id").alias("up"), F.col("name").alias("up_name"), F.col("parent").alias("up_parent"))
    now = boxes.select("id", "name", "role", F.col("name").alias("path"), "parent", F.array("id").alias("seen"))
    done, turn, spark = None, 0, mailboxes.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    scratch = f"{(shared or '').rstrip('/')}/folder-paths-{uuid.uuid4().hex}"
    while True:
        met = now.join(up, (F.col("parent") == F.col("up")) & ~F.array_contains("seen", F.col("up")), "left")
        turn += 1
        if turn % cut == 0 and shared:
            met.write.parquet(f"{scratch}/{turn}")
            met = spark.read.schema(met.schema).parquet(f"{scratch}/{turn}")
        ended = met.where("up is null").select("id", "name", "role", "path")
        done = ended if done is None else done.unionAll(ended)
        now = met.where("up is not null").select("id", "name", "role", F.concat_ws("/", "up_name", "path").alias("path"), F.col("up_parent").alias("parent"), F.concat("seen", F.array("up")).alias("seen"))
        if now.isEmpty():
            break
    names = [x.lower() for x in excluded]
    return done.where(~F.col("role").isin(*ROLES) & ~F.lower("path").isin(names) & ~F.lower("name").isin(names)).select("id", "path")


def first_folder(mails: DataFrame, paths: DataFrame) -> DataFrame:
    """id and folder of mails (id, mailboxes): the first mailbox by id that is archived; mails without one are left out."""
    rows = mails.select("id", F.explode("mailboxes").alias("box")).join(paths.select(F.col("id").alias("box"), "path"), "box")
    return rows.groupBy("id").agg(F.min_by("path", "box").alias("folder"))
