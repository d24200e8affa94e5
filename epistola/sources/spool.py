"""A spool directory as a stream: what a connector has fetched, with the state of fetching as the stream's offset.

A folder's mail lies in <spool>/<account>/<folder>/@<epoch>/<number>.eml, and the file `epoch` beside names the epoch that holds.
The offset has the epoch and the highest number of each folder. A folder whose epoch has changed is read anew, as its numbers
mean other mail; the new epoch is in the offset of the batch that holds the whole folder, so it counts when that batch has
ended, and not before. Mail that could not be read is named in a numbered list below <spool>/_again, and the next run asks for
it once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from epistola.operators import commits
from epistola.sources.folders import RAW

#: Mails of a task, and the folder of lists of mail to ask for again.
SHARE, AGAIN = 1000, "_again"


@dataclass
class Share(InputPartition):
    """Numbers of a folder's epoch, from above low up to high, or the lines of a list."""

    account: str
    folder: str
    epoch: int
    low: int
    high: int
    list: str = ""


def _folders(spool: str) -> Iterator[tuple[str, str]]:
    """Account and folder of each directory that has a file `epoch`; folders may have folders."""
    where, base = commits.opened(spool)
    base, look = base.rstrip("/"), [""]
    while look:
        at = look.pop()
        inside = where.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/"), allow_not_found=True))
        if "/" in at and any(x.base_name == "epoch" and x.is_file for x in inside):
            yield at.split("/", 1)[0], at.split("/", 1)[1]
        look += [f"{at}/{x.base_name}".lstrip("/") for x in inside if x.type == fs.FileType.Directory and not x.base_name.startswith(("@", "_", "."))]


def _numbers(spool: str, account: str, folder: str, epoch: int) -> list[int]:
    where, base = commits.opened(f"{spool.rstrip('/')}/{account}/{folder}/@{epoch}")
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(x.base_name[:-4]) for x in found if x.is_file and x.base_name.endswith(".eml") and x.base_name[:-4].isdigit())


def _lists(spool: str) -> list[str]:
    where, base = commits.opened(f"{spool.rstrip('/')}/{AGAIN}")
    return sorted(x.base_name for x in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.base_name.isdigit())


class SpoolReader(DataSourceStreamReader):
    def __init__(self, spool: str):
        self.spool = spool

    def initialOffset(self) -> dict:
        return {"folders": {}, "again": 0}

    def latestOffset(self) -> dict:
        now = {}
        for account, folder in _folders(self.spool):
            epoch = int(commits.get(f"{self.spool.rstrip('/')}/{account}/{folder}/epoch") or b"0")
            now[f"{account}/{folder}"] = [epoch, max(_numbers(self.spool, account, folder, epoch), default=0)]
        return {"folders": dict(sorted(now.items())), "again": max(map(int, _lists(self.spool)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for key, (epoch, high) in end["folders"].items():
            known, low = start["folders"].get(key, (None, 0))
            low = low if known == epoch and low <= high else 0
            account, folder = key.split("/", 1)
            numbers = [n for n in _numbers(self.spool, account, folder, epoch) if low < n <= high] if high > low else []
            for i in range(0, len(numbers), SHARE):
                out.append(Share(account, folder, epoch, numbers[i] - 1, numbers[min(i + SHARE, len(numbers)) - 1]))
        out += [Share("", "", 0, 0, 0, name) for name in _lists(self.spool) if start["again"] < int(name) <= end["again"]]
        return out or [Share("", "", 0, 0, 0)]

    def read(self, partition: Share) -> Iterator[tuple]:
        if partition.list:
            for line in (commits.get(f"{self.spool.rstrip('/')}/{AGAIN}/{partition.list}") or b"").decode().splitlines():
                account, folder, number = line.split("\t")
                epoch = int(commits.get(f"{self.spool.rstrip('/')}/{account}/{folder}/epoch") or b"0")
                yield from self._one(account, folder, epoch, int(number))
        elif partition.account:
            for n in _numbers(self.spool, partition.account, partition.folder, partition.epoch):
                if partition.low < n <= partition.high:
                    yield from self._one(partition.account, partition.folder, partition.epoch, n)

    def _one(self, account: str, folder: str, epoch: int, number: int) -> Iterator[tuple]:
        """A mail; none where its file has gone since."""
        raw = commits.get(f"{self.spool.rstrip('/')}/{account}/{folder}/@{epoch}/{number}.eml")
        if raw is not None:
            yield account, folder, number, "", raw

    def commit(self, end: dict) -> None:
        pass  # the spool is the connector's


class SpoolSource(DataSource):
    """spark.readStream.format("mailspool").load(spool)"""

    @classmethod
    def name(cls) -> str:
        return "mailspool"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> SpoolReader:
        return SpoolReader(self.options["path"])


def read_spool(spark: SparkSession, spool: str) -> DataFrame:
    spark.dataSource.register(SpoolSource)
    return spark.readStream.format("mailspool").load(spool)


def ask_again(spool: str, rows: DataFrame) -> int:
    """Names mails (account, folder, uid) that could not be read in the next list; returns how many. Lists are of mail that is broken, a part at a time."""
    lines = [f"{r['account']}\t{r['folder']}\t{r['uid']}\n" for r in rows.where("uid is not null").select("account", "folder", "uid").distinct().orderBy("account", "folder", "uid").toLocalIterator()]
    while lines:
        number = max(map(int, _lists(spool)), default=0) + 1
        if commits.put_new(f"{spool.rstrip('/')}/{AGAIN}/{number:09d}", "".join(lines).encode()):
            break
    return len(lines)


def fetch(spark: SparkSession, spool: str, root: str, captured: str, checkpoint: str, rules: tuple = ()) -> None:
    """Takes into an archive what the spool has and the archive's offset has not, and asks again for what could not be read."""
    from epistola.streaming import ingest

    before = ingest.load(spark, root, "quarantine").where(F.col("captured") == captured).count()
    ingest.ingest(read_spool(spark, spool), root, captured, checkpoint, rules).start().awaitTermination()
    broken = ingest.load(spark, root, "quarantine").where(F.col("captured") == captured)
    if broken.count() > before:
        ask_again(spool, broken)
