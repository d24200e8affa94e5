"""The hash-chained journal: reading, checking, folding, appending.

A line is canonical JSON with its own hash in `self` and that of the line before in `prev`. Each line is checked against
its predecessor alone: within a segment by a window, over segments by the last line of each, of which there are few.

A segment is a commit: its number is taken by one writer alone, and a writer that comes second chains its lines anew behind
the first one's. Lines that were committed are never taken back. A line of a stream's batch names both in `batch`, so a batch
that is done again knows what it has told.
"""

from __future__ import annotations

import hashlib
import json
import lzma
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from epistola import schemas
from epistola.operators import commits

START = "0" * 64
#: Bytes after which a segment is closed, and its name: a number, a batch in archives of earlier versions, and how it is packed.
ROLL = 64 << 20
_NAME = re.compile(r"(\d{6,})(?:-b\d+-\d+of\d+)?\.jsonl(\.zst|\.xz)?")


def canonical(entry: dict) -> str:
    return json.dumps(entry, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def entry_hash(entry: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in entry.items() if k != "self"}).encode()).hexdigest()


def append(last: dict | None, operations: list[dict], ts: str) -> list[str]:
    """Lines for operations after the last entry. The chain is made by its one writer, for one batch."""
    lines, seq, prev = [], (last or {}).get("seq", 0), (last or {}).get("self", START)
    for op in operations:
        # Quotes inside values are escaped, so the field is found in its place; `seq` and `ts` follow it.
        before, _, after = canonical({**op, "seq": seq + 1, "ts": ts, "prev": prev, "self": ""}).partition('"self":"",')
        seq, prev = seq + 1, hashlib.sha256((before + after).encode()).hexdigest()
        lines.append(f'{before}"self":"{prev}",{after}')
    return lines


def segments(path: str) -> list[str]:
    """Names of the journal's files in order."""
    where, base = commits.opened(path)
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((x.base_name for x in found if x.is_file and _NAME.fullmatch(x.base_name)), key=lambda n: (int(_NAME.fullmatch(n)[1]), n))


def _unpacked(name: str, data: bytes) -> bytes:
    return lzma.decompress(data) if name.endswith(".xz") else zstandard.ZstdDecompressor().decompressobj().decompress(data) if name.endswith(".zst") else data


def number(name: str) -> int:
    return int(_NAME.fullmatch(name)[1])


def read(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """segment, line_no and line of journal files whose number is above `after`; names of segments are in order. Packed ones are read in tasks; a journal that is not there is empty."""
    names = [n for n in segments(path) if number(n) > after]
    packed_names, plain_names = [n for n in names if n.endswith((".zst", ".xz"))], [n for n in names if n.endswith(".jsonl")]
    empty = spark.createDataFrame([], schemas.JOURNAL)
    if not names:
        return empty
    files = lambda some: [f"{path}/{n}" for n in some] if after else path
    order = Window.partitionBy("segment").orderBy("block", "at")
    # A long file is read in several blocks, which are not dealt out in order.
    plain = spark.read.option("pathGlobFilter", "*.jsonl").text(files(plain_names) or path).select(F.col("_metadata.file_name").alias("segment"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    plain = plain.select("segment", F.row_number().over(order).cast("long").alias("line_no"), "line")
    if not packed_names:
        return plain

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"]):
                lines = _unpacked(where, bytes(data)).decode().splitlines()
                yield pd.DataFrame({"segment": where.rpartition("/")[2], "line_no": range(1, len(lines) + 1), "line": lines})

    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.{zst,xz}").load(files(packed_names)).select("path", "content").mapInPandas(unpack, schemas.JOURNAL)
    return plain.unionByName(packed) if plain_names else packed


def last_entry(path: str) -> dict | None:
    """The last whole entry; a torn line at the end counts as never written."""
    where, base = commits.opened(path)
    for name in reversed(segments(path)):
        with where.open_input_stream(f"{base}/{name}", compression=None) as file:
            lines = _unpacked(name, file.read()).splitlines()
        for line in reversed(lines):
            try:
                return json.loads(line)
            except ValueError:
                continue
    return None


def commit(path: str, operations: list[dict], ts: str) -> int:
    """Appends a segment with a line for each operation, behind whatever is the journal's end when its number is taken; returns the number."""
    while True:
        names, last = segments(path), last_entry(path)
        n = max(map(number, names), default=0) + 1
        if segments(path) != names:
            continue  # another writer came between
        data = "".join(x + "\n" for x in append(last, operations, ts)).encode()
        if commits.put_new(f"{path}/{n:06d}.jsonl", data):
            if sum(number(x) == n for x in segments(path)) == 1:
                return n
            # The number was taken, and its segment packed since.
            where, base = commits.opened(path)
            where.delete_file(f"{base}/{n:06d}.jsonl")


def write(operations: DataFrame, root: str, ts: str, batch: str | None = None) -> int:
    """Appends a line for each row, in the order of the rows, in segments of their own; returns how many there were.

    Fields that are null are left out, but for an add's uid and date; `batch` names the stream and batch in each line. A chain
    is made one line after the other, so rows come through the driver in a stream, a partition at a time; what is held is one
    segment. A write that is broken off leaves whole segments: see `told` for what is still to be told.
    """
    path, n, held, size = f"{root}/journal", 0, [], 0
    for row in operations.toLocalIterator(prefetchPartitions=True):
        op = {k: v for k, v in row.asDict(recursive=True).items() if v is not None or (row["op"] == "add" and k in ("uid", "date"))}
        held.append({**op, "batch": batch} if batch is not None else op)
        n, size = n + 1, size + sum(len(k) + len(str(v)) + 6 for k, v in op.items()) + 200
        if size >= ROLL:
            commit(path, held, ts)
            held, size = [], 0
    if held:
        commit(path, held, ts)
    return n


def _stream(root: str, stream: str) -> str:
    return f"{root}/streams/{hashlib.sha256(stream.encode()).hexdigest()[:32]}.json"


def end(root: str) -> int:
    """The number of the last segment."""
    return max(map(number, segments(f"{root}/journal")), default=0)


def begin_batch(root: str, stream: str, batch: int) -> int:
    """The segment behind which lines of this batch can be: the journal's end when the stream's last batch was done, or when the stream began."""
    known = commits.note(_stream(root, stream))
    if known is None:
        known = {"stream": stream, "batch": None, "segment": end(root)}
        commits.put(_stream(root, stream), canonical(known).encode())
    return known["segment"]


def end_batch(root: str, stream: str, batch: int) -> None:
    """Notes that all of a batch is in the tables: the next one need not look before the journal's end of now."""
    commits.put(_stream(root, stream), canonical({"stream": stream, "batch": batch, "segment": end(root)}).encode())


def told(spark: SparkSession, root: str, batch: str, after: int) -> DataFrame:
    """op, hash, account and folder of the lines that a batch has in the journal, in segments behind a number."""
    return parsed(read(spark, f"{root}/journal", after)).where(F.col("batch") == batch).select("op", "hash", "account", "folder")


def pack(spark: SparkSession, root: str) -> int:
    """Packs all segments but the last, in tasks; a packed one never changes. Returns how many there were."""
    path = f"{root}/journal"
    names = [n for n in segments(path)[:-1] if n.endswith(".jsonl")]

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = commits.opened(path)
        for batch in batches:
            for name in batch["name"]:
                with where.open_input_stream(f"{base}/{name}", compression=None) as file:
                    data = zstandard.ZstdCompressor().compress(file.read())
                temporary = f"{base}/.tmp-{uuid.uuid4().hex}"
                with where.open_output_stream(temporary, compression=None) as out:
                    out.write(data)
                where.move(temporary, f"{base}/{name}.zst")
                where.delete_file(f"{base}/{name}")
            yield batch

    if not names:
        return 0
    return spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names)).mapInPandas(squeeze, "name string").count()


def parsed(journal: DataFrame) -> DataFrame:
    return journal.withColumn("e", F.from_json("line", schemas.ENTRY)).select("segment", "line_no", "line", "e.*")


def self_hash(line: Column) -> Column:
    """The hash of a canonical line without its `self`; quotes inside values are escaped, so they do not look like the field."""
    return F.sha2(F.regexp_replace(line, '"self":"[0-9a-f]{64}",?', ""), 256)


def verify(journal: DataFrame) -> DataFrame:
    """segment, line_no, seq, problem, known of every line that breaks the chain.

    Problems: unreadable, self, prev, seq. A line that cannot be read at the end of the last segment is a torn one and no
    problem. A note of the kind `kette` that names a segment and number makes its prev and seq problems known; a wrong self
    never is.
    """
    rows = parsed(journal)
    w = Window.partitionBy("segment").orderBy("line_no")
    rows = rows.withColumns({"before": F.lag("self").over(w), "number_before": F.lag("seq").over(w), "last": F.lead("line_no").over(w).isNull(), "first": F.lag("line_no").over(w).isNull()})
    # One row a segment.
    ends = rows.where("seq is not null").groupBy("segment").agg(F.max_by("self", "line_no").alias("end_self"), F.max_by("seq", "line_no").alias("end_seq"))
    order = Window.orderBy("segment")
    ends = ends.select(F.lead("segment").over(order).alias("segment"), "end_self", "end_seq", F.lead("segment").over(order).isNull().alias("newest")).where("segment is not null")
    newest = journal.agg(F.max("segment").alias("newest_segment"))
    rows = rows.join(ends.drop("newest"), "segment", "left").crossJoin(newest)  # one row
    before = F.when(F.col("first"), F.coalesce("end_self", F.lit(START))).otherwise(F.col("before"))
    number = F.when(F.col("first"), F.coalesce("end_seq", F.lit(0))).otherwise(F.col("number_before"))
    torn = F.col("last") & (F.col("segment") == F.col("newest_segment"))
    problem = F.when(F.col("self").isNull() | F.col("seq").isNull(), F.when(~torn, F.lit("unreadable")))
    problem = problem.when(self_hash(F.col("line")) != F.col("self"), "self").when(F.col("prev") != before, "prev").when(F.col("seq") != number + 1, "seq")
    notes = rows.where("op = 'kette'").select(F.col("place").alias("segment"), F.col("number").alias("seq"), F.lit(True).alias("noted")).distinct()
    bad = rows.withColumn("problem", problem).where("problem is not null").select("segment", "line_no", "seq", "problem")
    return bad.join(notes, ["segment", "seq"], "left").select("segment", "line_no", "seq", "problem", (F.coalesce("noted", F.lit(False)) & F.col("problem").isin("prev", "seq")).alias("known"))


def live(entries: DataFrame) -> DataFrame:
    """Hashes whose last operation among add and delete is an add: what the store has to hold. Null hashes are incomplete entries."""
    ops = entries.where("op in ('add', 'delete') and hash is not null")
    return ops.groupBy("hash").agg(F.max_by("op", "seq").alias("op"), F.max_by("bucket", F.when(F.col("op") == "add", F.col("seq"))).alias("bucket"), F.max("seq").alias("seq")).where("op = 'add'").drop("op")


def categories(entries: DataFrame) -> DataFrame:
    """The category of each hash by its last classification."""
    return entries.where("op = 'classify'").groupBy("hash").agg(F.max_by("category", "seq").alias("category"))


def locations(entries: DataFrame) -> DataFrame:
    """Places of live messages: those added after the last deletion, the first sighting of each, under their folders' last names."""
    gone = entries.where("op = 'delete'").groupBy("hash").agg(F.max("seq").alias("gone"))
    adds = entries.where("op = 'add' and hash is not null").join(gone, "hash", "left").where("gone is null or seq > gone")
    first = adds.groupBy("hash", "account", "folder").agg(F.min_by(F.struct("uid", "seq"), "seq").alias("f")).select("hash", "account", "folder", "f.uid", F.col("f.seq").alias("seq"))
    names = last_names(entries)
    held = F.col("seq").between(F.col("since"), F.col("until") - 1)
    # Names of one folder do not overlap in time, so a place meets one of them at most.
    rows = first.alias("f").join(names.alias("n"), (F.col("f.account") == F.col("n.account")) & (F.col("f.folder") == F.col("n.name")) & held, "left")
    rows = rows.select("f.hash", "f.account", F.coalesce("n.last", "f.folder").alias("folder"), "f.uid", "f.seq")
    return rows.groupBy("hash", "account", "folder").agg(F.min_by(F.struct("uid", "seq"), "seq").alias("f")).select("hash", "account", "folder", "f.uid", "f.seq")


def last_names(entries: DataFrame) -> DataFrame:
    """account, name, since, until, last: a folder that had the name for numbers from since up to until is called last now.

    Chains of renames are followed within an account, from the last rename to the first: a table of renames, not of mail.
    """
    notes = entries.where("op = 'note' and kind = 'ordner_umbenannt' and old <> new").select("account", "old", "new", "seq")

    def follow(batch: pd.DataFrame) -> pd.DataFrame:
        out, later = [], {}
        for r in batch.sort_values("seq", ascending=False).itertuples():
            # What the new name became after this rename, and until when the old one meant this folder.
            later = dict(later)
            later[r.old] = later.get(r.new, r.new)
            out.append((r.account, r.old, r.seq, later[r.old]))
        made = pd.DataFrame(out[::-1], columns=["account", "name", "until", "last"])
        made["since"] = made.groupby("name")["until"].shift(1).fillna(0).astype("int64")
        return made[["account", "name", "since", "until", "last"]]

    return notes.groupBy("account").applyInPandas(follow, "account string, name string, since long, until long, last string")


def gaps(entries: DataFrame, by: str, order: list[str], number: str) -> DataFrame:
    """Rows whose number does not follow that of the row before, for each group."""
    w = Window.partitionBy(by).orderBy(*order)
    return entries.withColumn("before", F.lag(number).over(w)).where(F.col("before").isNotNull() & (F.col(number) != F.col("before") + 1))
