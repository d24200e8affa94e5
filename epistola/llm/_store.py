"""Shared scratch space, range buckets and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder all machines share: `spark.checkpoint.dir`. Where it is unset, a new one on a local master; on a cluster this raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="epistola-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes that a Python worker is handed at a time while a scratch table is written.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For the time of a job, batches so small that long texts do not fill a worker."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def keep(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Writes df to a new shared table and returns what was written with its path: it cuts the lineage."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Cache(dict):
    """What a Python worker has worked out for short strings, `most` of them at most: some 40 MB.

    When it is full, nothing more is kept until as many others have been asked for; then it starts anew. Strings that come
    often come early, so most of what is asked for is there.
    """

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most, self.missed = most, 0

    def put(self, key, value):
        if len(self) < self.most:
            if len(key) <= 64:
                self[key] = value
        else:
            self.missed += 1
            if self.missed >= self.most:
                self.clear()
                self.missed = 0
        return value


def texts(column: pa.Array) -> Iterator:
    """The values of a column one after the other, so that no more than one of them is held beside the batch."""
    return (x.as_py() for x in column)


_own: dict = {}


def worker_cache(key, make: Callable):
    """What this Python worker keeps from task to task: one thing at a time, so that stages of a pipeline do not add up."""
    if key not in _own:
        _own.clear()
        _own[key] = make()
    return _own[key]


#: Bits that a filter has for each key, and the least and most bits of any, as powers of two: 32 MB at most. With more keys than that, more others pass it.
KEY_BITS, FILTER_LEAST, FILTER_MOST = 16, 15, 28


class Filter:
    """The bits of a table's integer keys, as a small table. A key that is not among them may have its bit set too."""

    def __init__(self, rows: DataFrame, key: Column):
        self.power = min(FILTER_MOST, max(FILTER_LEAST, (KEY_BITS * rows.count() - 1).bit_length()))
        bits = rows.select(self._bit(key).alias("h")).groupBy(F.shiftright("h", 15).alias("_at")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(32767).cast("long"))).alias("_bits"))
        self.bits, _ = keep(bits, "filter")  # 8192 pieces of 4 KB at most

    def _bit(self, key: Column) -> Column:
        """The bit of a key; null counts as the smallest."""
        return F.pmod(F.xxhash64(F.coalesce(key.cast("long"), F.lit(-(1 << 63)))), F.lit(1 << self.power))

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows whose key may be in the table, and those whose key is not. No row is dealt out for it."""
        bit = self._bit(key)
        marked = rows.withColumns({"_at": F.shiftright(bit, 15), "_in": bit.bitwiseAND(F.lit(32767).cast("long")).cast("int")}).join(F.broadcast(self.bits), "_at", "left")
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_in", 3) + 1, F.lit(1))), 16, 10).cast("int")
        own = F.coalesce(F.expr("shiftright(_byte, _in & 7) & 1") == 1, F.lit(False))
        marked = marked.withColumn("_byte", byte).withColumn("_own", own)
        return tuple(marked.where(test).select(*rows.columns) for test in (F.col("_own"), ~F.col("_own")))


#: Most ranges that a key is cut into, and cells that are counted at a time to find them.
RANGES, GRID = 1 << 14, 13


def range_bounds(rows: DataFrame, key: str, weight: Column, target: int) -> tuple[list[int], list[int | None]]:
    """Ascending bounds of an integer key, and the single keys that weigh more than `target`: between two bounds lies about `target`, or one such key.

    Weights are summed in the cells of a grid over the key, and anew in a finer one within cells that weigh too much. So the
    bounds follow from the rows alone, not from how they lie in partitions. There are at most RANGES of them; a larger table
    has heavier ranges. Null keys belong to the lowest range.
    """
    rows = rows.select(F.col(key).cast("long").alias("k"), weight.cast("long").alias("w"))
    low, high, total, without = rows.agg(F.min("k"), F.max("k"), F.sum("w"), F.sum(F.when(F.col("k").isNull(), F.col("w")))).first()
    heavy: list[int | None] = [None] if (without or 0) > target else []
    if low is None or (total or 0) <= target:
        return [], heavy
    target = max(target, -(-total // (RANGES // 2)))

    def count(part: DataFrame, by: int) -> dict[int, tuple[int, int]]:
        return {r["c"] << by: (r["w"] or 0, by) for r in part.groupBy(F.shiftright("k", by).alias("c")).agg(F.sum("w").alias("w")).collect()}

    rows = rows.where("k is not null")
    cells = count(rows, max(0, (high - low).bit_length() - GRID))  # 2**GRID + 1 cells at most
    while large := [c for c, (w, by) in cells.items() if w > target and by]:  # RANGES / 2 at most, all of one size
        by = cells[large[0]][1]
        finer = max(0, by - max(1, GRID + 4 - len(large).bit_length()))
        inside = rows.where(among(F.shiftright("k", by), [c >> by for c in large]))
        cells = {c: x for c, x in cells.items() if x[0] <= target or not x[1]}
        cells |= count(inside, finer)
    bounds, now = [], 0
    for c in sorted(cells):
        if now and now + cells[c][0] > target:
            bounds.append(c - 1)
            now = 0
        now += cells[c][0]
    return bounds, heavy + [c for c, (w, _) in cells.items() if w > target]


def constants(values: list[int]) -> Column:
    """A constant array of whole numbers, as one literal of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def among(key: Column, values: list[int | None]) -> Column:
    """Whether a key is one of many whole numbers, found in two steps; null is where it is among them."""
    some = sorted(v for v in values if v is not None)
    null = key.isNull() if None in values else F.lit(False)
    if not some:
        return null
    step = max(1, int(len(some) ** 0.5))
    rows = F.array(*[constants(some[i : i + step]) for i in range(0, len(some), step)])
    at = bucket_of(key, some)
    return null | F.coalesce(F.get(F.get(rows, F.floor(at / step).cast("int")), at % step) == key, F.lit(False))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key, found in two steps; a null key is in bucket 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda b: b < key
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(constants([b[-1] for b in blocks]), below))
    fine = F.get(F.array(*[constants(b) for b in blocks]), coarse)
    return F.coalesce(coarse * F.lit(step) + F.when(coarse < len(blocks), F.size(F.filter(fine, below))).otherwise(0), F.lit(0)).cast("int")


def running_offsets(sizes: DataFrame, order: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """Adds `offset`, the sum of value over the earlier rows. For tables of a bounded number of rows: one per bucket."""
    from pyspark.sql import Window

    w = Window.partitionBy(*[F.col(c) for c in by or []] or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
