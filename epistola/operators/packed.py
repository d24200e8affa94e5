"""Rows of an index, packed: a row for each key of some texts, with the texts it is in and where it stands in each.

Texts are packed in the task that reads them and written from there: no occurrence is a row of its own, on disk or in a shuffle.
Readers unpack only the rows of the keys that they ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Occurrences that are packed at a time.
AT_ONCE = 1 << 21
#: Bytes of a row group, as each bucket has one open, and of the list of different keys of texts in it.
OPTIONS = {"parquet.block.size": 4 << 20, "parquet.dictionary.page.size": 2 << 20, "compression": "zstd"}
#: Numbers of rows with what is to be packed, by where texts end, and the names of keys in ascending order.
Keys = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array]]


def stored(key: str, hash_type: str) -> str:
    return f"{key} string, column string, n long, hashes array<{hash_type}>, places array<array<int>>, bucket int"


def pack(rows: DataFrame, key: str, keys: Keys) -> DataFrame:
    """Packed rows of texts: hash, column, first (the place of the first key) and what `keys` takes keys from."""
    kind = rows.schema["hash"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("column").dictionary_encode()
            sizes = _sizes(batch.column("x"))
            ends, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, side="right")))
                yield from _packed(batch.slice(start, stop - start), names[start:stop], key, keys)
                start = stop

    made = f"{key} string, column string, n long, hashes array<{kind.simpleString()}>, places array<array<int>>"
    return rows.select("hash", "column", F.col("first").cast("int").alias("first"), F.col("x")).mapInArrow(work, made)


def _sizes(x: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    found = pc.list_value_length(x) if pa.types.is_list(x.type) else pc.utf8_length(x)
    return pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(batch: pa.RecordBatch, columns: pa.DictionaryArray, key: str, keys: Keys) -> Iterator[pa.RecordBatch]:
    number, sizes, names = keys(batch.column("x"))
    if not len(number):
        return
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + batch.column("first").to_numpy()[of]).astype(np.int32)
    group = number.astype(np.int64) * len(columns.dictionary) + columns.indices.to_numpy()[of]
    order = np.argsort(group, kind="stable")  # so texts and places in them ascend
    group, of, at = group[order], of[order], at[order]
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_text = new_group | np.concatenate([[True], of[1:] != of[:-1]])
    texts, groups = np.flatnonzero(new_text), np.flatnonzero(new_group)
    first = np.searchsorted(texts, groups)  # of each group's texts
    places = pa.ListArray.from_arrays(pa.array(np.append(texts, len(at)), pa.int32()), pa.array(at))
    to = pa.array(np.append(first, len(texts)), pa.int32())
    hashes = pa.ListArray.from_arrays(to, batch.column("hash").take(pa.array(of[texts])))
    told, column = np.divmod(group[groups], len(columns.dictionary))
    n = pa.array(np.diff(np.append(groups, len(at))), pa.int64())
    yield pa.RecordBatch.from_arrays([names.take(pa.array(told)), columns.dictionary.take(pa.array(column)), n, hashes, pa.ListArray.from_arrays(to, places)], [key, "column", "n", "hashes", "places"])


def unpack(rows: DataFrame, key: str) -> DataFrame:
    """hash, column, position, key and bucket: a row for each occurrence."""
    texts = rows.select("column", key, "bucket", F.explode(F.arrays_zip("hashes", "places")).alias("t"))
    return texts.select(F.col("t.hashes").alias("hash"), "column", F.explode("t.places").alias("position"), key, "bucket")


def without(rows: DataFrame, out: DataFrame, key: str, most: int = 4_000_000) -> DataFrame:
    """Packed rows without the texts of some keys (hash). They are read by all tasks if there are not more than `most` (of 64 letters, 256 MB), and joined else.

    Where they are read, rows are looked through as they are packed; a join has a row for each text of each key, many times what is packed.
    """
    out = out.select("hash").distinct()
    if out.count() <= most:
        return _looked_through(rows, out, key)
    texts = rows.select(key, "column", "bucket", F.explode(F.arrays_zip("hashes", "places")).alias("t")).select(key, "column", "bucket", F.col("t.hashes").alias("hash"), F.col("t.places").alias("own"))
    left = texts.join(out, "hash", "left_anti")
    kind = left.schema["hash"].dataType.simpleString()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a key that follow each other are one again."""
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in (key, "column")]
            new = np.concatenate([[True], (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])
            groups, own = np.flatnonzero(new), batch.column("own")
            to = pa.array(np.append(groups, batch.num_rows), pa.int32())
            n = np.add.reduceat(_sizes(own), groups)
            some = [batch.column(c).take(pa.array(groups)) for c in (key, "column")]
            yield pa.RecordBatch.from_arrays([*some, pa.array(n, pa.int64()), pa.ListArray.from_arrays(to, batch.column("hash")), pa.ListArray.from_arrays(to, own), batch.column("bucket").take(pa.array(groups))], [key, "column", "n", "hashes", "places", "bucket"])

    return left.select(key, "column", "hash", "own", "bucket").mapInArrow(again, stored(key, kind))


def _looked_through(rows: DataFrame, out: DataFrame, key: str) -> DataFrame:
    import pyarrow.compute as pc

    names = [key, "column", "n", "hashes", "places", "bucket"]
    kind, known = rows.schema["hashes"].dataType.elementType.simpleString(), out.toArrow().column("hash").combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dead = shared.value
        for batch in batches:
            hashes, places = batch.column("hashes"), batch.column("places")
            stays = pc.invert(pc.is_in(hashes.flatten(), value_set=dead))
            ends = np.concatenate([[0], np.cumsum(_sizes(hashes))])
            to = np.concatenate([[0], np.cumsum(stays.to_numpy(zero_copy_only=False))])[ends].astype(np.int32)
            own = places.flatten().filter(stays)
            n = np.diff(np.concatenate([[0], np.cumsum(_sizes(own))])[to])
            made = [batch.column(key), batch.column("column"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(to), hashes.flatten().filter(stays)), pa.ListArray.from_arrays(pa.array(to), own), batch.column("bucket")]
            yield pa.RecordBatch.from_arrays(made, names).filter(pa.array(np.diff(to) > 0))

    return rows.select(*names).mapInArrow(run, stored(key, kind))


@contextmanager
def _set(spark: SparkSession, values: dict[str, int]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write(rows: DataFrame, path: str, buckets: int) -> None:
    """Adds packed rows to the folders of their buckets at a path. A file for each bucket is open at once, so that rows need not be sorted by it first."""
    with _set(rows.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": buckets + 1, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}):
        rows.write.mode("append").options(**OPTIONS).partitionBy("bucket").parquet(path)


def each(texts: DataFrame, columns: tuple[str, ...], made: Callable[[Column], Column]) -> DataFrame:
    """hash, column, first and x, which is made from the text, for each column of texts; null texts are empty."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), made(F.coalesce(F.col(c), F.lit(""))).alias("x")) for c in columns]))
    return texts.select("hash", x.alias("s")).select("hash", "s.column", F.lit(0).alias("first"), "s.x")
