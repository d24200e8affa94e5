"""Ranked lexical search over an index of document shards.

A shard is a row: a megabyte of documents, the terms in them in order, and for each term the documents that hold it with
whole-number impacts (compressed sparse rows). Impacts need the mean length of all documents, so shards are counted first and
then given their impacts; the weight of a term is that of the dictionary of all shards.

A search takes a bounded block of items at a time to all shards. In a shard each item's terms are added one after the other to
a dense array of scores; a task keeps an item's best documents over all its shards, and the best of tasks are merged by item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from epistola.llm._store import keep, partitions, texts

#: Characters of text from which a shard is full, terms that a task sums at a time for the dictionary, and terms of items in a block of a search.
SHARD, SUMMED, BLOCK = 1 << 20, 200_000, 200_000
#: Bytes that are no part of a term become blanks, A to Z lower case; all bytes from 128 on belong to terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SHARD = "ids binary, known binary, lengths binary, terms binary, ends binary, starts binary, slots binary, values binary, n long, words long"
_NAMES = [x.split()[0] for x in _SHARD.split(", ")]


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order; none of a null."""
    return (text or "").encode("utf-8", "replace").translate(_TERM).split()


def _pack(ids: list, known: list[bool], words: list[list[bytes]]) -> tuple:
    """A shard of documents as one row: documents, ordered terms, and for each term its documents' slots with how often they hold it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = [t for own in words for t in own]
    vocabulary = sorted(set(flat))
    number = {t: i for i, t in enumerate(vocabulary)}
    at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    keys, counts = np.unique(at * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(vocabulary) + 1) * len(ids))
    ends = np.cumsum(np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)))
    return (np.array(ids, np.int64).tobytes(), np.array(known, bool).tobytes(), lengths.tobytes(), b"".join(vocabulary), ends.tobytes(), starts.tobytes(), (keys % len(ids)).astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), int((lengths > 0).sum()), int(lengths.sum()))


def _batch(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], _NAMES)


def _shards(docs: DataFrame, size: int) -> DataFrame:
    """Documents of a task, in shards. Those without a term are in them too, with no posting."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, words, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids.append(doc or 0)
                known.append(doc is not None)
                words.append(terms(text))
                held += len(text or "")
                if held >= size:
                    yield _batch(_pack(ids, known, words))
                    ids, known, words, held = [], [], [], 0
        if ids:
            yield _batch(_pack(ids, known, words))

    return docs.mapInArrow(make, _SHARD)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Shards one by one; their bytes stay where the batch has them."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: (x.as_buffer() if pa.types.is_binary(x.type) else x.as_py()) for c, x in zip(batch.schema.names, (column[i] for column in batch.columns))}


@contextmanager
def _few(spark: SparkSession) -> Iterator[None]:
    """For the time of a job, few rows at a time are read from Parquet, as a shard is a large one."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4")
        yield
    finally:
        spark.conf.set(name, before)


def _vocabulary(packed: pa.Buffer, ends: pa.Buffer) -> list[bytes]:
    packed, stops = memoryview(packed).tobytes(), np.frombuffer(ends, np.int64).tolist()
    return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops)]


@dataclass(frozen=True)
class Index:
    """shards: one row each, with impacts. dictionary: term, df, the documents that hold it. n: documents with a term; words: terms of all."""

    shards: DataFrame
    dictionary: DataFrame
    n: int
    words: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> Index:
    """An index of all rows and whole texts. A task holds one shard, so a text longer than a shard is a shard of its own.

    Null and empty texts, and those without a letter or digit, have no terms and are never found. Rows that repeat are
    documents each. A null id is kept as such. Other columns, whatever they are called, are not looked at.
    """
    counted, _ = keep(_shards(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shard), "counted", "zstd")
    n, words = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worth = []
            for row in _rows(iter([batch])):
                lengths, slots = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["slots"], np.int32)
                worth.append(impacts(np.frombuffer(row["values"], np.int32).astype(np.int64), lengths[slots], n, words).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(worth, pa.binary()) if c == "values" else batch.column(c) for c in _NAMES], _NAMES)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms with their documents, summed over shards of a task while they are few."""
        sums: dict[bytes, int] = {}
        told = lambda: pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.binary()), pa.array(sums.values(), pa.int64())], ["term", "df"])
        for row in _rows(batches):
            df = np.diff(np.frombuffer(row["starts"], np.int64)).tolist()
            for term, x in zip(_vocabulary(row["terms"], row["ends"]), df):
                sums[term] = sums.get(term, 0) + x
            if len(sums) >= SUMMED:
                yield told()
                sums.clear()
        yield told()

    with _few(docs.sparkSession):
        weighed, _ = keep(counted.mapInArrow(weigh, _SHARD), "index", "zstd")
        dictionary = weighed.select("terms", "ends", "starts").mapInArrow(held, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        return Index(weighed, keep(dictionary, "dictionary")[0], n, words)


def impacts(tf: np.ndarray, length: np.ndarray, n: int, words: int) -> np.ndarray:
    """What an occurrence count is worth in a document of that many terms: below a million, in whole numbers."""
    m = 25 + (75 * length * n) // words
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, highest first, equal ones by id, nulls first: all that equal the last of k are looked at."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
        at = at[own >= least]
    return at[np.lexsort((ids[at], known[at], -scores[at]))][:k]


def _items(index: Index, items: DataFrame) -> DataFrame:
    """number, term, times and df of each item's terms, those that no document has left out. number tells rows of items apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                own: dict[bytes, int] = {}
                for t in terms(text):
                    own[t] = own.get(t, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["number", "term", "times"])

    asked = items.select("number", "text").mapInArrow(cut, "number long, term binary, times long")
    return asked.join(index.dictionary, "term")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents above 0; equal scores by ascending doc_id, a null id first.

    Items of a block reach all tasks by one broadcast of at most `block` terms, but for a last item that has more; each block is
    a pass over the index, not over the texts. Items without a term, with none that a document holds, or null, have no rows;
    items that repeat are answered each.
    """
    spark = items.sparkSession
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    numbered, _ = keep(own.withColumn("number", F.monotonically_increasing_id()), "items")
    asked, _ = keep(_items(index, numbered), "asked")
    found, n = [], index.n
    for part in _blocks(asked, block):
        shared = spark.sparkContext.broadcast(part)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = [(number, [(t, times * weight(df, n)) for t, times, df in own]) for number, own in shared.value]
            empty = (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)
            top = {number: empty for number, _ in queries}
            for row in _rows(batches):
                ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
                number_of = {t: i for i, t in enumerate(_vocabulary(row["terms"], row["ends"]))}
                starts, slots, values = np.frombuffer(row["starts"], np.int64).tolist(), np.frombuffer(row["slots"], np.int32), np.frombuffer(row["values"], np.int32).astype(np.int64)
                scores = np.zeros(len(ids), np.int64)
                for number, own in queries:
                    scores[:] = 0
                    for term, w in own:
                        i = number_of.get(term)
                        if i is not None:
                            scores[slots[starts[i] : starts[i + 1]]] += w * values[starts[i] : starts[i + 1]]
                    at = best(scores, ids, known, k)
                    if len(at):
                        s, d, h = (np.concatenate(x) for x in zip(top[number], (scores[at], ids[at], known[at])))
                        at = best(s, d, h, k)
                        top[number] = s[at], d[at], h[at]
            for number, (s, d, h) in top.items():
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(s), pa.int64()), pa.array(d, mask=~h), pa.array(s)], ["number", "doc_id", "score"])

        with _few(spark):
            found.append(keep(index.shards.mapInArrow(look, "number long, doc_id long, score long"), "found")[0])
        shared.unpersist()
    if not found:
        found = [spark.createDataFrame([], "number long, doc_id long, score long")]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _blocks(asked: DataFrame, block: int) -> Iterator[list[tuple]]:
    """Items with their terms, some at a time: rows come to the driver by ranges of items that hold a bounded number of terms."""
    sizes = asked.groupBy("number").agg(F.count(F.lit(1)).alias("size"))
    ranged = sizes.repartitionByRange(max(1, partitions(asked.sparkSession)), "number").sortWithinPartitions("number")
    low, held, last = None, 0, None
    bounds = []
    for row in ranged.toLocalIterator():  # two numbers an item
        if low is None or held + row["size"] > block:
            if low is not None:
                bounds.append((low, last))
            low, held = row["number"], 0
        held, last = held + row["size"], row["number"]
    if low is not None:
        bounds.append((low, last))
    for a, b in bounds:
        own: dict[int, list] = {}
        for r in asked.where(F.col("number").between(a, b)).toLocalIterator():
            own.setdefault(r["number"], []).append((bytes(r["term"]), r["times"], r["df"]))
        yield sorted(own.items())


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item, by an index made for it. See build and search for odd rows."""
    return search(build(docs), items, k)
