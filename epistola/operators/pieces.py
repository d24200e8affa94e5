"""An index of the middles of words: a row for each three letters in a row of some short fields, with where they stand.

A value of three letters or more is covered by pieces of three that overlap or touch; a field holds the value where it has them
all at the same displacement. Of all covers the one with the fewest rows is taken, and its rarest piece comes first. So no text
is read by a search, and nothing has to be looked at again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epistola.functions.text import fold, fold_text, has_part, spellings
from epistola.operators import packed

#: Letters of a piece, and the fields that have some.
SIZE = 3
COLUMNS = ("subject", "sender", "recipients", "attachment_names")
SCHEMA = "hash {hash}, column string, position int, piece string, bucket int"
COUNTS = "piece string, n long"


def bucket_of(piece: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(buckets)).cast("int")


def occurrences(texts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """hash, column, position and piece; null texts and those of fewer letters have none. What the index has, from its definition."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), fold(F.coalesce(F.col(c), F.lit(""))).alias("text")) for c in columns]))
    rows = texts.select("hash", each.alias("x")).select("hash", "x.column", "x.text").where(F.length("text") >= SIZE)
    # Letters are laid beside those that follow, as a letter of a text is only found by going through it.
    letters = F.split("text", "")
    beside = lambda left, k: F.zip_with(left, F.slice(letters, k, F.length("text")), lambda a, b: F.concat(a, b))
    found = F.slice(beside(beside(letters, 2), 3), 1, F.length("text") - SIZE + 1)
    return rows.select("hash", "column", F.posexplode(found).alias("position", "piece"))


def _keys(x: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    texts = x.to_pylist()
    sizes = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)) - SIZE + 1, 0)
    # Two letters that are none between texts: no piece runs over them.
    letters = np.frombuffer("".join(t + "\0" * (SIZE - 1) for t in texts if len(t) >= SIZE).encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(letters):
        return np.empty(0, np.int64), sizes, pa.array([], pa.string())
    ends = np.cumsum(sizes[sizes > 0] + 2 * (SIZE - 1))
    code = (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]
    inner = np.ones(len(letters), bool)
    for k in range(1, 2 * (SIZE - 1) + 1):
        inner[ends - k] = False
    found, number = np.unique(code[inner[:-2]], return_inverse=True)
    names = np.stack([found >> 42, (found >> 21) & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return number, sizes, pa.array([names[i : i + SIZE] for i in range(0, len(names), SIZE)], pa.string())


def build(texts: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, buckets: int = 64, parts: int | None = None) -> None:
    """Adds the pieces of texts (hash and the columns) to the rows at a path, clustered by piece. parts: tasks at most that texts are read in."""
    rows = packed.pack(packed.each(texts if parts is None else texts.coalesce(parts), columns, fold), "piece", _keys)
    packed.write(rows.withColumn("bucket", bucket_of(F.col("piece"), buckets)), path, buckets)


def count(rows: DataFrame, path: str) -> None:
    """Adds how often each piece is there: a row a piece. rows: occurrences, or packed rows."""
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    rows.groupBy("piece").agg(n.alias("n")).repartition(1).sortWithinPartitions("piece").write.mode("append").parquet(path)


def cover(value: str, counts: dict[str, int]) -> list[int]:
    """Offsets of pieces that leave no letter of the value out, with the fewest rows in all; the rarest first."""
    last = len(value) - SIZE
    best: list[tuple[int, int]] = []  # rows up to an offset, and the offset before it
    for i in range(last + 1):
        before = [(best[j][0], j) for j in range(max(0, i - SIZE), i)] if i else [(0, -1)]
        rows, j = min(before)
        best.append((rows + counts.get(value[i : i + SIZE], 0), j))
    out, at = [], last
    while at >= 0:
        out.append(at)
        at = best[at][1]
    return sorted(out, key=lambda i: (counts.get(value[i : i + SIZE], 0), i))


class Pieces:
    """An index to search in."""

    def __init__(self, rows: DataFrame, counts: DataFrame, buckets: int = 64):
        """counts: at least as many rows as each piece has."""
        self.rows, self.counts, self.buckets = rows, counts, buckets

    @classmethod
    def at(cls, spark: SparkSession, path: str, hash_type: str, buckets: int = 64) -> Pieces:
        """An index whose rows and counts are two folders below a path."""
        return cls(packed.unpack(spark.read.schema(packed.stored("piece", hash_type)).parquet(f"{path}/rows"), "piece"), spark.read.schema(COUNTS).parquet(f"{path}/counts"), buckets)

    def _count(self, values: list[str]) -> dict[str, int]:
        """How many rows each piece of some values has: a handful of rows of a small table."""
        asked = sorted({v[i : i + SIZE] for v in values for i in range(len(v) - SIZE + 1)})
        found = self.counts.where(F.col("piece").isin(asked)).groupBy("piece").agg(F.sum("n").alias("n"))
        return {r["piece"]: r["n"] for r in found.collect()}

    def _holds(self, value: str, column: str, counts: dict[str, int]) -> DataFrame | None:
        offsets = cover(value, counts)
        if not counts.get(value[offsets[0] : offsets[0] + SIZE]):
            return None
        found = None
        for at in offsets:
            piece = value[at : at + SIZE]
            rows = self.rows.where((F.col("bucket") == bucket_of(F.lit(piece), self.buckets)) & (F.col("piece") == piece) & (F.col("column") == column))
            own = rows.select("hash", (F.col("position") - at).alias("start"))
            found = own if found is None else found.join(own, ["hash", "start"], "left_semi")
        return found.select("hash")

    def answers(self, value: str, column: str) -> bool:
        """Whether `find` knows all texts that contain the value."""
        return True

    def find(self, value: str, column: str) -> DataFrame:
        """Keys, perhaps more than once, of texts whose column contains the value in any spelling of three letters or more."""
        asked = [fold_text(v) for v in spellings(value) if len(v) >= SIZE]
        counts = self._count(asked) if asked else {}
        found = [x for x in (self._holds(v, column, counts) for v in asked) if x is not None]
        return reduce(DataFrame.unionAll, found) if found else self.rows.select("hash").where(F.lit(False))


class Values:
    """An index of fields that are lists of values, or whose values are in many texts: each different value is in pieces once, by a number of its own, and the rows that have it are joined."""

    #: What stands between the values of a text.
    BETWEEN = ", "

    def __init__(self, column: str, values: DataFrame, links: DataFrame, index: Callable[[DataFrame], Pieces], single: bool = False, most: int = 50_000):
        """values: the column, with each value at least once. links: hash and the column, a row for each value of a text. index: makes an index of hash and the column.

        single: whether a text has one value. Values that are found are read by all tasks if there are not more than `most`, and joined else.
        """
        self.column, self.links, self.single, self.most = column, links, single, most
        self.values = values.where(F.col(column).isNotNull()).select(column).distinct().select(F.xxhash64(column).alias("hash"), column)
        self.index = index(self.values)

    def answers(self, value: str, column: str) -> bool:
        """A value with a letter of what stands between may lie over two of them: the texts have to be asked."""
        return column == self.column and (self.single or not any(c in fold_text(v) for v in spellings(value) for c in self.BETWEEN))

    def find(self, value: str, column: str) -> DataFrame:
        """Keys, perhaps more than once, of texts with a value that contains this one."""
        test = reduce(lambda a, b: a | b, (has_part(fold(F.col(column)), v) for v in spellings(value)))
        # Two values may have one number, so those that are found are looked at.
        found = self.values.join(self.index.find(value, column), "hash", "left_semi").where(test).select(column)
        found = F.broadcast(found) if found.count() <= self.most else found
        return self.links.join(found, column, "left_semi").select("hash")
