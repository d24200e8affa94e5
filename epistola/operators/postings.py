"""A word index: a row for each word of some texts, clustered so that a search reads the few files its word can be in.

Texts are folded and cut into words once, when the index is built. A word or the front of one is a range of tokens, which
Parquet's statistics find in sorted files; words in a row are joined by their places. Texts are not read by a search.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epistola.functions.text import WORD, fold, fold_map, spellings, words
from epistola.operators import packed

#: Letters of a token by which it is put in a bucket: the front of a word that is at least so long is in one bucket.
HEAD = 3
SCHEMA = "hash {hash}, column string, position int, token string, bucket int"


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, HEAD)), F.lit(buckets)).cast("int")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"[{WORD}]+"), F.lit(0))


def by_text(texts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """hash, column, first and x, the words in their order, for each column of texts."""
    return packed.each(texts, columns, tokens)


def _unfolded(text: Column) -> Column:
    """Words of a text in lower case. Folding changes a letter for a letter, so it can follow, once for each different word."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))


def occurrences(texts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """hash, column, position and token of each word; null and empty texts have none."""
    return by_text(texts, columns).select("hash", "column", F.posexplode("x").alias("position", "token"))


def build(texts: DataFrame, path: str, columns: tuple[str, ...], buckets: int = 64) -> None:
    """Adds the words of texts (hash and the columns) to the index at a path."""
    write(packed.each(texts, columns, _unfolded), path, buckets)


def count_words(column: str) -> Column:
    """How many words a text has for the index."""
    return F.size(tokens(F.coalesce(F.col(column), F.lit(""))))


def _keys(x: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words, marks = x.flatten().dictionary_encode(), str.maketrans(*fold_map())
    folded = pa.array([w if w.isascii() else w.translate(marks) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    order = pc.sort_indices(folded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[folded.indices.to_numpy()][words.indices.to_numpy()], pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), folded.dictionary.take(pa.array(order))


def write(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds words (hash, column, first and x, the words from that place on) to the index at a path."""
    rows = packed.pack(rows, "token", _keys)
    packed.write(rows.withColumn("bucket", bucket_of(F.col("token"), buckets)), path, buckets)


class Postings:
    """An index to search in."""

    def __init__(self, rows: DataFrame, buckets: int = 64):
        self.rows, self.buckets = rows, buckets

    @classmethod
    def at(cls, spark: SparkSession, path: str, hash_type: str, buckets: int = 64) -> Postings:
        return cls(packed.unpack(spark.read.schema(packed.stored("token", hash_type)).parquet(path), "token"), buckets)

    def _range(self, token: str, whole: bool) -> Column:
        """A word, or all words that begin so; only a bucket's files are read where that is one."""
        test = F.col("token") == token if whole else F.col("token").startswith(token)
        return test & (F.col("bucket") == bucket_of(F.lit(token), self.buckets)) if whole or len(token) >= HEAD else test

    def _phrase(self, tokens: list[str], columns: tuple[str, ...] | None) -> DataFrame:
        rows = self.rows if columns is None else self.rows.where(F.col("column").isin(*columns))
        found = None
        for i, token in enumerate(tokens):
            own = rows.where(self._range(token, i < len(tokens) - 1)).select("hash", "column", (F.col("position") - i).alias("start"))
            found = own if found is None else found.join(own, ["hash", "column", "start"], "left_semi")
        return found.select("hash")

    def find(self, value: str, columns: tuple[str, ...] | None = None) -> DataFrame:
        """Keys, each once, of texts with the words of the value in a row in one column, the last from its front on, in any spelling. No words match nothing."""
        asked = [t for t in map(words, spellings(value)) if t]
        single = [self._range(t[0], False) for t in asked if len(t) == 1]
        rows = self.rows if columns is None else self.rows.where(F.col("column").isin(*columns))
        found = [rows.where(reduce(lambda a, b: a | b, single)).select("hash")] if single else []
        found += [self._phrase(t, columns) for t in asked if len(t) > 1]
        # Each task tells a text once, however often it has the words: a shuffle holds texts and not occurrences.
        return reduce(DataFrame.unionAll, found).distinct() if found else self.rows.select("hash").where(F.lit(False))
