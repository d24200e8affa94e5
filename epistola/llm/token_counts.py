"""Token counts by the whole-token shortcut.

Which strings of the vocabulary come out of the merges as one token is proved once, on the driver, by running the
merges on each of them. While counting, a pre-token among the proved strings is one token; only the others are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from epistola.llm._store import Cache, texts, worker_cache

#: The pre-token pattern of byte-level BPE, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Two white-space characters side by side, or at the ends of pieces cut at blanks.
_RUNS = re.compile(r"\s\s")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that the byte-level vocabulary is written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def prove_whole(tokenizer: Tokenizer) -> frozenset[str]:
    """The vocabulary strings that the merges turn into exactly one token, with that string's own id, when they stand alone."""
    model, special = tokenizer.model, {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    proved = set()
    for text, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if text not in special:
            made = model.tokenize(text)
            if len(made) == 1 and made[0].id == number:
                proved.add(text)
    return frozenset(proved)


class _Counts(Cache):
    """Tokens of each piece of text; what is missing is worked out."""

    def __init__(self, vocabulary: str, proved: frozenset[str], most: int = 250_000):
        super().__init__(most)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model, self.proved = self.tokenizer.model, proved
        self.letters = {b: s for b, s in byte_letters().items()}
        self.find = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> int:
        n = 0
        for token in self.find(piece):
            coded = "".join(map(self.letters.__getitem__, token.encode()))
            n += 1 if coded in self.proved else len(self.model.tokenize(coded))
        return self.put(piece, n)

    def of(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _RUNS.search(text):  # blanks join with their neighbours, so the whole text is cut by the pattern
            return sum(map(self.__getitem__, self.find(text)))
        # Each piece begins at a blank; no pre-token crosses such a point.
        first, *rest = text.split(" ")
        return (self[first] if first else 0) + sum(map(self.__getitem__, map(" ".__add__, rest)))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, as the tokenizers library counts.

    vocabulary: the path of a byte-level BPE file on the driver. Special strings in a text are special tokens, as is the
    library's default. A null or empty text has no tokens; rows that repeat are counted each; no rows give no rows.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        source = file.read()
    shared = spark.sparkContext.broadcast((source, prove_whole(Tokenizer.from_str(source))))  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_cache(("token-counts", hash(shared.value[0])), lambda: _Counts(*shared.value))
        for batch in batches:
            n = [counts.of(t) if t else 0 for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
