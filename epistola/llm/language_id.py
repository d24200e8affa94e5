"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters in a row is the product of the first rotated
twice, the second rotated once, and the third. A text's vector is the sum of those of its trigrams; a language's prototype
is the sum over its training texts. A text has the language whose prototype lies at the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from epistola.llm._store import texts

DIMENSIONS = 1024
LETTERS = 64
UNKNOWN = "und"
#: Trigrams and texts that are worked on at a time.
CODES, TEXTS = 4096, 64
#: Labels that a task counts at a time, 2 MB each.
LABELS = 16
#: Cosines that differ by no more are equal: they are sums of 32-bit numbers.
TIE = 1e-6


class Space:
    """The random vectors, which follow from a seed, and the symbols of characters: 0 is any run of other characters."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))
        self.third, self.second, self.first = letters, np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
        self.symbols = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            if chr(i).isalpha():  # a to z have symbols of their own, the others share the rest
                self.symbols[i] = i - 96 if 97 <= i <= 122 else 27 + i % (LETTERS - 27)

    def trigrams(self, text: str | None) -> np.ndarray:
        """The codes of all trigrams of the lower-cased text, with a blank on either side; none if it has no letter."""
        s = self.symbols[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)]
        if not s.any():
            return np.empty(0, np.int64)
        s = np.concatenate([[0], s, [0]]).astype(np.int64)
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one blank for each run
        return (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return (self.first[codes // LETTERS**2] * self.second[codes // LETTERS % LETTERS] * self.third[codes % LETTERS]).astype(np.float32)

    def bundle(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each list of codes with their counts; memory is bounded by CODES."""
        out = np.zeros((len(counts), self.third.shape[1]), np.float32)
        if not counts:
            return out
        every = np.unique(np.concatenate([c for c, _ in counts]))
        table = np.zeros((len(counts), len(every)), np.float32)
        for row, (codes, n) in zip(table, counts):
            row[np.searchsorted(every, codes)] = n
        for i in range(0, len(every), CODES):
            out += table[:, i : i + CODES] @ self.vectors(every[i : i + CODES])
        return out


_space: list[Space] = []


def space() -> Space:
    if not _space:
        _space.append(Space())
    return _space[0]


def train(docs: DataFrame, label: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """A prototype of unit length for each label, from all rows with a label.

    Trigrams are counted in each task, and the counts summed by label and code: at most labels * LETTERS**3 of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = space(), {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, n in totals.items():
                codes = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n[codes], pa.int64())], ["label", "code", "n"])
            totals.clear()

        for batch in batches:
            for text, name in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                codes = own.trigrams(text)
                if len(codes):
                    if name not in totals:
                        if len(totals) >= LABELS:  # so that many labels do not fill a task
                            yield from told()
                        totals[name] = np.zeros(LETTERS**3, np.int64)
                    codes, n = np.unique(codes, return_counts=True)
                    totals[name][codes] += n
        yield from told()

    rows = docs.where(F.col(label).isNotNull()).select(F.col(text_col).alias("text"), F.col(label).cast("string").alias("label"))
    summed = rows.mapInArrow(count, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("label").agg(F.collect_list(F.struct("code", "n")).alias("c")).orderBy("label").toLocalIterator()  # bounded by the letters
    made = {}
    for row in packed:
        pairs = np.array([(x["code"], x["n"]) for x in row["c"]], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        vector = space().bundle([(pairs[:, 0], pairs[:, 1].astype(np.float32))])[0]
        made[row["label"]] = vector / max(float(np.linalg.norm(vector)), 1e-9)
    return made


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to the rows.

    Texts that are null or without a letter get `und` and 0, as does every text where there are no prototypes. The score is
    the cosine with the nearest prototype, at least 0; of equal cosines the first name wins. Columns of docs that are
    called lang_pred or score are replaced; rows that repeat are predicted each.
    """
    names = sorted(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.array([prototypes[n] for n in names], np.float32)))  # a vector a language
    docs = docs.drop("lang_pred", "score")
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        own = space()
        for batch in batches:
            column, found, scores = batch.column(batch.schema.get_field_index(text_col)), [], []
            for i in range(0, batch.num_rows, TEXTS):
                codes = [np.unique(own.trigrams(t), return_counts=True) for t in texts(column.slice(i, TEXTS))]
                rows = own.bundle(codes)
                for (c, _), row in zip(codes, rows):
                    if not len(c) or not names:
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    cosines = vectors @ row / max(float(np.linalg.norm(row)), 1e-9)
                    best = int(np.argmax(cosines >= cosines.max() - TIE))
                    found.append(names[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tell, schema)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text has that remainder; a null key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the rows that are not held out.

    Null and empty texts, and those without a letter, are `und` with a score of 0, as is every text where no row to learn from
    has a lang; very long texts are told whole. Of languages with equal cosines the first name wins; rows that repeat give a
    row each, and no rows none. A null doc_id is not held out. Other columns, whatever they are called, are not read.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    prototypes = train(docs.where(~out))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


#: Cosine below which a text is as near to a prototype as one of random letters may be: four times what unrelated vectors have by chance.
CHANCE = 4 / DIMENSIONS**0.5


def keep_known(docs: DataFrame, least: float = CHANCE) -> DataFrame:
    """The documents whose language can be told: not `und`, and a cosine of at least `least` with a prototype learned from docs.

    Columns of docs keep their names and values, whatever they are called. Null and empty texts, and those without a letter,
    go; so does every document where none has a lang to learn from. Rows that repeat are told each; no rows give no rows.
    """
    columns = docs.columns
    prototypes = train(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    own = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(columns)])
    told = predict(own, prototypes, f"c_{columns.index('text')}")
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(columns)])
