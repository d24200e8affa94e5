"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over at most SPAN words in a row that looks at some of them only, so a changed word in a gap does
not hide a copied passage. The masks are all that the end of a stretch can have: there, of any number of last words, more
are equal than not, so whatever the verification would accept is hit by one of them. Hashes of all masked windows of the benchmark are joined with those of every document; where they
meet, document and item are laid side by side, and the stretch around the hit is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from epistola.llm._store import Cache, texts, worker_cache


def end_masks(weight: int) -> tuple[str, ...]:
    """All ends of a stretch from its equal word number `weight` from the last on: of any last words of it, more are equal than not."""
    found, ends = [], [("1", 1)]  # with equal less unequal words
    while ends:
        mask, over = ends.pop()
        if mask.count("1") == weight:
            found.append(mask)
        else:
            ends += [("1" + mask, over + 1)] + [("0" + mask, over - 1)] * (over > 1)
    return tuple(sorted(found))


#: Words that a mask looks at, or as many as a shorter item has to have equal.
WEIGHT = 4
MASKS = end_masks(WEIGHT)
SPAN = 2 * WEIGHT - 2
#: Words of the benchmark that are held by a task at a time; a larger benchmark takes more passes.
BLOCK_WORDS = 500_000
#: Hits that are looked at together.
AT_ONCE = 1 << 15
#: A stretch counts with so many equal words, or with this share of a shorter item.
LEAST_WORDS, LEAST_SHARE = 13, 0.8

_FACTORS = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(SPAN)], np.uint64)
_BITS = 22


class Words(Cache):
    """A 64-bit hash of the letters and digits, in lower case, of a stretch of text without white space; 0 if it has none."""

    def __missing__(self, chunk: str) -> int:
        word = chunk.lower()
        if not word.isalnum():
            word = "".join(filter(str.isalnum, word))
        return self.put(chunk, xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) | 1 if word else 0)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return found[found != 0]


def _words() -> Words:
    return worker_cache("decontamination", Words)


def least_equal(n: int) -> int:
    """Equal words that a stretch of an item of n words has to have."""
    return next(k for k in range(1, max(2, n + 1)) if k >= min(LEAST_WORDS, max(1, LEAST_SHARE * n)))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n words: each stretch that counts is hit by one of them."""
    return tuple(m for m in (MASKS if least_equal(n) >= WEIGHT else end_masks(least_equal(n))) if len(m) <= n)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window under a mask; none if there are fewer words than the mask is long."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, int(mask, 2) + (len(mask) << 16), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += words[k : k + n] * _FACTORS[k]
    return (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


class Index:
    """The seeds of some benchmark items. A seed stands for the end of a stretch, so those that have too few words before them are left out."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words = [_words().of(t) for _, t in items]
        self.flat = np.concatenate([*words, np.empty(0, np.uint64)])
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.masks = sorted({m for w in words for m in masks_of(len(w))})
        self.least = np.array([least_equal(len(w)) for w in words], np.int64)
        keys, item, at = [], [], []
        for n, own in enumerate(words):
            for mask in masks_of(len(own)):
                found = seeds(own, mask)
                skip = max(0, int(self.least[n]) - len(mask))
                keys.append(found[skip:])
                item.append(np.full(len(found[skip:]), n, np.int32))
                at.append(np.arange(skip, skip + len(found[skip:]), dtype=np.int32))
        keys, item, at = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((keys, np.uint64), (item, np.int32), (at, np.int32)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], item[order], at[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _BITS)] = True

    def _hits(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of an item and how far it is moved against the document, as one number each, some at a time."""
        for mask in self.masks:
            own = seeds(words, mask)
            at = np.flatnonzero(self.maybe[own >> np.uint64(64 - _BITS)])
            low = np.searchsorted(self.keys, own[at], "left")
            real = self.keys[np.minimum(low, len(self.keys) - 1)] == own[at] if len(at) else np.empty(0, bool)
            if not real.any():
                continue
            at, low = at[real], low[real]
            high = np.searchsorted(self.keys, own[at], "right")
            for part in slices(high - low, AT_ONCE):
                lo, n = low[part], (high - low)[part]
                hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                if len(hit):
                    yield np.unique((self.item[hit].astype(np.int64) << 40) + (np.repeat(at[part], n) - self.at[hit] + (1 << 32)))

    def _enough(self, lines: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The lines on which an item has enough words equal to the document's, wherever they stand: all items that share a window are laid beside the document at once."""
        item, shift = lines >> 40, (lines & ((1 << 40) - 1)) - (1 << 32)
        ok = np.zeros(len(lines), bool)
        for part in slices(self.size[item], 8 * AT_ONCE):
            i, s = item[part], shift[part]
            k = np.arange(int(self.size[i].max(initial=0)))
            place = s[:, None] + k
            inside = (k < self.size[i][:, None]) & (place >= 0) & (place < len(words))
            same = self.flat[np.minimum(self.first[i][:, None] + k, len(self.flat) - 1)] == words[np.clip(place, 0, len(words) - 1)]
            ok[part] = (same & inside).sum(axis=1) >= self.least[i]
        return lines[ok]

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """Item, first word in the document, words of the stretch, equal words, words of the item: the best stretch of each item that counts, the first of equal ones."""
        words = _words().of(text)
        lines = [self._enough(x, words) for x in self._hits(words)]
        best: dict[int, tuple[int, int, int, int]] = {}
        for line in np.unique(np.concatenate(lines)).tolist() if lines else []:
            item, shift = line >> 40, (line & ((1 << 40) - 1)) - (1 << 32)
            first = max(0, -shift)
            own = self.flat[self.first[item] : self.first[item] + self.size[item]]
            start, size, n = stretch(own[first : len(words) - shift] == words[max(0, shift) : shift + len(own)])
            if n >= self.least[item] and n > best.get(item, (0, 0, 0))[2]:
                best[item] = (first + shift + start, size, n, len(own))
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of about `most` in all, or of one larger part."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield slice(start, stop)
        start = stop


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal words of the stretch with most equal less unequal words: the largest sum of a run."""
    if not len(equal):
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    gain = total - np.minimum.accumulate(total)
    end = int(np.argmax(gain))
    start = int(np.argmin(total[: end + 1]))
    return start, end - start, int(equal[start:end].sum())


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items, each of about BLOCK_WORDS at most. Items without a word are in none; equal ids each keep their text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = 1 if total <= BLOCK_WORDS else 2 * -(-total // BLOCK_WORDS)
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield Index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()])  # a block


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_span, n_matched, n_words: a row for each document and item with a verified overlap.

    An overlap is a stretch, with substitutions, that has at least LEAST_WORDS equal words, or LEAST_SHARE of those of a
    shorter item; the one with most equal words of an item is returned, and of equal ones the first. Null and empty texts
    have none, and very long ones are searched whole; rows that repeat are searched each. A benchmark without a word gives no
    rows; items of one id are searched each.
    """
    out = None
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))) for x in shared.value.overlaps(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start", "n_span", "n_matched", "n_words"])

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, item_id long, start long, n_span long, n_matched long, n_words long")
        out = own if out is None else out.unionAll(own)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text overlaps no item, with all their columns."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = texts(batch.column(batch.schema.get_field_index(text_col)))
                yield batch.filter(pa.array([not shared.value.overlaps(t) for t in own], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
