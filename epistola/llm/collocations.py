"""Collocations of two and three words, by counts in arrays that a minimal perfect hash addresses.

A phrase that is frequent has only frequent parts, so candidates are narrowed before they are counted. First all words and
phrases are counted roughly, in cells of hashes; a cell holds at least what any phrase in it has. Then every phrase is counted whose
own cell and whose parts' cells reach the least count: that is a candidate. Tasks hand on the hashes of those that they have, with
how often they have each and the least number of a document that holds it, its owner. Hashes are dealt out, and those that are
frequent in all go to blocks: each gets a minimal perfect hash with its keys beside it, and an array of counts by its slots.

The words of a phrase are told by its owner alone, so only documents that own one are dealt out. What the parts of a phrase count is
asked of the block that they are in, and all that is asked of a block goes there at once: each is opened by few tasks, however many words
there are. No table of phrases is dealt out for counting, only arrays, and no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType

from epistola.llm import _files
from epistola.llm._store import Filter, drop, keep, new_dir, partitions, texts, worker_cache

#: The least count of a candidate, the words of the longest, the rows of a language, and the share of a longer phrase, in hundredths, from which it stands for its parts.
LEAST, LONGEST, ROWS, COVERED = 10, 3, 2000, 50
#: Cells of the rough counts, least and most, as powers of two; cells of a piece of them; words that are looked at together.
CELLS_LEAST, CELLS_MOST, PIECE, CHUNK = 16, 28, 1 << 16, 1 << 20
#: Keys of a block of candidates, and groups of a language's rows in which they are ranked first.
BLOCK, FAN = 1 << 21, 64
#: Bits of a level of the hash for each key still without a slot, and levels at most.
SPARE, LEVELS = 2, 48
#: Bytes of texts that are cut into words at once, and of a word that is hashed by its bytes' places.
SLICE, LETTERS = 2 << 20, 64
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: 0 a letter of a word, 1 a blank, 2 the end of a piece.
_KIND = np.array([2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTORS[3]
    return x ^ (x >> np.uint64(29))


def language_hash(lang: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), seed=seed + 1)


class Words:
    """The words of some documents in order: their hashes, their pieces, and where they stand in the documents' lower-cased bytes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, seed: int):
        """data: the texts' bytes one after the other; ends: where each ends."""
        kind, self.data = _KIND[data], _LOW[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = np.concatenate([[0], ends[:-1]])
        begins = begins[begins < len(data)]
        first[begins] = inside[begins]
        self.starts = np.flatnonzero(first)
        self.doc = np.searchsorted(ends, self.starts, side="right")
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts] + self.doc
        self.sizes = np.add.reduceat(inside, self.starts, dtype=np.int32) if len(self.starts) else np.empty(0, np.int32)
        self.hashes = self._hashed(self.data[inside], seed)

    def _hashed(self, letters: np.ndarray, seed: int) -> np.ndarray:
        """Sums of a number drawn for each letter at each place of a word; longer words are hashed one by one."""
        if not len(letters):
            return np.empty(0, np.uint64)
        drawn = worker_table(seed)
        begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        at = np.minimum(np.arange(len(letters), dtype=np.int32) - np.repeat(begins, self.sizes), LETTERS - 1)
        out = np.add.reduceat(drawn[(at << 8) | letters], begins)
        for i in np.flatnonzero(self.sizes > LETTERS).tolist():
            out[i] = xxhash.xxh3_64_intdigest(letters[begins[i] : begins[i] + self.sizes[i]].tobytes(), seed=seed)
        return out

    def told(self, at: int, n: int) -> str:
        """n words from one on, with a blank between."""
        return b" ".join(self.data[a : a + size].tobytes() for a, size in zip(self.starts[at : at + n].tolist(), self.sizes[at : at + n].tolist())).decode("utf-8", "replace")


_tables: dict[int, np.ndarray] = {}


def worker_table(seed: int) -> np.ndarray:
    """A number for each letter at each place of a word: 128 KB."""
    if seed not in _tables:
        _tables.clear()
        _tables[seed] = np.random.default_rng(seed).integers(0, 1 << 64, LETTERS << 8, np.uint64)
    return _tables[seed]


def phrases(words: np.ndarray, langs: np.ndarray, n: int) -> np.ndarray:
    """The hash of n words from each place on, with their language; words of other pieces too."""
    size = max(0, len(words) - n + 1)
    total = langs[:size] + np.uint64(n)
    for k in range(n):
        own = words[k : k + size]
        total = total + (own ^ (own >> np.uint64(29))) * _FACTORS[k]
    return _mixed(total)


def whole(piece: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each place on are in one piece."""
    size = max(0, len(piece) - n + 1)
    return piece[:size] == piece[n - 1 : n - 1 + size]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, the bytes of their texts (the second column) and where each ends, some at a time."""
    column = batch.column(1).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, side="right")) - 1)
        yield start, stop, data[ends[start] : ends[stop]], ends[start + 1 : stop + 1] - ends[start]
        start = stop


class Chunk:
    """Words of many documents: hashes, pieces, hashes of languages, which of the `known` languages each is in, and numbers of documents, of 32 bits."""

    def __init__(self, held: list[tuple[Words, list[str], np.ndarray]], seed: int):
        self.held, pieces, last = [w for w, _, _ in held], [], 0
        self.known = sorted({x for _, langs, _ in held for x in langs})
        number, of = {x: i for i, x in enumerate(self.known)}, np.array([language_hash(x, seed) for x in self.known], np.uint64)
        for w, _, _ in held:
            pieces.append(w.piece + last)
            last = int(pieces[-1][-1]) + 1 if len(w.piece) else last  # texts do not run on
        self.words, self.piece = np.concatenate([w.hashes for w in self.held]), np.concatenate(pieces)
        self.which = np.concatenate([np.array([number[x] for x in langs], np.int32)[w.doc] for w, langs, _ in held])
        self.langs, self.numbers = of[self.which], np.concatenate([n[w.doc] for w, _, n in held])
        self.first = np.cumsum([0, *(len(w.hashes) for w in self.held)])

    def told(self, at: np.ndarray, n: int) -> list[str]:
        """The n words from each of some places on."""
        of = np.searchsorted(self.first, at, side="right") - 1
        return [self.held[k].told(i, n) for k, i in zip(of.tolist(), (at - self.first[of]).tolist())]


def _chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Chunk, list[pa.Array]]]:
    """Of rows (lang, text, number, more), CHUNK words at a time, and with them what their rows have more."""
    held, more, size = [], [], 0
    for batch in batches:
        langs, numbers = batch.column(0).to_pylist(), batch.column(2).to_numpy().astype(np.uint32)
        for start, stop, data, ends in _slices(batch):
            held.append((Words(data, ends, seed), langs[start:stop], numbers[start:stop]))
            more += [c.slice(start, stop - start) for c in batch.columns[3:]]
            size += len(held[-1][0].hashes)
            if size >= CHUNK:
                yield Chunk(held, seed), more
                held, more, size = [], [], 0
    if size:
        yield Chunk(held, seed), more


def _cell(hashes: np.ndarray, power: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - power)).astype(np.uint32)


def _rough(docs: DataFrame, powers: list[int], seed: int) -> DataFrame:
    """Rows (level, piece, data) of the cells that a task's words are in, with rough counts up to 255, and rows (lang, n) of its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held = pa.Codec("zstd"), []
        names = ["level", "piece", "data", "lang", "n"]

        def told() -> Iterator[pa.RecordBatch]:
            for n in range(1, len(powers) + 1):
                cells = np.sort(np.concatenate([x[n - 1] for x in held]))
                at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
                counts, cells = np.minimum(np.diff(np.append(at, len(cells))), 255).astype(np.uint8), cells[at]
                ends = np.flatnonzero(np.diff(cells // PIECE, append=np.uint32(1 << 31))) + 1
                data = [_cells_packed(codec, cells[a:b] % PIECE, counts[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
                none = pa.nulls(len(ends))
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(ends), pa.int32()), pa.array((cells[ends - 1] // PIECE).astype(np.int32)), pa.array(data, pa.binary()), none.cast(pa.string()), none.cast(pa.int64())], names)
            held.clear()

        for chunk, _ in _chunks(batches, seed):
            held.append([_cell(phrases(chunk.words, chunk.langs, n)[whole(chunk.piece, n)], power) for n, power in enumerate(powers, 1)])
            if len(held) == 4:
                yield from told()
            none = pa.nulls(len(chunk.known))
            n = np.bincount(chunk.which, minlength=len(chunk.known))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(chunk.known, pa.string()), pa.array(n, pa.int64())], names)
        if held:
            yield from told()

    return docs.mapInArrow(count, "level int, piece int, data binary, lang string, n long")


def _cells_packed(codec: pa.Codec, cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Different cells of a piece in order, as differences, and their counts: as long as there are cells, not as the piece."""
    steps = np.diff(cells.astype(np.uint16), prepend=np.uint16(0))
    plain = (steps & 255).astype(np.uint8).tobytes() + (steps >> 8).astype(np.uint8).tobytes() + counts.tobytes()
    return len(cells).to_bytes(4, "little") + codec.compress(plain, asbytes=True)


def _cells_unpacked(codec: pa.Codec, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    plain = np.frombuffer(codec.decompress(data[4:], decompressed_size=3 * n, asbytes=True), np.uint8).reshape(3, n)
    return np.cumsum(plain[0] + plain[1].astype(np.int32) * 256), plain[2]


def _summed(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """For each piece one bit a cell: whether its rough counts reach the least. A piece has one row from each few chunks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, total = pa.Codec("zstd"), None, np.zeros(PIECE, np.uint16)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in now], pa.array([np.packbits(total >= least).tobytes()], pa.binary())], [*keys, "data"])

        for batch in batches:
            for *key, data in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    if now is not None:
                        yield told()
                    now, total = key, np.zeros(PIECE, np.uint16)
                cells, counts = _cells_unpacked(codec, data)
                total[cells] = np.minimum(total[cells] + counts, 255)
        if now is not None:
            yield told()

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).select(*keys, "data")
    return dealt.mapInArrow(add, ", ".join(f"{k} int" for k in keys) + ", data binary")


class Sieve:
    """A bit for each cell of each level, whether a phrase in it may be frequent: 2 * 2 ** CELLS_MOST bits and an eighth of that at most."""

    def __init__(self, powers: list[int], rows: list):
        self.powers = powers
        self.bits = [np.zeros(1 << max(0, p - 3), np.uint8) for p in powers]
        for r in rows:
            self.bits[r["level"] - 1][r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["data"], np.uint8)

    def passes(self, hashes: np.ndarray, n: int) -> np.ndarray:
        cells = _cell(hashes, self.powers[n - 1])
        return (self.bits[n - 1][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1

    def candidates(self, chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For one word, two and three: places where a phrase begins that may be frequent, as all its parts may, and the hashes there."""
        before = None
        for n in range(1, len(self.powers) + 1):
            own = whole(chunk.piece, n)
            if before is not None:
                own &= before[: len(own)] & before[1 : len(own) + 1]
            at = np.flatnonzero(own)
            hashes = phrases(chunk.words, chunk.langs, n)[at]
            ok = self.passes(hashes, n)
            at, hashes = at[ok], hashes[ok]
            before = np.zeros(len(own), bool)
            before[at] = True
            yield n, at, hashes


#: Candidates: hashes, owners, words and counts.
Counted = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _owned(held: list[Counted]) -> Counted:
    """Different hashes in order, each with its least owner and the sum of its counts."""
    hashes, owners, sizes, counts = (np.concatenate(x) for x in zip(*held))
    if not len(hashes):
        return hashes, owners, sizes, counts
    order = np.argsort(hashes)
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[starts], np.minimum.reduceat(owners[order], starts), sizes[order[starts]], np.add.reduceat(counts[order], starts)


def _seen(docs: DataFrame, shared, bits: int, seed: int) -> DataFrame:
    """Rows (bucket, data) of a task's candidates, by the first bits of their hashes, with owners and counts."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, codec, held, size = shared.value, pa.Codec("zstd"), [], 0

        def told() -> pa.RecordBatch:
            found = _owned(held)
            buckets = _block_of(found[0], bits)
            ends = np.flatnonzero(np.diff(buckets, append=-1)) + 1
            data = [_packed(codec, *(x[a:b] for x in found)) for a, b in zip([0, *ends[:-1]], ends)]
            return pa.RecordBatch.from_arrays([pa.array([int(buckets[e - 1]) for e in ends], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

        for chunk, _ in _chunks(batches, seed):
            for n, at, hashes in sieve.candidates(chunk):
                held.append(_owned([(hashes, chunk.numbers[at], np.full(len(at), n, np.uint8), np.ones(len(at), np.int64))]))
                size += len(held[-1][0])
            if size > 2 * CHUNK:
                held = [_owned(held)]
                size = len(held[0][0])
                if size > 2 * CHUNK:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()

    return docs.mapInArrow(see, "bucket int, data binary")


def _packed(codec: pa.Codec, hashes: np.ndarray, owners: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> bytes:
    """How many there are, then bytes of one weight beside one another, as the high ones of differences and counts are mostly 0."""
    beside = lambda x: x.view(np.uint8).reshape(-1, 8).T.tobytes()
    plain = beside(np.diff(hashes, prepend=np.uint64(0))) + beside(counts) + owners.tobytes() + sizes.tobytes()
    return len(hashes).to_bytes(8, "little") + codec.compress(plain, asbytes=True)


def _unpacked(codec: pa.Codec, data: bytes) -> Counted:
    n = int.from_bytes(data[:8], "little")
    plain = codec.decompress(data[8:], decompressed_size=21 * n, asbytes=True)
    wide = lambda at: np.ascontiguousarray(np.frombuffer(plain, np.uint8, 8 * n, at).reshape(8, n).T)
    return np.cumsum(wide(0).view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(plain, np.uint32, n, 16 * n), np.frombuffer(plain, np.uint8, n, 20 * n), wide(8 * n).view(np.int64).ravel()


def _merged(rows: DataFrame, least: int) -> DataFrame:
    """bucket, n and data of what is frequent over all tasks; what is held is a bucket's different candidates."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, held, size, last = pa.Codec("zstd"), None, [], 0, 0

        def told() -> Iterator[pa.RecordBatch]:
            found = _owned(held)
            found = [x[found[3] >= least] for x in found]
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(found[0])], pa.int64()), pa.array([_packed(codec, *found)], pa.binary())], ["bucket", "n", "data"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if bucket != now:
                    if held:
                        yield from told()
                    now, held, size, last = bucket, [], 0, 0
                held.append(_unpacked(codec, data))
                size += len(held[-1][0])
                if size > 2 * last + CHUNK:
                    held = [_owned(held)]
                    size = last = len(held[0][0])
        if held:
            yield from told()

    dealt = rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "bucket int, n long, data binary")


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits, and the keys in the order of their slots. In a level a key has its place for itself, or goes on to the next."""
    levels, left, slots = [], keys, []
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, SPARE * len(left) + 63 >> 6 << 6)
        at = _place(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone))
        own = alone[at]
        slots.append(left[own][np.argsort(at[own])])
        left = left[~own]
    if len(left):
        raise ValueError("keys of a minimal perfect hash are not different")
    return levels, np.concatenate(slots) if slots else keys


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


class Block:
    """A block's hash: slots of keys, which of them are its own, and the count of each."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray, counts: np.ndarray | None = None):
        self.levels, self.keys = levels, keys
        self.counts = np.zeros(len(keys), np.int64) if counts is None else counts
        self.before, n = [], 0  # of each byte of a level, the keys before it
        for bits in levels:
            own = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.before.append(n + np.concatenate([[0], own[:-1]]).astype(np.int32))
            n += int(own[-1])

    @classmethod
    def of(cls, data: bytes) -> Block:
        sizes = np.frombuffer(data, np.int64, 1 + int.from_bytes(data[:8], "little"))[1:].tolist()
        at, levels = 8 + 8 * len(sizes), []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        n = (len(data) - at) // 16
        return cls(levels, np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n))

    def data(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes() + b"".join(x.tobytes() for x in self.levels) + self.keys.tobytes() + self.counts.tobytes()

    def count(self, keys: np.ndarray) -> np.ndarray:
        """What each key counts, by its slot; 0 for one that is not in the block."""
        slots = self.slots(keys)
        return np.where(slots >= 0, self.counts[slots], 0)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in the block: its slot holds another."""
        out, left, at = np.full(len(keys), -1, np.int64), keys, np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            place = _place(left, level, 8 * len(bits))
            own = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            p = place[own]
            byte = p >> 3
            slot = before[byte] + np.bitwise_count(bits[byte].astype(np.int32) >> (8 - (p & 7)))
            out[at[own]] = slot
            left, at = left[~own], at[~own]
            if not len(left):
                break
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        out[~known] = -1
        return out


def _block_of(hashes: np.ndarray, power: int) -> np.ndarray:
    """Buckets and blocks are ranges of hashes; places in a level's bits are of hashes mixed anew."""
    return (hashes >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(hashes), np.int64)


def _hash_blocks(merged: DataFrame, bits: int, power: int, folder: str) -> None:
    """Writes a file for each block. A block is about BLOCK keys, as hashes spread evenly."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, held = pa.Codec("zstd"), None, []

        def told() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*held))
            block = Block(*build_hash(keys))
            block.counts[block.slots(keys)] = counts
            _files.put(folder, f"block-{now}", [block.data()])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], ["block"])

        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if number != now and held:
                    yield told()
                    held = []
                now = number
                held.append(_unpacked(codec, data)[::3])
        if held:
            yield told()

    rows = merged.select(F.shiftright("bucket", bits - power).alias("block"), "data")
    dealt = rows.repartition(max(1, min(1 << power, partitions(merged.sparkSession))), "block").sortWithinPartitions("block")
    keep(dealt.mapInArrow(make, "block int"), "blocks")


def _owners(merged: DataFrame) -> DataFrame:
    """number and own: for each document that has to tell some, the hashes of frequent phrases and their counts. There are no more than it has phrases."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for data in texts(batch.column(0)):
                hashes, owners, sizes, counts = _unpacked(codec, data)
                long = sizes > 1
                yield pa.RecordBatch.from_arrays([pa.array(owners[long].astype(np.int64)), pa.array(hashes[long].view(np.int64)), pa.array(counts[long])], ["number", "hash", "a"])

    rows = merged.select("data").mapInArrow(told, "number long, hash long, a long")
    return rows.groupBy("number").agg(F.collect_list(F.struct("hash", "a")).alias("own"))


def _named(docs: DataFrame, seed: int) -> DataFrame:
    """Frequent phrases of more than one word in their owners (lang, text, number, own), with their count and the hashes of their halves, or front and back parts of three words. Copies of an owner tell a phrase each."""
    schema = "lang string, words int, phrase string, hash long, a long, l1 long, r1 long, l2 long, r2 long"
    columns = [x.split()[0] for x in schema.split(", ")]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, own in _chunks(batches, seed):
            flat = pa.chunked_array(own).combine_chunks().flatten()
            asked, first = np.unique(flat.field("hash").to_numpy().view(np.uint64), return_index=True)
            counts, parts = flat.field("a").to_numpy()[first], [phrases(chunk.words, chunk.langs, n) for n in range(1, LONGEST)]
            for n in range(2, LONGEST + 1):
                at = np.flatnonzero(whole(chunk.piece, n))
                hashes = (parts[n - 1] if n < LONGEST else phrases(chunk.words, chunk.langs, n))[at]
                slot = np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)
                hit = asked[slot] == hashes
                hashes, once = np.unique(hashes[hit], return_index=True)
                at, a = at[hit][once], counts[slot[hit][once]]
                signed = lambda x: pa.array(x.view(np.int64))
                none = pa.nulls(len(at)).cast(pa.int64())
                cuts = [signed(parts[0][at]), signed(parts[n - 2][at + 1]), *([none, none] if n == 2 else [signed(parts[1][at]), signed(parts[0][at + 2])])]
                langs = pa.array([chunk.known[x] for x in chunk.which[at].tolist()], pa.string())
                made = [langs, pa.array(np.full(len(at), n, np.int32)), pa.array(chunk.told(at, n), pa.string()), signed(hashes), pa.array(a), *cuts]
                yield from pa.Table.from_arrays(made, columns).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(name, schema)


#: The parts of a phrase that are asked for: of its first cut and of its second.
PARTS = ("l1", "r1", "l2", "r2")


def _counts_of(named: DataFrame, power: int, folder: str) -> DataFrame:
    """hash, which and f: what each part of each phrase counts. All that is asked of a block is dealt to a few tasks, which open it once."""
    n = partitions(named.sparkSession)
    asked = named.select("hash", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("part")) for i, c in enumerate(PARTS)])).alias("x")).select("hash", "x.which", "x.part").where("part is not null")
    block = F.shiftrightunsigned("part", 64 - power).cast("int") if power else F.lit(0)
    dealt = asked.withColumn("block", block).repartition(n, "block", F.pmod("hash", F.lit(max(1, -(-2 * n >> power))))).sortWithinPartitions("block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, parts = batch.column(3).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            f = np.zeros(len(blocks), np.int64)
            for b in np.unique(blocks).tolist():
                f[blocks == b] = _open(folder, b).count(parts[blocks == b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f)], ["hash", "which", "f"])

    return dealt.select("hash", "which", "part", "block").mapInArrow(read, "hash long, which int, f long")


def _open(folder: str, block: int) -> Block:
    """A block; a worker keeps the last one that it has read."""
    return worker_cache(("collocations", folder, block), lambda: Block.of(_files.read(folder, f"block-{block}")))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits: exact for counts below 10 ** 16."""
    wide = lambda c, n: c.cast(DecimalType(n, 0))
    top = wide(wide(F.lit(1_000_000), 7) * wide(a, 16) * wide(a, 16), 38)
    return F.call_function("div", top, wide(wide(left, 18) * wide(right, 18), 38)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, rows: int = ROWS, lang_col: str = "lang", text_col: str = "text", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first rows by score, count and phrase, of phrases of two and three words.

    a, l, r count the phrase and the parts of its worst cut, n all words of the language. A phrase of two words within one of
    three that occurs at least half as often is left out. A null lang is `und`; null and empty texts, and those without a
    word, have no phrases; rows that repeat count each; texts are taken whole, but no phrase runs over the end of a piece.
    A table without words gives no rows. Other columns, whatever they are called, are not looked at.

    Phrases are told apart by 64-bit hashes: two of one hash would be counted as one. Another seed hashes otherwise.
    """
    if not 1 <= least <= 255:
        raise ValueError("the least count is one of 1 to 255: rough counts go no further")
    spark = docs.sparkSession
    number = F.shiftrightunsigned(F.xxhash64(text_col), 32)  # equal texts are one document
    docs = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), number.alias("number"))
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    power = min(CELLS_MOST, max(CELLS_LEAST + 3, (size // 16).bit_length()))
    powers = [power - 3] + [power] * (LONGEST - 1)
    rough, rough_path = keep(_rough(docs, powers, seed), "rough")
    totals, _ = keep(rough.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    sums, sums_path = keep(_summed(rough.where("level is not null").select("level", "piece", "data"), ["level", "piece"], least), "sieve")
    shared = spark.sparkContext.broadcast(Sieve(powers, list(sums.toLocalIterator())))  # bits, as many as CELLS_MOST lets be
    drop(spark, rough_path, sums_path)
    bits = max(1, power - CELLS_LEAST)
    seen, seen_path = keep(_seen(docs, shared, bits, seed), "seen")
    shared.unpersist()
    merged, merged_path = keep(_merged(seen, least), "merged")
    n = merged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drop(spark, seen_path)
    blocks, folder = min(bits, max(0, -(-n // block) - 1).bit_length()), new_dir(spark, "phrases")
    _files.make_dir(folder)
    _hash_blocks(merged, bits, blocks, folder)
    owners, owners_path = keep(_owners(merged), "owners", "zstd")
    telling, _ = Filter(owners, F.col("number")).split(docs, F.col("number"))
    named, _ = keep(_named(telling.join(owners, "number").select("lang", "text", "number", "own"), seed), "named", "zstd")
    counts, _ = keep(_counts_of(named, blocks, folder), "parts", "zstd")
    drop(spark, merged_path, owners_path, folder)
    # The longest phrase of three words around one of two stands beside what its own parts count.
    around = named.where("words = 3").select(F.explode(F.array("l2", "r1")).alias("hash"), F.lit(len(PARTS)).alias("which"), F.col("a").alias("f"))
    beside = counts.unionByName(around).groupBy("hash").agg(*[F.max(F.when(F.col("which") == i, F.col("f"))).alias(c) for i, c in enumerate((*PARTS, "longest"))])
    once = named.groupBy("hash").agg(*[F.min(c).alias(c) for c in ("lang", "words", "phrase", "a")])
    left = once.join(beside, "hash").where((F.col("words") == 3) | F.col("longest").isNull() | (100 * F.col("longest") < COVERED * F.col("a")))
    left = left.withColumns({"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": F.when(F.col("words") == 3, _score(F.col("a"), F.col("l2"), F.col("r2")))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    chosen = left.select("hash", "lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The first of a language are among the first of each group of its rows.
    some = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod("hash", F.lit(FAN))).orderBy(*order))).where(F.col("rank") <= rows)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= rows)
    return ranked.join(totals.withColumnRenamed("lang", "k"), F.col("lang") == F.col("k")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
