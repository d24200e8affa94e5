"""Token ids in files of length-limited canonical Huffman codes.

Global counts of all ids give one code for the whole corpus, no longer than `limit` bits. A document's code bits start at a
byte; a checkpoint is kept for every STEP tokens, so a reader decodes all stretches of a block side by side with one
table of 2**limit entries. Blocks hold whole documents and can be read on their own.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from epistola.llm import _files
from epistola.llm._store import Cache, among, bucket_of, drop, keep, new_dir, partitions, range_bounds, running_offsets, small_batches, worker_cache
from epistola.llm.token_counts import byte_letters

MAGIC = b"EPTK0001"
STEP = 256
BLOCK_TOKENS = 1 << 18
#: Characters or tokens that are worked on at a time, tokens of a range of documents, and parts of a range of one id.
AT_ONCE, PIECE_TOKENS, PARTS = 1 << 17, 1 << 23, 64
#: The pre-token pattern of the lower-case word vocabulary, a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(Cache):
    """Ids of each stretch of lower-case text without white space, as bytes of 32-bit integers; worked out when first asked for.

    It is for vocabularies that drop white space, lower-case and have no merges across it. Texts with letters beyond Latin,
    with a special string, or whose white space or letters are not plain to Python and the vocabulary alike, go to the
    library as they are.
    """

    def __init__(self, vocabulary: str, most: int = 250_000):
        super().__init__(most)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = {b: s for b, s in byte_letters().items()}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join(["[^\\x00-\\x1b\\x20-\u024f]", *map(re.escape, special)])).search
        self.find = regex.compile(WORD_PATTERN).findall

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            coded = chunk if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk.encode()))
            ids = array("I", [t.id for t in self.tokenize(coded)]).tobytes()
        elif (head := chunk[:-1]).isalpha() and not chunk[-1].isalpha():
            ids = self[head] + self[chunk[-1]]
        elif len(pieces := self.find(chunk)) > 1:
            ids = b"".join(map(self.__getitem__, pieces))
        else:
            ids = array("I", [t.id for t in self.tokenize("".join(map(self.letters.__getitem__, chunk.encode())))]).tobytes()
        return self.put(chunk, ids)

    def of(self, text: str) -> bytes:
        if self.other(text) or not unicodedata.is_normalized("NFC", text) or self.other(low := text.lower()):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, low.split()))


def _words(vocabulary: str) -> WordIds:
    """One cache for each Python worker."""
    return worker_cache(("token-ids", hash(vocabulary)), lambda: WordIds(vocabulary))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, flags = leaves, []
    for _ in range(limit):
        flags.append(None)
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1) if len(flags) > 1 else np.empty(0)
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        flags[-1], level = sort < len(leaves), both[sort]
    take = 2 * len(used) - 2
    depth = np.zeros(len(used), np.int64)
    for leaf in reversed(flags):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that follow from the lengths alone: by length, then by id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    for n, group in itertools.groupby(used.tolist(), key=lambda i: int(lengths[i])):
        ids = list(group)
        code <<= n - before
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, before = code + len(ids), n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The id and the length at the front of each string of `limit` bits."""
    limit = max(1, int(lengths.max(initial=0)))
    ids, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[used].astype(np.int64))
    first = int(codes[used[0]]) << (limit - int(lengths[used[0]])) if len(used) else 0
    ids[first : first + int(spans.sum())] = np.repeat(used.astype(np.uint32), spans)
    bits[first : first + int(spans.sum())] = np.repeat(lengths[used].astype(np.int64), spans)
    return ids, bits, limit


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code bits of one document's ids, and the bit offset of every STEP-th token."""
    data, _, points, _ = pack_all(ids, np.array([len(ids)]), lengths, codes)
    return data, points


def pack_all(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The code bits of documents whose ids stand one after the other, each from the first bit of a byte on.

    sizes: ids of each document, none of 0. Returns the bytes, where each document's begin (and all end), its bit offset of
    every STEP-th token, and where each document's offsets begin.
    """
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    last = np.cumsum(sizes)
    bits = np.diff(ends[last - 1], prepend=0)
    begin = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    # How far each document moves so that it starts at a byte.
    starts = ends - n + np.repeat(8 * begin[:-1] - (np.cumsum(bits) - bits), sizes)
    word, shift = starts >> 5, 64 - n - (starts & 31)
    window = codes[ids] << shift.astype(np.uint64)
    words = (8 * int(begin[-1]) + 31) // 32 + 1
    # Bits of different tokens do not meet, so sums of 32-bit halves are unions, and exact in doubles.
    high = np.bincount(word, weights=(window >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount(word + 1, weights=(window & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    data = (high[:words] + low[:words]).astype(np.uint64).astype(">u4").tobytes()[: int(begin[-1])]
    points = -(-sizes // STEP)
    of = np.repeat(np.arange(len(sizes)), points)
    at = (last - sizes)[of] + STEP * (np.arange(len(of)) - (np.cumsum(points) - points)[of])
    return data, begin, (starts[at] - 8 * begin[of]).astype(np.uint32), np.concatenate([[0], np.cumsum(points)])


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of rows with about `most` in all, or of one larger row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield slice(start, stop)
        start = stop


def _binary(data: bytes, begin: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(data)])


def unpack(data: bytes, points: np.ndarray, left: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Decodes all stretches side by side: each starts at bit points[i], has left[i] tokens and goes to at[i] of the result."""
    ids, bits, limit = table
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    # The 32 bits that start at each byte.
    wide = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
    out = np.empty(int(left.sum()), np.uint32)
    order = np.argsort(-left, kind="stable")
    pos, left, at = points[order].astype(np.int64), left[order], at[order]
    mask, most = (1 << limit) - 1, int(left.max(initial=0))
    live = np.searchsorted(-left, -np.arange(1, most + 1), side="right")
    for step in range(most):
        k = live[step]
        p = pos[:k]
        front = (wide[p >> 3] >> (32 - limit - (p & 7)).astype(np.uint32)) & mask
        out[at[:k] + step] = ids[front]
        pos[:k] = p + bits[front]
    return out


def cut(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Rows of two kinds: doc_id, size and ids with the end id as 16- or 32-bit integers, of each document; id and n of each task's counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = _words(shared.value), ["doc_id", "size", "ids", "id", "n"]
        size = max(words.tokenizer.get_vocab_size(), end_id + 1)
        kind, end = np.uint16 if size <= 1 << 16 else np.uint32, array("I", [end_id]).tobytes()
        totals = np.zeros(size, np.int64)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for part in _slices(lengths, AT_ONCE):
                some = batch.slice(part.start, part.stop - part.start)
                made = [words.of(t) + end if t else end for t in some.column(1).to_pylist()]
                ids = np.frombuffer(b"".join(made), np.uint32)
                totals += np.bincount(ids, minlength=size)
                sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
                begin = np.concatenate([[0], np.cumsum(sizes)]) * kind().nbytes
                none = pa.nulls(len(made))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int32()), _binary(ids.astype(kind).tobytes(), begin), none.cast(pa.int32()), none.cast(pa.int64())], names)
        ids = np.flatnonzero(totals)
        none = pa.nulls(len(ids))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(ids, pa.int32()), pa.array(totals[ids], pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, size int, ids binary, id int, n long")


def count_ids(made: DataFrame, end_id: int) -> np.ndarray:
    """How often each id occurs in the whole corpus."""
    rows = made.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row an id at most
    counts = np.zeros(max([end_id, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, to: str, vocabulary_path: str, end_id: int = 2, limit: int = 16, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20) -> str:
    """Writes the ids of every text, each with end_id after it, to the folder `to` in ascending order of the id column; returns the manifest's path.

    A null text is empty and has only the end id; very long texts are coded whole, in a block of their own. Rows that repeat
    are documents of their own; null ids come first. Ties are ordered by their code bits; those of an id that alone has more
    than PIECE_TOKENS by a hash of their ids first. Other columns are not read. No rows give an empty manifest. limit: bits of the
    longest code; it must hold all ids that occur. A file is closed after file_bytes.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = Tokenizer.from_str(vocabulary).get_vocab_size()
    wide = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    made, path = keep(cut(docs, vocabulary, end_id), "ids", "zstd")
    lengths = code_lengths(count_ids(made, end_id), limit)
    _files.put(to, "lengths.bin", [lengths.tobytes()])
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # bounded by the vocabulary
    own = made.where("id is null").select("doc_id", "size", "ids")
    bounds, heavy = range_bounds(own, "doc_id", F.col("size"), PIECE_TOKENS)
    part = F.when(among(F.col("doc_id"), heavy), F.pmod(F.xxhash64("ids"), F.lit(PARTS))).otherwise(0).cast("int")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = shared.value
        for batch in batches:
            sizes = batch.column("size").to_numpy().astype(np.int64)
            for at in _slices(sizes, AT_ONCE):
                some = batch.slice(at.start, at.stop - at.start)
                ids = np.frombuffer(b"".join(some.column("ids").to_pylist()), np.uint16 if wide == 2 else np.uint32)
                bits, begin, points, first = pack_all(ids, sizes[at], lengths, codes)
                yield pa.RecordBatch.from_arrays([some.column("piece"), some.column("part"), some.column("doc_id"), some.column("size"), _binary(bits, begin), _binary(points.tobytes(), 4 * first)], ["piece", "part", "doc_id", "n", "bits", "points"])

    coded = own.withColumns({"piece": bucket_of(F.col("doc_id"), bounds), "part": part}).mapInArrow(squeeze, "piece int, part int, doc_id long, n int, bits binary, points binary")
    # A range goes to one task, and parts of one range to several.
    tasks = len(bounds) + 1
    dealt = coded.repartitionById(tasks, F.pmod(F.col("piece") + F.col("part"), F.lit(tasks))).sortWithinPartitions("piece", "part", F.col("doc_id").asc_nulls_first(), "bits")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(6))))
        for (piece, part), own in itertools.groupby(rows, key=lambda r: r[:2]):
            blocks, first = _blocks(own), None
            for number in itertools.count():
                first = next(blocks, None) if first is None else first
                if first is None:
                    break
                name, told = f"part-{piece:06d}-{part:02d}-{number:04d}.eptk", _Told()
                rest = told.of(itertools.chain([first], blocks), file_bytes)
                _files.put(to, name, itertools.chain([MAGIC], rest))
                first = told.over
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([piece * PARTS + part], pa.int32()), pa.array([number], pa.int32()), pa.array([told.docs], pa.int64()), pa.array([told.tokens], pa.int64()), pa.array([told.digest.hexdigest()])], ["name", "piece", "number", "docs", "tokens", "sha256"])

    manifest = f"{to}/manifest"
    with small_batches(spark):
        dealt.mapInArrow(store, "name string, piece int, number int, docs long, tokens long, sha256 string").write.parquet(manifest)
    drop(spark, path)
    return manifest


class _Told:
    """What goes into one file: blocks pass until it is large enough; the one that no longer fits stays in `over`."""

    def __init__(self) -> None:
        self.docs = self.tokens = self.bytes = 0
        self.over, self.digest = None, hashlib.sha256()

    def of(self, blocks: Iterator[tuple[int, int, bytes]], most: int) -> Iterator[bytes]:
        for block in blocks:
            docs, tokens, data = block
            if self.bytes and self.bytes + len(data) > most:
                self.over = block
                return
            self.docs, self.tokens, self.bytes = self.docs + docs, self.tokens + tokens, self.bytes + len(data)
            self.digest.update(data)
            yield data


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[int, int, bytes]]:
    """Documents, tokens and bytes of each block: a head, then ids (least 64-bit integer for null), token counts, checkpoints, code bits."""
    ids, sizes, points, bits, at, tokens = [], [], [], [], 0, 0
    for _, _, doc, n, data, own in rows:
        if tokens and tokens + n > BLOCK_TOKENS:
            yield _block(ids, sizes, points, bits, tokens)
            ids, sizes, points, bits, at, tokens = [], [], [], [], 0, 0
        ids.append(-(1 << 63) if doc is None else doc)
        sizes.append(n)
        points.append(np.frombuffer(own, np.uint32).astype(np.int64) + 8 * at)
        bits.append(data)
        at, tokens = at + len(data), tokens + n
    if ids:
        yield _block(ids, sizes, points, bits, tokens)


def _block(ids: list, sizes: list, points: list, bits: list, tokens: int) -> tuple[int, int, bytes]:
    marks, data = np.concatenate(points).astype("<i8"), b"".join(bits)
    head = struct.pack("<IIQ", len(ids), len(marks), len(data))
    return len(ids), tokens, b"".join([head, np.array(ids, "<i8").tobytes(), np.array(sizes, "<i4").tobytes(), marks.tobytes(), data])


def read_blocks(data: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and token ids. A file that ends early raises."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 8
    while at < len(data):
        docs, marks, size = struct.unpack_from("<IIQ", data, at)
        at += 16
        if at + 12 * docs + 8 * marks + size > len(data):
            raise ValueError("a block ends early")
        ids = np.frombuffer(data, "<i8", docs, at)
        sizes = np.frombuffer(data, "<i4", docs, at + 8 * docs).astype(np.int64)
        points = np.frombuffer(data, "<i8", marks, at + 12 * docs)
        at += 12 * docs + 8 * marks
        parts = -(-sizes // STEP)
        starts = np.cumsum(sizes) - sizes
        inner = np.arange(marks) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.minimum(STEP, np.repeat(sizes, parts) - inner * STEP)
        tokens = unpack(data[at : at + size], points, left, np.repeat(starts, parts) + inner * STEP, table)
        at += size
        for doc, start, n in zip(ids.tolist(), starts.tolist(), sizes.tolist()):
            yield None if doc == -(1 << 63) else doc, tokens[start : start + n]


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document that the manifest lists.

    A file that is missing or whose blocks differ from the manifest's digest raises.
    """
    listed = spark.read.schema("name string, piece int, number int, docs long, tokens long, sha256 string").parquet(f"{folder}/manifest")
    # One row a file.
    before = running_offsets(listed.groupBy("piece").agg(F.sum("tokens").alias("n")), ["piece"], "n").select("piece", F.col("offset").alias("base"))
    own = running_offsets(listed, ["number"], "tokens", ["piece"])
    files = own.join(before, "piece").select("name", "sha256", (F.col("base") + F.col("offset")).alias("base"))
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _files._open(_files.normal(folder))

        def whole(name: str) -> bytes:
            with where.open_input_stream(f"{path}/{name}", compression=None) as file:
                return file.read()

        table = None
        for batch in batches:
            for name, digest, base in zip(*(c.to_pylist() for c in batch.columns)):
                table = table or decode_table(np.frombuffer(whole("lengths.bin"), np.uint8))
                data = whole(name)
                if hashlib.sha256(memoryview(data)[8:]).hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                documents = read_blocks(data, table)
                while some := list(itertools.islice(documents, 2000)):
                    rows = []
                    for doc, ids in some:
                        rows.append((doc, base, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                        base += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    dealt = files.repartition(partitions(spark), "name")
    return dealt.mapInArrow(open_files, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def encode_documents(docs: DataFrame, vocabulary_path: str, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Writes the documents' ids to a new shared folder and reads them back."""
    spark = docs.sparkSession
    to = new_dir(spark, "token-ids")
    write(docs, to, vocabulary_path, end_id)
    return read(spark, to, with_ids)
