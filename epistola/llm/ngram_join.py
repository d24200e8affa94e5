"""Jaccard self-join on word n-grams by rare-first prefix filtering.

Every n-gram has a place in one global order: by a rough count of its occurrences over all documents, then by its hash.
Two sets that are alike enough share an n-gram among the first few of either. Documents that meet on one pass a length,
a positional and a suffix filter before their whole sets are compared, once for a pair.

Documents of equal sets are one class from the start. Among the classes that share a prefix n-gram, neighbours in size are
compared first; what this links is one component. Then all other pairs are compared that lie in different components: a
link between two of one component would change nothing. So a large group of near copies costs one comparison a member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from epistola.llm._store import Cache, Filter, drop, keep, partitions, texts, worker_cache

#: Cells of the rough counts, and of each piece in which tasks hand them on.
CELLS, PIECE = 1 << 22, 1 << 16
#: Postings of an n-gram that are grouped together at most, by the rough count; more are dealt to several groups.
GROUP = 20_000
#: 64-bit numbers of a signature.
WORDS = 8
#: Classes with most copies that are known while prefixes are made, so that one copy alone makes them.
HOT = 20_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


@dataclass(frozen=True)
class Likeness:
    """n-grams of n words, at most 8; alike if the intersection is at least num / den of the union."""

    n: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, size: int) -> int:
        return size - -(-size * self.num // self.den) + 1

    def alike(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


class _Hashes(Cache):
    def __missing__(self, word: bytes) -> int:
        return self.put(word, xxhash.xxh3_64_intdigest(word))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the n-grams of a text's words, A to Z in lower case; of fewer words, one of them all."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(worker_cache("ngram-join", _Hashes).__getitem__, words), np.uint64, len(words))
    if len(own) < n:
        return np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own))], np.uint64)
    size = len(own) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += (own[k : k + size] ^ (own[k : k + size] >> np.uint64(29))) * _FACTORS[k]
    total = (total ^ (total >> np.uint64(32))) * _FACTORS[7]
    return np.unique(total ^ (total >> np.uint64(29)))


def class_of(grams: np.ndarray) -> int | None:
    """A number for the set; equal sets have equal ones. None for the empty set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)).__index__()).astype(np.int64))) if len(grams) else None


def rare_first(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    return grams[np.argsort(rank[(grams & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")]


def signature(grams: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS parts of the range of hashes, whether an odd number of members lie in it, in WORDS numbers.

    Two sets differ in at least as many members as their signatures differ in bits.
    """
    odd = np.bincount(((grams >> np.uint64(40)) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: doc_id, the text's hash, size, cid and signature of each document; and pieces of each task's rough counts."""
    marks = [f"s{k}" for k in range(WORDS)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(CELLS, np.uint32), 0
        names = ["doc_id", "told", "size", "cid", "piece", "data", *marks]
        for batch in batches:
            sizes, cids, cells, signs = [], [], [], []
            for text in texts(batch.column(1)):
                grams = gram_set(text, n)
                sizes.append(len(grams))
                cids.append(class_of(grams))
                signs.append(signature(grams))
                cells.append((grams & np.uint64(CELLS - 1)).astype(np.int32))
                held += len(grams)
                if held > 1 << 20:
                    np.add.at(counts, np.concatenate(cells), 1)
                    cells, held = [], 0
            if cells:
                np.add.at(counts, np.concatenate(cells), 1)
                held = 0
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), *map(pa.array, np.array(signs, np.int64).reshape(-1, WORDS).T.copy())], names)
        codec = pa.Codec("zstd")
        used = [i for i in range(0, CELLS, PIECE) if counts[i : i + PIECE].any()]
        data = [codec.compress(counts[i : i + PIECE].tobytes(), asbytes=True) for i in used]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i // PIECE for i in used], pa.int32()), pa.array(data, pa.binary()), *[none] * WORDS], names)

    schema = "doc_id long, told long, size long, cid long, piece int, data binary, " + ", ".join(f"{m} long" for m in marks)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("told")).mapInArrow(make, schema)


def _ranks(made: DataFrame) -> np.ndarray:
    """For each cell, eight times the binary logarithm of its count: CELLS bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, total = pa.Codec("zstd"), None, np.zeros(PIECE, np.float64)

        def told() -> pa.RecordBatch:
            rank = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["piece", "rank"])

        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if piece != now:
                    if now is not None:
                        yield told()
                    now, total = piece, np.zeros(PIECE, np.float64)
                total += np.frombuffer(codec.decompress(data, decompressed_size=4 * PIECE, asbytes=True), np.uint32)
        if now is not None:
            yield told()

    pieces = made.where("piece is not null").select("piece", "data").repartition(min(CELLS // PIECE, partitions(made.sparkSession)), "piece").sortWithinPartitions("piece")
    rank = np.zeros(CELLS, np.uint8)
    for r in pieces.mapInArrow(add, "piece int, rank binary").collect():
        rank[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["rank"], np.uint8)
    return rank


def _postings(docs: DataFrame, rank: np.ndarray, hot: dict[int, int], like: Likeness) -> DataFrame:
    """token, part, size, place, cid, doc for each n-gram in a document's prefix; part is -1 where a token has one group. Copies of hot classes but the first make none."""
    shared = docs.sparkSession.sparkContext.broadcast((rank, hot))  # CELLS bytes and HOT entries

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot = shared.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                grams = gram_set(text, like.n)
                cid = class_of(grams)
                if cid is None or hot.get(cid, doc) != doc:
                    continue
                own = rare_first(grams, rank)[: like.prefix(len(grams))]
                often = np.exp2(rank[(own & np.uint64(CELLS - 1)).astype(np.int64)] / 8.0)
                split = np.ceil(often / GROUP).astype(np.int64)
                for col, x in zip(cols, (own.astype(np.int64), np.where(split > 1, cid % split, -1).astype(np.int32), np.full(len(own), len(grams), np.int32), np.arange(len(own), dtype=np.int32), np.full(len(own), cid, np.int64), np.full(len(own), -(1 << 63) if doc is None else doc, np.int64))):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "part", "size", "place", "cid", "doc"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "token long, part int, size int, place int, cid long, doc long")


def _may_link(a: dict[str, np.ndarray], b: dict[str, np.ndarray], like: Likeness) -> np.ndarray:
    """The length and positional filters, the latter as for the first n-gram that two sets share: all others lie behind it in both."""
    least = -(-like.num * (a["size"] + b["size"]) // (like.num + like.den))
    small, large = np.minimum(a["size"], b["size"]), np.maximum(a["size"], b["size"])
    return (small * like.den >= large * like.num) & (np.minimum(a["size"] - a["place"], b["size"] - b["place"]) >= least)


def _least(a: Column, b: Column, like: Likeness) -> Column:
    """The smallest intersection with which sets of these sizes are alike."""
    return F.ceil((a + b).cast("long") * like.num / (like.num + like.den) - 1e-9)


def may_link(a: str, b: str, like: Likeness) -> Column:
    """The same filters on columns of two sides of a join, the first of which has the smaller set."""
    x, y = (lambda c: F.col(f"{a}.{c}").cast("long")), (lambda c: F.col(f"{b}.{c}").cast("long"))
    return (x("size") * like.den >= y("size") * like.num) & (F.least(x("size") - x("place"), y("size") - y("place")) >= _least(x("size"), y("size"), like))


def near_enough(a: str, b: str, like: Likeness) -> Column:
    """The suffix filter, by the parts of the whole range instead of one suffix: a bound on the members in which two sets differ, from their signatures."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    apart = sum((F.bit_count(x(f"s{k}").bitwiseXOR(y(f"s{k}"))) for k in range(WORDS)), F.lit(0))
    return apart <= x("size") + y("size") - 2 * _least(x("size"), y("size"), like)


def _met(postings: DataFrame, like: Likeness) -> DataFrame:
    """Postings of n-grams that more than one class has, each with the class before it in its group and the first one there, in the order of documents, if the filters let them pass.

    The first is most often the text that others were made from, and alike to more of them than they are to one another.
    """
    names = ["token", "part", "size", "place", "cid", "doc"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []

        def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {k: rows.column(k).to_numpy() for k in names}
            c = {k: np.ascontiguousarray(v.astype(np.int64)) for k, v in c.items()}
            fresh = np.concatenate([[True], (c["token"][1:] != c["token"][:-1]) | (c["part"][1:] != c["part"][:-1]) | (c["cid"][1:] != c["cid"][:-1])])
            c = {k: np.ascontiguousarray(v[fresh]) for k, v in c.items()}
            same = np.concatenate([[False], (c["token"][1:] == c["token"][:-1]) & (c["part"][1:] == c["part"][:-1]), [False]])
            # A group that is one part of several is needed whatever its size, as others of its token are elsewhere.
            use = same[1:] | same[:-1] | (c["part"] >= 0)
            after = np.flatnonzero(same[:-1])
            starts = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(use))))
            link, hub = np.zeros(len(use), bool), np.zeros(len(use), bool)
            if len(after):
                own = {k: v[after] for k, v in c.items()}
                link[after] = _may_link({k: v[after - 1] for k, v in c.items()}, own, like)
                hub[after] = _may_link({k: v[starts[after]] for k, v in c.items()}, own, like)
            before = np.concatenate([[0], c["cid"][:-1]])
            arrays = [pa.array(c[k][use].astype(np.int32 if k in ("part", "size", "place") else np.int64)) for k in names]
            yield pa.RecordBatch.from_arrays([*arrays[:-1], pa.array(before[use], mask=~link[use]), pa.array(c["cid"][starts][use], mask=~hub[use])], [*names[:-1], "link", "hub"])

        for batch in batches:
            token = batch.column(0).to_numpy()
            part = batch.column(1).to_numpy()
            ends = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1
            if len(ends):
                cut = int(ends[-1])
                yield from groups(pa.Table.from_batches([*left, batch.slice(0, cut)]))
                left = [batch.slice(cut)]
            elif left and (left[-1].column(0)[0], left[-1].column(1)[0]) != (batch.column(0)[0], batch.column(1)[0]):
                yield from groups(pa.Table.from_batches(left))
                left = [batch]
            else:
                left.append(batch)
        if left:
            yield from groups(pa.Table.from_batches(left))

    dealt = postings.repartition(max(partitions(postings.sparkSession), 1), "token", "part").sortWithinPartitions("token", "part", "doc", "cid")
    return dealt.mapInArrow(pair, "token long, part int, size int, place int, cid long, link long, hub long")


def sketch(grams: np.ndarray) -> bytes:
    """The size of a set, then the parity of members in each of a power of two parts, at least one for each member: two bits a member at most."""
    parts = 1 << max(6, (len(grams) - 1).bit_length())
    odd = np.bincount(((grams >> np.uint64(24)) & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return len(grams).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def sketches_alike(x: bytes, y: bytes, like: Likeness) -> bool:
    """False only for sets that are not alike: parts are merged until both have as many, then no more may differ than members of alike sets do."""
    a, b = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
    own, other = np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8)
    if len(own) > len(other):
        own, other = other, own
    while len(other) > len(own):
        half = len(other) // 2
        other = other[:half] ^ other[half:]
    least = -(-like.num * (a + b) // (like.num + like.den))
    return int(np.unpackbits(own ^ other).sum()) <= a + b - 2 * least


def sets_alike(x: bytes, y: bytes, like: Likeness) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return like.alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def _passing(docs: DataFrame, pairs: DataFrame, classes: DataFrame, like: Likeness, encode: Callable, test: Callable) -> tuple[DataFrame, str]:
    """The pairs (a, b) of classes that pass a test on what encode makes of their sets, as a new table."""
    asked = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct().join(classes, "cid").select("cid", "first")
    asked, asked_path = keep(asked, "asked")
    rows, _ = Filter(asked, F.col("first")).split(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.col("doc_id"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(t, like.n) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(class_of, sets), pa.int64()), pa.array(map(encode, sets), pa.binary())], ["doc_id", "cid", "data"])

    found = rows.mapInArrow(make, "doc_id long, cid long, data binary")
    found = found.join(asked.withColumnRenamed("cid", "k"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("cid") == F.col("k"))).select("cid", "data").dropDuplicates(["cid"])
    found, found_path = keep(found, "found")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [test(x.as_py(), y.as_py(), like) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sides = pairs.join(found.select(F.col("cid").alias("a"), F.col("data").alias("x")), "a").join(found.select(F.col("cid").alias("b"), F.col("data").alias("y")), "b")
    out = keep(sides.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "passing")
    drop(docs.sparkSession, asked_path, found_path)
    return out


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, like: Likeness) -> tuple[DataFrame, str]:
    """The pairs (a, b) of classes whose whole sets are alike, as a new table. Sketches, which grow with the sets, spare long texts that only share common n-grams."""
    likely, path = _passing(docs, pairs, classes, like, sketch, sketches_alike)
    out = _passing(docs, likely, classes, like, np.ndarray.tobytes, sets_alike)
    drop(docs.sparkSession, path)
    return out


def components(links: DataFrame) -> DataFrame:
    """cid and root, the smallest number that links (a, b) lead to, of every class with a link; each end is tied to smaller ones in turns until nothing changes."""
    spark = links.sparkSession
    edges, path = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before, n = None, 0
    while True:
        # Larger neighbours of each end go to its smallest neighbour, then smaller ones.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = edges.join(low, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = keep(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        # u goes to its smallest neighbour m, and so does each of its other neighbours v.
        small = small.select("u", "v", "m").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new, new_path = keep(small, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, path, large_path)
        edges, path, n = new, new_path, n + 1
        if tuple(state) == before:
            break
        before = tuple(state)
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct())


def link_documents(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, cid, component_id, and told, a hash of the text, for every row: the smallest id that links lead to, its own included.

    Null and empty texts, and those of white space alone, have no n-grams, a null cid and their own id. A null id counts
    for links but is a component's id only where all its ids are null. Rows that repeat are one class and a row each. No rows
    give no rows. n-grams are compared by 64-bit hashes, sets told apart by another.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made, _ = keep(_sets(docs, like.n), "sets")
    own = made.where("piece is null").select("doc_id", "told", "size", "cid")
    marks = [f"s{k}" for k in range(WORDS)]
    # Copies have one signature.
    copies = made.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("size", *marks)])
    classes, _ = keep(copies, "classes")
    signs = classes.select("cid", "size", *marks)
    hot = {r["cid"]: r["first"] for r in classes.where("n > 8").orderBy(F.desc("n"), "cid").limit(HOT).collect() if r["first"] is not None}
    met, met_path = keep(_met(_postings(docs, _ranks(made), hot, like), like), "met")
    # Neighbours in a group, and the first of each part of a token with that of the next part.
    heads = met.where("part >= 0").groupBy("token", "part").agg(F.min(F.struct("size", "cid")).alias("h")).select("token", "part", F.col("h.cid").alias("cid"))
    heads = heads.withColumn("link", F.lag("cid").over(Window.partitionBy("token").orderBy("part")))
    near = met.select("cid", "link").unionAll(met.select("cid", "hub")).unionAll(heads.select("cid", "link")).where("link is not null and link <> cid")
    near = near.select(F.least("cid", "link").alias("a"), F.greatest("cid", "link").alias("b")).distinct()
    near = near.join(signs.alias("x"), F.col("a") == F.col("x.cid")).join(signs.alias("y"), F.col("b") == F.col("y.cid")).where(near_enough("x", "y", like)).select("a", "b")
    near, near_path = keep(near, "near")
    links, links_path = _verify(docs, near, classes, like)
    first = components(links)
    # What is left: classes on the two sides of a token in different components.
    placed, placed_path = keep(met.select("token", "place", "cid").join(first, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "placed")
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    apart, apart_path = keep(placed.join(mixed, "token", "left_semi").join(signs, "cid"), "apart")
    # The smaller set of a pair must have the n-gram so early that a set as large as itself could follow; most have not where a template is shared.
    size = F.col("size").cast("long")
    x, y = apart.where(size - F.col("place") >= _least(size, size, like)).alias("x"), apart.alias("y")
    order = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.cid") != F.col("y.cid")))
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & order & (F.col("x.root") != F.col("y.root")) & may_link("x", "y", like) & near_enough("x", "y", like))
    rest = rest.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    rest, rest_path = keep(rest, "rest")
    more, more_path = _verify(docs, rest, classes, like)
    roots = components(links.unionAll(more)) if not more.isEmpty() else first
    placed_classes = classes.join(roots, "cid", "left").select("cid", "first", F.coalesce("root", "cid").alias("root"))
    lowest = placed_classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed_classes.join(lowest, "root").select(F.col("cid").alias("k"), "component_id")
    named, _ = keep(named, "named")
    drop(spark, met_path, near_path, links_path, placed_path, apart_path, rest_path, more_path)
    some = own.where("cid is not null").join(named, F.col("cid") == F.col("k"), "left")
    none = own.where("cid is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("size").alias("n_shingles"), "cid", "component_id", "told"]
    return some.select(*columns).unionAll(none.select(*columns))


#: Near duplicates, where nothing else is said.
NEAR = Likeness(5, 80, 100)


def keep_one(docs: DataFrame, like: Likeness = NEAR) -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns; rows without words are all kept.

    Rows of one id that are in one component with different texts leave the one of the smallest hash; equal rows leave one.
    Only texts whose id may be among those to drop are dealt out again, by a filter sized by their number.
    """
    columns = docs.columns
    linked, path = keep(link_documents(docs, like).where("cid is not null"), "linked")
    first = F.coalesce("doc_id", F.lit(2**63 - 1))
    chosen = linked.groupBy("component_id").agg(F.min(F.struct(first.alias("i"), F.col("told").alias("t"))).alias("c")).select(F.col("component_id").alias("k"), "c.i", "c.t")
    # An id that stands for its component in more than one row is looked at too.
    counts = linked.groupBy("doc_id", "told", "component_id").agg(F.count(F.lit(1)).alias("times"))
    judged = counts.join(chosen, F.col("component_id").eqNullSafe(F.col("k")) & (F.col("told") == F.col("t")) & (first == F.col("i")), "left")
    judged, _ = keep(judged.select(F.col("doc_id").alias("_d"), F.col("told").alias("_t"), F.col("t").isNull().alias("_out"), F.col("times").alias("_times")).where("_out or _times > 1"), "judged")
    own = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(columns)], F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("told"))
    look, sure = Filter(judged, F.col("_d")).split(own, F.col("doc_id"))
    look = look.join(judged, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("told") == F.col("_t")), "left").where("_out is null or not _out")
    once = look.where("_times > 1").dropDuplicates(["doc_id", "told"])
    out = [F.col(f"c_{i}").alias(c) for i, c in enumerate(columns)]
    drop(docs.sparkSession, path)
    return sure.select(*out).unionAll(look.where("_times is null or _times = 1").select(*out)).unionAll(once.select(*out))
