"""Near-duplicate groups by circulant MinHash, banding and exact verification.

One permutation puts each shingle at a place of a ring; a second one gives each place of the ring its rank. Coordinate k of a
signature is the smallest rank when the second permutation is shifted by k places, so the coordinates of one shingle are
COORDINATES neighbours on the ring, and a signature is the smallest row of them: two permutations make all coordinates.

Sets that share all ROWS coordinates of a band meet. What meets is compared on the whole sets, so bands decide which pairs are
looked at and nothing else. A pair of exactly the least likeness is missed by all bands with a chance of
(1 - likeness ** ROWS) ** (COORDINATES / ROWS): 1.2e-7 for 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from epistola.llm._store import drop, keep, texts
from epistola.llm.ngram_join import WORDS, Likeness, _least, _verify, class_of, components, gram_set, near_enough, signature

#: Places of the ring as a power of two, coordinates of a signature, and those of a band.
RING, COORDINATES, ROWS = 20, 200, 5
#: Sets of one band value that neighbours are looked for in together.
GROUP = 20_000
#: Near duplicates of the contract: two-word shingles, a likeness of 0.8 or more.
NEAR = Likeness(2, 80, 100)


@lru_cache(1)
def ring() -> np.ndarray:
    """For each place, the ranks of itself and of the places behind it, COORDINATES in all: a view of one permutation that runs on from its end to its start."""
    ranks = np.random.Generator(np.random.PCG64(11)).permutation(1 << RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: COORDINATES - 1]]), COORDINATES)


def places(grams: np.ndarray) -> np.ndarray:
    """The first permutation: shingles are hashes already, and are mixed once more by one that is a bijection."""
    mixed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - RING)).astype(np.int64)


def coordinates(grams: np.ndarray) -> np.ndarray:
    """All coordinates of a set that is not empty. Long sets are taken some at a time."""
    at, rows = places(grams), ring()
    least = rows[at[:512]].min(axis=0)
    for i in range(512, len(at), 512):
        np.minimum(least, rows[at[i : i + 512]].min(axis=0), out=least)
    return least


def bands(grams: np.ndarray) -> list[int]:
    """One number for each band; the band itself is a part of it."""
    own = coordinates(grams).reshape(-1, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(own)]


def _sets(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, size, cid, signature of parities and band numbers of each document; without words cid and bands are null."""
    marks = [f"s{k}" for k in range(WORDS)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cids, signs, found = [], [], [], []
            for text in texts(batch.column(1)):
                grams = gram_set(text, like.n)
                sizes.append(len(grams))
                cids.append(class_of(grams))
                signs.append(signature(grams))
                found.append(bands(grams) if len(grams) else None)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, np.array(signs, np.int64).reshape(-1, WORDS).T.copy())], ["doc_id", "size", "cid", "bands", *marks])

    schema = "doc_id long, size long, cid long, bands array<long>, " + ", ".join(f"{m} long" for m in marks)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, schema)


def near_duplicates(docs: DataFrame, like: Likeness = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row: the smallest id that links lead to, its own included, and whether that is the row's own id.

    Texts of one set are one class from the start. In each group of classes with one band number, the one that came first and
    the neighbour before are compared with each; what that links is a component. Then pairs of a group that lie in different
    components are compared, as a link within one would change nothing: a group of copies costs two comparisons a member.
    Groups are counted before they are gathered, and large ones are gathered in parts.

    Null and empty texts, and those of white space alone, have no shingles and their own id, and are kept. A null id counts
    for links, but is a component's id only where all its ids are null; such a row is kept if no other is. Rows that repeat are
    one class, a row each; rows of one id with different texts are classes of their own. No rows give no rows; very long texts
    are taken whole. Other columns, whatever they are called, are not looked at. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made, _ = keep(_sets(docs, like), "minhash-sets")
    marks = [f"s{k}" for k in range(WORDS)]
    # Copies have one signature and one row of bands; partial sums leave one of each class in a task.
    copies = made.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("size", *marks, "bands")])
    classes, _ = keep(copies, "classes")
    signs = classes.select("cid", "size", *marks)
    met = classes.select("cid", "first", "size", F.explode("bands").alias("token"))
    groups = met.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.coalesce("first", F.lit(-(1 << 63))).alias("f"), "cid")).alias("h")).where("n > 1")
    groups, groups_path = keep(groups.select(F.col("token").alias("t"), F.ceil(F.col("n") / GROUP).cast("int").alias("parts"), F.col("h.cid").alias("hub")), "groups")
    met, met_path = keep(met.join(groups, F.col("token") == F.col("t")).select("token", F.pmod("cid", "parts").cast("int").alias("part"), "first", "size", "cid", "hub"), "met")
    before = F.lag("cid").over(Window.partitionBy("token", "part").orderBy("size", "first", "cid"))
    near = met.select("cid", before.alias("link")).unionAll(met.select("cid", "hub")).where("link is not null and link <> cid")
    near = near.select(F.least("cid", "link").alias("a"), F.greatest("cid", "link").alias("b")).distinct()
    near = near.join(signs.alias("x"), F.col("a") == F.col("x.cid")).join(signs.alias("y"), F.col("b") == F.col("y.cid"))
    alike_sizes = F.least("x.size", "y.size") * like.den >= F.greatest("x.size", "y.size") * like.num
    near, near_path = keep(near.where(alike_sizes & near_enough("x", "y", like)).select("a", "b"), "near")
    links, links_path = _verify(docs, near, classes, like)
    first = components(links)
    # What is left: classes of one band number in different components.
    placed, placed_path = keep(met.select("token", "cid").join(first, "cid", "left").select("token", "cid", F.coalesce("root", "cid").alias("root")), "placed")
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    apart, apart_path = keep(placed.join(mixed, "token", "left_semi").join(signs, "cid"), "apart")
    x, y = apart.alias("x"), apart.alias("y")
    order = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.cid") < F.col("y.cid")))
    fits = F.col("x.size") * like.den >= F.col("y.size") * like.num
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & order & fits & (F.col("x.root") != F.col("y.root")) & near_enough("x", "y", like))
    rest = rest.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    rest, rest_path = keep(rest, "rest")
    more, more_path = _verify(docs, rest, classes, like)
    roots = components(links.unionAll(more)) if not more.isEmpty() else first
    named = classes.join(roots, "cid", "left").select("cid", "first", F.coalesce("root", "cid").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = keep(named.join(lowest, "root").select(F.col("cid").alias("k"), "component_id"), "named")
    drop(spark, groups_path, met_path, near_path, links_path, placed_path, apart_path, rest_path, more_path)
    some = made.where("cid is not null").join(named, F.col("cid") == F.col("k"), "left")
    none = made.where("cid is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return some.select(*columns).unionAll(none.select(*columns))
