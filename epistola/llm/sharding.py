"""Shards by jump consistent hashing (Lamping and Veach, 2014), in SQL functions alone.

A shard follows from the key and the number of shards; with one more shard, rows move only into it. No ring table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from epistola.llm._store import bucket_of, range_bounds, running_offsets

# The multiplier of the published generator, and the ranges of its words.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64
HALF = 1 << 31
#: Rows of a shard that are numbered by one task, about.
PIECE_ROWS = 1 << 16


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of an integer key, 0 to shards - 1; a null key counts as 0. Negative keys count as unsigned."""
    wide = "decimal(20,0)"
    number = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(38,0)")
    start = F.when(number < 0, number + F.lit(str(WORD)).cast("decimal(38,0)")).otherwise(number).cast(wide)

    def step(s: Column, _: Column) -> Column:
        after = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(WORD)).cast("decimal(20,0)")).cast(wide)
        high = F.floor(after / F.lit(1 << 33).cast(wide)).cast("double")
        far = F.floor((s["j"] + 1).cast("double") * (F.lit(float(HALF)) / (high + 1.0))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(after.alias("k"), s["j"].alias("b"), far.alias("j")))

    first = F.struct(start.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), first, step, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots count the rows of a shard from 0 in ascending order of the key. Each shard is cut by ranges of the key,
    counts of the pieces are summed first, and rows are numbered within their pieces, so no task holds a whole shard.
    A null text has size 8 and the checksum of nothing; null keys come first; rows that repeat share a shard and get
    slots of their own; no rows give no rows.
    """
    bounds, _ = range_bounds(docs, id_col, F.lit(1), shards * PIECE_ROWS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    rows = rows.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1), "piece": bucket_of(F.col("doc_id"), bounds)})
    keyed = docs.select(jump_shard(F.col(id_col), shards).alias("shard"), bucket_of(F.col(id_col), bounds).alias("piece"))
    counts = keyed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    starts = running_offsets(counts, ["piece"], "n", ["shard"]).select("shard", "piece", "offset")
    w = Window.partitionBy("shard", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    # starts has at most shards * pieces rows, whatever the input.
    numbered = rows.withColumn("n", F.row_number().over(w)).join(F.broadcast(starts), ["shard", "piece"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), "grown_shard")
