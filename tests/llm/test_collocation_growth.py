"""Collocations: what is handed on follows the words, and what is asked of a block is asked by few tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from epistola.llm import _files, collocations
from epistola.llm.collocations import Block, build_hash


class Caught:
    """A table whose tasks are run here."""

    def mapInArrow(self, f, schema):
        return f


def test_rough_counts_are_as_long_as_the_words_and_not_as_the_cells():
    rng, texts = np.random.default_rng(1), []
    for _ in range(60):
        texts.append(" ".join(f"w{i}" for i in rng.integers(0, 500, 300)) + ".")
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 60), pa.array(texts), pa.array(range(60))], ["lang", "text", "number"])
    codec, counted = pa.Codec("zstd"), {}
    for powers in ([16, 19, 19], [25, 28, 28]):
        rows = [r for b in collocations._rough(Caught(), powers, 0)(iter([batch])) for r in b.to_pylist() if r["level"]]
        found = [(r["level"], *x) for r in rows for x in [collocations._cells_unpacked(codec, r["data"])]]
        assert sum(k.sum() for level, _, k in found if level == 2) == 60 * 299
        assert sum(len(cells) for _, cells, _ in found) <= 60 * 900 and sum(len(r["data"]) for r in rows) < 60 * 900 * 20
        counted[powers[0]] = sum(len(cells) for level, cells, _ in found if level == 1)
    assert counted[25] == 500


def test_a_block_is_opened_by_few_tasks(spark, tmp_path):
    folder, power = f"file://{tmp_path}/blocks", 5
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 4000, np.uint64))
    blocks = (keys >> np.uint64(64 - power)).astype(int)
    for b in range(1 << power):
        block = Block(*build_hash(keys[blocks == b]))
        block.counts[block.slots(keys[blocks == b])] = np.flatnonzero(blocks == b) + 10
        _files.put(folder, f"block-{b}", [block.data()])
    rows = [(i, *(int(np.int64(np.uint64(keys[(i * k) % len(keys)]))) for k in (1, 3)), None, None) for i in range(len(keys))]
    named = spark.createDataFrame(rows, "hash long, l1 long, r1 long, l2 long, r2 long").repartition(40)
    got = collocations._counts_of(named, power, folder).withColumn("task", F.spark_partition_id()).collect()
    want = {(i, which): (i * k) % len(keys) + 10 for i in range(len(keys)) for which, k in enumerate((1, 3))}
    assert {(r["hash"], r["which"]): r["f"] for r in got} == want
    assert len({(blocks[r["f"] - 10], r["task"]) for r in got}) <= max(1 << power, 2 * 4 + (1 << power))
