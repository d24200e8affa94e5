"""Tables as sorted runs: each append is a run, and runs of a kind are merged into one of the next.

A run is a folder that is written once, and a part of the table to Spark. Which runs a table has is told by its newest version, a small file whose number one
writer takes; so an append or a merge is seen whole or not at all, and writers at once lose nothing. FAN runs of a tier make
one of the next, so a table has fewer than FAN for each tier. Runs that were merged are deleted by the merge after the next,
as readers may still have them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epistola.operators import commits

#: Runs of a tier that are merged, and bytes of a file that one task writes, about.
FAN, MOST = 8, 128 << 20
#: Versions that are kept for readers that have just looked.
KEPT = 4


class Conflict(Exception):
    """Another writer has merged what this one was about to."""


def _versions(root: str, name: str) -> list[int]:
    from pyarrow import fs

    where, base = commits.opened(f"{root}/{name}/_runs")
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(x.base_name[:-5]) for x in found if x.is_file and re.fullmatch(r"\d+\.json", x.base_name))


def state(root: str, name: str) -> dict:
    """runs (run, tier, bytes, files) and retired of the newest version."""
    while True:
        numbers = _versions(root, name)
        if not numbers:
            return {"version": 0, "runs": [], "retired": []}
        found = commits.note(f"{root}/{name}/_runs/{numbers[-1]:09d}.json")
        if found is not None:
            return {"version": numbers[-1], **found}


def commit(root: str, name: str, add: list[dict], merged: list[str] = (), retired: bool = False, expected: int | None = None) -> None:
    """The next version: with new runs and without merged ones. retired: what was retired before is deleted and forgotten. expected: the version that this one must follow."""
    while True:
        now = state(root, name)
        if expected is not None and now["version"] != expected:
            raise Conflict(name)
        known = {r["run"] for r in now["runs"]}
        if not set(merged) <= known:
            raise Conflict(name)
        if add and {r["run"] for r in add} <= known:
            return  # done before
        old = list(merged) if retired else [*now["retired"], *merged]
        new = {"runs": [r for r in now["runs"] if r["run"] not in merged] + add, "retired": old}
        if commits.put_new(f"{root}/{name}/_runs/{now['version'] + 1:09d}.json", json.dumps(new).encode()):
            where, base = commits.opened(f"{root}/{name}/_runs")
            for number in _versions(root, name)[:-KEPT]:
                where.delete_file(f"{base}/{number:09d}.json")
            return


def paths(root: str, name: str) -> list[str]:
    return [f"{root}/{name}/{r['run']}" for r in state(root, name)["runs"]]


def read(spark: SparkSession, root: str, name: str, schema: str, chosen: list[str] | None = None) -> DataFrame | None:
    """All rows of a table's runs, or of the chosen ones; None if there are none. The run is a column too."""
    found = paths(root, name) if chosen is None else [f"{root}/{name}/{r}" for r in chosen]
    return spark.read.option("basePath", f"{root}/{name}").schema(schema).parquet(*found) if found else None


def is_new(spark: SparkSession, root: str, name: str) -> bool:
    """Whether nothing is below a table's folder but runs, perhaps ones that were never told."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(where) or all(x.getPath().getName().startswith(("run=", "_runs")) for x in files.listStatus(where))


def new_run() -> str:
    return f"run=r{uuid.uuid4().hex}"


def measured(spark: SparkSession, path: str) -> dict:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where)
    return {"bytes": found.getLength(), "files": found.getFileCount()}


def append(spark: SparkSession, root: str, name: str, write, tier: int = 0) -> None:
    """A new run, which write(path) makes; one without rows is none."""
    run = new_run()
    write(f"{root}/{name}/{run}")
    size = measured(spark, f"{root}/{name}/{run}")
    commit(root, name, [{"run": run, "tier": tier, **size}])


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def to_merge(runs: list[dict]) -> tuple[list[dict], int] | None:
    """The runs of the lowest tier that has FAN of them, and the tier that they make."""
    for tier in sorted({r["tier"] for r in runs}):
        own = [r for r in runs if r["tier"] == tier]
        if len(own) >= FAN:
            return own, tier + 1
    return None


def bucket_bytes(spark: SparkSession, found: list[str], by: str) -> dict[int | None, int]:
    """Bytes of each bucket or part over some runs, from the sizes of their files."""
    out: dict[int | None, int] = {}
    for path in found:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in files.listStatus(where):
            m = re.fullmatch(rf"{by}=(-?\d+|__HIVE_DEFAULT_PARTITION__)", x.getPath().getName())
            if m:
                key = None if m[1].startswith("_") else int(m[1])
                out[key] = out.get(key, 0) + files.getContentSummary(x.getPath()).getLength()
    return out


def dealt(rows: DataFrame, by: str, sizes: dict[int | None, int], most: int = MOST, by_rows: str = "hash") -> DataFrame:
    """Rows in partitions of one bucket each, as many for a bucket as its bytes ask for: no task writes much more than `most`."""
    start, first, count = 0, {}, {}
    for key, size in sorted(sizes.items(), key=str):
        first[key], count[key] = start, max(1, -(-size // most))
        start += count[key]
    if not start:
        return rows
    known = [k for k in first if k is not None]

    def told(values: dict) -> Column:
        of = F.create_map(*[F.lit(x) for k in known for x in (k, values[k])])[F.col(by)] if known else F.lit(None).cast("int")
        return F.coalesce(of, F.lit(values.get(None, 0)))

    spread = F.pmod(F.xxhash64(by_rows), told(count)).cast("int")
    return rows.repartitionById(start, (told(first) + spread).cast("int"))
