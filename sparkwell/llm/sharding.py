"""Sharding by size-tiered compaction (native: DataFrame functions only).

A dataset is a folder of immutable runs (folders of Parquet files) and of manifests
``v<number>.json``, each the full list of live runs with their sizes. Appending writes new
runs and a new manifest. Compaction groups runs of similar size into tiers, rewrites any tier
of at least MIN_RUNS runs as files of about TARGET_BYTES, and commits a manifest with the
merged run in their place. A manifest is written aside and renamed into place, which fails if
that version exists, so of two writers one commits and the other starts again; readers see one
version or the next, never a mixture, and old versions stay readable until ``vacuum``.

Merging reads and writes each run once without a shuffle: files are dealt to tasks by size.

Cases: an empty arrival adds no run; rows may hold nulls in any column and repeat; extra
columns are stored as they are, whatever their names; a dataset without runs reads as an empty table of its schema.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TARGET_BYTES = 128 << 20
MIN_RUNS = 4
#: Runs belong to one tier while they are within this factor of the tier's mean.
TIER_LOW, TIER_HIGH = 0.5, 1.5


class Dataset:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, min_runs: int = MIN_RUNS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.min_runs = target_bytes, min_runs
        #: Names of the columns that ``read`` adds; a stored column of such a name keeps it.
        self.shard_col, self.file_col = common.fresh(schema.names, "shard", "file")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests.

    def version(self) -> int:
        """The latest committed version, 0 before the first."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        """The live runs of a version: name, files, bytes, tier."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["runs"]
        finally:
            stream.close()

    def _commit(self, base: int, runs: list[dict]) -> bool:
        """Make ``runs`` version base + 1; false if another writer was first."""
        aside = self._path(f"{self.root}/manifest/.tmp-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": base + 1, "runs": runs}, sort_keys=True).encode()))
        out.close()
        final = self._path(f"{self.root}/manifest/v{base + 1:010d}.json")
        if not self._fs.exists(final) and self._fs.rename(aside, final):
            return True
        self._fs.delete(aside, False)
        return False

    def _measure(self, name: str, tier: int) -> dict | None:
        found = [x for x in self._fs.listStatus(self._path(f"{self.root}/{name}")) if x.getPath().getName().endswith(".parquet")]
        size = sum(x.getLen() for x in found)
        return {"name": name, "files": sorted(x.getPath().getName() for x in found), "bytes": size, "tier": tier} if found else None

    # Writers.

    def append(self, arrivals: DataFrame, arrival_col: str | None = None) -> int:
        """Add the rows as one run, or as a run for each value of ``arrival_col`` (which is not
        stored), in one pass and one commit. Returns the version."""
        batch = f"runs/{uuid.uuid4().hex}"
        if arrival_col is None:
            arrivals.write.parquet(f"{self.root}/{batch}")
            names = [batch]
        else:
            arrivals.write.partitionBy(arrival_col).parquet(f"{self.root}/{batch}")
            names = [f"{batch}/{x.getPath().getName()}" for x in self._fs.listStatus(self._path(f"{self.root}/{batch}")) if x.isDirectory()]
        made = [r for r in (self._measure(n, 0) for n in sorted(names)) if r]
        while True:
            base = self.version()
            if self._commit(base, self.runs(base) + made):
                return base + 1

    def tiers(self, runs: list[dict]) -> list[list[dict]]:
        """Runs grouped by similar size, smallest first."""
        out: list[list[dict]] = []
        for r in sorted(runs, key=lambda r: (r["bytes"], r["name"])):
            mean = sum(x["bytes"] for x in out[-1]) / len(out[-1]) if out else None
            if mean is not None and TIER_LOW * mean <= r["bytes"] <= TIER_HIGH * mean:
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def compact(self) -> int:
        """Merge every tier that has enough runs, again until none has. Returns the version."""
        while True:
            base = self.version()
            live = self.runs(base)
            # A run whose files have their target size gains nothing from a merge.
            open_ = [r for r in live if r["bytes"] < self.target_bytes * max(1, len(r["files"])) * TIER_LOW or len(r["files"]) == 1 and r["bytes"] < self.target_bytes]
            tier = next((t for t in self.tiers(open_) if len(t) >= self.min_runs), None)
            if tier is None:
                return base
            name = f"runs/{uuid.uuid4().hex}"
            total = sum(r["bytes"] for r in tier)
            rows = self.spark.read.schema(self.schema).parquet(*self._files(tier))
            rows.coalesce(max(1, math.ceil(total / self.target_bytes))).write.parquet(f"{self.root}/{name}")
            merged = self._measure(name, max(r["tier"] for r in tier) + 1)
            gone = {r["name"] for r in tier}
            # If another writer came first, the same merge is tried on its version.
            while not self._commit(base, [r for r in live if r["name"] not in gone] + [merged]):
                base = self.version()
                live = self.runs(base)
                if not gone <= {r["name"] for r in live}:
                    self._fs.delete(self._path(f"{self.root}/{name}"), True)
                    break

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete runs that none of the last versions uses. Returns how many."""
        last = self.version()
        used = {r["name"] for v in range(max(1, last - keep_versions + 1), last + 1) for r in self.runs(v)}
        dead = {r["name"] for v in range(1, last + 1) for r in (self.runs(v) if self._fs.exists(self._path(f"{self.root}/manifest/v{v:010d}.json")) else [])} - used
        for n in dead:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(dead)

    # Readers.

    def _files(self, runs: list[dict]) -> list[str]:
        return [f"{self.root}/{r['name']}/{f}" for r in runs for f in r["files"]]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the run and file they lie in (``shard_col``, ``file_col``)."""
        runs = self.runs(version)
        if not runs:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumns({c: F.lit(None).cast("string") for c in (self.shard_col, self.file_col)})
        path = F.col("_metadata.file_path")
        rows = self.spark.read.schema(self.schema).parquet(*self._files(runs))
        return rows.withColumns({
            self.shard_col: F.regexp_extract(path, r"(runs/.*)/[^/]*$", 1), self.file_col: F.regexp_extract(path, r"([^/]*)$", 1)})


#: Arrivals of the query, in parts of PARTS: a batch of small ones, then some of four times their
#: size. The small ones merge to one run of the larger size, which makes a second tier complete.
SMALL_ARRIVALS, LARGE_ARRIVALS = 4, 3
PARTS = SMALL_ARRIVALS + 4 * LARGE_ARRIVALS
QUERY_TARGET_BYTES = 32 << 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as runs of two sizes, compacted tier by tier, and read through the last
    manifest."""
    docs = common.table(spark, sf_dir, "documents")
    data = Dataset(spark, f"{common.shared_dir(spark)}/sparkwell/shards-{uuid.uuid4().hex}", docs.schema, QUERY_TARGET_BYTES)
    arrival, = common.fresh(docs.columns, "_arrival")
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(PARTS))
    number = F.when(part < SMALL_ARRIVALS, part).otherwise(SMALL_ARRIVALS + F.floor((part - SMALL_ARRIVALS) / 4))
    data.append(docs.withColumn(arrival, number), arrival)
    data.compact()
    data.vacuum()
    facts = spark.createDataFrame(
        [(r["name"], r["tier"], r["bytes"], len(r["files"])) for r in data.runs()],
        f"{data.shard_col} string, tier int, shard_bytes long, shard_files int")
    out = data.read().select("doc_id", data.shard_col, data.file_col, F.length("text").cast("long").alias("n_chars"))
    return out.join(facts, data.shard_col).select(
        "doc_id", "n_chars", F.col(data.shard_col).alias("shard"), F.col(data.file_col).alias("file"), "tier", "shard_bytes", "shard_files")
