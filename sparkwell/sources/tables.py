"""Tables in the shared folder: step results of loops, versioned snapshots, views that refresh."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one is set only where it is unset and driver and
    executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkwell-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder: loops keep a short lineage, and a lost
    executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/sparkwell/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotTable:
    """Versions of a table as folders ``v=<n>``; a version is there once its writer's success
    mark is. Reads name a version or take the last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._p(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._p(self.path))]
        nums = sorted(int(n[2:]) for n in names if n.startswith("v="))
        return [n for n in nums if self._fs.exists(self._p(f"{self.path}/v={n}/_SUCCESS"))]

    def write(self, df: DataFrame, mode: str = "overwrite") -> int:
        """overwrite, append, error or ignore. Returns the version that readers now see."""
        have = self.versions()
        if have and mode == "ignore":
            return have[-1]
        if have and mode == "error":
            raise ValueError(f"{self.path} exists")
        if have and mode == "append":
            df = self.read().unionByName(df)
        new = (have[-1] if have else 0) + 1
        df.write.mode("error").parquet(f"{self.path}/v={new}")
        return new

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.versions()[-1] if version is None else version}")

    def vacuum(self, keep: int = 1) -> None:
        for v in self.versions()[:-keep]:
            self._fs.delete(self._p(f"{self.path}/v={v}"), True)


def incremental_sum_refresh(view: DataFrame, new_rows: DataFrame, key: list[str], sums: dict[str, str], count: str = "n") -> DataFrame:
    """A materialised view of sums and a count after new rows: only these are aggregated."""
    delta = new_rows.groupBy(*key).agg(*[F.sum(src).alias(out) for out, src in sums.items()], F.count("*").alias(count))
    return view.unionByName(delta).groupBy(*key).agg(*[F.sum(c).alias(c) for c in (*sums, count)])


def refreshable(columns: list[str], has_window: bool = False, has_distinct: bool = False, has_limit: bool = False, has_order: bool = False) -> bool:
    """Whether a view can be refreshed from new rows alone."""
    return bool(columns) and not (has_window or has_distinct or has_limit or has_order)


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """A change log (op c/u/r/d, the columns after the change, and an order) onto a table: the
    last change of a key decides."""
    rest = [c for c in table.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("_o"), F.col("op").alias("_op"), *rest)).alias("_c"))
    kept = table.join(last.select(*key), key, "left_anti")
    new = last.filter("_c._op <> 'd'").select(*key, *[F.col(f"_c.{c}") for c in rest])
    return kept.select(*table.columns).unionByName(new.select(*table.columns))
