"""Written tables between steps, in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own, if driver and tasks are one process; on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines of the cluster see")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _own[0]


class Tables:
    """Tables of one job. put() writes and reads again, which cuts the lineage and survives the loss of an executor; drop() deletes one, clear() all, as does the driver's end."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._end)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        where = f"{self.root}/{self.n}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._written_at = where
        return out

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._written_at)

    def clear(self) -> None:
        self._delete(self.root)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.clear()
