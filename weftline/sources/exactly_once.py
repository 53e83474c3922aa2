"""A sink that holds every row of a stream once: rows, keys and frames of a batch become visible together, under the batch's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """A folder of committed batches. Each batch writes its tables into folders of its own and then one mark, whose creation is what commits it.

    A batch that comes again, as after a crash before Spark noted its end, is left out if it is marked; else what it had
    begun to write is replaced. Only marked batches are read, so a crash between two tables leaves nothing of it behind.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _mark(self, batch: int) -> str:
        return f"{self.root}/_committed/{batch}"

    def is_committed(self, batch: int) -> bool:
        return self._fs.exists(self._path(self._mark(batch)))

    def committed(self) -> list[int]:
        marks = self._path(f"{self.root}/_committed")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(marks)) if self._fs.exists(marks) else []

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Writes tables in their order, then the mark. False if the batch was committed before."""
        if self.is_committed(batch):
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").json(f"{self.root}/{name}/{batch}")
        self._fs.create(self._path(self._mark(batch)), False).close()
        return True

    def read(self, name: str, schema: str) -> DataFrame:
        """What committed batches hold of table name."""
        batches = self.committed()
        paths = [p for p in (f"{self.root}/{name}/{b}" for b in batches) if self._fs.exists(self._path(p))]
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)

    def sink(self, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: commits what tables makes of each batch. The batch is read once for each table, so it is kept while it is written."""

        def write(df: DataFrame, batch: int) -> None:
            if self.is_committed(batch):
                return
            df.persist()
            try:
                self.commit(batch, tables(df))
            finally:
                df.unpersist()

        return write


def rows_and_keys(key: str) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """The tables of a resumable job: rows, and the keys that are done."""
    return lambda df: {"rows": df, "keys": df.select(key).distinct()}
