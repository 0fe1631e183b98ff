"""Streams of edges accumulated into a matrix with a monoid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import ops
from lattica.operators.collection import Matrix


class EdgeStream:
    """A matrix fed by a streaming DataFrame of (row, column, value).

    Every micro-batch is folded with the monoid and written to its own folder under
    ``path`` (idempotent: a batch that is retried overwrites itself), and ``matrix``
    folds the folders.
    """

    def __init__(self, path: str, dtype, shape: tuple, monoid="plus"):
        from lattica.functions import dtypes as dt

        self.path, self.dtype, self.shape, self.monoid = path, dt.lookup(dtype), shape, ops.as_monoid(monoid)

    def sink(self, df: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``."""
        m = Matrix.from_df(df, *df.columns[:3], dtype=self.dtype, shape=self.shape, dup_op=self.monoid)
        m.df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def matrix(self, spark) -> Matrix:
        df = spark.read.parquet(self.path)
        return Matrix.from_df(df, "i", "j", F.col("v"), dtype=self.dtype, shape=self.shape, dup_op=self.monoid)
