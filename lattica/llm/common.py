"""What the training-data operators share: inputs, scratch tables, Arrow passes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    """Partitions for explicit exchanges: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lattica-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster
    has no folder that all can see, so there it is an error.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def bound_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to ARROW_BYTES (Spark's own limit is 64 MB a batch, in the JVM and again in Python)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def slabs(batches, limit: int):
    """The rows of Arrow batches in batches of about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    whole = pa.Table.from_batches(held).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns], schema=whole.schema)


class Scratch:
    """Tables written to the shared folder to cut lineage and to be read more than once.

    A lost executor costs only its tasks: what is written stays readable by all.
    ``drop`` frees a table that no later result needs; the rest goes when the
    driver's process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        bound_batches(spark)
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/lattica-{what}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_apart(self, df: DataFrame, by: str, name: str) -> dict[str, DataFrame]:
        """Tables by the values of a string column, written in one pass; each can be dropped alone."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(self.path(name))
        schema = T.StructType([f for f in df.schema.fields if f.name != by])
        return {x: self.spark.read.schema(schema).parquet(self.path(f"{name}/{by}={x}")) for x in self._inside(name, by)}

    def _inside(self, name: str, by: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        return [n.split("=", 1)[1] for n in (s.getPath().getName() for s in found) if n.startswith(f"{by}=")]

    def drop(self, name: str = "") -> None:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may have ended before the process
            pass


def trimmed(fn):
    """fn over Arrow batches, after which the worker, that later tasks use too, gives freed memory back to the system."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc keeps it otherwise
                trim(0)

    return run


def binary(col: pa.Array) -> list[bytes]:
    """A text column's rows as UTF-8 bytes; null is empty."""
    return [b or b"" for b in pc.cast(col, pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], limit: int = 1 << 19):
    """Slices of rows of about ``limit`` bytes together, one row at least."""
    lo, size = 0, 0
    for i, b in enumerate(texts):
        if size and size + len(b) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(b) + 1
    if lo < len(texts):
        yield lo, len(texts)


def with_columns(df: DataFrame, fields: list[T.StructField], fn) -> DataFrame:
    """Adds columns computed per Arrow batch; fn(batch) -> list of arrays."""
    bound_batches(df.sparkSession)
    schema = T.StructType(df.schema.fields + fields)
    names = schema.names

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *fn(b)], names=names)

    return df.mapInArrow(trimmed(add), schema)


def guarded(docs: DataFrame, *needed: str):
    """docs with only the needed columns under their names, so none clashes with an operator's own; and what puts all names back."""
    held = {f"c{i}": n for i, n in enumerate(docs.columns) if n not in needed}
    inner = docs.toDF(*(n if n in needed else f"c{i}" for i, n in enumerate(docs.columns)))
    names = [(n if n in needed else f"c{i}", n) for i, n in enumerate(docs.columns)]
    return inner, lambda df: df.select(*(F.col(c).alias(n) for c, n in names), *(c for c in df.columns if c not in held and c not in needed))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n (null where the id is null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
