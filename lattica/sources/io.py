"""Reading and writing collections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import dtypes as dt
from lattica.functions import ops
from lattica.operators.collection import Matrix, Vector, session
from lattica.operators.ext import ranked


def save(a, path: str, compression: str = "zstd") -> None:
    """Rows as Parquet, with type and shape beside them."""
    a.df.write.mode("overwrite").option("compression", compression).parquet(f"{path}/rows")
    meta = json.dumps({"kind": type(a).__name__, "dtype": a.dtype.name, "shape": a.shape})
    session().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str, spark: SparkSession | None = None):
    spark = spark or session()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return {"Matrix": Matrix, "Vector": Vector}[meta["kind"]].of(spark.read.parquet(f"{path}/rows"), dt.lookup(meta["dtype"]), tuple(meta["shape"]))


def dictionary(df: DataFrame, key: str) -> DataFrame:
    """(key, id): dense ids from 0 in key order, by ranges that are written once and their sizes."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return ranked(keys, key).select(key, (F.col("r") - 1).alias("id"))


def from_keys(df: DataFrame, row: str, column: str, value=None, *, dup_op="plus", dtype=None) -> tuple[Matrix, DataFrame, DataFrame]:
    """A matrix from columns of any type, with the dictionaries of its rows and columns."""
    rows, cols = dictionary(df, row), dictionary(df, column)
    j = df.join(rows.withColumnRenamed("id", "__i"), row).join(cols.withColumnRenamed("id", "__j"), column)
    a = Matrix.from_df(j, "__i", "__j", F.lit(1) if value is None else value, dtype=dtype, dup_op=dup_op, shape=(rows.count(), cols.count()))
    return a, rows, cols


def mmread(path: str, *, dup_op=None, spark: SparkSession | None = None) -> Matrix:
    """A Matrix Market file: coordinate or array; real, integer, complex or pattern; all symmetries."""
    spark = spark or session()
    # parts and splits are not read in order: file, offset of the split, then line
    lines = spark.read.text(path).withColumn("n", F.struct(F.input_file_name().alias("f"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("m")))
    head = lines.where("value like '\\%\\%MatrixMarket%'").first()
    if head is None:
        raise ValueError("no Matrix Market header")
    _, _, layout, field, symmetry = head.value.lower().split()
    body = lines.where("trim(value) <> '' and value not like '\\%%'")
    size = body.orderBy("n").first()
    shape = tuple(map(int, size.value.split()[:2]))
    body = body.where(F.col("n.m") != size.n.m)
    parts = F.split(F.trim("value"), r"\s+")
    kind = {"integer": dt.INT64, "real": dt.FP64, "double": dt.FP64, "pattern": dt.BOOL, "complex": dt.FC64}[field]
    if layout == "array":
        w = Window.orderBy("n")
        tri = symmetry != "general"
        at = body.withColumn("r", F.row_number().over(w) - 1)
        if tri:  # columns of the lower triangle, one after the other
            cells = [(k, i, j) for k, (i, j) in enumerate((i, j) for j in range(shape[1]) for i in range(j + (symmetry == "skew-symmetric"), shape[0]))]
            at = at.join(spark.createDataFrame(cells, "r int, i long, j long"), "r")
        else:
            at = at.withColumn("i", (F.col("r") % shape[0]).cast("long")).withColumn("j", F.floor(F.col("r") / shape[0]).cast("long"))
        first = 0
    else:
        at = body.withColumn("i", parts[0].cast("long") - 1).withColumn("j", parts[1].cast("long") - 1)
        first = 2
    if kind == dt.FC64:
        v = F.struct(parts[first].cast("double").alias("re"), parts[first + 1].cast("double").alias("im"))
    else:
        v = F.lit(True) if kind == dt.BOOL else parts[first].cast(kind.spark)
    df = at.select("i", "j", v.alias("v"))
    if symmetry != "general":
        op = {"symmetric": "identity", "skew-symmetric": "ainv", "hermitian": "conj" if kind == dt.FC64 else "identity"}[symmetry]
        mirror = df.where("i <> j").select(F.col("j").alias("a"), F.col("i").alias("b"), ops.UNARY[op].compute(F.col("v"), kind).alias("v")).toDF("i", "j", "v")
        df = df.union(mirror)
    if dup_op is not None:
        df = df.groupBy("i", "j").agg(ops.as_monoid(dup_op).reduce(F.col("v"), kind).alias("v"))
    return Matrix.of(df, kind, shape)


def mmwrite(path: str, a: Matrix, *, comment: str = "") -> None:
    """Coordinate format, as a folder of text parts whose first holds the header."""
    field = {"b": "pattern", "i": "integer", "u": "integer", "f": "real", "c": "complex"}[a.dtype.kind]
    v = {"pattern": [], "complex": [F.col("v.re").cast("string"), F.col("v.im").cast("string")]}.get(field, [F.col("v").cast("string")])
    df = a.df if field != "pattern" else a.df.where("v")
    lines = df.orderBy("i", "j").select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *v).alias("value"))
    head = [f"%%MatrixMarket matrix coordinate {field} general", *(f"%{c}" for c in comment.splitlines()), f"{a.nrows} {a.ncols} {df.count()}"]
    top = session().createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    top.union(lines).write.mode("overwrite").text(path)


def from_networkx(g, nodelist=None, dtype=None, weight="weight") -> Matrix:
    nodes = list(g) if nodelist is None else list(nodelist)
    at = {n: i for i, n in enumerate(nodes)}
    edges = [(at[a], at[b], d.get(weight, 1)) for a, b, d in g.edges(data=True) if a in at and b in at]
    if not g.is_directed():
        edges += [(b, a, w) for a, b, w in edges if a != b]
    return Matrix.from_edgelist(edges, dtype=dtype, nrows=len(nodes), ncols=len(nodes)) if edges else Matrix(dtype or dt.FP64, len(nodes), len(nodes))


def to_networkx(a: Matrix, edge_attribute="weight"):
    import networkx as nx

    g = nx.DiGraph()
    g.add_nodes_from(range(a.nrows))
    g.add_edges_from((i, j, {edge_attribute: v}) for (i, j), v in a.ss.iteritems())
    return g


def from_scipy_sparse(m, *, dup_op=None) -> Matrix:
    c = m.tocoo()
    return Matrix.from_coo(c.row, c.col, c.data, nrows=c.shape[0], ncols=c.shape[1], dup_op=dup_op)


def to_scipy_sparse(a: Matrix, format: str = "csr"):
    from scipy import sparse

    i, j, v = a.to_coo()
    return sparse.coo_array((v, (i.astype(int), j.astype(int))), shape=a.shape).asformat(format)


def from_pydata_sparse(s, *, dup_op=None):
    c = s.asformat("coo")
    if c.ndim == 1:
        return Vector.from_coo(c.coords[0], c.data, size=c.shape[0], dup_op=dup_op)
    return Matrix.from_coo(c.coords[0], c.coords[1], c.data, nrows=c.shape[0], ncols=c.shape[1], dup_op=dup_op)


def to_pydata_sparse(a, format: str = "coo"):
    import sparse

    *at, v = a.to_coo()
    return sparse.COO([x.astype(int) for x in at], v, shape=a.shape).asformat(format)
