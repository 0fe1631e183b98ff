"""Operators on the supplier-part, customer-supplier, nation and event matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import Matrix, Scalar, Vector, agg, binary, monoid, semiring
from lattica.functions import ops
from lattica.functions.agg import AGG
from lattica.functions.dtypes import INT64
from lattica.operators import ext
from lattica.operators.expr import Expr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- inputs

SHAPE = (1 << 20, 1 << 24)  # fixed, so no scan is needed to learn a shape


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def sp(spark, d, flag=None, dup="plus") -> Matrix:
    """Supplier by part, quantities."""
    df = read(spark, d, "lineitem")
    df = df if flag is None else df.where(F.col("l_returnflag") == flag)
    return Matrix.from_df(df, "l_suppkey", "l_partkey", F.col("l_quantity").cast("long"), dtype=INT64, shape=SHAPE, dup_op=dup, sparse=True)


def nn(spark, d) -> Matrix:
    """Trade of nations: customer's by supplier's nation, orders counted."""
    df = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return Matrix.from_df(df, "c_nationkey", "s_nationkey", F.lit(1).cast("long"), dtype=INT64, shape=(25, 25), dup_op="plus")


def sz(spark, d) -> Vector:
    """Part sizes."""
    return Vector.from_df(read(spark, d, "part"), "p_partkey", F.col("p_size").cast("long"), dtype=INT64, shape=(SHAPE[1],))


def sn(spark, d) -> Vector:
    """Suppliers' nations."""
    return Vector.from_df(read(spark, d, "supplier"), "s_suppkey", F.col("s_nationkey").cast("long"), dtype=INT64, shape=(SHAPE[0],))


SP = "SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem {} GROUP BY 1, 2"
VIEWS = {
    "sp": SP.format(""), "ra": SP.format("WHERE l_returnflag = 'A'"), "rr": SP.format("WHERE l_returnflag = 'R'"), "rn": SP.format("WHERE l_returnflag = 'N'"),
    "sz": "SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS v FROM part", "sn": "SELECT s_suppkey AS i, CAST(s_nationkey AS BIGINT) AS v FROM supplier",
    "nn": "SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, count(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
}
FLAG = {"sp": None, "ra": "A", "rr": "R", "rn": "N"}


def rows(x) -> DataFrame:
    """The result's coordinates and values."""
    return (x.new() if isinstance(x, Expr) else x).df


def q(name: str, fn, sql: str, *views: str):
    """Registers fn(spark, sf_dir) and its SQL over the named views."""
    QUERIES[name] = lambda spark, d: rows(fn(spark, d))
    ORACLE[name] = ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " if views else "") + sql


# ---------------------------------------------------------------- construction

for _m, _s in {"plus": "sum(x)", "min": "min(x)", "max": "max(x)", "any": "min(x)", "bor": "bit_or(x)", "band": "bit_and(x)", "bxor": "bit_xor(x)"}.items():
    q(f"from_df_dup_{_m}", lambda s, d, m=_m: sp(s, d, dup=m), f"SELECT l_suppkey AS i, l_partkey AS j, CAST({_s} AS BIGINT) AS v FROM (SELECT *, CAST(l_quantity AS BIGINT) AS x FROM lineitem) GROUP BY 1, 2")
q("from_df_iso", lambda s, d: Matrix.from_df(read(s, d, "lineitem"), "l_suppkey", "l_partkey", F.lit(True), shape=SHAPE, dup_op="lor"), "SELECT DISTINCT l_suppkey AS i, l_partkey AS j, true AS v FROM lineitem")
q("embeddings_dense", lambda s, d: Matrix.from_df(read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")), "vec_id", "p", F.round(F.col("x").cast("double") * 1000).cast("long"), shape=SHAPE),
  "SELECT vec_id AS i, CAST(p - 1 AS BIGINT) AS j, CAST(round(CAST(embedding[p] AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings, range(1, 65) t(p)")
q("vector_diag", lambda s, d: sn(s, d).diag(2), "SELECT i, i + 2 AS j, v FROM sn", "sn")

# ---------------------------------------------------------------- products

_MUL = {"times": "a.v * b.v", "plus": "a.v + b.v", "minus": "a.v - b.v", "rminus": "b.v - a.v", "pair": "CAST(1 AS BIGINT)", "first": "a.v", "second": "b.v", "min": "least(a.v, b.v)", "max": "greatest(a.v, b.v)",
        "iseq": "CAST(a.v = b.v AS BIGINT)", "isgt": "CAST(a.v > b.v AS BIGINT)", "land": "CAST(a.v <> 0 AND b.v <> 0 AS BIGINT)", "lxor": "CAST((a.v <> 0) <> (b.v <> 0) AS BIGINT)", "bor": "a.v | b.v", "band": "a.v & b.v",
        "bxor": "xor(a.v, b.v)", "absfirst": "abs(a.v)", "firsti": "a.i", "firstj": "a.j", "secondi": "b.i", "secondj": "b.j", "firsti1": "a.i + 1", "secondj1": "b.j + 1", "eq": "a.v = b.v", "gt": "a.v > b.v"}
_ADD = {"plus": "CAST(sum({}) AS BIGINT)", "min": "min({})", "max": "max({})", "any": "min({})", "bor": "bit_or({})", "band": "bit_and({})", "bxor": "bit_xor({})", "lor": "bool_or({})", "land": "bool_and({})",
        "lxor": "sum(CAST({} AS INT)) % 2 = 1"}
_RINGS = "plus_times min_plus max_plus plus_pair plus_first plus_second min_first max_second plus_minus plus_rminus min_max max_min plus_iseq plus_isgt plus_land plus_lxor bor_bor band_band bxor_band plus_absfirst any_pair min_firsti max_firstj min_secondi max_secondj any_firsti1 any_secondj1 lor_eq land_gt lxor_eq".split()
for _r in _RINGS:
    _a, _b = _r.split("_")
    q(f"mxm_{_r}", lambda s, d, r=_r: sp(s, d, "R").mxm(sp(s, d, "A").T, getattr(semiring, r)), f"SELECT a.i, b.j, {_ADD[_a].format(_MUL[_b])} AS v FROM rr a JOIN (SELECT j AS i, i AS j, v FROM ra) b ON a.j = b.i GROUP BY 1, 2", "rr", "ra")
q("mxv", lambda s, d: sp(s, d).mxv(sz(s, d)), "SELECT a.i, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM sp a JOIN sz b ON a.j = b.i GROUP BY 1", "sp", "sz")
q("vxm", lambda s, d: sn(s, d).vxm(sp(s, d), "max_minus"), "SELECT b.j AS i, max(a.v - b.v) AS v FROM sn a JOIN sp b ON a.i = b.i GROUP BY 1", "sp", "sn")
q("inner", lambda s, d: sp(s, d).reduce_rowwise("plus").new().inner(sn(s, d), "plus_times"), "SELECT CAST(sum(a.v * b.v) AS BIGINT) AS v FROM sp a JOIN sn b ON a.i = b.i", "sp", "sn")
q("outer", lambda s, d: sn(s, d).outer(sn(s, d), "minus"), "SELECT a.i, b.i AS j, a.v - b.v AS v FROM sn a, sn b", "sn")
q("kronecker", lambda s, d: nn(s, d).kronecker(nn(s, d), "plus"), "SELECT a.i * 25 + b.i AS i, a.j * 25 + b.j AS j, a.v + b.v AS v FROM nn a, nn b", "nn")
q("transpose", lambda s, d: sp(s, d).T.new(), "SELECT j AS i, i AS j, v FROM sp", "sp")
q("power_2", lambda s, d: nn(s, d).power(2), "SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM nn a JOIN nn b ON a.j = b.i GROUP BY 1, 2", "nn")
q("power_3_min_plus", lambda s, d: nn(s, d).power(3, "min_plus"), "SELECT a.i, c.j, min(a.v + b.v + c.v) AS v FROM nn a JOIN nn b ON a.j = b.i JOIN nn c ON b.j = c.i GROUP BY 1, 2", "nn")
q("mxm_masked", lambda s, d: _masked(sp(s, d, "R"), sp(s, d, "A"), nn(s, d)), "SELECT a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM rr a JOIN ra b ON a.j = b.j WHERE (a.i, b.i) IN (SELECT (i, j) FROM nn) GROUP BY 1, 2", "rr", "ra", "nn")


def _masked(a, b, m):
    mask = Matrix.of(m.df, INT64, (SHAPE[0], SHAPE[0]))
    return a.mxm(b.T).new(mask=mask.S)


# ---------------------------------------------------------------- element-wise

_EW = {"plus": "x + y", "minus": "x - y", "times": "x * y", "min": "least(x, y)", "max": "greatest(x, y)", "first": "x", "second": "y", "pair": "CAST(1 AS BIGINT)", "floordiv": "CAST(floor(x / y) AS BIGINT)",
       "cdiv": "CAST(x // y AS BIGINT)", "truediv": "x / y", "eq": "x = y", "ne": "x <> y", "lt": "x < y", "ge": "x >= y", "isle": "CAST(x <= y AS BIGINT)", "lor": "CAST(x <> 0 OR y <> 0 AS BIGINT)", "land": "CAST(x <> 0 AND y <> 0 AS BIGINT)",
       "bor": "x | y", "bxor": "xor(x, y)", "bxnor": "~xor(x, y)", "rminus": "y - x", "absfirst": "abs(x)", "numpy_mod": "x % y", "any": "y", "firsti": "i", "secondj": "j"}
for _o, _s in _EW.items():
    q(f"ewise_mult_{_o}", lambda s, d, o=_o: sp(s, d, "R").ewise_mult(sp(s, d, "A"), ops.BINARY[o]), f"SELECT i, j, {_s} AS v FROM (SELECT a.i, a.j, a.v AS x, b.v AS y FROM rr a JOIN ra b ON a.i = b.i AND a.j = b.j)", "rr", "ra")
_FULL = "(SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, a.v AS x, b.v AS y FROM rr a FULL JOIN ra b ON a.i = b.i AND a.j = b.j)"
for _o in ("plus", "minus", "min", "max", "second"):
    q(f"ewise_add_{_o}", lambda s, d, o=_o: sp(s, d, "R").ewise_add(sp(s, d, "A"), o), f"SELECT i, j, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE {_EW[_o]} END AS v FROM {_FULL}", "rr", "ra")
q("ewise_union_minus", lambda s, d: sp(s, d, "R").ewise_union(sp(s, d, "A"), "minus", 0, 0), f"SELECT i, j, coalesce(x, 0) - coalesce(y, 0) AS v FROM {_FULL}", "rr", "ra")
q("ewise_union_times", lambda s, d: sp(s, d, "R").ewise_union(sp(s, d, "A"), "times", 2, 10), f"SELECT i, j, coalesce(x, 2) * coalesce(y, 10) AS v FROM {_FULL}", "rr", "ra")
q("broadcast_mult", lambda s, d: sp(s, d).ewise_mult(sz(s, d), "times"), "SELECT a.i, a.j, a.v * b.v AS v FROM sp a JOIN sz b ON a.j = b.i", "sp", "sz")
q("broadcast_mult_left", lambda s, d: sn(s, d).ewise_mult(sp(s, d), "minus"), "SELECT a.i, a.j, b.v - a.v AS v FROM sp a JOIN sn b ON a.i = b.i", "sp", "sn")
q("broadcast_add", lambda s, d: nn(s, d).select("valuegt", 60).new().ewise_add(nn(s, d).reduce_columnwise("max").new(), "minus"),
  "SELECT g.i, g.j, CASE WHEN a.v IS NULL THEN c.v WHEN c.v IS NULL THEN a.v ELSE a.v - c.v END AS v FROM (SELECT r.i, s.j FROM range(25) r(i), (SELECT DISTINCT j FROM nn) s) g LEFT JOIN (SELECT * FROM nn WHERE v > 60) a ON a.i = g.i AND a.j = g.j LEFT JOIN (SELECT j, max(v) AS v FROM nn GROUP BY j) c ON c.j = g.j", "nn")
q("infix_sub", lambda s, d: sp(s, d, "R") - sp(s, d, "A"), f"SELECT i, j, coalesce(x, 0) - coalesce(y, 0) AS v FROM {_FULL}", "rr", "ra")
q("infix_compare", lambda s, d: sp(s, d, "R") < sp(s, d, "A"), "SELECT a.i, a.j, a.v < b.v AS v FROM rr a JOIN ra b ON a.i = b.i AND a.j = b.j", "rr", "ra")

# ---------------------------------------------------------------- apply and select

_UN = {"identity": "v", "ainv": "-v", "abs": "abs(v)", "one": "CAST(1 AS BIGINT)", "lnot": "CAST(v = 0 AS BIGINT)", "bnot": "~v", "signum": "CAST(sign(v) AS BIGINT)", "square": "v * v", "sqrt": "round(sqrt(v), 9)",
       "exp2": "round(pow(2.0, v % 20), 9)", "log": "round(ln(v), 9)", "log2": "round(log2(v), 9)", "log10": "round(log10(v), 9)", "sin": "round(sin(v), 9)", "atan": "round(atan(v), 9)", "cbrt": "round(cbrt(v), 9)",
       "log1p": "round(ln(1 + v), 9)", "minv": "CAST(CAST(1 AS BIGINT) // v AS BIGINT)", "positioni": "i", "positionj1": "j + 1", "isnan": "false", "isfinite": "true"}


def _un(a, name):
    if name == "exp2":
        a = a.apply("numpy_mod", right=20).new()
    e = a.apply(ops.UNARY[name]).new()
    return Matrix.of(e.df.withColumn("v", F.round("v", 9)), e.dtype, e.shape) if e.dtype.kind == "f" else e


for _o, _s in _UN.items():
    q(f"apply_{_o}", lambda s, d, o=_o: _un(sp(s, d), o), f"SELECT i, j, {_s} AS v FROM sp", "sp")
_BIND = {"plus": "v + 7", "minus": "v - 7", "rminus": "7 - v", "times": "v * 7", "floordiv": "CAST(floor(v / 7) AS BIGINT)", "cdiv": "CAST(v // 7 AS BIGINT)", "numpy_mod": "v % 7", "pow": "CAST(pow(v, 2) AS BIGINT)", "min": "least(v, 7)", "gt": "v > 7",
         "truediv": "v / 7", "bget": "CAST((v >> 6) & 1 AS BIGINT)", "bset": "v | 64", "bclr": "v & ~CAST(64 AS BIGINT)", "bshift": "v * 128"}
for _o, _s in _BIND.items():
    q(f"apply_right_{_o}", lambda s, d, o=_o: sp(s, d).apply(ops.BINARY[o], right=2 if o == "pow" else 7), f"SELECT i, j, {_s} AS v FROM sp", "sp")
q("apply_left_minus", lambda s, d: 100 - sp(s, d), "SELECT i, j, 100 - v AS v FROM sp", "sp")
for _o, _s in {"rowindex": "i + 3", "colindex": "j + 3", "diagindex": "j - i + 3"}.items():
    q(f"apply_{_o}", lambda s, d, o=_o: sp(s, d).apply(o, right=3), f"SELECT i, j, {_s} AS v FROM sp", "sp")
_SEL = {"tril": "j <= i + 9", "triu": "j >= i + 9", "diag": "j = i + 9", "offdiag": "j <> i + 9", "rowle": "i <= 9", "rowgt": "i > 9", "colle": "j <= 9", "colgt": "j > 9", "valueeq": "v = 9", "valuene": "v <> 9", "valuelt": "v < 9", "valuele": "v <= 9", "valuegt": "v > 9", "valuege": "v >= 9"}
for _o, _s in _SEL.items():
    q(f"select_{_o}", lambda s, d, o=_o: sp(s, d).select(o, 9), f"SELECT i, j, v FROM sp WHERE {_s}", "sp")
q("select_mask", lambda s, d: sp(s, d).select(~sp(s, d, "R").S), "SELECT * FROM sp a WHERE NOT EXISTS (SELECT 1 FROM rr b WHERE a.i = b.i AND a.j = b.j)", "sp", "rr")
q("reposition", lambda s, d: nn(s, d).reposition(3, -4), "SELECT i + 3 AS i, j - 4 AS j, v FROM nn WHERE i + 3 < 25 AND j >= 4", "nn")
q("matrix_diag", lambda s, d: nn(s, d).diag(2), "SELECT i, v FROM nn WHERE j = i + 2", "nn")
q("setdiag", lambda s, d: _do(nn(s, d), lambda c: c.setdiag(-1, 1)), "SELECT * FROM nn WHERE j <> i + 1 UNION ALL SELECT i, i + 1, -1 FROM range(24) t(i)", "nn")


def _do(c, change):
    change(c)
    return c


# ---------------------------------------------------------------- reductions

_AGG = {"sum": "CAST(sum(v) AS BIGINT)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "any_value": "min(v)", "any": "bool_or(v <> 0)", "all": "bool_and(v <> 0)", "bitwise_all": "bit_and(v)", "bitwise_any": "bit_or(v)",
        "count_nonzero": "CAST(count_if(v <> 0) AS BIGINT)", "count_zero": "CAST(count_if(v = 0) AS BIGINT)", "sum_of_squares": "CAST(sum(v * v) AS BIGINT)", "sum_of_inverses": "round(sum(1.0 / v), 6)", "exists": "CAST(1 AS BIGINT)",
        "hypot": "round(sqrt(sum(v * v)), 6)", "L0norm": "CAST(count_if(v <> 0) AS BIGINT)", "L1norm": "CAST(sum(abs(v)) AS BIGINT)", "L2norm": "round(sqrt(sum(v * v)), 6)", "Linfnorm": "max(abs(v))", "mean": "round(avg(v), 6)", "peak_to_peak": "max(v) - min(v)",
        "varp": "round(var_pop(v), 6)", "stdp": "round(stddev_pop(v), 6)", "vars": "round(var_samp(v), 6)", "stds": "round(stddev_samp(v), 6)", "harmonic_mean": "round(count(*) / sum(1.0 / v), 6)", "root_mean_square": "round(sqrt(sum(v * v) / count(*)), 6)",
        "logaddexp": "round(ln(sum(exp(v))), 6)", "logaddexp2": "round(ln(sum(exp(v * ln(2)))) / ln(2), 6)"}
_PLACE = {"argmin": "arg_min(p, (v, p))", "argmax": "arg_min(p, (-v, p))", "first": "arg_min(v, p)", "last": "arg_max(v, p)", "first_index": "min(p)", "last_index": "max(p)"}


def _tidy(e):
    x = e.new() if isinstance(e, Expr) else e
    return type(x).of(x.df.withColumn("v", F.round("v", 6)), x.dtype, x.shape) if x.dtype.kind == "f" else x


for _o, _s in (_AGG | _PLACE).items():
    q(f"reduce_row_{_o}", lambda s, d, o=_o: _tidy(sp(s, d).reduce_rowwise(AGG[o])), f"SELECT i, {_s} AS v FROM (SELECT i, j AS p, v FROM sp) GROUP BY i", "sp")
    if _o in ("vars", "stds"):  # a sample of one has no variance: nan here, NULL in SQL
        ORACLE[f"reduce_row_{_o}"] = ORACLE[f"reduce_row_{_o}"].replace(_s, f"coalesce({_s}, 'nan'::DOUBLE)")
for _o in ("sum", "count", "argmax", "first", "mean"):
    q(f"reduce_col_{_o}", lambda s, d, o=_o: _tidy(sp(s, d).reduce_columnwise(AGG[o])), f"SELECT j AS i, {(_AGG | _PLACE)[_o]} AS v FROM (SELECT j, i AS p, v FROM sp) GROUP BY j", "sp")
for _o, _s in _AGG.items():
    q(f"reduce_all_{_o}", lambda s, d, o=_o: _tidy(sp(s, d).reduce_scalar(AGG[o])), f"SELECT {_s} AS v FROM sp" + " LIMIT 1" * (_o == "exists"), "sp")
for _o in ("plus", "min", "max", "lor", "bxor", "lxnor", "bxnor", "times"):
    _s = {"plus": "CAST(sum(v) AS BIGINT)", "min": "min(v)", "max": "max(v)", "lor": "CAST(bool_or(v <> 0) AS BIGINT)", "bxor": "bit_xor(v)", "lxnor": "CAST(count_if(v = 0) % 2 = 0 AS BIGINT)",
          "bxnor": "CASE WHEN count(*) % 2 = 1 THEN bit_xor(v) ELSE ~bit_xor(v) END", "times": "CAST(product(CASE WHEN v % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT)"}[_o]
    q(f"reduce_monoid_{_o}", lambda s, d, o=_o: (sp(s, d) if o != "times" else sp(s, d).apply(ops.register_unary(None, lambda x: F.when(x % 2 == 0, 1).otherwise(-1).cast("long"))).new()).reduce_rowwise(getattr(monoid, o)), f"SELECT i, {_s} AS v FROM sp GROUP BY i", "sp")
q("reduce_vector", lambda s, d: sz(s, d).reduce("max"), "SELECT max(v) AS v FROM sz", "sz")

# ---------------------------------------------------------------- scans, sorts, top-k, shapes

q("scan_row_plus", lambda s, d: sp(s, d).ss.scan("plus"), "SELECT i, j, CAST(sum(v) OVER (PARTITION BY i ORDER BY j) AS BIGINT) AS v FROM sp", "sp")
q("scan_col_max", lambda s, d: sp(s, d).ss.scan("max", "columnwise"), "SELECT i, j, max(v) OVER (PARTITION BY j ORDER BY i) AS v FROM sp", "sp")
q("scan_vector", lambda s, d: sz(s, d).ss.scan("plus"), "SELECT i, CAST(sum(v) OVER (ORDER BY i) AS BIGINT) AS v FROM sz", "sz")
q("scan_vector_min", lambda s, d: sz(s, d).ss.scan("min"), "SELECT i, min(v) OVER (ORDER BY i) AS v FROM sz", "sz")
q("sort_rows", lambda s, d: sp(s, d).ss.sort()[0], "SELECT i, row_number() OVER (PARTITION BY i ORDER BY v, j) - 1 AS j, v FROM sp", "sp")
q("sort_rows_permutation", lambda s, d: sp(s, d).ss.sort("gt")[1], "SELECT i, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) - 1 AS j, j AS v FROM sp", "sp")
q("sort_vector", lambda s, d: sz(s, d).ss.sort()[1], "SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, i AS v FROM sz", "sz")
for _h, _s in {"first": "j", "last": "j DESC", "smallest": "v, j", "largest": "v DESC, j"}.items():
    q(f"selectk_{_h}", lambda s, d, h=_h: sp(s, d).ss.selectk(h, 3), f"SELECT i, j, v FROM sp QUALIFY row_number() OVER (PARTITION BY i ORDER BY {_s}) <= 3", "sp")
q("selectk_vector", lambda s, d: sz(s, d).ss.selectk("largest", 20), "SELECT * FROM sz ORDER BY v DESC, i LIMIT 20", "sz")
q("compactify", lambda s, d: sp(s, d).ss.compactify("largest", 4, asindex=True), "SELECT i, j, v FROM (SELECT i, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) - 1 AS j, j AS v FROM sp) WHERE j < 4", "sp")
q("compactify_vector", lambda s, d: sz(s, d).ss.compactify("smallest"), "SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, v FROM sz", "sz")
q("flatten", lambda s, d: nn(s, d).ss.flatten(), "SELECT i * 25 + j AS i, v FROM nn", "nn")
q("flatten_columnwise", lambda s, d: nn(s, d).ss.flatten("columnwise"), "SELECT j * 25 + i AS i, v FROM nn", "nn")
q("reshape", lambda s, d: nn(s, d).ss.reshape(5, 125), "SELECT (i * 25 + j) // 125 AS i, (i * 25 + j) % 125 AS j, v FROM nn", "nn")
q("concat", lambda s, d: ext.concat([[nn(s, d), nn(s, d)], [nn(s, d), nn(s, d).T.new()]]), "SELECT i, j, v FROM nn UNION ALL SELECT i, j + 25, v FROM nn UNION ALL SELECT i + 25, j, v FROM nn UNION ALL SELECT j + 25, i + 25, v FROM nn", "nn")
q("split", lambda s, d: nn(s, d).ss.split([10, 15], 7)[1][2], "SELECT i - 10 AS i, j - 14 AS j, v FROM nn WHERE i >= 10 AND j >= 14 AND j < 21", "nn")

# ---------------------------------------------------------------- write-back

_W = """SELECT i, j, CASE WHEN m THEN CASE WHEN {acc} THEN CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE x + y END ELSE y END ELSE x END AS v
FROM (SELECT coalesce(c.i, t.i) AS i, coalesce(c.j, t.j) AS j, c.v AS x, t.v AS y, {mask} AS m FROM rr c FULL JOIN ra t ON c.i = t.i AND c.j = t.j LEFT JOIN rn n ON n.i = coalesce(c.i, t.i) AND n.j = coalesce(c.j, t.j))
WHERE CASE WHEN m THEN y IS NOT NULL OR ({acc} AND x IS NOT NULL) ELSE x IS NOT NULL AND NOT {rep} END"""


def _written(c, t, n, kind, comp, accum, replace):
    m = n.apply("minus", right=20).new()  # some stored zeros
    mask = m.S if kind == "S" else m.V
    c(~mask if comp else mask, accum=binary.plus if accum else None, replace=replace) << t
    return c


for _k in "SV":
    for _c in (False, True):
        for _acc in (False, True):
            for _rep in (False, True):
                _test = "n.v IS NOT NULL" if _k == "S" else "coalesce(n.v, 20) <> 20"
                q(f"write_{'not_' if _c else ''}{_k}{'_accum' if _acc else ''}{'_replace' if _rep else ''}",
                  lambda s, d, k=_k, c=_c, a=_acc, r=_rep: _written(sp(s, d, "R"), sp(s, d, "A"), sp(s, d, "N"), k, c, a, r),
                  _W.format(acc=str(_acc).lower(), rep=str(_rep).lower(), mask=f"NOT ({_test})" if _c else _test), "rr", "ra", "rn")
q("write_accum", lambda s, d: _do(sp(s, d, "R"), lambda c: c(accum="plus") << sp(s, d, "A")), f"SELECT i, j, coalesce(x, 0) + coalesce(y, 0) AS v FROM {_FULL}", "rr", "ra")
q("mask_union", lambda s, d: (sp(s, d, "R").S | sp(s, d, "A").S).new(), "SELECT i, j, true AS v FROM rr UNION SELECT i, j, true FROM ra", "rr", "ra")
q("mask_difference", lambda s, d: (sp(s, d, "R").S & ~sp(s, d, "A").S).new(), "SELECT a.i, a.j, true AS v FROM rr a WHERE NOT EXISTS (SELECT 1 FROM ra b WHERE a.i = b.i AND a.j = b.j)", "rr", "ra")
q("mask_complement", lambda s, d: (~nn(s, d).select("valuegt", 60).new().S).new(), "SELECT r.i, c.j, true AS v FROM range(25) r(i), range(25) c(j) WHERE (r.i, c.j) NOT IN (SELECT (i, j) FROM nn WHERE v > 60)", "nn")

# ---------------------------------------------------------------- extract, assign, delete

q("extract_list", lambda s, d: nn(s, d)[[3, 1, 3], [0, 5, 2]].new(), "SELECT r.n AS i, c.n AS j, v FROM nn JOIN (VALUES (0, 3), (1, 1), (2, 3)) r(n, o) ON i = r.o JOIN (VALUES (0, 0), (1, 5), (2, 2)) c(n, o) ON j = c.o", "nn")
ORACLE["extract_list"] = ORACLE["extract_list"].replace("r.n AS i, c.n AS j", "CAST(r.n AS BIGINT) AS i, CAST(c.n AS BIGINT) AS j")
q("extract_slice", lambda s, d: sp(s, d)[2:40:3, 100:50:-1].new(), "SELECT (i - 2) // 3 AS i, 100 - j AS j, v FROM sp WHERE i >= 2 AND i < 40 AND (i - 2) % 3 = 0 AND j > 50 AND j <= 100", "sp")
q("extract_row", lambda s, d: sp(s, d)[5, :].new(), "SELECT j AS i, v FROM sp WHERE i = 5", "sp")
q("extract_column", lambda s, d: sp(s, d)[:, 7].new(), "SELECT i, v FROM sp WHERE j = 7", "sp")
q("extract_element", lambda s, d: nn(s, d)[3, 4].new(), "SELECT v FROM nn WHERE i = 3 AND j = 4", "nn")
q("assign_region", lambda s, d: _do(nn(s, d), lambda c: c[2:6, [1, 9, 4]] << nn(s, d)[0:4, 10:13].new().select("valuegt", 20).new()),
  "SELECT * FROM nn WHERE NOT (i BETWEEN 2 AND 5 AND j IN (1, 9, 4)) UNION ALL SELECT i + 2, CASE j WHEN 10 THEN 1 WHEN 11 THEN 9 ELSE 4 END, v FROM nn WHERE i < 4 AND j BETWEEN 10 AND 12 AND v > 20", "nn")
q("assign_scalar", lambda s, d: _do(nn(s, d), lambda c: c[3, :] << 7), "SELECT * FROM nn WHERE i <> 3 UNION ALL SELECT 3, j, 7 FROM range(25) t(j)", "nn")
q("assign_accum", lambda s, d: _do(nn(s, d), lambda c: c(accum="plus")[0:5, 0:5] << nn(s, d)[5:10, 5:10].new()),
  "SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM nn UNION ALL SELECT i - 5, j - 5, v FROM nn WHERE i BETWEEN 5 AND 9 AND j BETWEEN 5 AND 9) GROUP BY 1, 2", "nn")
q("assign_masked_replace", lambda s, d: _do(nn(s, d), lambda c: c(nn(s, d).select("valuegt", 40).new().S, replace=True)[0:5, :] << -1), "SELECT i, j, CASE WHEN i < 5 THEN -1 ELSE v END AS v FROM nn WHERE v > 40", "nn")
q("subassign_masked_replace", lambda s, d: _do(nn(s, d), lambda c: c[0:5, 0:5](nn(s, d)[5:10, 5:10].new().select("valuegt", 40).new().S, replace=True) << -1),
  "SELECT * FROM nn WHERE NOT (i < 5 AND j < 5) UNION ALL SELECT i - 5, j - 5, -1 FROM nn WHERE i BETWEEN 5 AND 9 AND j BETWEEN 5 AND 9 AND v > 40", "nn")
q("assign_row_vector", lambda s, d: _do(nn(s, d), lambda c: c[4, :] << nn(s, d).reduce_columnwise("max").new()), "SELECT * FROM nn WHERE i <> 4 UNION ALL SELECT 4, j, max(v) FROM nn GROUP BY j", "nn")
q("delete_region", lambda s, d: _do(nn(s, d), lambda c: c.__delitem__((slice(0, 10), slice(5, 9)))), "SELECT * FROM nn WHERE NOT (i < 10 AND j >= 5 AND j < 9)", "nn")
q("resize", lambda s, d: _do(nn(s, d), lambda c: c.resize(10, 12)), "SELECT * FROM nn WHERE i < 10 AND j < 12", "nn")
q("dup_mask", lambda s, d: sp(s, d).dup(mask=sp(s, d, "R").S), "SELECT a.* FROM sp a JOIN rr b ON a.i = b.i AND a.j = b.j", "sp", "rr")
q("dup_cast", lambda s, d: sp(s, d).dup("FP64"), "SELECT i, j, CAST(v AS DOUBLE) AS v FROM sp", "sp")

# ---------------------------------------------------------------- user operators

q("udf_unary", lambda s, d: sp(s, d).apply(ops.register_unary(None, lambda x: x * x + 1)), "SELECT i, j, v * v + 1 AS v FROM sp", "sp")
q("udf_select", lambda s, d: sp(s, d).select(ops.register_indexunary(None, lambda x, i, j, k: (i + j) % 3 == k), 1), "SELECT * FROM sp WHERE (i + j) % 3 = 1", "sp")
q("udf_indexbinary", lambda s, d: sp(s, d, "R").ewise_mult(sp(s, d, "A"), ops.register_indexbinary(None, lambda x, ix, jx, y, iy, jy, t: x * ix + y * jy + t)(5)), "SELECT a.i, a.j, a.v * a.i + b.v * b.j + 5 AS v FROM rr a JOIN ra b ON a.i = b.i AND a.j = b.j", "rr", "ra")
q("udf_monoid", lambda s, d: sp(s, d).reduce_rowwise(ops.register_monoid(None, ops.register_binary(None, lambda x, y: F.pmod(x + y, F.lit(97))), 0)), "SELECT i, CAST(sum(v) % 97 AS BIGINT) AS v FROM sp GROUP BY i", "sp")
q("custom_aggregator", lambda s, d: sp(s, d).reduce_rowwise(agg.custom("sum_minus_max", lambda v: F.sum(v) - F.max(v))), "SELECT i, CAST(sum(v) - max(v) AS BIGINT) AS v FROM sp GROUP BY i", "sp")
q("scalar_from_value", lambda s, d: Scalar.from_value(5), "SELECT CAST(5 AS BIGINT) AS v")
