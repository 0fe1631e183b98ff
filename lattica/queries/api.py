"""Queries of the collection interface, element types, complex numbers and the less common operators."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import Matrix, Scalar, Vector, agg, binary, monoid, select, semiring, unary
from lattica.functions import dtypes as dt
from lattica.functions import ops
from lattica.functions.dtypes import BOOL, FP64, INT64
from lattica.operators import ext
from lattica.operators.collection import session
from lattica.operators.expr import Expr, op as any_op
from lattica.queries.algebra import VIEWS, nn, read, sn, sp, sz
from lattica.sources import io

QUERIES, ORACLE = {}, {}


def q(name: str, fn, sql: str, *views: str):
    """Registers fn(spark, sf_dir) -> collection, expression or DataFrame, and its SQL over the named views."""

    def run(spark, d) -> DataFrame:
        x = fn(spark, d)
        x = x.new() if isinstance(x, Expr) else x
        return x if isinstance(x, DataFrame) else x.df

    QUERIES[name] = run
    ORACLE[name] = ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " if views else "") + sql


def do(c, change):
    change(c)
    return c


def facts(**x) -> DataFrame:
    """One row of plain values."""
    return session().createDataFrame([tuple(x.values())], list(x))


def shared(name: str) -> str:
    sc = session().sparkContext
    where = sc.getCheckpointDir()
    if not where:
        raise ValueError("set spark.checkpoint.dir")
    return f"{where}/{name}-{uuid.uuid4().hex}"


def nation(spark, d):
    """The nation table's keys and regions as arrays: it has 25 rows at every size."""
    r = read(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    return np.array([x[0] for x in r]), np.array([x[1] for x in r])


def nat(spark, d) -> Matrix:
    k, r = nation(spark, d)
    return Matrix.from_coo(k, r, k * 2, INT64, nrows=25, ncols=5)


NAT = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS j, CAST(n_nationkey * 2 AS BIGINT) AS v FROM nation"
NATV = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS v FROM nation"

# ---------------------------------------------------------------- construction and export

q("matrix_new_empty", lambda s, d: Matrix(INT64, 3, 4), "SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS v WHERE false")
q("vector_new_empty", lambda s, d: Vector(INT64, 3), "SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS v WHERE false")
q("scalar_new_empty", lambda s, d: Scalar(INT64), "SELECT CAST(0 AS BIGINT) AS v WHERE false")
q("matrix_from_coo", nat, NAT)
q("vector_from_coo", lambda s, d: Vector.from_coo(*nation(s, d), INT64, size=25), NATV)
q("from_coo_dup_op", lambda s, d: Vector.from_coo(nation(s, d)[1], nation(s, d)[0], INT64, size=5, dup_op=binary.plus), "SELECT CAST(n_regionkey AS BIGINT) AS i, CAST(sum(n_nationkey) AS BIGINT) AS v FROM nation GROUP BY 1")
q("matrix_build", lambda s, d: do(Matrix(INT64, 25, 5), lambda c: c.build(*nation(s, d), nation(s, d)[0] * 2)), NAT)
q("vector_build", lambda s, d: do(Vector(INT64, 25), lambda c: c.build(*nation(s, d))), NATV)
q("from_edgelist", lambda s, d: Matrix.from_edgelist(list(zip(*(x.tolist() for x in nation(s, d)), (nation(s, d)[0] * 2).tolist(), strict=True)), dtype=INT64, nrows=25, ncols=5), NAT)
q("from_pairs", lambda s, d: Vector.from_pairs(list(zip(*(x.tolist() for x in nation(s, d)), strict=True)), INT64, size=25), NATV)
q("from_dicts", lambda s, d: Matrix.from_dicts(nat(s, d).to_dicts(), INT64, nrows=25, ncols=5), NAT)
q("from_dict", lambda s, d: Vector.from_dict(Vector.from_coo(*nation(s, d), INT64, size=25).to_dict(), INT64, size=25), NATV)
for _f in ("csr", "csc", "dcsr", "dcsc"):
    def _compressed(s, d, f=_f):
        a = nn(s, d)
        return getattr(Matrix, f"from_{f}")(*getattr(a, f"to_{f}")(), INT64, **({"ncols": 25} if f == "csr" else {"nrows": 25} if f == "csc" else {"nrows": 25, "ncols": 25}))

    q(f"from_{_f}", _compressed, "SELECT * FROM nn", "nn")
q("matrix_from_scalar", lambda s, d: Matrix.from_scalar(7, 4, 3, INT64), "SELECT r.i, c.j, CAST(7 AS BIGINT) AS v FROM range(4) r(i), range(3) c(j)")
q("vector_from_scalar", lambda s, d: Vector.from_scalar(7, 9, INT64), "SELECT i, CAST(7 AS BIGINT) AS v FROM range(9) t(i)")
q("matrix_from_dense", lambda s, d: Matrix.from_dense(nat(s, d).to_dense(0), 0, dtype=INT64), f"SELECT * FROM ({NAT}) WHERE v <> 0")
q("vector_from_dense", lambda s, d: Vector.from_dense(nation(s, d)[1], dtype=INT64), NATV)
q("to_coo", lambda s, d: Matrix.from_coo(*nn(s, d).to_coo(), INT64, nrows=25, ncols=25), "SELECT * FROM nn", "nn")
q("to_edgelist", lambda s, d: Matrix.from_edgelist(*nn(s, d).to_edgelist(), INT64, nrows=25, ncols=25), "SELECT * FROM nn", "nn")
q("to_dicts_columnwise", lambda s, d: Matrix.from_dicts(nn(s, d).to_dicts("columnwise"), INT64, nrows=25, ncols=25), "SELECT j AS i, i AS j, v FROM nn", "nn")
q("to_dense", lambda s, d: Matrix.from_dense(nn(s, d).to_dense(-1), -1, dtype=INT64), "SELECT * FROM nn", "nn")
q("build_scalar", lambda s, d: do(Matrix(INT64, 25, 5), lambda c: c.ss.build_scalar(*nation(s, d), 3)), f"SELECT i, j, CAST(3 AS BIGINT) AS v FROM ({NAT})")
q("vector_build_scalar", lambda s, d: do(Vector(INT64, 25), lambda c: c.ss.build_scalar(nation(s, d)[0], 3)), f"SELECT i, CAST(3 AS BIGINT) AS v FROM ({NATV})")
for _f in ("coo", "csr", "csc", "hypercsr", "hypercsc", "bitmapr"):
    q(f"export_import_{_f}", lambda s, d, f=_f: ext.MatrixExt.import_any(**nat(s, d).ss.export(f)), NAT)
for _f in ("sparse", "bitmap", "full"):
    q(f"vector_export_import_{_f}", lambda s, d, f=_f: ext.VectorExt.import_any(**Vector.from_coo(*nation(s, d), INT64, size=25).ss.export(f)), NATV)
q("pickle_matrix", lambda s, d: pickle.loads(pickle.dumps(nn(s, d))), "SELECT * FROM nn", "nn")
q("pickle_vector", lambda s, d: pickle.loads(pickle.dumps(sn(s, d))), "SELECT * FROM sn", "sn")


def _saved(a):
    path = shared("saved")
    a.ss.serialize(path)
    return io.load(path)


def _market(a):
    path = shared("market")
    io.mmwrite(path, a)
    return io.mmread(path)


q("serialize", lambda s, d: _saved(sp(s, d)), "SELECT * FROM sp", "sp")
q("serialize_vector", lambda s, d: _saved(sn(s, d)), "SELECT * FROM sn", "sn")
q("matrix_market", lambda s, d: _market(sp(s, d)), "SELECT * FROM sp", "sp")

# ---------------------------------------------------------------- accessors

q("shape_and_nvals", lambda s, d: (lambda a: facts(nrows=a.nrows, ncols=a.ncols, nvals=a.nvals))(nn(s, d)), "SELECT CAST(25 AS BIGINT) AS nrows, CAST(25 AS BIGINT) AS ncols, count(*) AS nvals FROM nn", "nn")
q("vector_size", lambda s, d: (lambda a: facts(size=a.size, nvals=a.nvals))(Vector.from_coo(*nation(s, d), INT64, size=30)), "SELECT CAST(30 AS BIGINT) AS size, count(*) AS nvals FROM nation")
q("get", lambda s, d: (lambda a: facts(there=a.get(3, 4), absent=a.get(24, 24, default=-1) if (24, 24) not in a else -1))(nn(s, d).select("offdiag", 0).new()), "SELECT (SELECT v FROM nn WHERE i = 3 AND j = 4) AS there, CAST(-1 AS BIGINT) AS absent", "nn")
q("contains", lambda s, d: (lambda a: facts(a=(3, 4) in a, b=(4, 4) in a))(nn(s, d).select("offdiag", 0).new()), "SELECT EXISTS (SELECT 1 FROM nn WHERE i = 3 AND j = 4) AS a, false AS b", "nn")
q("iterate", lambda s, d: session().createDataFrame(list(nn(s, d)), "i long, j long"), "SELECT i, j FROM nn", "nn")
q("isequal", lambda s, d: facts(same=sp(s, d).isequal(sp(s, d)), other=sp(s, d).isequal(sp(s, d, "R"))), "SELECT true AS same, false AS other")
q("isclose", lambda s, d: (lambda a: facts(near=a.isclose(a.apply("times", right=1.0 + 1e-9).new()), far=a.isclose(a.apply("times", right=1.01).new())))(sp(s, d).dup(FP64)), "SELECT true AS near, false AS far")
q("clear", lambda s, d: do(nn(s, d), lambda c: c.clear()), "SELECT * FROM nn WHERE false", "nn")
q("wait", lambda s, d: nn(s, d).wait(), "SELECT * FROM nn", "nn")
q("head", lambda s, d: session().createDataFrame(list(zip(*nn(s, d).ss.head(7), strict=True)), "i long, j long, v long"), "SELECT * FROM nn ORDER BY i, j LIMIT 7", "nn")
q("iteritems_seek", lambda s, d: session().createDataFrame([(i, j, v) for (i, j), v in nn(s, d).ss.iteritems(seek=-5)], "i long, j long, v long"), "SELECT * FROM (SELECT * FROM nn ORDER BY i DESC, j DESC LIMIT 5)", "nn")
q("iterkeys_values", lambda s, d: (lambda a: session().createDataFrame([(*k, v) for k, v in zip(a.ss.iterkeys(), a.ss.itervalues(), strict=True)], "i long, j long, v long"))(nn(s, d)), "SELECT * FROM nn", "nn")
q("iso", lambda s, d: facts(iso=nn(s, d).apply("one").new().ss.is_iso, other=nn(s, d).ss.is_iso, value=nn(s, d).apply("one").new().ss.iso_value.value), "SELECT true AS iso, false AS other, CAST(1 AS BIGINT) AS value")
q("nbytes_format", lambda s, d: (lambda a: facts(stored=a.nbytes > 0, format=a.format, orientation=a.orientation))(nn(s, d).ss), "SELECT true AS stored, 'coo' AS format, 'rowwise' AS orientation")
q("repr", lambda s, d: facts(text=repr(nat(s, d)[0:3, :].new().select("valuegt", 2).new())), f"SELECT 'Matrix(INT64, shape=(3, 5))' || chr(10) || '  2, ' || j || ': ' || v AS text FROM ({NAT}) WHERE i = 2")

# ---------------------------------------------------------------- index expressions and writing

_COLS = "(VALUES (0, 30), (1, 7), (2, 30), (3, 11)) c(n, o)"
q("extract_col_list", lambda s, d: sp(s, d)[:, [30, 7, 30, 11]].new(), f"SELECT i, CAST(n AS BIGINT) AS j, v FROM sp JOIN {_COLS} ON j = o", "sp")
q("extract_row_of_list", lambda s, d: sp(s, d)[5, [30, 7, 30, 11]].new(), f"SELECT CAST(n AS BIGINT) AS i, v FROM sp JOIN {_COLS} ON j = o WHERE i = 5", "sp")
q("extract_row_list", lambda s, d: sp(s, d)[[9, 2], :].new(), "SELECT CASE i WHEN 9 THEN CAST(0 AS BIGINT) ELSE 1 END AS i, j, v FROM sp WHERE i IN (9, 2)", "sp")
q("extract_slice_and_list", lambda s, d: nn(s, d)[20:4:-3, [8, 1]].new(), "SELECT (20 - i) // 3 AS i, CASE j WHEN 8 THEN CAST(0 AS BIGINT) ELSE 1 END AS j, v FROM nn WHERE i > 4 AND i <= 20 AND (20 - i) % 3 = 0 AND j IN (8, 1)", "nn")
q("extract_into", lambda s, d: do(Matrix(INT64, 5, 2), lambda c: c << nn(s, d)[3:8, [8, 1]]), "SELECT i - 3 AS i, CASE j WHEN 8 THEN CAST(0 AS BIGINT) ELSE 1 END AS j, v FROM nn WHERE i BETWEEN 3 AND 7 AND j IN (8, 1)", "nn")
q("extract_into_accum", lambda s, d: do(sn(s, d), lambda c: c(accum="plus") << sp(s, d)[:, 7]),
  "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM sn UNION ALL SELECT i, v FROM sp WHERE j = 7) GROUP BY i", "sn", "sp")
q("extract_scalar_into", lambda s, d: do(Scalar(INT64), lambda c: c << nn(s, d)[3, 4]), "SELECT v FROM nn WHERE i = 3 AND j = 4", "nn")
q("extract_infix", lambda s, d: nn(s, d)[0:5, 0:5] + nn(s, d)[5:10, 5:10], "SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM nn WHERE i < 5 AND j < 5 UNION ALL SELECT i - 5, j - 5, v FROM nn WHERE i BETWEEN 5 AND 9 AND j BETWEEN 5 AND 9) GROUP BY 1, 2", "nn")
q("extract_masked", lambda s, d: nn(s, d)[0:10, 5:15].new(input_mask=nn(s, d).select("valuegt", 40).new().S), "SELECT i, j - 5 AS j, v FROM nn WHERE i < 10 AND j BETWEEN 5 AND 14 AND v > 40", "nn")
_INPUT = "SELECT g.i, g.j, CASE WHEN {} THEN t.v ELSE c.v END AS v FROM (SELECT r.i, c.j FROM range(10) r(i), range(10) c(j)) g LEFT JOIN nn c ON c.i = g.i AND c.j = g.j LEFT JOIN nn t ON t.i = g.i AND t.j = g.j + 5 LEFT JOIN (SELECT * FROM nn WHERE v > 40) m ON m.i = g.i AND m.j = g.j + 5"


def _input_mask(s, d, comp, replace):
    c, m = nn(s, d)[0:10, 0:10].new(), nn(s, d).select("valuegt", 40).new().S
    c(input_mask=~m if comp else m, replace=replace) << nn(s, d)[0:10, 5:15]
    return c


q("input_mask", lambda s, d: _input_mask(s, d, False, False), f"SELECT * FROM ({_INPUT.format('m.v IS NOT NULL')}) WHERE v IS NOT NULL", "nn")
q("input_mask_complement", lambda s, d: _input_mask(s, d, True, False), f"SELECT * FROM ({_INPUT.format('m.v IS NULL')}) WHERE v IS NOT NULL", "nn")
q("input_mask_replace", lambda s, d: _input_mask(s, d, False, True), "SELECT i, j - 5 AS j, v FROM nn WHERE i < 10 AND j BETWEEN 5 AND 14 AND v > 40", "nn")
q("bool_mask", lambda s, d: nn(s, d).dup(mask=(nn(s, d) > 50).new()), "SELECT * FROM nn WHERE v > 50", "nn")
q("scalar_accum", lambda s, d: do(nn(s, d), lambda c: c(accum=binary.plus) << 3), "SELECT r.i, c.j, coalesce(v, 0) + 3 AS v FROM range(25) r(i) CROSS JOIN range(25) c(j) LEFT JOIN nn ON nn.i = r.i AND nn.j = c.j", "nn")
q("assign_row_vector_mask", lambda s, d: do(nn(s, d), lambda c: c(Vector.from_coo([1, 3, 5], True, size=25).S)[4, :].__lshift__(-7)), "SELECT * FROM nn WHERE NOT (i = 4 AND j IN (1, 3, 5)) UNION ALL SELECT CAST(4 AS BIGINT), CAST(j AS BIGINT), CAST(-7 AS BIGINT) FROM (VALUES (1), (3), (5)) t(j)", "nn")
q("set_element", lambda s, d: do(nn(s, d), lambda c: c.__setitem__((2, 3), 99)), "SELECT * FROM nn WHERE NOT (i = 2 AND j = 3) UNION ALL SELECT 2, 3, 99", "nn")
q("delete_element", lambda s, d: do(nn(s, d), lambda c: c.__delitem__((2, 3))), "SELECT * FROM nn WHERE NOT (i = 2 AND j = 3)", "nn")
q("set_empty_scalar_deletes", lambda s, d: do(nn(s, d), lambda c: c.__setitem__((2, 3), Scalar(INT64))), "SELECT * FROM nn WHERE NOT (i = 2 AND j = 3)", "nn")
_SMALL, _LARGE = "(SELECT i, j, v > 50 AS v FROM nn WHERE i < 15)", "(SELECT i, j, v > 40 AS v FROM nn WHERE i > 9)"


def _flags(s, d, low: bool) -> Matrix:
    a = nn(s, d)
    return (a.select("rowle", 14) if low else a.select("rowgt", 9)).new().apply("gt", right=50 if low else 40).new()


def _inplace(s, d, how):
    a, b = _flags(s, d, True), _flags(s, d, False)
    if how == "and":
        a &= b
    elif how == "or":
        a |= b
    else:
        a ^= b
    return a


_BOTH = f"(SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, a.v AS x, b.v AS y FROM {_SMALL} a FULL JOIN {_LARGE} b ON a.i = b.i AND a.j = b.j)"
q("inplace_and", lambda s, d: _inplace(s, d, "and"), f"SELECT i, j, x AND y AS v FROM {_BOTH} WHERE x IS NOT NULL AND y IS NOT NULL", "nn")
q("inplace_or", lambda s, d: _inplace(s, d, "or"), f"SELECT i, j, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE x OR y END AS v FROM {_BOTH}", "nn")
q("inplace_xor", lambda s, d: _inplace(s, d, "xor"), f"SELECT i, j, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE x <> y END AS v FROM {_BOTH}", "nn")


def _matmul(s, d):
    a = nn(s, d)
    a @= nn(s, d)
    return a


def _arithmetic(s, d):
    a = nn(s, d)
    a += 5
    a *= 3
    a -= 2
    a //= 4
    return a


q("inplace_matmul", _matmul, "SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM nn a JOIN nn b ON a.j = b.i GROUP BY 1, 2", "nn")
q("inplace_arithmetic", _arithmetic, "SELECT r.i, c.j, CAST(floor(((coalesce(v, 0) + 5) * 3 - 2) / 4) AS BIGINT) AS v FROM range(25) r(i) CROSS JOIN range(25) c(j) LEFT JOIN nn ON nn.i = r.i AND nn.j = c.j", "nn")
q("divmod_quotient", lambda s, d: divmod(sp(s, d), 7)[0], "SELECT i, j, v // 7 AS v FROM sp", "sp")
q("divmod_remainder", lambda s, d: divmod(sp(s, d), 7)[1], "SELECT i, j, v % 7 AS v FROM sp", "sp")
q("rdivmod", lambda s, d: divmod(1000, sp(s, d))[0], "SELECT i, j, 1000 // v AS v FROM sp", "sp")
q("infix_and_or_matmul", lambda s, d: binary.plus(nn(s, d) & semiring.min_plus(nn(s, d) @ nn(s, d)).new()), "SELECT n.i, n.j, n.v + m.v AS v FROM nn n JOIN (SELECT a.i, b.j, min(a.v + b.v) AS v FROM nn a JOIN nn b ON a.j = b.i GROUP BY 1, 2) m ON m.i = n.i AND m.j = n.j", "nn")

# ---------------------------------------------------------------- select by comparison, sorts, top-k, tiles

q("select_value", lambda s, d: select.value(sp(s, d) > 30), "SELECT * FROM sp WHERE v > 30", "sp")
q("select_row", lambda s, d: select.row(sp(s, d) <= 9), "SELECT * FROM sp WHERE i <= 9", "sp")
q("select_column", lambda s, d: select.column(sp(s, d) >= 9), "SELECT * FROM sp WHERE j >= 9", "sp")
q("select_index", lambda s, d: select.index(sn(s, d) < 9), "SELECT * FROM sn WHERE i < 9", "sn")
q("broadcast_union", lambda s, d: nn(s, d).select("valuegt", 60).new().ewise_union(nn(s, d).reduce_columnwise("max").new(), "minus", 1000, 1),
  "SELECT g.i, g.j, coalesce(a.v, 1000) - coalesce(c.v, 1) AS v FROM (SELECT r.i, s.j FROM range(25) r(i), (SELECT DISTINCT j FROM nn) s) g LEFT JOIN (SELECT * FROM nn WHERE v > 60) a ON a.i = g.i AND a.j = g.j LEFT JOIN (SELECT j, max(v) AS v FROM nn GROUP BY j) c ON c.j = g.j", "nn")
_SHORT = ops.register_binary(None, lambda a, b: F.struct(a % 10, a) < F.struct(b % 10, b), BOOL)
q("sort_by_operator", lambda s, d: sp(s, d).ss.sort(_SHORT)[0], "SELECT i, row_number() OVER (PARTITION BY i ORDER BY v % 10, v, j) - 1 AS j, v FROM sp", "sp")
q("sort_vector_values", lambda s, d: sz(s, d).ss.sort("gt")[0], "SELECT row_number() OVER (ORDER BY v DESC, i) - 1 AS i, v FROM sz", "sz")
q("selectk_random_counts", lambda s, d: sp(s, d).ss.selectk("random", 3, seed=5).reduce_rowwise("count"), "SELECT i, least(count(*), 3) AS v FROM sp GROUP BY i", "sp")
q("compactify_vector_first", lambda s, d: sz(s, d).ss.compactify("first"), "SELECT row_number() OVER (ORDER BY i) - 1 AS i, v FROM sz", "sz")
q("compactify_vector_last", lambda s, d: sz(s, d).ss.compactify("last", asindex=True), "SELECT row_number() OVER (ORDER BY i DESC) - 1 AS i, i AS v FROM sz", "sz")
q("compactify_reverse", lambda s, d: sp(s, d).ss.compactify("smallest", 4, reverse=True), "SELECT i, least(n, 4) - r AS j, v FROM (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v, j) AS r, count(*) OVER (PARTITION BY i) AS n FROM sp) WHERE r <= 4", "sp")
q("scan_row_min", lambda s, d: sp(s, d).ss.scan("min"), "SELECT i, j, min(v) OVER (PARTITION BY i ORDER BY j) AS v FROM sp", "sp")
q("concat_mixed_types", lambda s, d: ext.concat([[nn(s, d), nn(s, d).dup(FP64).apply("times", right=0.5).new()]]), "SELECT i, j, CAST(v AS DOUBLE) AS v FROM nn UNION ALL SELECT i, j + 25, v * 0.5 FROM nn", "nn")
q("vector_concat", lambda s, d: do(Vector(INT64, 50), lambda c: c.ss.concat([Vector.from_coo(*nation(s, d), INT64, size=25)] * 2)), f"SELECT i, v FROM ({NATV}) UNION ALL SELECT i + 25, v FROM ({NATV})")
q("vector_split", lambda s, d: sz(s, d).ss.split([100, None])[1], "SELECT i - 100 AS i, v FROM sz WHERE i >= 100", "sz")
q("build_diag", lambda s, d: do(Matrix(INT64, 27, 27), lambda c: c.ss.build_diag(Vector.from_coo(*nation(s, d), INT64, size=25), 2)), f"SELECT i, i + 2 AS j, v FROM ({NATV})")
q("vector_reposition", lambda s, d: sz(s, d).reposition(-50), "SELECT i - 50 AS i, v FROM sz WHERE i >= 50", "sz")
q("as_matrix", lambda s, d: sz(s, d).as_matrix(), "SELECT i, CAST(0 AS BIGINT) AS j, v FROM sz", "sz")

# ---------------------------------------------------------------- element types

_INTS = {"INT8": (8, True), "UINT8": (8, False), "INT16": (16, True), "UINT16": (16, False), "INT32": (32, True), "UINT32": (32, False)}


def _wrapped(sql: str, bits: int, sign: bool) -> str:
    n = 1 << bits
    low = f"((({sql}) % {n}) + {n}) % {n}"
    return f"(({low} + {n >> 1}) % {n} - {n >> 1})" if sign else f"({low})"


def _long(e) -> DataFrame:
    c = e.new() if isinstance(e, Expr) else e
    return c.df.withColumn("v", F.col("v").cast("long"))


for _t, (_b, _s) in _INTS.items():
    _x = _wrapped("v", _b, _s)
    q(f"type_{_t}_cast", lambda s, d, t=_t: _long(sp(s, d).apply("times", right=1237).new().dup(t)), f"SELECT i, j, CAST({_wrapped('v * 1237', _b, _s)} AS BIGINT) AS v FROM sp", "sp")
    q(f"type_{_t}_times", lambda s, d, t=_t: _long(sp(s, d).dup(t).ewise_mult(sp(s, d).dup(t), "times")), f"SELECT i, j, CAST({_wrapped(f'{_x} * {_x}', _b, _s)} AS BIGINT) AS v FROM sp", "sp")
    q(f"type_{_t}_minus", lambda s, d, t=_t: _long(sp(s, d).dup(t).apply("rminus", right=3)), f"SELECT i, j, CAST({_wrapped(f'3 - {_x}', _b, _s)} AS BIGINT) AS v FROM sp", "sp")
    q(f"type_{_t}_reduce", lambda s, d, t=_t: _long(sp(s, d).dup(t).reduce_rowwise("plus")), f"SELECT i, CAST({_wrapped(f'sum({_x})', _b, _s)} AS BIGINT) AS v FROM sp GROUP BY i", "sp")
    q(f"type_{_t}_mxm", lambda s, d, t=_t: _long(nn(s, d).dup(t).mxm(nn(s, d).dup(t), "max_plus")), f"SELECT a.i, b.j, CAST(max({_wrapped('a.v + b.v', _b, _s)}) AS BIGINT) AS v FROM (SELECT i, j, {_x} AS v FROM nn) a JOIN (SELECT i, j, {_x} AS v FROM nn) b ON a.j = b.i GROUP BY 1, 2", "nn")


def _text(e) -> DataFrame:
    c = e.new() if isinstance(e, Expr) else e
    return c.df.withColumn("v", F.col("v").cast("string"))


_TOP = "18446744073709551616::HUGEINT"
_BIG = lambda s, d: sp(s, d).dup("UINT64").apply("rminus", right=0).new()  # 2^64 - v
_U64 = {
    "cast": (lambda s, d: sp(s, d).dup("UINT64"), "v::HUGEINT"), "negative": (_BIG, f"({_TOP} - v)"), "bnot": (lambda s, d: sp(s, d).dup("UINT64").apply("bnot"), f"({_TOP} - 1 - v)"),
    "plus": (lambda s, d: _BIG(s, d).ewise_mult(_BIG(s, d), "plus"), f"({_TOP} - 2 * v)"), "band": (lambda s, d: _BIG(s, d).apply("band", right=255), "((256 - v % 256) % 256)::HUGEINT"),
    "bor": (lambda s, d: _BIG(s, d).apply("bor", right=0), f"({_TOP} - v)"), "right_shift": (lambda s, d: _BIG(s, d).apply("right_shift", right=60), "15::HUGEINT"),
    "min": (lambda s, d: _BIG(s, d).ewise_mult(sp(s, d).dup("UINT64"), "min"), "v::HUGEINT"), "floordiv": (lambda s, d: _BIG(s, d).apply("floordiv", right=2), f"(({_TOP} - v) // 2)"),
}
for _n, (_f, _s) in _U64.items():
    q(f"type_UINT64_{_n}", lambda s, d, f=_f: _text(f(s, d)), f"SELECT i, j, CAST({_s} AS VARCHAR) AS v FROM sp", "sp")
q("type_UINT64_reduce_max", lambda s, d: _text(_BIG(s, d).reduce_rowwise("max")), f"SELECT i, CAST({_TOP} - min(v) AS VARCHAR) AS v FROM sp GROUP BY i", "sp")
q("type_UINT64_reduce_plus", lambda s, d: _text(_BIG(s, d).reduce_rowwise("plus")), f"SELECT i, CAST({_TOP} - sum(v) AS VARCHAR) AS v FROM sp GROUP BY i", "sp")
q("type_UINT64_reduce_bxor", lambda s, d: _text(sp(s, d).dup("UINT64").reduce_rowwise("bxor")), "SELECT i, CAST(bit_xor(v) AS VARCHAR) AS v FROM sp GROUP BY i", "sp")
q("type_UINT64_to_FP64", lambda s, d: _BIG(s, d).dup(FP64), f"SELECT i, j, CAST({_TOP} - v AS DOUBLE) AS v FROM sp", "sp")
q("type_UINT64_to_INT64", lambda s, d: _BIG(s, d).dup(INT64), "SELECT i, j, -v AS v FROM sp", "sp")
q("type_FP32_times", lambda s, d: sp(s, d).dup("FP32").apply("times", right=0.5).new().dup(FP64), "SELECT i, j, v * 0.5::DOUBLE AS v FROM sp", "sp")
q("type_FP64_to_INT32", lambda s, d: _long(sp(s, d).dup(FP64).apply("truediv", right=-3.0).new().dup("INT32")), "SELECT i, j, CAST(trunc(v / -3.0) AS BIGINT) AS v FROM sp", "sp")
q("type_BOOL_cast", lambda s, d: sp(s, d).apply("minus", right=20).new().dup(BOOL), "SELECT i, j, v <> 20 AS v FROM sp", "sp")
q("type_unify", lambda s, d: session().createDataFrame([(a, b, str(dt.unify(a, b))) for a, b in (("INT8", "UINT8"), ("INT64", "UINT64"), ("FP32", "INT32"), ("BOOL", "INT8"), ("FP32", "FC64"))], "a string, b string, c string"),
  "SELECT * FROM (VALUES ('INT8', 'UINT8', 'INT16'), ('INT64', 'UINT64', 'FP64'), ('FP32', 'INT32', 'FP64'), ('BOOL', 'INT8', 'INT8'), ('FP32', 'FC64', 'FC64')) t(a, b, c)")


def _record(s, d) -> Matrix:
    """Quantity and its half, as a user type."""
    a = sp(s, d)
    t = dt.lookup({"x": INT64, "y": FP64})
    return Matrix.of(a.df.select("i", "j", F.struct(F.col("v").alias("x"), (F.col("v") / 2).alias("y")).alias("v")), t, a.shape)


def _fields(e) -> DataFrame:
    c = e.new() if isinstance(e, Expr) else e
    return c.df.select("i", "j", "v.x", "v.y")


q("udt_plus", lambda s, d: _fields(_record(s, d).ewise_mult(_record(s, d), "plus")), "SELECT i, j, 2 * v AS x, CAST(v AS DOUBLE) AS y FROM sp", "sp")
q("udt_ainv", lambda s, d: _fields(_record(s, d).apply("ainv")), "SELECT i, j, -v AS x, -v / 2.0::DOUBLE AS y FROM sp", "sp")
q("udt_second", lambda s, d: _fields(_record(s, d).ewise_mult(_record(s, d), "second")), "SELECT i, j, v AS x, v / 2.0::DOUBLE AS y FROM sp", "sp")
q("udt_any", lambda s, d: _fields(_record(s, d).ewise_mult(_record(s, d), "any")), "SELECT i, j, v AS x, v / 2.0::DOUBLE AS y FROM sp", "sp")
q("udt_eq", lambda s, d: _record(s, d).ewise_mult(_record(s, d), "eq"), "SELECT i, j, true AS v FROM sp", "sp")
q("udt_pair", lambda s, d: _record(s, d).ewise_mult(_record(s, d), "pair"), "SELECT i, j, CAST(1 AS BIGINT) AS v FROM sp", "sp")

# ---------------------------------------------------------------- complex numbers


def _z(s, d) -> Matrix:
    return sp(s, d, "R").dup(FP64).ewise_mult(sp(s, d, "A").dup(FP64), "cmplx").new()


_Z = "(SELECT a.i, a.j, CAST(a.v AS DOUBLE) AS x, CAST(b.v AS DOUBLE) AS y FROM rr a JOIN ra b ON a.i = b.i AND a.j = b.j)"


def _parts(e) -> DataFrame:
    c = e.new() if isinstance(e, Expr) else e
    return c.df.select(*c.KEYS, F.round("v.re", 6).alias("re"), F.round("v.im", 6).alias("im"))


def _near(e, n: int = 9) -> DataFrame:
    c = e.new() if isinstance(e, Expr) else e
    return c.df.withColumn("v", F.round(F.col("v").cast("double"), n))


for _n, _s in {"creal": "x", "cimag": "y", "carg": "round(atan2(y, x), 9)", "abs": "round(sqrt(x * x + y * y), 9)"}.items():
    q(f"complex_{_n}", lambda s, d, n=_n: _near(_z(s, d).apply(n)), f"SELECT i, j, {_s} AS v FROM {_Z}", "rr", "ra")
for _n, (_r, _i) in {"conj": ("x", "-y"), "ainv": ("-x", "-y"), "identity": ("x", "y")}.items():
    q(f"complex_{_n}", lambda s, d, n=_n: _parts(_z(s, d).apply(n)), f"SELECT i, j, {_r} AS re, {_i} AS im FROM {_Z}", "rr", "ra")
q("complex_times", lambda s, d: _parts(_z(s, d).ewise_mult(_z(s, d), "times")), f"SELECT i, j, x * x - y * y AS re, 2 * x * y AS im FROM {_Z}", "rr", "ra")
q("complex_truediv", lambda s, d: _parts(_z(s, d).ewise_mult(_z(s, d).apply("conj").new(), "truediv")), f"SELECT i, j, round((x * x - y * y) / (x * x + y * y), 6) AS re, round(2 * x * y / (x * x + y * y), 6) AS im FROM {_Z}", "rr", "ra")
q("complex_plus_times", lambda s, d: _parts(_z(s, d).mxm(_z(s, d).T, semiring.plus_times)), f"SELECT a.i, b.i AS j, sum(a.x * b.x - a.y * b.y) AS re, sum(a.x * b.y + a.y * b.x) AS im FROM {_Z} a JOIN {_Z} b ON a.j = b.j GROUP BY 1, 2", "rr", "ra")
q("complex_reduce", lambda s, d: _parts(_z(s, d).reduce_rowwise("plus")), f"SELECT i, sum(x) AS re, sum(y) AS im FROM {_Z} GROUP BY i", "rr", "ra")

# ---------------------------------------------------------------- less common operators


def _tenth(s, d) -> Matrix:
    """Quantities around 0: (v - 40) / 8."""
    return sp(s, d).dup(FP64).apply("minus", right=40.0).new().apply("truediv", right=8.0).new()


def _unit(s, d) -> Matrix:
    """1 / (v + 1), inside (0, 1)."""
    return sp(s, d).dup(FP64).apply("plus", right=1.0).new().apply("minv").new()


_TENTH, _UNIT = "(SELECT i, j, (v - 40) / 8.0::DOUBLE AS x FROM sp)", "(SELECT i, j, 1.0::DOUBLE / (v + 1) AS x FROM sp)"
_SERIES = "(2 / sqrt(pi()) * list_sum([pow(-1, n) * pow(x, 2 * n + 1) / (factorial(n::INT) * (2 * n + 1)) for n in range(0, 18)]))"
_ON_TENTH = {
    "ceil": "ceil(x)", "floor": "floor(x)", "trunc": "trunc(x)", "rint": "round_even(x, 0)", "round": "CASE WHEN x < 0 THEN -floor(-x + 0.5) ELSE floor(x + 0.5) END", "sinh": "CASE WHEN abs(x) < 8 THEN (exp(x) - exp(-x)) / 2 END", "cosh": "CASE WHEN abs(x) < 8 THEN (exp(x) + exp(-x)) / 2 END",
    "tanh": "tanh(x)", "cos": "cos(x)", "tan": "CASE WHEN abs(cos(x)) > 0.1 THEN tan(x) END", "expm1": "CASE WHEN x < 8 THEN exp(x) - 1 END", "exp": "CASE WHEN x < 8 THEN exp(x) END", "asinh": "asinh(x)", "deg2rad": "radians(x)", "rad2deg": "degrees(x)", "square": "x * x", "fabs": "abs(x)",
}
for _n, _s in _ON_TENTH.items():
    def _kept(s, d, n=_n):
        a = _tenth(s, d)
        if n in ("sinh", "cosh", "exp", "expm1"):
            a = a.select("valuelt", 8.0).new().select("valuegt", -8.0).new() if n in ("sinh", "cosh") else a.select("valuelt", 8.0).new()
        e = a.apply(getattr(unary.numpy, n) if n in ops.NUMPY_UNARY else n)
        if n == "tan":
            return _near(Matrix.of(a.df.where(F.abs(F.cos("v")) > 0.1), FP64, a.shape).apply(n), 7)
        return _near(e, 7)

    q(f"unary_{_n}", _kept, f"SELECT * FROM (SELECT i, j, round({_s}, 7) AS v FROM {_TENTH}) WHERE v IS NOT NULL", "sp")
_ON_UNIT = {"asin": "asin(x)", "acos": "acos(x)", "atanh": "atanh(x)", "erf": _SERIES, "erfc": f"1 - {_SERIES}", "minv": "1 / x", "exp2": "pow(2.0, x)", "log1p": "ln(1 + x)", "lgamma": "lgamma(1 + x)", "tgamma": "gamma(1 + x)"}
for _n, _s in _ON_UNIT.items():
    q(f"unary_{_n}", lambda s, d, n=_n: _near((_unit(s, d) if "gamma" not in n else _unit(s, d).apply("plus", right=1.0).new()).apply(n), 8), f"SELECT i, j, round({_s}, 8) AS v FROM {_UNIT}", "sp")
q("unary_acosh", lambda s, d: _near(sp(s, d).dup(FP64).apply("acosh"), 8), "SELECT i, j, round(acosh(v), 8) AS v FROM sp", "sp")
q("unary_frexpx", lambda s, d: _near(sp(s, d).dup(FP64).apply("frexpx")), "SELECT i, j, round(v / pow(2, floor(log2(v)) + 1), 9) AS v FROM sp", "sp")
q("unary_frexpe", lambda s, d: _near(sp(s, d).dup(FP64).apply("frexpe")), "SELECT i, j, floor(log2(v)) + 1 AS v FROM sp", "sp")
q("unary_spacing", lambda s, d: sp(s, d).dup(FP64).apply("spacing"), "SELECT i, j, pow(2, floor(log2(v)) - 52) AS v FROM sp", "sp")
q("unary_isinf", lambda s, d: sp(s, d).dup(FP64).apply("minus", right=20.0).new().apply("minv").new().apply("isinf"), "SELECT i, j, v = 20 AS v FROM sp", "sp")
q("unary_signbit", lambda s, d: _tenth(s, d).apply("signbit"), f"SELECT i, j, x < 0 AS v FROM {_TENTH}", "sp")
q("unary_numpy_sign", lambda s, d: _tenth(s, d).apply(unary.numpy.sign), f"SELECT i, j, CAST(sign(x) AS DOUBLE) AS v FROM {_TENTH}", "sp")
_PAIRS = "(SELECT a.i, a.j, a.v AS x, b.v AS y FROM rr a JOIN ra b ON a.i = b.i AND a.j = b.j)"
_ON_PAIRS = {
    "gcd": "gcd(x, y)", "lcm": "lcm(x, y)", "atan2": "round(atan2(x, y), 8)", "hypot": "round(sqrt(x * x + y * y), 8)", "fmod": "CAST(x % y AS DOUBLE)",
    "remainder": "CAST(x - y * round_even(x / y, 0) AS DOUBLE)", "copysign": "CAST(x AS DOUBLE)", "logaddexp": "round(greatest(x, y) + ln(1 + exp(-abs(x - y))), 8)", "logaddexp2": "round(greatest(x, y) + log2(1 + pow(2.0, -abs(x - y))), 8)",
    "maximum": "greatest(x, y)", "minimum": "least(x, y)", "isne": "CAST(x <> y AS BIGINT)", "isgt": "CAST(x > y AS BIGINT)", "isge": "CAST(x >= y AS BIGINT)", "islt": "CAST(x < y AS BIGINT)", "iseq": "CAST(x = y AS BIGINT)", "lxor": "CAST((x <> 0) <> (y <> 0) AS BIGINT)",
    "lxnor": "CAST((x <> 0) = (y <> 0) AS BIGINT)", "band": "x & y", "rdiv": "y // x", "rtruediv": "y / x", "rfloordiv": "y // x", "abssecond": "abs(y)", "gt": "x > y", "le": "x <= y",
}
for _n, _s in _ON_PAIRS.items():
    q(f"binary_{_n}", lambda s, d, n=_n: (lambda e: _near(e, 8) if e.dtype.kind == "f" else e)(sp(s, d, "R").ewise_mult(sp(s, d, "A"), ops.BINARY[n])), f"SELECT i, j, {_s.replace('x / y', 'x / y::DOUBLE') if _n != 'rtruediv' else 'round(y / x, 8)'} AS v FROM {_PAIRS}", "rr", "ra")
q("binary_binom", lambda s, d: sp(s, d).apply("binom", right=3), "SELECT i, j, CAST(v::HUGEINT * (v - 1) * (v - 2) // 6 AS BIGINT) AS v FROM sp", "sp")
q("binary_left_shift", lambda s, d: sp(s, d).apply("left_shift", right=4), "SELECT i, j, v * 16 AS v FROM sp", "sp")
q("binary_right_shift", lambda s, d: sp(s, d).apply("right_shift", right=2), "SELECT i, j, v // 4 AS v FROM sp", "sp")
q("binary_ldexp", lambda s, d: sp(s, d).dup(FP64).apply("ldexp", right=5.0), "SELECT i, j, v * 32.0::DOUBLE AS v FROM sp", "sp")
q("binary_float_power", lambda s, d: sp(s, d).apply("float_power", right=2), "SELECT i, j, CAST(v * v AS DOUBLE) AS v FROM sp", "sp")
q("binary_nextafter", lambda s, d: sp(s, d).dup(FP64).apply("nextafter", right=1e300), "SELECT i, j, v + pow(2, floor(log2(v)) - 52) AS v FROM sp", "sp")
q("binary_isclose", lambda s, d: sp(s, d, "R").ewise_mult(sp(s, d, "A"), ops.isclose(0.1)), f"SELECT i, j, abs(x - y) <= greatest(x, y) * 0.1 AS v FROM {_PAIRS}", "rr", "ra")
q("operator_names", lambda s, d: session().createDataFrame([(x, str(f(x))) for f, x in ((any_op.from_string, "+"), (any_op.from_string, "min_plus"), (binary.from_string, "*"), (unary.from_string, "-"), (monoid.from_string, "&"), (semiring.from_string, "max.times"), (agg.from_string, "mean"))], "a string, b string"),
  "SELECT * FROM (VALUES ('+', 'binaryop.plus'), ('min_plus', 'semiring.min_plus'), ('*', 'binaryop.times'), ('-', 'unaryop.ainv'), ('&', 'monoid.land'), ('max.times', 'semiring.max_times'), ('mean', 'agg.mean')) t(a, b)")
q("commutation", lambda s, d: session().createDataFrame([(n, ops.BINARY[n].commutes_to.name if ops.BINARY[n].commutes_to else "", ops.BINARY[n].is_commutative) for n in ("plus", "minus", "first", "lt", "pow", "atan2", "times")], "a string, b string, c boolean"),
  "SELECT * FROM (VALUES ('plus', 'plus', true), ('minus', 'rminus', false), ('first', 'second', false), ('lt', 'gt', false), ('pow', 'rpow', false), ('atan2', '', false), ('times', 'times', true)) t(a, b, c)")
q("monoid_numpy_gcd", lambda s, d: sp(s, d).reduce_rowwise(monoid.numpy.gcd), "SELECT i, CAST(list_reduce(list(v), lambda a, b: gcd(a, b)) AS BIGINT) AS v FROM sp GROUP BY i", "sp")
q("monoid_numpy_hypot", lambda s, d: _near(sp(s, d).reduce_rowwise(monoid.numpy.hypot), 6), "SELECT i, round(sqrt(sum(v * v)), 6) AS v FROM sp GROUP BY i", "sp")
for _sign in (1, -1):
    q(f"monoid_logaddexp_far_{'up' if _sign > 0 else 'down'}", lambda s, d, k=_sign: _near(sp(s, d).dup(FP64).apply("plus", right=k * 5000.0).new().reduce_rowwise("logaddexp"), 6), f"SELECT i, round(m + {_sign * 5000} + ln(sum(exp(v - m))), 6) AS v FROM (SELECT i, v, max(v) OVER (PARTITION BY i) AS m FROM sp) GROUP BY i, m", "sp")
q("aggregator_logaddexp2_far", lambda s, d: _near(sp(s, d).dup(FP64).apply("plus", right=-9000.0).new().reduce_columnwise(agg.logaddexp2), 6), "SELECT i, round(m - 9000 + log2(sum(pow(2.0, v - m))), 6) AS v FROM (SELECT j AS i, v, max(v) OVER (PARTITION BY j) AS m FROM sp) GROUP BY i, m", "sp")
q("semiring_logaddexp_plus", lambda s, d: _near(nn(s, d).dup(FP64).mxm(nn(s, d).dup(FP64), "logaddexp_plus"), 6), "SELECT i, j, round(m + ln(sum(exp(v - m))), 6) AS v FROM (SELECT i, j, v, max(v) OVER (PARTITION BY i, j) AS m FROM (SELECT a.i, b.j, a.v + b.v AS v FROM nn a JOIN nn b ON a.j = b.i)) GROUP BY i, j, m", "nn")
q("semiring_numpy", lambda s, d: nn(s, d).mxm(nn(s, d), semiring.numpy.add_multiply), "SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM nn a JOIN nn b ON a.j = b.i GROUP BY 1, 2", "nn")
q("get_semiring", lambda s, d: nn(s, d).mxm(nn(s, d), semiring.get_semiring("max", "minus")), "SELECT a.i, b.j, max(a.v - b.v) AS v FROM nn a JOIN nn b ON a.j = b.i GROUP BY 1, 2", "nn")
ops.register_binary("sum_of_squares_of", lambda x, y: x * x + y * y)
ops.register_semiring("largest_squares", "max", "sum_of_squares_of")
q("register_binary", lambda s, d: sp(s, d, "R").ewise_mult(sp(s, d, "A"), binary.sum_of_squares_of), f"SELECT i, j, x * x + y * y AS v FROM {_PAIRS}", "rr", "ra")
q("register_semiring", lambda s, d: nn(s, d).mxm(nn(s, d), semiring.largest_squares), "SELECT a.i, b.j, max(a.v * a.v + b.v * b.v) AS v FROM nn a JOIN nn b ON a.j = b.i GROUP BY 1, 2", "nn")
_scaled = lambda k: ops.register_unary(None, lambda x: x * k)
q("parameterized_operator", lambda s, d: sp(s, d).apply(_scaled(9)), "SELECT i, j, v * 9 AS v FROM sp", "sp")
q("typed_operator", lambda s, d: sp(s, d).ewise_mult(sp(s, d), binary.plus["FP64"]), "SELECT i, j, CAST(v + v AS DOUBLE) AS v FROM sp", "sp")
q("scalar_value", lambda s, d: (lambda x: facts(value=x.value, number=int(x), real=float(x), truth=bool(x), same=bool(x == 5)))(Scalar.from_value(5)), "SELECT CAST(5 AS BIGINT) AS value, CAST(5 AS BIGINT) AS number, 5.0::DOUBLE AS real, true AS truth, true AS same")
q("reduce_row_geometric_mean", lambda s, d: _near(nn(s, d).apply("numpy_mod", right=3).new().apply("plus", right=1).new().reduce_rowwise(agg.geometric_mean), 6), "SELECT i, round(pow(product(1 + v % 3), 1.0 / count(*)), 6) AS v FROM nn GROUP BY i", "nn")
