"""Registered queries over whole driver tables, each with its SQL twin where SQL can state it.

Only integers, strings and arrays of them leave a query, so results can be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import containers as V
from ..functions import fixed as X
from ..functions import scalars as S
from ..functions import wide as L
from ..functions.typed import Typed
from ..operators import cipher as E
from ..operators import hashing as H
from ..operators import iterate as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import order as O
from ..operators import sharing as P
from ..operators import tensor as T
from ..operators.scratch import materialise, scratch_path
from ..operators.table import POS, VALID, to_compact, to_padded
from ..sources import csv_sink as C
from ..sources import numpy_io as N
from ..sources import read_parquet
from ..sources import typed_json as Y
from .graphs import Context
from .library import Library

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return read_parquet(s, f"{d}/{name}.parquet")


def div(a, b: int):
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def div_columns(a, b):
    return F.call_function("div", a, b)


# Inputs -----------------------------------------------------------------------------------------

SQL_A = "(SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer WHERE c_acctbal >= 0)"
SQL_B = "(SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_custkey HAVING count(*) >= 5)"
SQL_AM = f"(SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_custkey END AS ck, c_nationkey, CASE WHEN c_nationkey = 5 THEN NULL ELSE bal END AS bal FROM {SQL_A})"
SQL_E = "(SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id, user_id, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
SQL_O = "(SELECT o_orderkey, o_orderkey * 1234567891 AS x, CAST(round(o_totalprice * 100) AS BIGINT) - 20000000 AS y FROM orders)"
SQL_T = "(SELECT vec_id AS i0, g - 1 AS i1, CAST(round(CAST(embedding[g] AS DOUBLE) * 32768) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS g FROM embeddings))"


def customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("bal"))


def order_totals(s: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(cents).alias("cents")).where("n_orders >= 5")


def masked_customers(s: SparkSession, d: str) -> DataFrame:
    a = customers(s, d)
    return a.select(F.when(F.col("c_nationkey") != 3, F.col("c_custkey")).alias("ck"), "c_nationkey", F.when(F.col("c_nationkey") != 5, F.col("bal")).alias("bal"))


def events(s: SparkSession, d: str) -> DataFrame:
    """All events with their place by event_id, numbered once: what builds on the places reads the numbered table."""
    e = table(s, d, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return materialise(O.positions(e, "event_id", None, "pos").select("pos", "event_id", "user_id", "v"), "events")


def numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 1234567891).alias("x"), (F.round(F.col("o_totalprice") * 100).cast("bigint") - 20000000).alias("y"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    cells = F.transform("embedding", lambda x: F.round(x.cast("double") * 32768).cast("bigint"))
    return T.from_cells(table(s, d, "embeddings").select("vec_id", cells.alias("c")), "vec_id", "c")


def _rows(s: SparkSession, d: str) -> int:
    return table(s, d, "embeddings").count()


def sql_wrap(e: str, bits: int = 64, signed: bool = True) -> str:
    m, h = 1 << bits, (1 << (bits - 1)) if signed else 0
    return f"CAST(((((({e})::HUGEINT + {h}::HUGEINT) % {m}::HUGEINT) + {m}::HUGEINT) % {m}::HUGEINT) - {h}::HUGEINT AS BIGINT)"


# Joins ------------------------------------------------------------------------------------------

_KEYS = {"c_custkey": "o_custkey"}
_SQL_JOIN = {
    "inner": f"SELECT c_custkey, c_nationkey, bal, n_orders, cents FROM {SQL_A} a JOIN {SQL_B} b ON c_custkey = o_custkey",
    "left": f"SELECT c_custkey, c_nationkey, bal, coalesce(n_orders, 0) AS n_orders, coalesce(cents, 0) AS cents FROM {SQL_A} a LEFT JOIN {SQL_B} b ON c_custkey = o_custkey",
    "union": f"SELECT c_custkey, c_nationkey, bal, 0 AS n_orders, 0 AS cents FROM {SQL_A} a WHERE NOT EXISTS (SELECT 1 FROM {SQL_B} b WHERE c_custkey = o_custkey) UNION ALL SELECT o_custkey, 0, 0, n_orders, cents FROM {SQL_B} b",
    "full": f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(c_nationkey, 0) AS c_nationkey, coalesce(bal, 0) AS bal, coalesce(n_orders, 0) AS n_orders, coalesce(cents, 0) AS cents FROM {SQL_A} a FULL JOIN {SQL_B} b ON c_custkey = o_custkey",
}
_SQL_MASKED = {
    "inner": f"SELECT ck, c_nationkey, bal, n_orders, cents FROM {SQL_AM} a JOIN {SQL_B} b ON ck = o_custkey",
    "left": f"SELECT ck, c_nationkey, bal, n_orders, cents FROM {SQL_AM} a LEFT JOIN {SQL_B} b ON ck = o_custkey",
    "union": f"SELECT ck, c_nationkey, bal, CAST(NULL AS BIGINT) AS n_orders, CAST(NULL AS BIGINT) AS cents FROM {SQL_AM} a WHERE NOT EXISTS (SELECT 1 FROM {SQL_B} b WHERE ck = o_custkey) UNION ALL SELECT o_custkey, NULL, NULL, n_orders, cents FROM {SQL_B} b",
    "full": f"SELECT coalesce(ck, o_custkey) AS ck, c_nationkey, bal, n_orders, cents FROM {SQL_AM} a FULL JOIN {SQL_B} b ON ck = o_custkey",
}
for _kind in J.KINDS:
    query(f"join_{_kind}", _SQL_JOIN[_kind])(lambda s, d, k=_kind: J.join(customers(s, d), order_totals(s, d), k, _KEYS))
    query(f"join_{_kind}_masked", _SQL_MASKED[_kind])(lambda s, d, k=_kind: J.join(masked_customers(s, d), order_totals(s, d), k, {"ck": "o_custkey"}, masked=True))


def _padded(s: SparkSession, d: str, kind: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("bal"))
    left = to_padded(c, F.col("bal") >= 0, F.col("c_custkey"))
    right = order_totals(s, d).select("o_custkey", "cents")
    right = to_padded(right, F.lit(1), F.col("o_custkey"))
    out = to_compact(J.padded_join(left, right, kind, _KEYS))
    return out.select("c_custkey", "bal", "cents")


for _kind in J.KINDS:
    query(f"padded_join_{_kind}", f"SELECT c_custkey, bal, cents FROM ({_SQL_JOIN[_kind]})")(lambda s, d, k=_kind: _padded(s, d, k))


def _parts(s: SparkSession, d: str, odd: int) -> DataFrame:
    rows = table(s, d, "lineitem").where(F.col("l_orderkey") % 2 == odd)
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias(f"q{odd}"))


@query("join_multikey", "SELECT a.l_partkey, a.l_suppkey, q0, q1 FROM (SELECT l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q0 FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2) a JOIN (SELECT l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q1 FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_multikey(s, d):
    return J.join(_parts(s, d, 0), _parts(s, d, 1), "inner", {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"})


query("join_semi", f"SELECT * FROM {SQL_A} a WHERE EXISTS (SELECT 1 FROM {SQL_B} b WHERE c_custkey = o_custkey)")(lambda s, d: J.semi_join(customers(s, d), order_totals(s, d), _KEYS))
query("join_anti", f"SELECT * FROM {SQL_A} a WHERE NOT EXISTS (SELECT 1 FROM {SQL_B} b WHERE c_custkey = o_custkey)")(lambda s, d: J.anti_join(customers(s, d), order_totals(s, d), _KEYS))
query("join_unique_checked", _SQL_JOIN["inner"])(lambda s, d: J.join(customers(s, d), order_totals(s, d), "inner", _KEYS, on_duplicate="error"))


@query("join_last_duplicate", f"SELECT c_custkey, bal, o_orderkey FROM {SQL_A} a JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) b ON c_custkey = o_custkey")
def join_last_duplicate(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias(POS))
    return J.join(customers(s, d), o, "inner", _KEYS, on_duplicate="last").select("c_custkey", "bal", "o_orderkey")


# Order ------------------------------------------------------------------------------------------


def _ranked(key: str) -> str:
    return f"SELECT event_id, row_number() OVER (ORDER BY {key}, pos) - 1 AS pos FROM {SQL_E}"


query("sort_int", _ranked("user_id"))(lambda s, d: O.stable_sort(events(s, d), "user_id", "pos").select("event_id", "pos"))
query("sort_signed", _ranked("v - 5000"))(lambda s, d: O.stable_sort(events(s, d).withColumn("k", F.col("v") - 5000), "k", "pos").select("event_id", "pos"))
query("sort_bits", _ranked("(user_id & 1) * 8 + ((user_id >> 1) & 1) * 4 + ((user_id >> 2) & 1) * 2 + ((user_id >> 3) & 1)"))(
    lambda s, d: O.sort_by_bits(events(s, d).withColumn("b", F.array(*(F.shiftright("user_id", i).bitwiseAND(F.lit(1)) for i in range(4)))), "b", "pos").select("event_id", "pos")
)
_PERM_KEY = "(event_id * 7919) % 10007"
_SQL_PERM = f"(SELECT pos, row_number() OVER (ORDER BY {_PERM_KEY}, pos) - 1 AS p FROM {SQL_E})"


def _perm(e: DataFrame) -> DataFrame:
    keyed = e.select("pos", (F.col("event_id") * 7919 % 10007).alias("k"))
    return O.positions(keyed, "k", "pos", "p").select("pos", F.col("p").alias("v"))


query("perm_apply", f"SELECT q.pos, e.event_id FROM {_SQL_PERM} q JOIN {SQL_E} e ON e.pos = q.p")(lambda s, d: O.apply_permutation((e := events(s, d)).select("pos", "event_id"), _perm(e), pos="pos"))
query("perm_apply_inverse", f"SELECT q.p AS pos, e.event_id FROM {_SQL_PERM} q JOIN {SQL_E} e ON e.pos = q.pos")(lambda s, d: O.apply_permutation((e := events(s, d)).select("pos", "event_id"), _perm(e), True, pos="pos"))
query("perm_inverse", f"SELECT p AS pos, pos AS v FROM {_SQL_PERM}")(lambda s, d: O.inverse_permutation(_perm(events(s, d)), pos="pos"))
query("gather", f"SELECT q.pos, e.event_id FROM (SELECT pos, (pos * pos) % (SELECT count(*) FROM events) AS p FROM {SQL_E}) q JOIN {SQL_E} e ON e.pos = q.p")(
    lambda s, d: O.gather((e := events(s, d)).select("pos", "event_id"), e.select("pos", (F.col("pos") * F.col("pos") % e.count()).alias("v")), pos="pos")
)
query("get_row", f"SELECT event_id, user_id, v FROM {SQL_E} WHERE pos = 7")(lambda s, d: O.get_row(events(s, d), 7, "pos"))
query("slice_step", f"SELECT (pos - 3) // 7 AS pos, event_id FROM {SQL_E} WHERE pos >= 3 AND (pos - 3) % 7 = 0")(lambda s, d: O.take_slice((e := events(s, d)).select("pos", "event_id"), e.count(), 3, None, 7, pos="pos"))
query("slice_reverse", f"SELECT (SELECT count(*) FROM events) - 1 - pos AS pos, event_id FROM {SQL_E}")(lambda s, d: O.take_slice((e := events(s, d)).select("pos", "event_id"), e.count(), None, None, -1, pos="pos"))
query("concat", f"SELECT pos, event_id FROM {SQL_E} UNION ALL SELECT pos + (SELECT count(*) FROM events), event_id FROM {SQL_E}")(lambda s, d: O.concatenate([((e := events(s, d).select("pos", "event_id")), n := e.count()), (e, n)], pos="pos"))
query("stack", f"SELECT CAST(0 AS BIGINT) AS i0, pos AS i1, user_id AS v FROM {SQL_E} UNION ALL SELECT 1, pos, v FROM {SQL_E}")(
    lambda s, d: T.stack([(e := events(s, d)).select(F.col("pos").alias("i0"), F.col("user_id").alias("v")), e.select(F.col("pos").alias("i0"), "v")])
)
query("zip", f"SELECT pos, user_id, v FROM {SQL_E}")(lambda s, d: O.zip_tables((e := events(s, d)).select("pos", "user_id"), e.select("pos", "v"), pos="pos"))
query("repeat", f"SELECT CAST(c AS INTEGER) AS _copy, pos, event_id FROM {SQL_E}, (SELECT unnest(range(3)) AS c)")(lambda s, d: O.repeat(events(s, d).select("pos", "event_id"), 3))
query("transpose", f"SELECT i1 AS i0, i0 AS i1, v FROM {SQL_T}")(lambda s, d: T.permute_axes(vectors(s, d), [1, 0]))


@query("reshape", f"SELECT (i0 * 64 + i1) // 16 AS i0, (i0 * 64 + i1) % 16 AS i1, v FROM {SQL_T}")
def reshape(s, d):
    n = table(s, d, "embeddings").count()
    return T.reshape(vectors(s, d), [n, 64], [n * 4, 16])


query("array_vector", "SELECT vec_id AS i0, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 32768) AS BIGINT)), ',') AS cells FROM embeddings")(lambda s, d: T.to_cells(vectors(s, d)).select("i0", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells")))

# Arithmetic -------------------------------------------------------------------------------------


def scalar_query(name: str, columns: dict[str, object], sql: dict[str, str]) -> None:
    body = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    query(name, f"SELECT o_orderkey, {body} FROM {SQL_O}")(lambda s, d: numbers(s, d).select("o_orderkey", *(c().alias(n) for n, c in columns.items())))


x, y, key = (lambda: F.col("x")), (lambda: F.col("y")), (lambda: F.col("o_orderkey"))
_BIG = 9223372036850000000
scalar_query("add_wrap", {"v64": lambda: S.add_all([x(), F.lit(_BIG - 10**15), x()], S.I64), "v32": lambda: S.add(S.wrap(x(), S.I32), S.wrap(y() * 1000, S.I32), S.I32).cast("bigint"), "u8": lambda: S.add(S.wrap(x(), S.U8), S.wrap(y(), S.U8), S.U8).cast("bigint")}, {"v64": sql_wrap(f"x::HUGEINT + {_BIG - 10**15} + x"), "v32": sql_wrap("x + y * 1000", 32), "u8": sql_wrap("x + y", 8, False)})
scalar_query("sub_wrap", {"v64": lambda: S.subtract(S.subtract(S.neg64(x()), F.lit(_BIG - 10**15), S.I64), S.multiply(x(), F.lit(100), S.I64), S.I64), "v16": lambda: S.subtract(S.wrap(x(), S.I16), S.wrap(y(), S.I16), S.I16).cast("bigint")}, {"v64": sql_wrap(f"-x::HUGEINT - {_BIG - 10**15} - x * 100"), "v16": sql_wrap("x - y", 16)})
scalar_query("mul_wrap", {"v64": lambda: S.multiply(x(), y(), S.I64), "u32": lambda: S.multiply(S.wrap(x(), S.U32), S.wrap(y(), S.U32), S.U32).cast("bigint"), "i8": lambda: S.multiply(S.wrap(x(), S.I8), S.wrap(y(), S.I8), S.I8).cast("bigint")}, {"v64": sql_wrap("x::HUGEINT * y"), "u32": sql_wrap("x::HUGEINT * y", 32, False), "i8": sql_wrap("x::HUGEINT * y", 8)})
scalar_query("bit_arith", {"xor": lambda: S.add((x() % 2).cast("tinyint"), (key() % 3 % 2).cast("tinyint"), S.BIT).cast("int"), "land": lambda: S.multiply((x() % 2).cast("tinyint"), (key() % 3 % 2).cast("tinyint"), S.BIT).cast("int")}, {"xor": "CAST(xor(x % 2, o_orderkey % 3 % 2) AS INTEGER)", "land": "CAST((x % 2) & (o_orderkey % 3 % 2) AS INTEGER)"})
scalar_query("mixed_mul", {"v": lambda: S.mixed_multiply(y(), (key() % 2).cast("tinyint"))}, {"v": "CASE WHEN o_orderkey % 2 = 1 THEN y ELSE 0 END"})
scalar_query("truncate", {"v": lambda: S.truncate(y(), 32768), "u": lambda: S.truncate(y(), 1000, S.U64)}, {"v": "y // 32768", "u": "CAST((CASE WHEN y < 0 THEN y::HUGEINT + 18446744073709551616::HUGEINT ELSE y::HUGEINT END) // 1000 AS BIGINT)"})

# Scans, reductions and linear algebra -----------------------------------------------------------

query("sum_axes", f"SELECT i1, CAST(sum(v) AS BIGINT) AS v FROM {SQL_T} GROUP BY i1")(lambda s, d: T.sum_axes(vectors(s, d), [0]))
query("sum_all", f"SELECT CAST(sum(v) AS BIGINT) AS v FROM {SQL_T}")(lambda s, d: T.sum_axes(vectors(s, d), [0, 1]))
query("sum_wrapped", f"SELECT {sql_wrap('sum(x::HUGEINT * 1000)')} AS v FROM {SQL_O}")(lambda s, d: numbers(s, d).agg(S.sum_wrapped(S.multiply(F.col("x"), F.lit(1000), S.I64)).alias("v")))
query("cumsum", f"SELECT pos AS i0, CAST(sum(v) OVER (ORDER BY pos) AS BIGINT) AS v FROM {SQL_E}")(lambda s, d: T.cumsum(events(s, d).select(F.col("pos").alias("i0"), "v"), 0))
query("cumsum_axis", f"SELECT i0, i1, CAST(sum(v) OVER (PARTITION BY i1 ORDER BY i0) AS BIGINT) AS v FROM {SQL_T}")(lambda s, d: T.cumsum(vectors(s, d), 0))
query("cumsum_bits", f"SELECT pos AS i0, CAST(sum(v % 2) OVER (ORDER BY pos) % 2 AS INTEGER) AS v FROM (SELECT pos, abs(v) AS v FROM {SQL_E})")(lambda s, d: T.cumsum(events(s, d).select(F.col("pos").alias("i0"), (F.abs("v") % 2).alias("v")), 0, S.BIT).withColumn("v", F.col("v").cast("int")))
_SQL_SEG = f"(SELECT CAST(0 AS BIGINT) AS pos, CAST(10 AS BIGINT) AS v, 0 AS b UNION ALL SELECT pos + 1, v, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END FROM {SQL_E})"
query("segment_cumsum", f"SELECT pos AS _pos, CAST(sum(v) OVER (PARTITION BY g ORDER BY pos) AS BIGINT) AS v FROM (SELECT pos, v, sum(1 - b) OVER (ORDER BY pos) AS g FROM {_SQL_SEG})")(lambda s, d: T.segment_cumsum(events(s, d).withColumn("b", (F.col("event_id") % 5 != 0).cast("int")), "pos", "v", "b", 10))
query("dot", f"SELECT i0 AS vec_id, CAST(sum(v * v) AS BIGINT) AS v FROM {SQL_T} GROUP BY i0")(lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.round(e.cast("double") * 32768).cast("bigint")).alias("c")).select("vec_id", T.dot(F.col("c"), F.col("c")).alias("v")))
_SQL_W = "(SELECT k, j, (k * 31 + j * 17) % 101 - 50 AS w FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(8)) AS j))"


def _weights(s: SparkSession) -> DataFrame:
    return s.range(512).select(div(F.col("id"), 8).alias("i0"), (F.col("id") % 8).alias("i1")).withColumn("v", (F.col("i0") * 31 + F.col("i1") * 17) % 101 - 50)


query("matmul", f"SELECT i0, j AS i1, CAST(sum(v * w) AS BIGINT) AS v FROM {SQL_T} t JOIN {_SQL_W} w ON t.i1 = w.k GROUP BY i0, j")(lambda s, d: T.matmul(vectors(s, d), _weights(s)))
query("gemm_t", f"SELECT a.i1 AS i0, b.i1 AS i1, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {SQL_T} a JOIN {SQL_T} b ON a.i0 = b.i0 GROUP BY 1, 2")(lambda s, d: T.gemm(v := vectors(s, d), v, transpose_a=True, small=True))
query("broadcast_add", f"SELECT i0, i1, v + i1 * 3 AS v FROM {SQL_T}")(lambda s, d: T.elementwise(vectors(s, d), s.range(64).select(F.col("id").alias("i0"), (F.col("id") * 3).alias("v")), S.add, shapes=([_rows(s, d), 64], [64])))

query("expand_dims", f"SELECT CAST(0 AS BIGINT) AS i0, i0 AS i1, CAST(0 AS BIGINT) AS i2, i1 AS i3, v FROM {SQL_T}")(lambda s, d: T.expand_dims(vectors(s, d), [0, 2]))
query("zeros_and_ones", f"SELECT i0, i1, CAST(0 AS BIGINT) AS v FROM {SQL_T} UNION ALL SELECT i0, i1, CAST(1 AS BIGINT) FROM {SQL_T}")(lambda s, d: T.zeros_like(v := vectors(s, d)).unionByName(T.ones_like(v)))
query("extend_with_zeros", f"SELECT i0, i1, v FROM {SQL_T} UNION ALL SELECT (SELECT count(*) FROM embeddings) + r, c, 0 FROM (SELECT unnest(range(3)) AS r), (SELECT unnest(range(64)) AS c)")(lambda s, d: T.extend_with_zeros(vectors(s, d), [table(s, d, "embeddings").count(), 64], 3))
query("bit_planes", f"SELECT b AS i0, o_orderkey AS i1, CAST((o_orderkey >> b) & 1 AS INTEGER) AS v FROM {SQL_O}, (SELECT unnest(range(32)) AS b)")(lambda s, d: T.pull_out_bits(numbers(s, d).select("o_orderkey", B.a2b(key(), S.U32).array().alias("bits"))).withColumn("v", F.col("v").cast("int")))
query("bits_in_cells", f"SELECT o_orderkey AS i0, o_orderkey AS v FROM {SQL_O}")(lambda s, d: T.put_in_bits(T.pull_out_bits(numbers(s, d).select("o_orderkey", B.a2b(key(), S.U32).array().alias("bits")))).select("i0", B.b2a(F.col("bits"), S.U32).alias("v")))
query("reduce_bits", f"SELECT bit_xor(y) AS v FROM {SQL_O}")(lambda s, d: T.reduce_rows(numbers(s, d).select(F.col("y").alias("v")), F.bit_xor))

# Bits -------------------------------------------------------------------------------------------

scalar_query("a2b", {"bits": lambda: F.array_join(B.a2b(y(), S.I64).array().cast("array<string>"), "")}, {"bits": "array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN y >= 0 THEN (y >> i) & 1 ELSE 1 - (((-y - 1) >> i) & 1) END), '')"})
scalar_query("b2a", {"v": lambda: B.b2a(B.a2b(S.wrap(y(), S.I32), S.I32).array(), S.I32).cast("bigint"), "w": lambda: B.b2a(B.a2b(y(), S.I64), S.I64)}, {"v": sql_wrap("y", 32), "w": "y"})
scalar_query("bin_add", {"total": lambda: B.binary_add(x(), y(), S.U8)[0], "carry": lambda: B.binary_add(x(), y(), S.U8)[1].cast("int")}, {"total": sql_wrap("x + y", 8, False), "carry": f"CASE WHEN {sql_wrap('x', 8, False)} + {sql_wrap('y', 8, False)} >= 256 THEN 1 ELSE 0 END"})
_U = "(CASE WHEN {0} < 0 THEN {0}::HUGEINT + 18446744073709551616::HUGEINT ELSE {0}::HUGEINT END)"
_RIGHT = "((o_orderkey * 37) % 2001 - 1000) * 20000"
for _name, _op, _f in (("gt", ">", B.greater), ("lt", "<", B.less), ("ge", ">=", B.greater_equal), ("le", "<=", B.less_equal), ("eq", "=", lambda a, b, k: B.equal(a, b)), ("ne", "<>", lambda a, b, k: B.not_equal(a, b))):
    scalar_query(
        f"cmp_{_name}",
        {"signed": lambda f=_f: f(y(), (key() * 37 % 2001 - 1000) * 20000, S.I64).cast("int"), "unsigned": lambda f=_f: f(y(), (key() * 37 % 2001 - 1000) * 20000, S.U64).cast("int")},
        {"signed": f"CAST(y {_op} {_RIGHT} AS INTEGER)", "unsigned": f"CAST({_U.format('y')} {_op} {_U.format('(' + _RIGHT + ')')} AS INTEGER)"},
    )
scalar_query("min_max", {"least": lambda: B.minimum(y(), key() * 1000, S.I64), "most": lambda: B.maximum(y(), key() * 1000, S.I64), "u_least": lambda: B.minimum(y(), key() * 1000, S.U64)}, {"least": "least(y, o_orderkey * 1000)", "most": "greatest(y, o_orderkey * 1000)", "u_least": "CASE WHEN y < 0 THEN o_orderkey * 1000 ELSE least(y, o_orderkey * 1000) END"})
scalar_query("mux", {"v": lambda: B.mux(key() % 2, x(), y())}, {"v": "CASE WHEN o_orderkey % 2 = 1 THEN x ELSE y END"})
scalar_query("clip", {"v": lambda: B.clip_2k(y(), 22)}, {"v": "least(greatest(y, 0), 4194304)"})
scalar_query("not_or", {"inv": lambda: B.not_(key() % 2).cast("int"), "either": lambda: B.or_(key() % 2, x() % 3 % 2).cast("int")}, {"inv": "CAST(1 - o_orderkey % 2 AS INTEGER)", "either": "CAST((o_orderkey % 2) | (x % 3 % 2) AS INTEGER)"})
scalar_query("one_hot", {"bits": lambda: F.array_join(B.one_hot(key() % 8, 8).cast("array<string>"), "")}, {"bits": "array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN i = o_orderkey % 8 THEN 1 ELSE 0 END), '')"})

# Fixed point ------------------------------------------------------------------------------------

_A, _D = "y", "(o_orderkey % 11 - 5)"
scalar_query("longdiv_floor", {"q": lambda: X.floor_divide(y(), key() % 11 - 5)[0], "r": lambda: X.floor_divide(y(), key() % 11 - 5)[1]}, {"q": f"CASE WHEN {_D} = 0 THEN 0 ELSE {_A} // {_D} - (CASE WHEN {_A} % {_D} <> 0 AND ({_A} < 0) <> ({_D} < 0) THEN 1 ELSE 0 END) END", "r": f"CASE WHEN {_D} = 0 THEN {_A} ELSE {_A} % {_D} + (CASE WHEN {_A} % {_D} <> 0 AND ({_A} < 0) <> ({_D} < 0) THEN {_D} ELSE 0 END) END"})


def _nest(inner: str, steps: list[str]) -> str:
    for step in steps:
        inner = f"SELECT o_orderkey, {step} FROM ({inner})"
    return inner


_SMALL = "o_orderkey % 1000 + 1"


def _goldschmidt_sql(cap: int, iterations: int) -> str:
    start = f"SELECT o_orderkey, (abs(y) % 100000) * w AS a, d * w AS b FROM (SELECT o_orderkey, y, {_SMALL} AS d, CAST(1 AS BIGINT) << ({cap - 1} - (length(bin({_SMALL})) - 1)) AS w FROM {SQL_O})"
    step = f"(a * ({1 << (cap + 1)} - b)) // {1 << cap} AS a, (b * ({1 << (cap + 1)} - b)) // {1 << cap} AS b"
    return f"SELECT o_orderkey, a AS v FROM ({_nest(start, [step] * (iterations - 1))})"


def _newton_sql(cap: int, iterations: int) -> str:
    start = f"SELECT o_orderkey, {_SMALL} AS d, CAST(1 AS BIGINT) << ({cap - 1} - (length(bin({_SMALL})) - 1)) AS z FROM {SQL_O}"
    return f"SELECT o_orderkey, z AS v FROM ({_nest(start, [f'd, (({1 << (cap + 1)} - z * d) * z) // {1 << cap} AS z'] * iterations)})"


def _inverse_sqrt_sql(cap: int, iterations: int) -> str:
    start = f"SELECT o_orderkey, {_SMALL} AS d, CAST(1 AS BIGINT) << ({cap - 1} - CAST(floor((length(bin({_SMALL})) - 1) / 2) AS INTEGER)) AS z FROM {SQL_O}"
    return f"SELECT o_orderkey, z AS v FROM ({_nest(start, [f'd, (({3 << (cap - 1)} - (d * z * z) // {1 << (cap + 1)}) * z) // {1 << cap} AS z'] * iterations)})"


def _small():
    return key() % 1000 + 1


query("goldschmidt", _goldschmidt_sql(10, 5))(lambda s, d: numbers(s, d).select("o_orderkey", X.goldschmidt_divide(F.abs("y") % 100000, _small(), 5, 10).alias("v")))
query("newton", _newton_sql(10, 5))(lambda s, d: numbers(s, d).select("o_orderkey", X.newton_inverse(_small(), 5, 10).alias("v")))
query("inverse_sqrt", _inverse_sqrt_sql(10, 5))(lambda s, d: numbers(s, d).select("o_orderkey", X.inverse_sqrt(_small(), 5, 10).alias("v")))
#: A fixed-point argument from -12 to 8.
_ARG = "(((o_orderkey * 7919) % 655360) - 393216)"


def _arg():
    return key() * 7919 % 655360 - 393216


def _taylor_sql(terms: int = 5, f: int = 15) -> str:
    import math

    one, ln2, per, top = 1 << f, int(math.log(2) * (1 << f)), int((1 << f) / math.log(2)), math.ceil(math.log2(31 - f))
    inner = f"SELECT o_orderkey, ({_ARG} * {per}) // {one} AS z FROM {SQL_O}"
    m = 1 << 40  # makes the argument positive, which leaves its low bits as they are
    power = " * ".join(f"(CASE WHEN ((z + {m}) >> {f + j}) & 1 = 1 THEN CAST({1 << (1 << j)} AS BIGINT) ELSE 1 END)" for j in range(top))
    inner = f"SELECT o_orderkey, z, {power} AS power, (((z + {m}) % {one}) * {ln2}) // {one} AS y1, CAST({one} AS BIGINT) AS c, CAST({one} AS BIGINT) AS t FROM ({inner})"
    for i in range(terms - 1):
        inner = f"SELECT o_orderkey, z, power, y1, (c * y1) // {(i + 1) << f} AS c, t + (c * y1) // {(i + 1) << f} AS t FROM ({inner})"
    return f"SELECT o_orderkey, CASE WHEN z < {-10 * one} THEN 0 WHEN z < 0 THEN (t * power) // {1 << (1 << top)} ELSE t * power END AS v FROM ({inner})"


query("taylor_exp", _taylor_sql())(lambda s, d: numbers(s, d).select("o_orderkey", X.taylor_exp(_arg()).alias("v")))


def _curve_sql(name: str, f: int = 15) -> str:
    slopes, offsets, left, width = X.curve_table(name, f)
    at = f"({_ARG} - ({left})) // {width}"
    place = f"(CASE WHEN {at} < 0 THEN 0 ELSE least({at} + 1, {len(slopes) - 1}) END) + 1"
    return f"SELECT o_orderkey, ({slopes}[{place}] * {_ARG} + {offsets}[{place}]) // {1 << f} AS v FROM {SQL_O}"


for _name in X.CURVES:
    query(f"pwl_{_name}", _curve_sql(_name))(lambda s, d, n=_name: numbers(s, d).select("o_orderkey", X.approximate(n, _arg()).alias("v")))
scalar_query("fixed_mul", {"v": lambda: X.fixed_multiply(y(), _small() * 3277, debug=True)}, {"v": f"(y * (({_SMALL}) * 3277)) // 32768"})
_SQL_AUC = "(SELECT n_chars AS s, {0} AS y FROM labels JOIN documents USING (doc_id))"


def _auc_sql(label: str) -> str:
    by = f"(SELECT s, sum(y) AS p, sum(1 - y) AS n FROM {_SQL_AUC.format(label)} GROUP BY s)"
    return f"SELECT CAST(sum(p * (2 * upto - n)) AS BIGINT) AS twice_ordered, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM (SELECT p, n, sum(n) OVER (ORDER BY s) AS upto FROM {by})"


for _label in ("quality", "toxic"):
    query(f"auc_{_label}", _auc_sql(_label))(
        lambda s, d, c=_label: M.auc_counts(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id"), F.col(c), F.col("n_chars")).select(*(F.col(n).cast("bigint").alias(n) for n in ("twice_ordered", "positives", "negatives")))
    )

# Control, structure and hashing -----------------------------------------------------------------

_CELLS = "list_transform(embedding, lambda e: CAST(abs(round(CAST(e AS DOUBLE) * 32768)) AS BIGINT))"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.abs(F.round(e.cast("double") * 32768)).cast("bigint")).alias("c"))


query("iterate_state", f"SELECT vec_id, list_reduce(list_prepend(CAST(1 AS BIGINT), {_CELLS}), lambda a, b: (a * 3 + b) % 1009) AS v FROM embeddings")(lambda s, d: _cells(s, d).select("vec_id", I.iterate_cell(F.col("c"), F.lit(1).cast("bigint"), lambda st, e: ((st * 3 + e) % 1009, st), "bigint")["state"].alias("v")))
query("iterate_map", f"SELECT vec_id, array_to_string(list_transform({_CELLS}, lambda e: e * 2 + 1), ',') AS v FROM embeddings")(lambda s, d: _cells(s, d).select("vec_id", F.array_join(I.iterate_map(F.col("c"), lambda e: e * 2 + 1).cast("array<string>"), ",").alias("v")))


@query("call_graph", f"SELECT o_orderkey, x + 3 * y AS v FROM {SQL_O}")
def call_graph(s, d):
    c = Context()
    c.graph("scale", ("a",))(lambda a: a * 3)
    c.graph("main", ("a", "b"))(lambda a, b: a + c.call("scale", b))
    return numbers(s, d).select("o_orderkey", c.finalise("main").run(a=x(), b=y()).alias("v"))


query("tuples", f"SELECT o_orderkey, x AS a, y AS b FROM {SQL_O}")(lambda s, d: numbers(s, d).select("o_orderkey", V.tuple_of(x(), y()).alias("t")).select("o_orderkey", V.tuple_get(F.col("t"), 0).alias("a"), V.tuple_get(F.col("t"), 1).alias("b")))
query("vector_ops", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN x WHEN 1 THEN y ELSE 5 END AS v, CAST(4 AS INTEGER) AS n FROM {SQL_O}")(lambda s, d: numbers(s, d).select("o_orderkey", V.push(V.vector(x(), y(), F.lit(5).cast("bigint")), F.lit(9).cast("bigint")).alias("t")).select("o_orderkey", V.vector_get(F.col("t"), key() % 3).alias("v"), F.size("t").alias("n")))
query("constants", f"SELECT o_orderkey, '0,0,0' AS z, '1,1' AS o FROM {SQL_O}")(lambda s, d: numbers(s, d).select("o_orderkey", F.array_join(V.zeros(3).cast("array<string>"), ",").alias("z"), F.array_join(V.ones(2).cast("array<string>"), ",").alias("o")))
query("asserted", f"SELECT o_orderkey, x AS v FROM {SQL_O}")(lambda s, d: I.observed(numbers(s, d), "rows").select("o_orderkey", I.checked(x(), x() >= 0, "negative").alias("v")))
query("share_reveal", f"SELECT o_orderkey, x, y FROM {SQL_O}")(lambda s, d: P.reveal_table(P.share_table(numbers(s, d), k := {"x": S.I64, "y": S.I64}, 7, "o_orderkey"), k))
query("share_multiply", f"SELECT o_orderkey, {sql_wrap('x::HUGEINT * y')} AS v FROM {SQL_O}")(lambda s, d: P.share_table(numbers(s, d), {"x": S.I64, "y": S.I64}, 7, "o_orderkey").select("o_orderkey", P.reveal(P.multiply_shares(F.col("x"), F.col("y"), S.I64), S.I64).alias("v")))
query("shard_rows", "SELECT CAST(c_custkey % 7 AS INTEGER) AS _shard, row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY 1) - 1 AS _slot FROM customer")(lambda s, d: H.shards(table(s, d, "customer").select("c_custkey"), 7, ["c_custkey"], by=F.col("c_custkey"), pos="c_custkey").select("_shard", "_slot"))
query("minimum", f"SELECT min(y) AS v FROM {SQL_O}")(lambda s, d: T.minimum_of(numbers(s, d), "y"))
query("millionaires", f"SELECT c_custkey, CAST(bal > cents AS INTEGER) AS richer FROM {SQL_A} a JOIN {SQL_B} b ON c_custkey = o_custkey")(lambda s, d: J.join(customers(s, d), order_totals(s, d), "inner", _KEYS).select("c_custkey", B.greater(F.col("bal"), F.col("cents"), S.I64).cast("int").alias("richer")))
query("psi_count", f"SELECT count(*) AS n FROM {SQL_A} a WHERE c_custkey IN (SELECT o_custkey FROM {SQL_B})")(lambda s, d: J.semi_join(customers(s, d), order_totals(s, d), _KEYS).agg(F.count("*").alias("n")))
query("csv_rows", f"SELECT CAST(ck AS VARCHAR) AS id, printf('%.3f', bal / 8.0) AS share, CASE WHEN c_nationkey > 12 THEN 'true' ELSE 'false' END AS far FROM {SQL_AM}")(
    lambda s, d: C.csv_table(masked_customers(s, d), {"id": C.int_cell(F.col("ck")), "share": C.float_cell(F.col("bal"), 3, 3), "far": C.bool_cell((F.col("c_nationkey") > 12).cast("int"))}).select(*(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("id", "share", "far")))
)
# Random operations are checked by what holds for every draw.
query("perm_random", f"SELECT pos AS image, 1 AS times FROM {SQL_E}")(lambda s, d: H.random_permutation(events(s, d), 42, "pos").groupBy(F.col("v").alias("image")).agg(F.count("*").cast("int").alias("times")))
query("perm_prf", f"SELECT pos AS image, 1 AS times FROM {SQL_E}")(lambda s, d: H.permutation_from_prf(events(s, d), F.lit("key"), 5, "pos").groupBy(F.col("v").alias("image")).agg(F.count("*").cast("int").alias("times")))


def _drawn(df: DataFrame) -> DataFrame:
    """Rows, whether values of 64 bits differ, whether half of them are negative (within a twentieth), and the range of bytes."""
    half = F.abs(F.avg((F.col("v") < 0).cast("int")) - 0.5) < 0.05
    return df.agg(F.count("*").alias("n"), F.count_distinct("v").alias("different"), half.cast("int").alias("balanced"), F.min("b").cast("int").alias("low"), F.max("b").cast("int").alias("high"), F.max(F.size("cells")).alias("cells"))


_SQL_DRAWN = "SELECT count(*) AS n, count(*) AS different, 1 AS balanced, 0 AS low, 255 AS high, 3 AS cells FROM events"
query("random_values", _SQL_DRAWN)(lambda s, d: _drawn(events(s, d).select(H.random_column(42, F.col("pos")).alias("v"), H.random_value(7, F.col("pos"), S.U8).alias("b"), H.random_value(7, F.col("pos"), [3, S.I32]).alias("cells"))))
query("prf", _SQL_DRAWN)(lambda s, d: _drawn(events(s, d).select(H.prf(F.lit("key"), 3, F.col("pos")).alias("v"), H.prf_value(F.lit("key"), 4, F.col("pos"), S.U8).alias("b"), H.prf_value(F.lit("key"), 5, F.col("pos"), [3, S.I32]).alias("cells"))))
query("random_tensor", "SELECT i0, count(*) AS n, 1 AS in_range FROM (SELECT unnest(range(50)) AS i0), (SELECT unnest(range(40)) AS i1) GROUP BY i0")(lambda s, d: H.random_tensor(s, 3, [50, 40], S.U16).groupBy("i0").agg(F.count("*").alias("n"), F.min(F.col("v").between(0, 65535).cast("int")).alias("in_range")))


def _matrices(h: int, m: int) -> list[list[int]]:
    """Bit masks from a fixed multiplier."""
    return [[((i * m + j + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1) for j in range(m)] for i in range(h)]


def _hash_slots(v, matrices: list[list[int]]):
    """The slots of a key as an array, by the parity of its bits under each mask."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    slot = lambda masks: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(signed(m)))).bitwiseAND(F.lit(1)).cast("bigint"), k) for k, m in enumerate(masks)])
    return F.array(*map(slot, matrices))


@query("cuckoo", "SELECT c_nationkey, c_custkey, 1 AS own_slots FROM customer")
def cuckoo(s, d):
    """Every key's row stands in one slot of its set's table, and that is one of its hash slots."""
    rows = table(s, d, "customer").select("c_nationkey", "c_custkey", F.xxhash64("c_custkey").alias("v"))
    most = rows.groupBy("c_nationkey").count().agg(F.max("count")).first()[0] or 1
    m = (2 * most).bit_length()
    placed = H.cuckoo_tables(rows, "c_nationkey", "c_custkey", "v", _matrices(3, m), m, seed=1).where(F.col("row") != H.DUMMY)
    found = rows.join(placed.select("c_nationkey", F.col("row").alias("c_custkey"), "slot"), ["c_nationkey", "c_custkey"], "left")
    own = F.array_contains(_hash_slots(F.col("v"), _matrices(3, m)), F.col("slot"))
    return found.groupBy("c_nationkey", "c_custkey").agg(F.sum(own.cast("int")).cast("int").alias("own_slots"))


@query("cuckoo_permutation", "SELECT unnest(range(CAST(1 AS BIGINT) << length(bin(2 * (SELECT count(*) FROM customer))))) AS image, 1 AS times")
def cuckoo_permutation(s, d):
    """The filled table has every index below its size once."""
    rows = O.positions(table(s, d, "customer").select("c_custkey"), "c_custkey", None, "r").select(F.lit(0).alias("g"), "r", F.xxhash64("c_custkey").alias("v"))
    m = (2 * (table(s, d, "customer").count() or 1)).bit_length()
    filled = H.cuckoo_to_permutation(materialise(H.cuckoo_tables(rows, "g", "r", "v", _matrices(3, m), m, seed=1), "cuckoo"))
    return filled.groupBy(F.col("row").alias("image")).agg(F.count("*").cast("int").alias("times"))


@query("switching_map", f"SELECT pos, (pos * pos) % (SELECT count(*) FROM events) AS v FROM {SQL_E}")
def switching_map(s, d):
    """The three steps of a decomposed index map, put together again."""
    e = events(s, d).select("pos")
    n = e.count()
    first, second, third = H.decompose_switching(e.select("pos", (F.col("pos") * F.col("pos") % n).alias("v")), n, pos="pos")
    a, b = first.select(F.col("pos").alias("p1"), F.col("v").alias("source")), second.select(F.col("pos").alias("p2"), F.col("v").alias("p1"))
    return third.select("pos", F.col("v").alias("p2")).join(b, "p2").join(a, "p1").select("pos", F.col("source").alias("v"))


# Axes, ranks and containers -------------------------------------------------------------------

query("broadcast_axes", f"SELECT i0, i1, v + i1 * 3 + i0 * 1000 AS v FROM {SQL_T}")(
    lambda s, d: T.elementwise(
        T.elementwise(s.range(64).select(F.lit(0).cast("bigint").alias("i0"), F.col("id").alias("i1"), (F.col("id") * 3).alias("v")), v := vectors(s, d), S.add, shapes=([1, 64], [n := _rows(s, d), 64])),
        v.where("i1 = 0").select("i0", "i1", (F.col("i0") * 1000).alias("v")), S.add, shapes=([n, 64], [n, 1]),
    )
)
query("broadcast_outer", "SELECT i0, i1, i0 * 10 + i1 AS v FROM (SELECT unnest(range(40)) AS i0), (SELECT unnest(range(30)) AS i1)")(
    lambda s, d: T.elementwise(s.range(40).select(F.col("id").alias("i0"), F.lit(0).cast("bigint").alias("i1"), (F.col("id") * 10).alias("v")), s.range(30).select(F.col("id").alias("i0"), F.col("id").alias("v")), S.add)
)
_SQL_CUBE = f"(SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, v FROM {SQL_T})"
_SQL_8 = "(SELECT k, j, (k * 31 + j * 17) % 101 - 50 AS w FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(8)) AS j))"


def _cube(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).select("i0", div(F.col("i1"), 8).alias("i1"), (F.col("i1") % 8).alias("i2"), "v")


def _eight(s: SparkSession) -> DataFrame:
    return s.range(64).select(div(F.col("id"), 8).alias("i0"), (F.col("id") % 8).alias("i1")).withColumn("v", (F.col("i0") * 31 + F.col("i1") * 17) % 101 - 50)


_SQL_PRODUCT = f"SELECT i0, i1, j AS i2, CAST(sum(v * w) AS BIGINT) AS v FROM {_SQL_CUBE} c JOIN {_SQL_8} w ON i2 = k GROUP BY 1, 2, 3"
query("dot_nd", _SQL_PRODUCT)(lambda s, d: T.dot_product(_cube(s, d), _eight(s)))
query("dot_scalar", f"SELECT i0, i1, v * 7 AS v FROM {SQL_T}")(lambda s, d: T.dot_product(s.range(1).select(F.lit(7).cast("bigint").alias("v")), vectors(s, d)))
query("matmul_batch", _SQL_PRODUCT)(lambda s, d: T.matmul(_cube(s, d), _eight(s).select(F.lit(0).cast("bigint").alias("i0"), F.col("i0").alias("i1"), F.col("i1").alias("i2"), "v"), small=True, shapes=([_rows(s, d), 8, 8], [1, 8, 8])))
query("matmul_vector", f"SELECT i0, CAST(sum(v * (i1 - 30)) AS BIGINT) AS v FROM {SQL_T} GROUP BY i0")(lambda s, d: T.matmul(vectors(s, d), s.range(64).select(F.col("id").alias("i0"), (F.col("id") - 30).alias("v"))))
query("slice_axes", f"SELECT (i0 - 1) // 2 AS i0, (63 - i1) // 5 AS i1, v FROM {SQL_T} WHERE i0 % 2 = 1 AND (63 - i1) % 5 = 0 AND i1 > 10")(lambda s, d: T.take(vectors(s, d), [_rows(s, d), 64], slice(1, None, 2), slice(None, 10, -5)))
query("slice_ellipsis", f"SELECT i0, i1 - 2 AS i1, v FROM {_SQL_CUBE} WHERE i2 = 5 AND i1 >= 2")(lambda s, d: T.take(_cube(s, d), [_rows(s, d), 8, 8], Ellipsis, slice(2, None), -3))
query("get_index", f"SELECT i2 AS i0, v FROM {_SQL_CUBE} WHERE i0 = 7 AND i1 = 3")(lambda s, d: T.get(_cube(s, d), [_rows(s, d), 8, 8], [7, 3]))
query("gather_axis", f"SELECT i0, x AS i1, y AS i2, v FROM {SQL_T} t JOIN (SELECT x, y, (x * 37 + y * 11) % 64 AS at FROM (SELECT unnest(range(4)) AS x), (SELECT unnest(range(3)) AS y)) w ON t.i1 = w.at")(
    lambda s, d: T.gather(vectors(s, d), s.range(12).select(div(F.col("id"), 3).alias("i0"), (F.col("id") % 3).alias("i1")).withColumn("v", (F.col("i0") * 37 + F.col("i1") * 11) % 64), 1, 64, [4, 3])
)
query("concat_axis", f"SELECT i0, i1, v FROM {SQL_T} UNION ALL SELECT i0, i1 + 64, v * 2 FROM {SQL_T}")(lambda s, d: T.concatenate([(v := vectors(s, d), 64), (v.withColumn("v", F.col("v") * 2), 64)], 1))
query("stack_outer", "SELECT a // 2 AS i0, a % 2 AS i1, i AS i2, CASE a WHEN 0 THEN i WHEN 1 THEN 5 WHEN 2 THEN i * i ELSE -1 END AS v FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(100)) AS i)")(
    lambda s, d: T.stack([(r := s.range(100)).select(F.col("id").alias("i0"), F.col("id").alias("v")), s.range(1).select(F.lit(5).cast("bigint").alias("v")), r.select(F.col("id").alias("i0"), (F.col("id") * F.col("id")).alias("v")), s.range(1).select(F.col("id").alias("i0"), F.lit(-1).cast("bigint").alias("v"))], [2, 2], [[100], [], [100], [1]])
)
_SQL_SEGR = f"(SELECT CAST(0 AS BIGINT) AS i0, g AS i1, g AS v, 0 AS b FROM (SELECT unnest(range(64)) AS g) UNION ALL SELECT i0 + 1, i1, v, CASE WHEN i0 % 5 = 0 THEN 0 ELSE 1 END FROM {SQL_T})"
query("segment_cumsum_rows", f"SELECT i0, i1, CAST(sum(v) OVER (PARTITION BY i1, g ORDER BY i0) AS BIGINT) AS v FROM (SELECT i0, i1, v, sum(1 - b) OVER (PARTITION BY i1 ORDER BY i0) AS g FROM {_SQL_SEGR})")(
    lambda s, d: T.segment_cumsum_rows(vectors(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("i0"), (F.col("vec_id") % 5 != 0).cast("int").alias("v")), s.range(64).select(F.col("id").alias("i0"), F.col("id").alias("v")))
)
query("running_null_partition", f"SELECT pos, CAST(sum(v) OVER (PARTITION BY part ORDER BY pos) AS BIGINT) AS total FROM (SELECT pos, v, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS part FROM {SQL_E})")(
    lambda s, d: O.running(events(s, d).select("pos", "v", F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3).alias("part")), "pos", {"total": F.col("v")}, partition=["part"]).select("pos", F.col("total").cast("bigint").alias("total"))
)
query("sort_unsigned", f"SELECT event_id, row_number() OVER (ORDER BY k + CASE WHEN k < 0 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END, pos) - 1 AS pos FROM (SELECT event_id, pos, (v - 5000)::HUGEINT AS k FROM {SQL_E})")(
    lambda s, d: O.stable_sort(events(s, d).withColumn("k", F.col("v") - 5000), "k", "pos", kind=S.U64).select("event_id", "pos")
)
query("sort_bits_wide", f"SELECT event_id, row_number() OVER (ORDER BY reverse(right(concat(repeat('0', 40), bin(user_id)), 40)), reverse(right(concat(repeat('0', 40), bin(event_id)), 40)), pos) - 1 AS pos FROM {SQL_E}")(
    lambda s, d: O.sort_by_bits(events(s, d).withColumn("b", F.concat(*(F.slice(B.a2b(F.col(c), S.I64).array(), 1, 40) for c in ("user_id", "event_id")))), "b", "pos", 80).select("event_id", "pos")
)


@query("padded_join_last", f"SELECT c_custkey, bal, o_orderkey FROM {SQL_A} a JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) b ON c_custkey = o_custkey")
def padded_join_last(s, d):
    """Of valid right rows with one key the one in the last slot is joined; the result has the left side's slots."""
    left = to_padded(table(s, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("bal")), F.col("bal") >= 0, F.col("c_custkey"))
    right = to_padded(table(s, d, "orders").select("o_custkey", "o_orderkey"), F.lit(1), F.col("o_orderkey"))
    return to_compact(J.padded_join(left, right, "inner", _KEYS)).select("c_custkey", "bal", "o_orderkey")


def _sql_halves(e: str, name: str) -> str:
    m = "18446744073709551616::HUGEINT"
    low = f"(((({e}) % {m}) + {m}) % {m})"
    return f"CAST((({e}) - {low}) // {m} AS BIGINT) AS {name}_hi, {sql_wrap(e)} AS {name}_lo"


def _wide_pair(s: SparkSession, d: str, divided: bool = False) -> DataFrame:
    """a, b and a / 2^60 in columns of their own, so that they stay in generated code; if asked for, q and r of a / b too."""
    df = L.with_halves(numbers(s, d), square=L.product64(x(), x()))
    df = L.with_halves(df, a=L.product(L.named("square"), L.from_signed(y())), b=L.from_signed(y() * 7 + 3))
    df = L.with_halves(df, cut=L.truncate(L.named("a"), 1 << 60))
    return L.with_floor_parts(df, "a", "b", "q", "r") if divided else df


_WIDE = {"sum": L.add, "difference": L.subtract, "product": lambda a, b: L.product(L.named("cut"), b), "q": lambda a, b: L.named("q"), "r": lambda a, b: L.named("r"), "bits": lambda a, b: L.from_bits(L.bits(a))}
_WA, _WB = "x::HUGEINT * x * y", "(y * 7 + 3)::HUGEINT"
_OFF = f"(({_WA}) % {_WB} <> 0 AND (({_WA}) < 0) <> ({_WB} < 0))"
_SQL_WIDE = {"sum": f"{_WA} + {_WB}", "difference": f"{_WA} - {_WB}", "product": f"(({_WA}) // 1152921504606846976) * {_WB}", "q": f"({_WA}) // {_WB} - CASE WHEN {_OFF} THEN 1 ELSE 0 END", "r": f"({_WA}) % {_WB} + CASE WHEN {_OFF} THEN {_WB} ELSE 0::HUGEINT END", "bits": _WA}
for _names in (("sum", "difference", "bits"), ("product",), ("q", "r")):
    query(f"wide_{_names[0]}", f"SELECT o_orderkey, {', '.join(_sql_halves(_SQL_WIDE[n], n) for n in _names)} FROM {SQL_O}")(
        lambda s, d, names=_names: _wide_pair(s, d, "q" in names).select("o_orderkey", *(_WIDE[n](L.named("a"), L.named("b"))[h].alias(f"{n}_{h}") for n in names for h in ("hi", "lo")))
    )
query("wide_compare", f"SELECT o_orderkey, CAST({_WA} < {_WB} * 1000000000000 AS INTEGER) AS less, CAST({_WA} = {_WB} AS INTEGER) AS equal FROM {SQL_O}")(
    lambda s, d: _wide_pair(s, d).select("o_orderkey", L.less(L.named("a"), L.product(L.named("b"), L.literal(10**12))).cast("int").alias("less"), L.equal(L.named("a"), L.named("b")).cast("int").alias("equal"))
)

scalar_query("cumulative_or", {"bits": lambda: F.array_join(B.cumulative_or(F.slice(B.a2b(key(), S.I64).array(), 1, 8)).cast("array<string>"), "")}, {"bits": "array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN (o_orderkey & 255) >> i > 0 THEN 1 ELSE 0 END), '')"})
scalar_query("reduce_mul", {"every": lambda: B.reduce_mul(F.slice(B.a2b(key(), S.I64).array(), 1, 3)).cast("int")}, {"every": "CAST(o_orderkey % 8 = 7 AS INTEGER)"})
scalar_query("precise_divide", {"close": lambda: (F.abs(X.precise_divide(F.abs(y()), _small()) - div_columns(F.abs(y()), _small())) <= 1).cast("int")}, {"close": "1"})
query("sort_128", f"SELECT event_id, row_number() OVER (ORDER BY (v - 5000)::HUGEINT * 1000000000000000000000 + user_id, pos) - 1 AS pos FROM {SQL_E}")(
    lambda s, d: O.sort_wide(events(s, d).withColumn("k", L.add(L.multiply(L.from_signed(F.col("v") - 5000), L.literal(10**21)), L.from_signed(F.col("user_id")))), "k", "pos").select("event_id", "pos")
)
_FAR = sql_wrap("x::HUGEINT * 3000000019")
scalar_query("bin_add_64", {"total": lambda: B.binary_add(S.mul64(x(), F.lit(3000000019)), y(), S.U64)[0], "carry": lambda: B.binary_add(S.mul64(x(), F.lit(3000000019)), y(), S.U64)[1].cast("int")}, {"total": sql_wrap(f"({_FAR})::HUGEINT + y"), "carry": f"CAST({_U.format(f'({_FAR})')} + {_U.format('y')} >= 18446744073709551616::HUGEINT AS INTEGER)"})
scalar_query("longdiv_unsigned", {"q": lambda: X.floor_divide(y(), key() % 11 + 1, S.U64)[0], "r": lambda: X.floor_divide(y(), key() % 11 + 1, S.U64)[1]}, {"q": sql_wrap(f"{_U.format('y')} // (o_orderkey % 11 + 1)"), "r": f"CAST({_U.format('y')} % (o_orderkey % 11 + 1) AS BIGINT)"})


@query("library_operations", f"SELECT o_orderkey, least(y, o_orderkey * 1000) AS least, CAST(y > o_orderkey * 1000 AS INTEGER) AS more, y // 8 AS eighth, least(greatest(y, 0), 1048576) AS clipped FROM {SQL_O}")
def library_operations(s, d):
    """Operations taken from the registry by name and kinds."""
    ops, other = Library(), key() * 1000
    return numbers(s, d).select("o_orderkey", ops.instance("min", "i64", "i64")(y(), other).alias("least"), ops.instance("greater", "i64", "i64")(y(), other).cast("int").alias("more"), ops.instance("truncate(scale=8)", "i64")(y()).alias("eighth"), ops.instance("clip_2k(k=20)", "i64")(y()).alias("clipped"))


@query("typed_operators", f"SELECT o_orderkey, {sql_wrap('x::HUGEINT * y - x')} AS v, CAST(x <> y AS INTEGER) AS differs, CAST({_U.format('x')} < {_U.format('y')} AS INTEGER) AS below, {sql_wrap('x::HUGEINT * y + y::HUGEINT * x')} AS dot, greatest(x, y) AS most FROM {SQL_O}")
def typed_operators(s, d):
    """Python's operators on columns that carry their kind."""
    a, b = Typed(x(), S.I64), Typed(y(), S.I64)
    v, w = Typed(F.array(x(), y()), S.I64, 2), Typed(F.array(y(), x()), S.I64, 2)
    return numbers(s, d).select("o_orderkey", (a * b - a).column.alias("v"), (a != b).column.cast("int").alias("differs"), (Typed(x(), S.U64) < Typed(y(), S.U64)).column.cast("int").alias("below"), (v @ w).column.alias("dot"), v[0].max(v[1]).column.alias("most"))


query("regroup", f"SELECT o_orderkey, x AS a, y AS b, concat(o_orderkey, ',', x + 1) AS c FROM {SQL_O}")(
    lambda s, d: numbers(s, d).select("o_orderkey", V.reshape(F.array(F.array(x(), y()), F.array(key(), x() + 1)), [2, [2, "i64"]], ("i64", "i64", [2, "i64"])).alias("t")).select("o_orderkey", V.tuple_get(F.col("t"), 0).alias("a"), V.tuple_get(F.col("t"), 1).alias("b"), F.array_join(V.tuple_get(F.col("t"), 2).cast("array<string>"), ",").alias("c"))
)


@query("cipher_join", f"SELECT c_custkey, n_orders FROM {SQL_A} a JOIN {SQL_B} b ON c_custkey = o_custkey")
def cipher_join(s, d):
    """A join of keyed images of the keys: equal keys, and only they, have equal images."""
    left, right = (E.encrypt(df, k, 0x0123456789ABCDEF0123456789ABCDEF, "image") for df, k in ((customers(s, d).select("c_custkey"), "c_custkey"), (order_totals(s, d).select("o_custkey", "n_orders"), "o_custkey")))
    return left.join(right.select("image", "n_orders"), "image").select("c_custkey", "n_orders")


@query("annotations", f"SELECT o_orderkey, x AS v, 'shared' AS note FROM {SQL_O}")
def annotations(s, d):
    """A column with a note, which is read back from the schema."""
    df = numbers(s, d).select("o_orderkey", I.annotated(x(), "v", status="shared"))
    return df.withColumn("note", F.lit(I.notes_of(df, "v")["status"]))


_SQL_PAD = "SELECT CAST(c_nationkey % 5 AS INTEGER) AS _shard, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1"


def _shard_size(s: SparkSession, d: str) -> int:
    return table(s, d, "customer").groupBy((F.col("c_nationkey") % 5).alias("k")).count().agg(F.max("count")).first()[0] or 1


query("shard_padded", f"SELECT _shard, n, keys, (SELECT max(n) FROM ({_SQL_PAD})) AS slots FROM ({_SQL_PAD})")(
    lambda s, d: H.shards(table(s, d, "customer").select("c_nationkey", "c_custkey"), 5, ["c_nationkey"], _shard_size(s, d), F.col("c_nationkey"), "c_custkey").groupBy("_shard").agg(F.sum(VALID).alias("n"), F.sum("c_custkey").alias("keys"), F.count("*").alias("slots"))
)
query("shard_cell_masks", f"SELECT CAST(c_nationkey % 5 AS INTEGER) AS _shard, count(*) AS n_keys, count(bal) AS n_bal, CAST(coalesce(sum(bal), 0) AS BIGINT) AS bal, (SELECT max(n) FROM ({_SQL_PAD})) AS slots FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS bal FROM customer) GROUP BY 1")(
    lambda s, d: H.shards(table(s, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("bal")), 5, ["c_nationkey"], _shard_size(s, d), F.col("c_nationkey"), "c_custkey", cell_masks=True)
    .groupBy("_shard").agg(F.sum("c_custkey" + VALID).alias("n_keys"), F.sum("bal" + VALID).alias("n_bal"), F.sum("bal").alias("bal"), F.count("*").alias("slots"))
)


@query("json_rows", f"SELECT pos AS _pos, event_id, v FROM {SQL_E}")
def json_rows(s, d):
    """A table written as JSON rows and read again."""
    path = scratch_path(s, "json")
    Y.write_table(events(s, d).select(F.col("pos").alias(POS), "event_id", "v"), path)
    return Y.read_rows(s, path, {"event_id": S.I64, "v": S.I64})


@query("numpy_arrays", "SELECT i0, i1, (i0 * 65537 + i1 * 257) % 65536 AS v FROM (SELECT unnest(range(200)) AS i0), (SELECT unnest(range(30)) AS i1)")
def numpy_arrays(s, d):
    """An array in, out and in again."""
    import numpy as np

    made = ((np.arange(200)[:, None] * 65537 + np.arange(30)[None, :] * 257) % 65536).astype(np.uint16)
    back = N.to_numpy(N.from_numpy(s, made), [200, 30], S.U16)
    return N.from_numpy(s, back).withColumn("v", F.col("v").cast("bigint"))


@query(
    "flagship",
    f"SELECT c_mktsegment, CAST(sum(fx) AS BIGINT) AS total FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0) a JOIN (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 32768) AS BIGINT)) AS BIGINT) AS fx FROM orders GROUP BY o_custkey) b ON c_custkey = o_custkey GROUP BY c_mktsegment",
)
def flagship(s, d):
    """A masked inner join with a fixed-point aggregate."""
    a = table(s, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    b = table(s, d, "orders").groupBy("o_custkey").agg(S.sum_wrapped(X.encode(F.col("o_totalprice"))).alias("fx"))
    return J.join(a, b, "inner", _KEYS).groupBy("c_mktsegment").agg(S.sum_wrapped(F.col("fx")).alias("total"))

