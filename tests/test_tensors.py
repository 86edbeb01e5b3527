"""Tensor operators against NumPy, and what they refuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.functions import containers as V
from maskframe.functions import scalars as S
from maskframe.functions import wide as L
from maskframe.functions.typed import Typed
from maskframe.operators import cipher
from maskframe.operators import hashing as H
from maskframe.operators import iterate as I
from maskframe.operators import joins as J
from maskframe.operators import order as O
from maskframe.operators import scratch
from maskframe.operators import tensor as T
from maskframe.operators.table import POS, VALID
from maskframe.plans import catalogue, graphs, inspect
from maskframe.plans.library import Library
from maskframe.sources import numpy_io as N
from maskframe.sources import typed_json as Y

RNG = np.random.default_rng(11)


def tensor(spark, a):
    return N.from_numpy(spark, np.asarray(a, np.int64))


def array(df, shape):
    return N.to_numpy(df, list(shape), S.I64)


@pytest.mark.parametrize("left,right", [((2, 3), (1, 3)), ((2, 3), (2, 1)), ((2, 1), (1, 3)), ((3,), (2, 3)), ((2, 3), (3,)), ((4, 1, 3), (2, 3)), ((1,), (2, 2)), ((2, 3), (2, 3))])
@pytest.mark.parametrize("given", [True, False])
def test_broadcasting(spark, left, right, given):
    a, b = RNG.integers(-9, 9, left), RNG.integers(-9, 9, right)
    want = a - b
    got = T.elementwise(tensor(spark, a), tensor(spark, b), S.subtract, shapes=(list(left), list(right)) if given else None)
    assert (array(got, want.shape) == want).all() and got.count() == want.size


def test_shapes_that_do_not_match(spark):
    a, b = tensor(spark, np.ones((2, 3))), tensor(spark, np.ones((2, 2)))
    for f in (lambda: T.elementwise(a, b, S.add), lambda: T.broadcast_to(a, [2, 3], [3, 3]), lambda: T.stack([a, b], None, [[2, 3], [2, 2]]), lambda: T.stack([a, a], [3])):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("left,right", [((2, 3), (3, 4)), ((3,), (3, 4)), ((2, 3), (3,)), ((3,), (3,)), ((5, 2, 3), (5, 3, 4)), ((5, 2, 3), (3, 4)), ((1, 2, 3), (5, 3, 4)), ((4, 1, 2, 3), (5, 3, 2))])
def test_matmul(spark, left, right):
    a, b = RNG.integers(-9, 9, left), RNG.integers(-9, 9, right)
    want = np.matmul(a, b)
    assert (array(T.matmul(tensor(spark, a), tensor(spark, b), shapes=(list(left), list(right))), want.shape) == want).all()


@pytest.mark.parametrize("left,right", [((2, 3), (3, 4)), ((2, 3), (3,)), ((3,), (3,)), ((2, 5, 3), (4, 3, 2)), ((), (2, 2)), ((2, 2), ()), ((3,), (3, 2))])
def test_dot(spark, left, right):
    a, b = RNG.integers(-9, 9, left), RNG.integers(-9, 9, right)
    want = np.dot(a, b)
    assert (array(T.dot_product(tensor(spark, a), tensor(spark, b)), want.shape) == want).all()


def test_products_refuse(spark):
    one, row = tensor(spark, 3), tensor(spark, [1, 2])
    for f in (lambda: T.matmul(one, row), lambda: T.gemm(row, row)):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("index", [(slice(None, None, -1),), (1,), (-1, slice(1, 3)), (Ellipsis, 0), (slice(0, 2), Ellipsis, slice(None, None, -2)), (0, 1, 2), (slice(-2, None), slice(None), slice(3, 0, -2))])
def test_indexing(spark, index):
    a = RNG.integers(-9, 9, (3, 4, 5))
    want = a[index]
    assert (array(T.take(tensor(spark, a), [3, 4, 5], *index), want.shape) == want).all()


@pytest.mark.parametrize("index,error", [((3,), IndexError), ((slice(0, 9),), IndexError), ((slice(2, 2),), ValueError), ((Ellipsis, Ellipsis), ValueError), ((0, 0, 0, 0), ValueError)])
def test_indexing_refuses(spark, index, error):
    with pytest.raises(error):
        T.take(tensor(spark, np.ones((3, 4, 5))), [3, 4, 5], *index)


def test_get_and_rows(spark):
    a = RNG.integers(-9, 9, (3, 4))
    assert array(T.get(tensor(spark, a), [3, 4], [2, 1]), ()) == a[2, 1]
    with pytest.raises(IndexError):
        T.get(tensor(spark, a), [3, 4], [3])
    table = spark.createDataFrame([(0, 5), (1, 6)], f"{POS} bigint, x bigint")
    assert [r["x"] for r in O.get_row(table, 1).collect()] == [6]
    with pytest.raises(Exception, match="out of range"):
        O.get_row(table, 2).collect()


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_gather_and_concatenate_on_any_axis(spark, axis):
    a = RNG.integers(-9, 9, (3, 4, 5))
    at = np.array([[2, 0], [1, 1]])[: 1 if axis == 0 else 2]
    want = np.take(a, at, axis)
    assert (array(T.gather(tensor(spark, a), tensor(spark, at), axis, a.shape[axis], list(at.shape)), want.shape) == want).all()
    both = np.concatenate([a, 2 * a], axis)
    assert (array(T.concatenate([(tensor(spark, a), a.shape[axis]), (tensor(spark, 2 * a), a.shape[axis])], axis), both.shape) == both).all()


def test_gather_refuses(spark):
    a = tensor(spark, [1, 2, 3])
    with pytest.raises(ValueError):
        T.gather(a, tensor(spark, [0, 0, 0, 0]), 0, 3, [4])
    with pytest.raises(Exception, match="out of range"):
        T.gather(a, tensor(spark, [5]), 0, 3, [1]).collect()
    with pytest.raises(ValueError):
        T.concatenate([(a, 3)])


def test_stack_with_an_outer_shape(spark):
    a, b = RNG.integers(-9, 9, (2, 3)), RNG.integers(-9, 9, (3,))
    want = np.stack([a, np.broadcast_to(b, (2, 3)), -a, np.full((2, 3), 7)]).reshape(2, 2, 2, 3)
    got = T.stack([tensor(spark, a), tensor(spark, b), tensor(spark, -a), tensor(spark, 7)], [2, 2], [[2, 3], [3], [2, 3], []])
    assert (array(got, want.shape) == want).all()


def test_segments_of_rows_with_several_cells(spark):
    a, bits, first = RNG.integers(-9, 9, (30, 2, 3)), RNG.integers(0, 2, 30), RNG.integers(-9, 9, (2, 3))
    want = [first]
    for x, b in zip(a, bits):
        want.append(x + b * want[-1])
    got = T.segment_cumsum_rows(tensor(spark, a), tensor(spark, bits), tensor(spark, first))
    assert (array(got, (31, 2, 3)) == np.array(want)).all()


@pytest.mark.parametrize("buckets", [1, 2, 5, 16])
def test_running_since_over_buckets(spark, buckets):
    rows = [(i, int(RNG.integers(-9, 9)), bool(RNG.integers(0, 8) == 0), None if i % 3 else i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, v bigint, b boolean, p int").repartition(4)
    got = {r["i"]: int(r["s"]) for r in O.running_since(df, "i", F.col("v"), F.col("b"), "s", ["p"], buckets).collect()}
    state, want = {}, {}
    for i, v, b, p in rows:
        state[p] = v if b else state.get(p, 0) + v
        want[i] = state[p]
    assert got == want


def test_null_partitions_keep_their_rows(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 2, 1), (2, 4, None)], "i bigint, v bigint, p int")
    assert sorted((r["i"], int(r["t"])) for r in O.running(df, "i", {"t": F.col("v")}, partition=["p"]).collect()) == [(0, 1), (1, 2), (2, 5)]


def test_null_keys_come_first_and_heavy_keys_are_split(spark):
    rows = [(i, None if i % 10 == 0 else 7 if i % 2 else i) for i in range(500)]
    df = spark.createDataFrame(rows, f"{POS} bigint, k bigint").repartition(3)
    got = {r["k"]: r[POS] for r in O.stable_sort(df.withColumn("o", F.col(POS)), "k").select(F.col("o").alias("k"), POS).collect()}
    want = sorted(range(500), key=lambda i: (rows[i][1] is not None, rows[i][1] or 0, i))
    assert [o for o, _ in sorted(got.items(), key=lambda x: x[1])] == want


def test_unsigned_and_wide_sort_keys(spark):
    df = spark.createDataFrame([(0, -1), (1, 5)], f"{POS} bigint, k bigint")
    assert [r["k"] for r in O.stable_sort(df, "k", kind=S.U64).orderBy(POS).collect()] == [5, -1]
    keys = [[int(x) for x in RNG.integers(0, 2, 150)] for _ in range(20)] * 2
    df = spark.createDataFrame(list(enumerate(keys)), f"{POS} bigint, b array<int>").withColumn("o", F.col(POS))
    assert [r["o"] for r in O.sort_by_bits(df, "b").orderBy(POS).collect()] == sorted(range(40), key=lambda i: (keys[i], i))
    with pytest.raises(Exception, match="width"):
        O.sort_by_bits(spark.createDataFrame([(0, [1]), (1, [1, 0])], f"{POS} bigint, b array<int>"), "b").collect()


def test_last_duplicate_of_a_padded_join(spark):
    left = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 6, 2)], f"{VALID} int, {POS} bigint, k bigint, x bigint")
    right = spark.createDataFrame([(1, 0, 5, 10), (1, 1, 5, 20), (0, 2, 5, 30)], f"{VALID} int, {POS} bigint, k2 bigint, y bigint")
    for kind, n in (("inner", 2), ("left", 2), ("union", 5), ("full", 5)):
        rows = {r[POS]: r for r in J.padded_join(left, right, kind, {"k": "k2"}).collect()}
        assert sorted(rows) == list(range(n))
        if n == 2:
            assert (rows[0]["y"], rows[1]["y"]) == (20, 0)


INTS = [0, 1, -1, 5, -7, 1 << 63, (1 << 64) - 1, 1 << 64, -(1 << 64), (1 << 127) - 1, -(1 << 127), 123456789 << 50, -(987654321 << 70)]


def _whole(hi, lo, signed=True):
    x = (hi % (1 << 64)) << 64 | lo % (1 << 64)
    return x - (1 << 128) if signed and x >= 1 << 127 else x


def _wrap(x):
    return (x + (1 << 127)) % (1 << 128) - (1 << 127)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_128_bits(spark, ansi):
    half = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    rows = [(half(a >> 64 & (1 << 64) - 1), half(a & (1 << 64) - 1), half(b >> 64 & (1 << 64) - 1), half(b & (1 << 64) - 1)) for a in INTS for b in INTS]
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint").select("*", L.wide(F.col("a"), F.col("b")).alias("x"), L.wide(F.col("c"), F.col("d")).alias("y"))
        x, y = F.col("x"), F.col("y")
        d, u = L.floor_divide(x, y), L.floor_divide(x, y, L.U128)
        made = {"add": L.add(x, y), "sub": L.subtract(x, y), "mul": L.multiply(x, y), "q": d["q"], "r": d["r"], "uq": u["q"], "ur": u["r"], "t": L.truncate(x, 1000), "bits": L.from_bits(L.bits(x))}
        got = df.select("a", "b", "c", "d", L.less(x, y).alias("less"), L.less(x, y, L.U128).alias("uless"), *(c.alias(n) for n, c in made.items())).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    for r in got:
        p, q = _whole(r["a"], r["b"]), _whole(r["c"], r["d"])
        up, uq = p % (1 << 128), q % (1 << 128)
        value = {n: _whole(r[n]["hi"], r[n]["lo"]) for n in made}
        assert (value["add"], value["sub"], value["mul"], value["bits"]) == (_wrap(p + q), _wrap(p - q), _wrap(p * q), p)
        assert (r["less"], r["uless"]) == (p < q, up < uq)
        assert (value["q"], value["r"]) == ((_wrap(p // q), p % q) if q else (0, p))
        assert (value["uq"] % (1 << 128), value["ur"] % (1 << 128)) == ((up // uq, up % uq) if uq else (0, up))
        assert value["t"] == abs(p) // 1000 * (1 if p >= 0 else -1)


@pytest.mark.parametrize("signed", [True, False])
def test_sort_of_128_bits(spark, signed):
    half = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    rows = [(i, half(x >> 64 & (1 << 64) - 1), half(x & (1 << 64) - 1)) for i, x in enumerate(INTS * 2)]
    df = spark.createDataFrame(rows, f"{POS} bigint, hi bigint, lo bigint").select(POS, L.wide(F.col("hi"), F.col("lo")).alias("k"), F.col(POS).alias("o"))
    want = sorted(range(len(rows)), key=lambda i: ((INTS * 2)[i] if signed else (INTS * 2)[i] % (1 << 128), i))
    assert [r["o"] for r in O.sort_wide(df, "k", signed=signed).orderBy(POS).collect()] == want


def test_vector_get_of_any_type(spark):
    df = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    assert df.select(V.vector_get(F.col("v"), 1)).first()[0] == "b"
    with pytest.raises(Exception, match="out of range"):
        df.select(V.vector_get(F.col("v"), 2)).collect()


def test_regrouping(spark):
    df = spark.range(1).select(F.array(*(F.lit(i) for i in range(6))).alias("v"))
    old, new = [6, "i32"], ([2, "i32"], {"a": "i32", "b": ("i32", [2, "i32"])})
    r = df.select(V.reshape(F.col("v"), old, new).alias("t")).select(V.reshape(F.col("t"), new, [3, [2, "i32"]]).alias("w"), "t").first()
    assert r["w"] == [[0, 1], [2, 3], [4, 5]] and r["t"]["_1"]["b"]["_1"] == [4, 5]
    with pytest.raises(ValueError):
        V.reshape(F.col("v"), old, [5, "i32"])


def test_typed_columns(spark):
    df = spark.createDataFrame([(250, 10, [1, 2, 3])], "a smallint, b smallint, v array<int>")
    a, b, v = Typed(F.col("a"), S.U8), Typed(F.col("b"), S.U8), Typed(F.col("v"), S.I32, 3)
    r = df.select(*(t.column.alias(f"c{i}") for i, t in enumerate([a + b, a - b, b - a, a * b, a > b, a != b, a == 250, a.min(b), v[1], v @ v, v + 1]))).first()
    assert list(r) == [4, 240, 16, 196, 1, 1, 1, 10, 2, 14, [2, 3, 4]]
    with pytest.raises(TypeError):
        a + Typed(F.col("b"), S.I8)
    with pytest.raises(IndexError):
        v[3]


def test_library(spark):
    ops = Library()
    assert ops.instance("add", "i64", "i64") is ops.instance("add", "i64", "i64")
    with pytest.raises(TypeError):
        ops.instance("add", "i64", "i32")
    with pytest.raises(KeyError):
        ops.instance("nothing", "i64")
    x = F.lit(1000).cast("bigint")
    r = spark.range(1).select(ops.instance("clip_2k(k=5)", "i64")(x).alias("c"), ops.instance("approximate_sigmoid", "i64")(x).alias("s"), ops.instance("long_division", "u64", "u64")(x, F.lit(7).cast("bigint"))[0].alias("q")).first()
    assert (r["c"], r["q"]) == (32, 142)


def test_numpy_files_and_tables(spark, tmp_path):
    a = RNG.integers(0, 1 << 63, (7, 3), dtype=np.uint64) * np.uint64(2)
    for first in (0, 4):
        np.save(tmp_path / f"{first}.npy", a[first : first + 4])
    assert (N.to_numpy(N.read_npy(spark, str(tmp_path), S.U64, 2), [7, 3], S.U64) == a).all()
    table = N.table_from_numpy(spark, {"k": np.arange(3, dtype=np.uint8), "m": np.ones((3, 2), bool)})
    assert [(r["k"], r["m"]) for r in table.orderBy(POS).collect()] == [(i, [1, 1]) for i in range(3)]
    with pytest.raises(TypeError):
        N.from_numpy(spark, np.ones(2))
    with pytest.raises(ValueError):
        N.to_numpy(spark.range(1), [1 << 20, 1 << 20], S.I64)


def test_json_rows(spark, tmp_path):
    df = spark.createDataFrame([(0, 3, [[1, 2]]), (1, None, None)], f"{POS} bigint, a int, m array<array<int>>")
    Y.write_table(df, str(tmp_path / "t"))
    got = Y.read_rows(spark, str(tmp_path / "t"), {"a": S.I32, "m": S.I32}, {"m": 2})
    assert [tuple(r) for r in got.orderBy(POS).collect()] == [(0, 3, [[1, 2]]), (1, None, None)]


def test_random_values_of_types(spark):
    of = {"a": S.U8, "b": [2, (S.BIT, S.I16)]}
    pick = lambda seed: [tuple(r) for r in spark.range(50).select(H.random_value(seed, F.col("id"), of).alias("r")).select("r.*").collect()]
    assert pick(1) == pick(1) != pick(2)
    assert all(0 <= a < 256 and all(t[0] in (0, 1) and -(1 << 15) <= t[1] < 1 << 15 for t in b) for a, b in pick(1))


def test_shards_with_cell_masks(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i) for i in range(5)], "k bigint, x bigint")
    rows = H.shards(df, 2, ["k"], 4, F.col("k"), "k", cell_masks=True).collect()
    assert len(rows) == 8 and VALID not in rows[0].asDict()
    assert sum(r["k" + VALID] for r in rows) == 5 and sum(r["x" + VALID] for r in rows) == 4
    with pytest.raises(ValueError):
        H.shards(df, 2, ["k", "k"])


def test_scratch_tables_belong_to_scopes(spark):
    import os

    with scratch.scope() as outer:
        with scratch.scope() as inner:
            df = scratch.materialise(spark.range(5), "scratch-test")
        scratch.materialise(spark.range(2), "scratch-test")
    assert len(inner) == 1 and len(outer) == 2 and df.count() == 5
    scratch.drop(inner)
    assert [os.path.exists(p) for p in outer] == [False, True]
    scratch.drop(outer)
    assert not os.path.exists(outer[1])
    assert "BroadcastHashJoin" in df.sparkSession.range(9).join(scratch.sized(spark.range(3)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in spark.range(9).join(scratch.sized(spark.range(3), 2), "id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block,boxes,rounds", [(128, 10, 20), (128, 42, 11), (80, 5, 3)])
def test_lowmc(block, boxes, rounds):
    """Against a bit-by-bit reading of the published rounds, and back."""
    c = cipher.LowMC(boxes, rounds, block, 5)
    key, x = 0xFEDCBA98765432100123456789ABCDEF, RNG.integers(0, 2, (6, block), dtype=np.uint8)
    got = c.encrypt_bits(x, key)
    assert (c.decrypt_bits(got.copy(), key) == x).all() and len({r.tobytes() for r in got}) == 6
    keys = [[sum(int(c.key_matrices[r][i][j]) & key >> i & 1 for i in range(128)) % 2 for j in range(block)] for r in range(rounds + 1)]
    for row, want in zip(x[:2], got):
        s = [int(b) ^ k for b, k in zip(row, keys[0])]
        for r in range(rounds):
            for t in range(0, 3 * boxes, 3):
                p, q, u = s[t : t + 3]
                s[t : t + 3] = p ^ q & u, p ^ q ^ p & u, p ^ q ^ u ^ p & q
            s = [(sum(int(m) & b for m, b in zip(line, s)) + int(k) + e) % 2 for line, k, e in zip(c.linear[r], c.constants[r], keys[r + 1])]
        assert s == want.tolist()
    with pytest.raises(ValueError):
        cipher.LowMC(50)


def test_images_of_keys(spark):
    df = spark.createDataFrame([(5, "a"), (None, "b"), (5, "c"), (-6, "d")], "k int, n string")
    r = {x["n"]: x["i"] for x in cipher.encrypt(df, "k", 7, "i").collect()}
    assert r["b"] is None and r["a"] == r["c"] != r["d"] and len(r["a"]) == 16


def test_notes_and_plans(spark):
    df = spark.range(20).select(I.annotated(F.col("id"), "v", owner="party 1"), (F.col("id") % 3).alias("k"))
    assert I.notes_of(df, "v") == {"owner": "party 1"}
    joined = df.groupBy("k").agg(F.sum("v").alias("t")).join(spark.range(3).withColumnRenamed("id", "k").hint("merge"), "k")
    facts = inspect.summary(joined)
    assert facts["exchanges"] >= 2 and facts["joins"] == 1 and facts["python"] == 0
    dot = graphs.to_dot(joined)
    assert dot.startswith("digraph plan {") and dot.count("->") >= 4
    assert inspect.propagate("matmul", ["shared", "public"]) == "shared" and inspect.propagate("anything", ["public"]) == "public"
    for f in (lambda: inspect.propagate("vector_get", ["shared", "shared"]), lambda: inspect.propagate("sum_of_squares", ["shared"])):
        with pytest.raises(ValueError):
            f()


@pytest.fixture(scope="module")
def late_orders(spark, tmp_path_factory):
    """Orders with keys as larger tables have them, and the x and y of the catalogue's numbers."""
    d = str(tmp_path_factory.mktemp("orders"))
    keys = [0, 1, 74_700, 810_001, 899_999, 7_470_000, 8_999_999, 53_999_999]
    given = [(k, 1000.25 + 54321.5 * (i % 3) + 200_000 * (i % 2)) for i, k in enumerate(keys)]
    spark.createDataFrame(given, "o_orderkey bigint, o_totalprice double").coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d, {k: (k * 1234567891, round(p * 100) - 20_000_000) for k, p in given}


def _wrap64(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def test_add_wrap_of_large_keys(spark, late_orders):
    d, numbers = late_orders
    got = {r["o_orderkey"]: r["v64"] for r in catalogue.QUERIES["add_wrap"](spark, d).collect()}
    assert got == {k: _wrap64(2 * x + 9223372036850000000 - 10**15) for k, (x, _) in numbers.items()}


def test_sub_wrap_of_large_keys(spark, late_orders):
    d, numbers = late_orders
    got = {r["o_orderkey"]: r["v64"] for r in catalogue.QUERIES["sub_wrap"](spark, d).collect()}
    assert got == {k: _wrap64(-x - (9223372036850000000 - 10**15) - 100 * x) for k, (x, _) in numbers.items()}


def test_sum_wrapped_of_large_keys(spark, late_orders):
    d, numbers = late_orders
    assert catalogue.QUERIES["sum_wrapped"](spark, d).first()["v"] == _wrap64(sum(1000 * x for x, _ in numbers.values()))


def test_wide_product_is_compiled(spark, late_orders):
    """Right for values of all sizes, and without lambdas, which Spark interprets."""
    d, numbers = late_orders
    df = catalogue.QUERIES["wide_product"](spark, d)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "aggregate(" not in plan
    for r in df.collect():
        x, y = numbers[r["o_orderkey"]]
        a = _wrap(x * x * y)
        assert _whole(r["product_hi"], r["product_lo"]) == _wrap(abs(a) // (1 << 60) * (-1 if a < 0 else 1) * (y * 7 + 3))


@pytest.mark.parametrize("k", [0, 1, 63, 64, 65, 127])
def test_wide_truncation_by_a_power_of_two(spark, k):
    df = spark.range(len(INTS)).coalesce(1)
    x = F.element_at(F.array(*(L.literal(v) for v in INTS)), (F.col("id") + 1).cast("int"))
    for r in df.select("id", L.truncate(x, 1 << k).alias("t"), L.truncate(x, 1 << k, L.U128).alias("u")).collect():
        v = INTS[r["id"]]
        assert _whole(r["t"]["hi"], r["t"]["lo"]) == abs(v) // (1 << k) * (-1 if v < 0 else 1)
        assert _whole(r["u"]["hi"], r["u"]["lo"]) % (1 << 128) == v % (1 << 128) >> k


def test_floor_parts_in_columns(spark):
    """Divisors of all sizes and signs, 0, and -2^127 by -1, as `floor_divide` has them; nulls give nulls."""
    half = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    split = lambda v: (half(v >> 64 & (1 << 64) - 1), half(v & (1 << 64) - 1))
    divisors = [0, 1, -1, 5, -7, (1 << 46) - 1, 1 - (1 << 46), 1 << 46, -(1 << 46), 123456789 << 50, -(1 << 127)]
    rows = [(*split(a), *split(b)) for a in INTS for b in divisors] + [(None, None, 0, 5), (0, 5, None, None)]
    df = spark.createDataFrame(rows, "a_hi bigint, a_lo bigint, b_hi bigint, b_lo bigint")
    for r in L.with_floor_parts(df, "a", "b", "q", "r").collect():
        if r["a_lo"] is None or r["b_lo"] is None:
            assert (r["q_lo"], r["r_lo"]) == (None, None)
            continue
        a, b = _whole(r["a_hi"], r["a_lo"]), _whole(r["b_hi"], r["b_lo"])
        assert (_whole(r["q_hi"], r["q_lo"]), _whole(r["r_hi"], r["r_lo"])) == ((_wrap(a // b), a % b) if b else (0, a))
