"""Order and indexing over rows with a `_pos` column.

Numbering and running sums never gather all rows in one task: rows fall into buckets between approximate
quantiles of the order key, each bucket is numbered by itself, and the buckets' totals, one row each, are
summed and joined back. A key that holds a whole quantile has a bucket of its own, split by place. Buckets
depend on values only, so a repeated task deals its rows out as before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import I64, U64, Kind, flip
from .scratch import materialise
from .table import POS

#: Buckets, unless a caller says otherwise: the session's shuffle partitions between these.
FEWEST, MOST = 16, 4096
#: Up to so many buckets their totals are broadcast: at most as many rows as the square of the buckets.
BROADCAST_BUCKETS = 512
#: Bits of a sort key that one pass takes.
PASS_BITS = 62


def bucket_count(df: DataFrame) -> int:
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), FEWEST), MOST)


def _bounds(df: DataFrame, key: Column, buckets: int) -> tuple[list, bool]:
    """Distinct quantiles in order, and whether some value is more than one of them."""
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return [], False
    row = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), 10 * buckets).alias("b")).first()
    found = row["b"] or []
    return sorted(set(found)), len(set(found)) < len(found)


def _bucket(df: DataFrame, bounds: list, key: str, name: str) -> DataFrame:
    """df with twice the number of bounds below the key, plus one if it is a bound: a bound's own bucket has one key.

    The bounds are a search tree in an array, walked a level a column: each level is a line of generated code."""
    if not bounds:
        return df.withColumn(name, F.when(F.col(key).isNull(), F.lit(-2)).otherwise(F.lit(0)))
    depth = len(bounds).bit_length()
    size = (1 << depth) - 1
    padded, tree = [*bounds, *[None] * (size - len(bounds))], [None] * size

    def fill(node: int, low: int, high: int) -> None:
        middle = (low + high) // 2
        tree[node] = padded[middle]
        if low < high:
            fill(2 * node + 1, low, middle - 1)
            fill(2 * node + 2, middle + 1, high)

    fill(0, 0, size - 1)
    kind = df.schema[key].dataType.simpleString()
    array = lambda values: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    nodes, at = array(tree), "_node"
    out = df.withColumn(at, F.coalesce((F.lit(tree[0]).cast(kind) < F.col(key)).cast("int"), F.lit(0)) + 1)
    for _ in range(depth - 1):
        out = out.withColumn(at, 2 * F.col(at) + 1 + F.coalesce((F.get(nodes, F.col(at)) < F.col(key)).cast("int"), F.lit(0)))
    below = F.col(at) - size
    own = F.coalesce((F.get(array([*bounds, None]), below) == F.col(key)).cast("int"), F.lit(0))
    return out.withColumn(name, F.when(F.col(key).isNull(), F.lit(-2)).otherwise(2 * below + own)).drop(at)


def bucketed(df: DataFrame, key: str, pos: str | None, buckets: int | None = None) -> DataFrame:
    """df with `_b1` and `_b2`, whose order is that of (key, pos)."""
    buckets = buckets or bucket_count(df)
    bounds, heavy = _bounds(df, F.col(key), buckets)
    rows = _bucket(df, bounds, key, "_b1")
    if pos is None or pos == key or not heavy:
        return rows.withColumn("_b2", F.lit(0))
    return _bucket(rows, _bounds(df, F.col(pos), buckets)[0], pos, "_b2").withColumn("_b2", F.when(F.col("_b1") % 2 == 1, F.col("_b2")).otherwise(F.lit(0)))


def _with_totals(rows: DataFrame, totals: DataFrame, own: list[str], buckets: int) -> DataFrame:
    """rows with the columns of their bucket's totals; partition columns may be NULL."""
    names = {c: f"_of_{i}" for i, c in enumerate([*own, "_b1", "_b2"])}
    few = totals.select(*(F.col(c).alias(n) for c, n in names.items()), *(c for c in totals.columns if c not in names))
    match = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(n)) if c in own else F.col(c) == F.col(n) for c, n in names.items()))
    return rows.join(F.broadcast(few) if not own and buckets <= BROADCAST_BUCKETS else few, match).drop(*names.values())


def _order_keys(order: str, pos: str | None) -> list[str]:
    return [order] if pos is None or pos == order else [order, pos]


def running(df: DataFrame, order: str, values: dict[str, Column], pos: str | None = None, partition: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """df with inclusive running sums (name: value) in the order of (order, pos); by partition columns if given, NULL being one partition.

    Sums are exact decimals, to be wrapped by the caller."""
    own, buckets = partition or [], buckets or bucket_count(df)
    wide = {f"_v_{n}": v.cast("decimal(28,0)") for n, v in values.items()}
    rows = bucketed(df, order, pos, buckets).withColumns(wide)
    totals = rows.groupBy(*own, "_b1", "_b2").agg(*(F.sum(v).alias(f"_t_{n}") for n, v in zip(values, wide)))
    by = Window.partitionBy(*own).orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)  # a few rows for each partition
    before = totals.select(*own, "_b1", "_b2", *(F.coalesce(F.sum(f"_t_{n}").over(by), F.lit(0).cast("decimal(38,0)")).alias(f"_s_{n}") for n in values))
    within = Window.partitionBy(*own, "_b1", "_b2").orderBy(*_order_keys(order, pos)).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_totals(rows.withColumns({n: F.sum(v).over(within) for n, v in zip(values, wide)}).drop(*wide), before, own, buckets)
    return out.select(*df.columns, *((F.col(n) + F.col(f"_s_{n}")).cast("decimal(38,0)").alias(n) for n in values))


def running_since(df: DataFrame, order: str, value: Column, begins: Column, name: str, partition: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """df with the running sum, in the order of one column, of a value since the last row (itself included) at which `begins` holds.

    A bucket passes on its sum and the sum before its last beginning, one row each."""
    own, buckets = partition or [], buckets or bucket_count(df)
    rows = bucketed(df.withColumns({"_v": value.cast("decimal(28,0)"), "_begins": begins}), order, None, buckets)
    within = Window.partitionBy(*own, "_b1", "_b2").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_v").over(within))
    rows = rows.withColumn("_from", F.last(F.when(F.col("_begins"), F.col("_sum") - F.col("_v")), ignorenulls=True).over(within))
    totals = rows.groupBy(*own, "_b1", "_b2").agg(F.sum("_v").alias("_t"), F.max_by("_from", order).alias("_l"))
    by = Window.partitionBy(*own).orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(by), F.lit(0).cast("decimal(38,0)")))
    before = before.withColumn("_since", F.last(F.col("_before") + F.col("_l"), ignorenulls=True).over(by)).select(*own, "_b1", "_b2", "_before", "_since")
    out = _with_totals(rows, before, own, buckets)
    since = F.coalesce(F.col("_before") + F.col("_from"), F.col("_since"), F.lit(0).cast("decimal(38,0)"))
    return out.select(*df.columns, (F.col("_sum") + F.col("_before") - since).cast("decimal(38,0)").alias(name))


def positions(df: DataFrame, order: str, pos: str | None = None, name: str = POS, buckets: int | None = None) -> DataFrame:
    """df with a place from 0 in the order of (order, pos)."""
    base = df.drop(name) if name in df.columns and name not in (order, pos) else df
    buckets = buckets or bucket_count(df)
    rows = bucketed(base, order, pos, buckets)
    counts = rows.groupBy("_b1", "_b2").agg(F.count("*").alias("_n"))
    before = counts.select("_b1", "_b2", F.coalesce(F.sum("_n").over(Window.orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b1", "_b2").orderBy(*_order_keys(order, pos)))
    kept = [c for c in base.columns if c != name]
    out = _with_totals(rows.withColumn("_k", within), before, [], buckets)
    return out.select(*kept, (F.col("_before") + F.col("_k") - 1).cast("bigint").alias(name))


def stable_sort(df: DataFrame, key: str, pos: str = POS, buckets: int | None = None, kind: Kind = I64) -> DataFrame:
    """The table in the order of a key of a kind, rows with equal keys in the order of their places; `_pos` is the new place."""
    moved = df.withColumnRenamed(pos, "_old")
    if kind.bits == 64 and not kind.signed:
        return positions(moved.withColumn("_flipped", flip(F.col(key), kind)), "_flipped", "_old", pos, buckets).drop("_flipped", "_old")
    return positions(moved, key, "_old", pos, buckets).drop("_old")


def sort_wide(df: DataFrame, key: str, pos: str = POS, signed: bool = True) -> DataFrame:
    """A stable sort by 128-bit keys (structs of hi and lo): by the lower half, then by the upper one; the table is written before each pass."""
    halves = materialise(df.withColumns({"_lo": F.col(key)["lo"], "_hi": F.col(key)["hi"]}), "sort-halves")
    by_low = materialise(stable_sort(halves, "_lo", pos, kind=U64), "sort-by-low")
    return stable_sort(by_low, "_hi", pos, kind=I64 if signed else U64).drop("_lo", "_hi")


def sort_by_bits(df: DataFrame, bits: str, pos: str = POS, width: int | None = None) -> DataFrame:
    """A stable sort by arrays of bits of one width, the first bit weighing most.

    Wide keys take a stable pass for each PASS_BITS bits, from the last ones on, and the table is written before
    each pass. The width is looked up if not given."""
    if width is None:
        width = df.agg(F.max(F.size(bits))).first()[0] or 0
    whole = F.when(F.size(bits) == width, F.col(bits)).otherwise(F.raise_error("bit keys differ in width").cast(df.schema[bits].dataType))
    starts = range(0, max(width, 1), PASS_BITS)
    part = lambda s: F.aggregate(F.slice(whole, s + 1, PASS_BITS), F.lit(0).cast("bigint"), lambda acc, x: acc * 2 + x.cast("bigint"))
    keys = [f"_key{k}" for k in range(len(starts))]
    out = df.withColumns({k: part(s) for k, s in zip(keys, starts)})
    for k in reversed(keys):
        out = stable_sort(materialise(out, "sort-pass") if len(keys) > 1 else out, k, pos)
    return out.drop(*keys)


def gather(df: DataFrame, index: DataFrame, pos: str = POS, value: str = "v") -> DataFrame:
    """Row `value` of df for each (pos, value) of the index; an index beyond the table is an error."""
    rest = [c for c in df.columns if c != pos]
    wanted = index.select(F.col(pos).alias("_at"), F.col(value).alias("_from"))
    found = wanted.join(df.withColumn("_hit", F.lit(1)), wanted["_from"] == df[pos], "left")
    at = F.when(F.col("_hit") == 1, F.col("_at")).otherwise(F.raise_error("index out of range").cast("bigint"))
    return found.select(at.alias(pos), *rest)


def assert_permutation(perm: DataFrame, pos: str = POS, value: str = "v") -> DataFrame:
    """perm, failing when used unless its values are 0 to n-1, each once."""
    facts = perm.agg(F.count("*").alias("n"), F.count_distinct(value).alias("d"), F.min(value).alias("a"), F.max(value).alias("b"))
    good = facts.select(F.when((F.col("n") == F.col("d")) & ((F.col("n") == 0) | ((F.col("a") == 0) & (F.col("b") == F.col("n") - 1))), F.lit(True)).otherwise(F.raise_error("not a permutation").cast("boolean")).alias("_ok"))
    return perm.crossJoin(F.broadcast(good)).where("_ok").drop("_ok")  # one row


def apply_permutation(df: DataFrame, perm: DataFrame, inverse: bool = False, pos: str = POS, value: str = "v") -> DataFrame:
    """out[i] = df[perm[i]], or out[perm[i]] = df[i]."""
    p = assert_permutation(perm, pos, value).select(F.col(pos).alias("_i"), F.col(value).alias("_p"))
    source, target = ("_i", "_p") if inverse else ("_p", "_i")
    rest = [c for c in df.columns if c != pos]
    return df.join(p, df[pos] == p[source]).select(F.col(target).cast("bigint").alias(pos), *rest)


def inverse_permutation(perm: DataFrame, pos: str = POS, value: str = "v") -> DataFrame:
    return assert_permutation(perm, pos, value).select(F.col(value).cast("bigint").alias(pos), F.col(pos).alias(value))


def take_slice(df: DataFrame, n: int, start: int | None = None, stop: int | None = None, step: int = 1, pos: str = POS) -> DataFrame:
    """Rows start:stop:step of n, as Python slices; an empty slice or a bound beyond the table is an error."""
    for bound in (start, stop):
        if bound is not None and not -n <= bound <= n:
            raise ValueError("slice out of range")
    span = range(n)[start:stop:step]
    if not len(span):
        raise ValueError("empty slice")
    low, high = min(span[0], span[-1]), max(span[0], span[-1])
    p = F.col(pos)
    rest = [c for c in df.columns if c != pos]
    place = F.call_function("div", p - span[0], F.lit(span.step).cast("bigint"))
    return df.where(p.between(low, high) & ((p - span[0]) % abs(span.step) == 0)).select(place.alias(pos), *rest)


def get_row(df: DataFrame, k: int, pos: str = POS) -> DataFrame:
    """Row k, without its place; a place that the table doesn't have is an error."""
    found = df.where(F.col(pos) == k).withColumn("_hit", F.lit(1))  # one row
    one = df.sparkSession.range(1).select(F.lit(k).alias("_wanted")).join(F.broadcast(found), F.col("_wanted") == F.col(pos), "left")
    there = F.when(F.col("_hit") == 1, F.lit(True)).otherwise(F.raise_error("index out of range").cast("boolean"))
    return one.where(there).select(*(c for c in df.columns if c != pos))


def concatenate(parts: list[tuple[DataFrame, int]], pos: str = POS) -> DataFrame:
    """Tables of known lengths one after the other."""
    out, shift = None, 0
    for df, n in parts:
        moved = df.withColumn(pos, F.col(pos) + shift)
        out, shift = moved if out is None else out.unionByName(moved), shift + n
    return out


def repeat(df: DataFrame, n: int, pos: str = POS, axis: str = "_copy") -> DataFrame:
    """n copies under a new leading axis."""
    return df.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(axis), "*")


def zip_tables(left: DataFrame, right: DataFrame, pos: str = POS) -> DataFrame:
    """Rows of two tables of one length side by side; a place that only one has is an error."""
    a, b = left.withColumn("_a", F.lit(1)), right.withColumn("_b", F.lit(1))
    both = a.join(b, pos, "full")
    place = F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.col(pos)).otherwise(F.raise_error("lengths differ").cast("bigint"))
    return both.select(place.alias(pos), *(c for c in left.columns if c != pos), *(c for c in right.columns if c != pos))
