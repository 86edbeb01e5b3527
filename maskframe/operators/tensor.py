"""Tensors as coordinate tables (i0, i1, ..., v): linear algebra, reductions and shape changes.

Shapes are known to the caller, as in any static tensor language; zeros may be left out of products.
"""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import I64, Kind, multiply, sum_wrapped, wrap_decimal
from .order import running, running_since


def axes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "v"]


def from_cells(df: DataFrame, row: str, cells: str) -> DataFrame:
    """(i0, i1, v) from rows with array cells."""
    return df.select(F.col(row).alias("i0"), F.posexplode(cells).alias("i1", "v")).select("i0", F.col("i1").cast("bigint").alias("i1"), "v")


def lengths(df: DataFrame) -> list[int]:
    """The length of each axis, as far as the tensor's coordinates show it: one row of maxima."""
    row = df.agg(*(F.max(c) for c in axes(df))).first() if axes(df) else []
    return [0 if m is None else m + 1 for m in row]


def broadcast_shape(a: list[int], b: list[int]) -> list[int]:
    """The common shape of two tensors: axes are matched from the last one, and an axis of length 1 is repeated."""
    out = []
    for k in range(max(len(a), len(b))):
        x, y = (s[-1 - k] if k < len(s) else 1 for s in (a, b))
        if x != y and 1 not in (x, y):
            raise ValueError(f"shapes {a} and {b} don't match")
        out.append(max(x, y))
    return out[::-1]


def _carried(df: DataFrame, shape: list[int], common: list[int]) -> dict[int, str]:
    """The axes of the common shape along which a tensor runs itself, and their names."""
    names, skipped = axes(df), len(common) - len(shape)
    return {k: names[k - skipped] for k in range(skipped, len(common)) if shape[k - skipped] == common[k]}


def elementwise(a: DataFrame, b: DataFrame, op, kind: Kind = I64, default: int | None = None, shapes: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """op(a.v, b.v) on shared coordinates, either side repeated along axes that it lacks or that have length 1 there.

    Shapes that aren't given are looked up. With a default, coordinates that one side leaves out count as
    that value; then one side has to run along all axes."""
    sa, sb = shapes or (lengths(a), lengths(b))
    common = broadcast_shape(sa, sb)
    mine, other = _carried(a, sa, common), _carried(b, sb, common)
    left = a.select(*(F.col(n).alias(f"_a{k}") for k, n in mine.items()), F.col("v").alias("_v"))
    right = b.select(*(F.col(n).alias(f"_b{k}") for k, n in other.items()), F.col("v").alias("_w"))
    shared = [k for k in mine if k in other]
    if default is None:
        how = "inner"
    elif len(mine) == len(common):
        how = "full" if len(other) == len(common) else "left"
    elif len(other) == len(common):
        how = "right"
    else:
        raise ValueError("with a default one side must run along all axes")
    match = [F.col(f"_a{k}") == F.col(f"_b{k}") for k in shared]
    both = left.join(right, match, how) if match else left.join(right, F.lit(True), how)  # an outer product is as large as its result
    place = lambda k: F.coalesce(*(F.col(f"{s}{k}") for s, has in (("_a", mine), ("_b", other)) if k in has)).alias(f"i{k}")
    x, y = (F.col("_v"), F.col("_w")) if default is None else (F.coalesce("_v", F.lit(default)), F.coalesce("_w", F.lit(default)))
    return both.select(*(place(k) for k in range(len(common))), op(x, y, kind).alias("v"))


def _product(a: Column, b: Column, exact: bool) -> Column:
    return a * b if exact else (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")


def _contract(a: DataFrame, b: DataFrame, match: list[tuple[str, str]], kept: list[Column], kind: Kind, small: bool) -> DataFrame:
    """Sums of products of the pairs that agree on the matched axes, by the kept ones (a's are `_a_` and b's `_b_` before their names).

    A join on the matched axes and an aggregation with partial sums; frequent inner keys are split by Spark."""
    left = a.select(*(F.col(c).alias(f"_a_{c}") for c in axes(a)), F.col("v").alias("_v"))
    right = b.select(*(F.col(c).alias(f"_b_{c}") for c in axes(b)), F.col("v").alias("_w"))
    both = left.join(right, [F.col(f"_a_{x}") == F.col(f"_b_{y}") for x, y in match])
    named = [c.alias(f"i{k}") for k, c in enumerate(kept)]
    both = both.select(*named, _product(F.col("_v"), F.col("_w"), small).alias("p"))
    total = F.sum(F.col("p").cast("decimal(28,0)")) if small else F.sum(F.pmod("p", F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(28,0)"))
    places = [f"i{k}" for k in range(len(kept))]
    return both.groupBy(*places).agg(wrap_decimal(total, kind).alias("v")) if places else both.agg(wrap_decimal(F.coalesce(total, F.lit(0).cast("decimal(38,0)")), kind).alias("v"))


def matmul(a: DataFrame, b: DataFrame, kind: Kind = I64, small: bool = False, shapes: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """(batch..., i, k) by (batch..., k, j). `small` promises |products| below 2^63, which stay BIGINT.

    A side with one axis is a row or a column, whose axis the result lacks. Batch axes are matched from the
    last one; with shapes given, a side is repeated along batch axes of length 1 there."""
    na, nb = axes(a), axes(b)
    if not na or not nb:
        raise ValueError("matmul takes no scalars")
    rows, inner_a = (na[-2:-1], na[-1])
    inner_b, columns = (nb[-2], nb[-1:]) if len(nb) > 1 else (nb[0], [])
    batch_a, batch_b = na[:-2], nb[:-2]
    sa, sb = (s[: max(len(s) - 2, 0)] for s in shapes) if shapes else ([2] * len(batch_a), [2] * len(batch_b))
    common = broadcast_shape(sa, sb)
    runs = lambda names, s: {k: names[k - len(common) + len(names)] for k in range(len(common) - len(names), len(common)) if s[k - len(common) + len(names)] == common[k]}
    ra, rb = runs(batch_a, sa), runs(batch_b, sb)
    match = [(ra[k], rb[k]) for k in ra if k in rb] + [(inner_a, inner_b)]
    kept = [F.col(f"_a_{ra[k]}") if k in ra else F.col(f"_b_{rb[k]}") for k in range(len(common))]
    return _contract(a, b, match, [*kept, *(F.col(f"_a_{c}") for c in rows), *(F.col(f"_b_{c}") for c in columns)], kind, small)


def dot_product(a: DataFrame, b: DataFrame, kind: Kind = I64, small: bool = False) -> DataFrame:
    """The sum over a's last axis and b's last but one (or only) axis, as numpy.dot; a side without axes is a factor."""
    na, nb = axes(a), axes(b)
    if not na or not nb:
        many, one = (b, a) if not na else (a, b)
        factor = F.broadcast(one.select(F.col("v").alias("_w")))  # one row
        return many.join(factor).select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(axes(many))), multiply(F.col("v"), F.col("_w"), kind).alias("v"))
    inner = nb[-2] if len(nb) > 1 else nb[0]
    rest = [c for c in nb if c != inner]
    return _contract(a, b, [(na[-1], inner)], [*(F.col(f"_a_{c}") for c in na[:-1]), *(F.col(f"_b_{c}") for c in rest)], kind, small)


def gemm(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False, kind: Kind = I64, small: bool = False, shapes: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """A product with the last two axes of either side swapped on request; a swap costs nothing."""
    if min(len(axes(a)), len(axes(b))) < 2:
        raise ValueError("gemm takes tensors with two axes or more")
    return matmul(swap_last(a) if transpose_a else a, swap_last(b) if transpose_b else b, kind, small, shapes)


def swap_last(df: DataFrame) -> DataFrame:
    names = axes(df)
    return permute_axes(df, [*range(len(names) - 2), len(names) - 1, len(names) - 2])


def dot(a: Column, b: Column, kind: Kind = I64) -> Column:
    """The dot product of two array cells, modulo 2^bits."""
    pairs = F.zip_with(a, b, lambda x, y: F.pmod((x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")))
    return wrap_decimal(F.aggregate(pairs, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + x).cast("decimal(38,0)")), kind)


def sum_axes(df: DataFrame, over: list[int], kind: Kind = I64) -> DataFrame:
    """Sums over some axes; over none it is the tensor itself."""
    if not over:
        return df
    kept = [c for i, c in enumerate(axes(df)) if i not in over]
    return df.groupBy(*kept).agg(sum_wrapped(F.col("v"), kind).alias("v")) if kept else df.agg(sum_wrapped(F.col("v"), kind).alias("v"))


def cumsum(df: DataFrame, axis: int, kind: Kind = I64) -> DataFrame:
    """Inclusive prefix sums along an axis."""
    names = axes(df)
    others = [c for i, c in enumerate(names) if i != axis]
    out = running(df, names[axis], {"_c": F.col("v")}, partition=others)
    return out.select(*names, wrap_decimal(F.col("_c"), kind).alias("v"))


def segment_cumsum(df: DataFrame, pos: str, value: str, bit: str, first: int | DataFrame, kind: Kind = I64) -> DataFrame:
    """out[0] = first; out[i] = value[i-1] + bit[i-1] * out[i-1], for rows of one cell. One more row than df; `_pos` from 0."""
    out = segment_cumsum_rows(df.select(F.col(pos).alias("i0"), F.col(value).alias("v")), df.select(F.col(pos).alias("i0"), F.col(bit).alias("v")), first, kind)
    return out.select(F.col("i0").alias("_pos"), "v")


def segment_cumsum_rows(df: DataFrame, bits: DataFrame, first: int | DataFrame, kind: Kind = I64) -> DataFrame:
    """The same for rows of any shape: df (i0, i1, ..., v), bits (i0, v), first (i1, ..., v) or, without further axes, a number.

    A 0 begins a segment, whose sums are running sums since there; they are made in even shares of the rows."""
    names = axes(df)
    if isinstance(first, int):
        first = df.sparkSession.createDataFrame([(first,)], "v bigint")
    head = first.select(F.lit(0).cast("bigint").alias("i0"), *(F.col(c).alias(f"i{k + 1}") for k, c in enumerate(axes(first))), F.col("v").cast("bigint").alias("v"), F.lit(0).alias("b"))
    moved = df.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(names)), F.col("v").cast("bigint").alias("v"))
    moved = moved.join(bits.select(F.col(axes(bits)[0]).alias("i0"), F.col("v").cast("int").alias("b")), "i0").withColumn("i0", F.col("i0") + 1)
    places = [f"i{k}" for k in range(len(names))]
    rows = head.unionByName(moved.select(*places, "v", "b"))
    out = running_since(rows, "i0", F.col("v"), F.col("b") == 0, "_c", places[1:])
    return out.select(*places, wrap_decimal(F.col("_c"), kind).alias("v"))


def permute_axes(df: DataFrame, order: list[int]) -> DataFrame:
    """Axis order[k] of the input becomes axis k: a change of names."""
    names = axes(df)
    return df.select(*(F.col(names[o]).alias(names[k]) for k, o in enumerate(order)), "v")


def reshape(df: DataFrame, shape: list[int], new_shape: list[int]) -> DataFrame:
    """The same elements in row-major order under another shape."""
    if prod(shape) != prod(new_shape):
        raise ValueError("shapes differ in size")
    place = F.lit(0).cast("bigint")
    for name, n in zip(axes(df), shape):
        place = place * n + F.col(name)
    out, rest = [], prod(new_shape)
    for k, n in enumerate(new_shape):
        rest //= n
        out.append(F.call_function("div", place, F.lit(rest).cast("bigint")) % n)
    return df.select(*(c.alias(f"i{k}") for k, c in enumerate(out)), "v")


def broadcast_to(df: DataFrame, shape: list[int], wanted: list[int]) -> DataFrame:
    """The tensor repeated along the axes that it lacks or that have length 1."""
    if broadcast_shape(shape, wanted) != wanted:
        raise ValueError(f"{shape} can't become {wanted}")
    own = _carried(df, shape, wanted)
    out = df.select(*(F.col(n).alias(f"i{k}") for k, n in own.items()), "v")
    for k, n in enumerate(wanted):
        if k not in own:
            out = out.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))) if n > 1 else F.lit(0).cast("bigint"))
    return out.select(*(f"i{k}" for k in range(len(wanted))), "v")


def stack(parts: list[DataFrame], outer: list[int] | None = None, shapes: list[list[int]] | None = None) -> DataFrame:
    """Tensors under new leading axes of the given shape (one axis if none is given), in row-major order.

    With their shapes given, they are first repeated to the common shape; otherwise they must have one shape."""
    outer = outer or [len(parts)]
    if prod(outer) != len(parts) or not parts:
        raise ValueError(f"{len(parts)} tensors don't fill {outer}")
    if shapes:
        common = reduce(broadcast_shape, shapes)
        parts = [broadcast_to(p, s, common) for p, s in zip(parts, shapes)]
    out = None
    for number, p in enumerate(parts):
        places, rest = [], number
        for n in reversed(outer):
            places.append(rest % n)
            rest //= n
        names = [F.lit(x).cast("bigint") for x in reversed(places)] + [F.col(c) for c in axes(p)]
        moved = p.select(*(c.alias(f"i{k}") for k, c in enumerate(names)), "v")
        out = moved if out is None else out.unionByName(moved)
    return out


def concatenate(parts: list[tuple[DataFrame, int]], axis: int = 0) -> DataFrame:
    """Tensors one after the other along an axis, of which each has the given length."""
    if len(parts) < 2:
        raise ValueError("two tensors at least")
    out, shift = None, 0
    for df, n in parts:
        names = axes(df)
        moved = df.select(*((F.col(c) + (shift if k == axis else 0)).alias(f"i{k}") for k, c in enumerate(names)), "v")
        out, shift = moved if out is None else out.unionByName(moved), shift + n
    return out


def gather(df: DataFrame, index: DataFrame, axis: int, length: int, index_shape: list[int] | None = None) -> DataFrame:
    """numpy.take along an axis of the given length: the axis is replaced by the axes of the index.

    An index beyond the axis is an error, and so are more indices than the axis is long, if their shape is given."""
    if index_shape is not None and prod(index_shape) > length:
        raise ValueError(f"more than {length} indices")
    names = axes(df)
    good = F.when(F.col("v").between(0, length - 1), F.col("v")).otherwise(F.raise_error("index out of range").cast("bigint"))
    wanted = index.select(*(F.col(c).alias(f"_x{k}") for k, c in enumerate(axes(index))), good.alias("_from"))
    both = wanted.join(df, F.col("_from") == F.col(names[axis]))
    places = [*(F.col(c) for c in names[:axis]), *(F.col(f"_x{k}") for k in range(len(axes(index)))), *(F.col(c) for c in names[axis + 1 :])]
    return both.select(*(c.alias(f"i{k}") for k, c in enumerate(places)), "v")


def _full_index(index: tuple, rank: int) -> list:
    """An index with its Ellipsis (or the missing end) written out as whole axes."""
    if sum(x is Ellipsis for x in index) > 1:
        raise ValueError("more than one Ellipsis")
    at = next((k for k, x in enumerate(index) if x is Ellipsis), len(index))
    given = len(index) - (at < len(index))
    if given > rank:
        raise ValueError("too many indices")
    return [*index[:at], *[slice(None)] * (rank - given), *index[at + 1 :]]


def take(df: DataFrame, shape: list[int], *index) -> DataFrame:
    """Basic indexing by numbers, slices and at most one Ellipsis: a number takes its axis away.

    A number or bound beyond its axis is an error, and so is an empty slice."""
    keep, places = F.lit(True), []
    for name, n, x in zip(axes(df), shape, _full_index(index, len(shape))):
        c = F.col(name)
        if isinstance(x, int):
            if not -n <= x < n:
                raise IndexError(f"{x} is beyond an axis of length {n}")
            keep = keep & (c == x % n)
            continue
        if any(b is not None and not -n <= b <= n for b in (x.start, x.stop)):
            raise IndexError(f"{x} is beyond an axis of length {n}")
        span = range(n)[x]
        if not len(span):
            raise ValueError("empty slice")
        if span != range(n):
            keep = keep & c.between(min(span[0], span[-1]), max(span[0], span[-1])) & ((c - span[0]) % abs(span.step) == 0)
        places.append(F.call_function("div", c - span[0], F.lit(span.step).cast("bigint")))
    return df.where(keep).select(*(p.alias(f"i{k}") for k, p in enumerate(places)), "v")


def get(df: DataFrame, shape: list[int], index: list[int]) -> DataFrame:
    """The part at leading indices; one beyond its axis is an error."""
    if len(index) > len(shape) or any(not 0 <= i < n for i, n in zip(index, shape)):
        raise IndexError(f"{index} is beyond {shape}")
    return take(df, shape, *index)


def to_cells(df: DataFrame, cells: str = "cells") -> DataFrame:
    """(i0, array) from (i0, i1, v); a row's cells are as many as the inner axis is long."""
    sorted_cells = F.array_sort(F.collect_list(F.struct("i1", "v")))
    return df.groupBy("i0").agg(F.transform(sorted_cells, lambda x: x["v"]).alias(cells))


def minimum_of(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("v"))


def expand_dims(df: DataFrame, at: list[int]) -> DataFrame:
    """The tensor with axes of length one put in at the given places of the result."""
    names = iter(axes(df))
    total = len(axes(df)) + len(at)
    places = {a % total for a in at}
    return df.select(*((F.lit(0).cast("bigint") if k in places else F.col(next(names))).alias(f"i{k}") for k in range(total)), "v")


def zeros_like(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.lit(0).cast(df.schema["v"].dataType))


def ones_like(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.lit(1).cast(df.schema["v"].dataType))


def extend_with_zeros(df: DataFrame, shape: list[int], rows: int) -> DataFrame:
    """`rows` more zero rows at the end of the first axis."""
    names, rest = axes(df), prod(shape[1:])
    more, place = df.sparkSession.range(rows * rest), F.col("id")
    out = []
    for n in reversed(shape[1:]):
        out.append(place % n)
        place = F.call_function("div", place, F.lit(n).cast("bigint"))
    out.append(place + shape[0])
    return df.unionByName(more.select(*(c.alias(n) for n, c in zip(names, reversed(out))), F.lit(0).cast(df.schema["v"].dataType).alias("v")))


def pull_out_bits(df: DataFrame, bits: str = "bits") -> DataFrame:
    """Cells of bits as a tensor of bits whose first axis is the bit's place."""
    names = [c for c in df.columns if c != bits]
    return df.select(*names, F.posexplode(bits).alias("_b", "v")).select(F.col("_b").cast("bigint").alias("i0"), *(F.col(c).alias(f"i{k + 1}") for k, c in enumerate(names)), "v")


def put_in_bits(df: DataFrame, bits: str = "bits") -> DataFrame:
    """The inverse: the first axis goes back into cells, in order."""
    first, *names = axes(df)
    cells = F.array_sort(F.collect_list(F.struct(F.col(first).alias("p"), "v")))  # as many as an integer has bits
    return df.groupBy(*names).agg(F.transform(cells, lambda x: x["v"]).alias(bits)).select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(names)), bits)


def reduce_rows(df: DataFrame, merge, column: str = "v") -> DataFrame:
    """One row from an associative aggregate function of Spark (bit_and, bit_xor, max, ...), which combines before it shuffles."""
    return df.agg(merge(F.col(column)).alias(column))
