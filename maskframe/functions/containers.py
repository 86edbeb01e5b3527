"""Vectors (arrays), tuples and named tuples (structs) as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tuple_of(*parts: Column) -> Column:
    return F.struct(*(p.alias(f"_{i}") for i, p in enumerate(parts)))


def named_tuple(**parts: Column) -> Column:
    return F.struct(*(p.alias(n) for n, p in parts.items()))


def tuple_get(t: Column, i: int) -> Column:
    return t.getField(f"_{i}")


def vector(*parts: Column) -> Column:
    return F.array(*parts)


def vector_get(v: Column, i: Column | int) -> Column:
    """The element at i from 0; an index beyond the vector is an error."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when((i >= 0) & (i < F.size(v)), F.get(v, i.cast("int"))).otherwise(F.raise_error("index out of range"))


def zip_vectors(**parts: Column) -> Column:
    """A vector of named tuples from vectors of one length."""
    first, *rest = parts.values()
    same = F.lit(True)
    for p in rest:
        same = same & (F.size(p) == F.size(first))
    zipped = F.arrays_zip(*(p.alias(n) for n, p in parts.items()))
    return F.when(same, zipped).otherwise(F.raise_error("lengths differ"))


def repeat(x: Column, n: int) -> Column:
    return F.array_repeat(x, n)


def sub_vector(v: Column, start: int, stop: int) -> Column:
    return F.slice(v, start + 1, stop - start)


def push(v: Column, x: Column) -> Column:
    return F.array_append(v, x)


def insert(v: Column, i: int, x: Column) -> Column:
    return F.array_insert(v, F.lit(i + 1), x)


def extend(v: Column, w: Column) -> Column:
    return F.concat(v, w)


def remove(v: Column, i: int) -> Column:
    return F.concat(F.slice(v, 1, i), F.slice(v, F.lit(i + 2), F.greatest(F.size(v) - i - 1, F.lit(0))))


def pop(v: Column) -> Column:
    return F.slice(v, F.lit(1), F.size(v) - 1)


def zeros(n: int, kind: str = "bigint") -> Column:
    return F.array_repeat(F.lit(0).cast(kind), n)


def ones(n: int, kind: str = "bigint") -> Column:
    return F.array_repeat(F.lit(1).cast(kind), n)


def cell_slice(v: Column, n: int, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """A Python slice of a vector of known length; an empty one is an error."""
    places = list(range(n))[start:stop:step]
    if not places:
        raise ValueError("empty slice")
    return F.array(*(F.get(v, F.lit(i)) for i in places))


#: A container's static type: "x" for a scalar, [n, type] for a vector or array axis, a tuple of types, a dict of named types.
Shape = object


def leaves(value: Column, of: Shape) -> list[Column]:
    """The scalars of a value in their order."""
    if isinstance(of, str):
        return [value]
    if isinstance(of, list):
        n, part = of
        return [leaf for i in range(n) for leaf in leaves(F.get(value, F.lit(i)), part)]
    names = [f"_{i}" for i in range(len(of))] if isinstance(of, tuple) else list(of)
    parts = of if isinstance(of, tuple) else of.values()
    return [leaf for name, part in zip(names, parts) for leaf in leaves(value.getField(name), part)]


def _built(rest: list[Column], of: Shape) -> Column:
    if isinstance(of, str):
        return rest.pop(0)
    if isinstance(of, list):
        n, part = of
        return F.array(*(_built(rest, part) for _ in range(n)))
    if isinstance(of, tuple):
        return F.struct(*(_built(rest, part).alias(f"_{i}") for i, part in enumerate(of)))
    return F.struct(*(_built(rest, part).alias(name) for name, part in of.items()))


def reshape(value: Column, old: Shape, new: Shape) -> Column:
    """The same scalars in the same order in another container: vectors become tuples, arrays other arrays, and back."""
    rest = leaves(value, old)

    def count(of: Shape) -> int:
        if isinstance(of, str):
            return 1
        return of[0] * count(of[1]) if isinstance(of, list) else sum(map(count, of if isinstance(of, tuple) else of.values()))

    if count(new) != len(rest):
        raise ValueError("containers differ in size")
    return _built(rest, new)
