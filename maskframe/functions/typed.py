"""Columns that carry their kind, with Python's operators: `a + b`, `a < b`, `a != b`, `v[1]`, `v @ w`.

Results keep the operands' kind; comparisons give bits and respect the kind's sign, also of bits made from
an integer. Both operands must be of one kind; plain numbers take the other operand's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bits as B
from . import scalars as S
from .containers import cell_slice, vector_get
from .scalars import BIT, Kind


@dataclass(frozen=True, eq=False)
class Typed:
    """A column of scalars of a kind; of vectors of them if `length` is set."""

    column: Column
    kind: Kind
    length: int | None = None

    def _other(self, x: "Typed | int") -> Column:
        if isinstance(x, Typed):
            if x.kind != self.kind:
                raise TypeError(f"{self.kind.name} and {x.kind.name}")
            return x.column
        return F.lit(x).cast(self.kind.spark)

    def _each(self, x: "Typed | int", op) -> "Typed":
        """op on scalars, or on each cell; a scalar meets every cell of a vector."""
        other, wide = self._other(x), x.length if isinstance(x, Typed) else None
        if self.length is None and wide is None:
            return Typed(op(self.column, other, self.kind), self.kind)
        if self.length is not None and wide is not None:
            if self.length != wide:
                raise ValueError(f"vectors of {self.length} and {wide}")
            return Typed(F.zip_with(self.column, other, lambda a, b: op(a, b, self.kind)), self.kind, wide)
        if wide is None:
            return Typed(F.transform(self.column, lambda a: op(a, other, self.kind)), self.kind, self.length)
        return Typed(F.transform(other, lambda b: op(self.column, b, self.kind)), self.kind, wide)

    def _compare(self, x: "Typed | int", op) -> "Typed":
        if self.length is not None:
            raise TypeError("comparisons take scalars")
        return Typed(op(self.column, self._other(x), self.kind), BIT)

    def __add__(self, x):
        return self._each(x, S.add)

    def __sub__(self, x):
        return self._each(x, S.subtract)

    def __mul__(self, x):
        return self._each(x, S.multiply)

    __and__, __xor__ = __mul__, __add__

    def __matmul__(self, x: "Typed") -> "Typed":
        """The dot product of two vectors."""
        from ..operators.tensor import dot

        if self.length is None or self.length != x.length:
            raise ValueError("@ takes vectors of one length")
        return Typed(dot(self.column, self._other(x), self.kind), self.kind)

    def __lt__(self, x):
        return self._compare(x, B.less)

    def __le__(self, x):
        return self._compare(x, B.less_equal)

    def __gt__(self, x):
        return self._compare(x, B.greater)

    def __ge__(self, x):
        return self._compare(x, B.greater_equal)

    def __eq__(self, x):
        return self._compare(x, lambda a, b, k: B.equal(a, b))

    def __ne__(self, x):
        return self._compare(x, lambda a, b, k: B.not_equal(a, b))

    __hash__ = None

    def min(self, x):
        return Typed(B.minimum(self.column, self._other(x), self.kind), self.kind)

    def max(self, x):
        return Typed(B.maximum(self.column, self._other(x), self.kind), self.kind)

    def __getitem__(self, at: int | slice | Column) -> "Typed":
        if self.length is None:
            raise TypeError("a scalar has no cells")
        if isinstance(at, slice):
            places = range(self.length)[at]
            return Typed(cell_slice(self.column, self.length, at.start, at.stop, at.step or 1), self.kind, len(places))
        if isinstance(at, int) and not 0 <= at < self.length:
            raise IndexError(at)
        return Typed(vector_get(self.column, at), self.kind)
