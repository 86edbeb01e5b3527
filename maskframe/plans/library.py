"""The library's operations by name, for the registry of custom operations.

An operation is made for the kinds of its arguments and for its options, written after the name as
`name(option=value)`; it takes and gives Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions import bits as B
from ..functions import fixed as X
from ..functions import scalars as S
from .graphs import CustomOperations

#: Operations on columns of one kind, and on columns alone.
_KINDED: dict[str, Callable] = {
    "add": S.add, "subtract": S.subtract, "multiply": S.multiply, "greater": B.greater, "less": B.less, "greater_equal": B.greater_equal, "less_equal": B.less_equal,
    "min": B.minimum, "max": B.maximum, "binary_add": B.binary_add, "long_division": X.floor_divide,
}
_PLAIN: dict[str, Callable] = {
    "not": B.not_, "or": B.or_, "equal": B.equal, "not_equal": B.not_equal, "mux": B.mux, "mixed_multiply": S.mixed_multiply, "fixed_multiply": X.fixed_multiply,
    "goldschmidt": X.goldschmidt_divide, "newton": X.newton_inverse, "inverse_sqrt": X.inverse_sqrt, "taylor_exp": X.taylor_exp, "clip_2k": B.clip_2k, "one_hot": B.one_hot,
    "cumulative_or": B.cumulative_or, "reduce_mul": B.reduce_mul, "precise_divide": X.precise_divide,
}


def _options(text: str) -> dict[str, int]:
    return {k: int(v) for k, v in re.findall(r"(\w+)=(-?\d+)", text)}


class Library(CustomOperations):
    """A registry that has the library's operations from the start."""

    def __init__(self):
        super().__init__()
        for name, f in _KINDED.items():
            self.register(name)(lambda *kinds, _f=f, **named: self._one_kind(_f, kinds, named))
        for name, f in _PLAIN.items():
            self.register(name)(lambda *kinds, _f=f, **named: lambda *args: _f(*args, **named))
        for name in X.CURVES:
            self.register(f"approximate_{name}")(lambda *kinds, _n=name, **named: lambda x: X.approximate(_n, x, **named))
        self.register("truncate")(lambda kind, scale: lambda x: S.truncate(x, scale, S.kind(kind)))

    @staticmethod
    def _one_kind(f: Callable, kinds: tuple[str, ...], named: dict) -> Callable:
        if len(set(kinds)) != 1:
            raise TypeError(f"arguments of one kind are needed, not {kinds}")
        kind = S.kind(kinds[0])
        return lambda *args: f(*args, kind, **named)

    def instance(self, name: str, *types: str) -> Callable:
        """The operation for these kinds, e.g. instance("truncate(scale=8)", "i64"); made once."""
        base, _, rest = name.partition("(")
        if base not in self.makers:
            raise KeyError(base)
        if not rest:
            return super().instance(name, *types)
        if name not in self.makers:
            self.makers[name] = lambda *kinds: self.makers[base](*kinds, **_options(rest))
        return super().instance(name, *types)
