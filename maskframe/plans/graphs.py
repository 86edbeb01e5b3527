"""Named computations that are built lazily and composed: graphs, calls and custom operations.

A graph is a Python function from columns or tables to a column or table; Spark's logical plan is its
body. The registry checks that a graph only calls ones defined before it and keeps instances by the
types they were made for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass
class Graph:
    name: str
    body: Callable
    inputs: tuple[str, ...] = ()
    notes: dict[str, object] = field(default_factory=dict)

    def __call__(self, *args, **named):
        if self.inputs and named:
            missing = set(self.inputs) - set(named)
            if missing or args:
                raise TypeError(f"{self.name} needs {sorted(missing)}")
            args = tuple(named[n] for n in self.inputs)
        if self.inputs and len(args) != len(self.inputs):
            raise TypeError(f"{self.name} takes {len(self.inputs)} inputs")
        return self.body(*args)


class Context:
    """Graphs by name, closed once finalised."""

    def __init__(self):
        self.graphs: dict[str, Graph] = {}
        self.main: str | None = None
        self.final = False

    def graph(self, name: str, inputs: tuple[str, ...] = (), **notes):
        """A decorator that adds a graph."""

        def add(body: Callable) -> Graph:
            if self.final:
                raise RuntimeError("the context is final")
            if name in self.graphs:
                raise ValueError(f"{name} exists")
            self.graphs[name] = Graph(name, body, inputs, notes)
            return self.graphs[name]

        return add

    def finalise(self, main: str) -> "Context":
        if main not in self.graphs:
            raise KeyError(main)
        self.main, self.final = main, True
        return self

    def call(self, name: str, *args, **named) -> Column | DataFrame:
        return self.graphs[name](*args, **named)

    def run(self, *args, **named) -> Column | DataFrame:
        if not self.final:
            raise RuntimeError("the context isn't final")
        return self.call(self.main, *args, **named)


class CustomOperations:
    """Polymorphic operations: made once for each tuple of argument types, and never in a circle."""

    def __init__(self):
        self.makers: dict[str, Callable] = {}
        self.made: dict[tuple, Callable] = {}
        self._making: list[tuple] = []

    def register(self, name: str):
        def add(maker: Callable) -> Callable:
            self.makers[name] = maker
            return maker

        return add

    def instance(self, name: str, *types: str) -> Callable:
        key = (name, *types)
        if key in self._making:
            raise RecursionError(f"{name} needs itself")
        if key not in self.made:
            self._making.append(key)
            try:
                self.made[key] = self.makers[name](*types)
            finally:
                self._making.pop()
        return self.made[key]


def to_dot(df: DataFrame) -> str:
    """The optimised logical plan as a Graphviz digraph."""
    lines, stack, edges = [], [], []
    for i, line in enumerate(df._jdf.queryExecution().optimizedPlan().treeString().splitlines()):
        depth = len(line) - len(line.lstrip(" :+-"))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        lines.append(f'  n{i} [label="{line.strip(" :+-")[:60].replace(chr(34), chr(39))}"];')
        if stack:
            edges.append(f"  n{i} -> n{stack[-1][1]};")
        stack.append((depth, i))
    return "\n".join(["digraph plan {", *lines, *edges, "}"])
