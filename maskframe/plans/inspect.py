"""What a plan will do: exchanges, joins, scans and Python stages, and a lint of share privacy."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from ..operators.sharing import PUBLIC, SHARED


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan before it runs."""
    plan = physical_plan(df).split("== Initial Plan ==")[0]
    return Counter(m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-*()\d]*([A-Za-z]+)", line)))


def summary(df: DataFrame) -> dict[str, int]:
    """Exchanges stand for rounds between workers; broadcasts and Python stages are told apart."""
    ops = operators(df)
    return {
        "exchanges": ops["Exchange"],
        "broadcasts": ops["BroadcastExchange"],
        "joins": sum(n for k, n in ops.items() if k.endswith("Join")),
        "sorts": ops["Sort"],
        "python": sum(n for k, n in ops.items() if re.search("Python|Pandas|Arrow", k)),
        "single_partition": physical_plan(df).count("SinglePartition"),
        "nodes": sum(ops.values()),
    }


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


#: Operations that act on shares, and whether an input must be public.
LINEAR = {"add", "subtract", "sum", "cumsum", "permute_axes", "reshape", "concatenate", "stack", "get", "slice", "zip", "repeat"}
PRODUCT = {"multiply", "dot", "matmul", "gemm", "mixed_multiply", "truncate", "a2b", "b2a", "join", "sort", "apply_permutation"}
PUBLIC_ONLY = {"vector_get": 1, "gather": 1}


def propagate(operation: str, inputs: list[str]) -> str:
    """Whether a result is public or shared; an error if an operation can't take a shared input there."""
    if operation in PUBLIC_ONLY and inputs[PUBLIC_ONLY[operation]] != PUBLIC:
        raise ValueError(f"{operation} needs a public index")
    if operation in LINEAR | PRODUCT | set(PUBLIC_ONLY):
        return SHARED if SHARED in inputs else PUBLIC
    if all(i == PUBLIC for i in inputs):
        return PUBLIC
    raise ValueError(f"{operation} isn't defined on shares")
