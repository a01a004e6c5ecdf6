"""Mangle scripts: integer operations that change a cost, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_script(value: Column, ops: Column) -> Column:
    """Fold array<struct<op, arg>> over ``value``; division truncates toward zero, ``=`` sets. A division by zero gives null."""
    def step(v: Column, x: Column) -> Column:
        out = F.when(x["op"] == "+", v + x["arg"]).when(x["op"] == "-", v - x["arg"]).when(x["op"] == "*", v * x["arg"])
        out = out.when((x["op"] == "/") & (x["arg"] != 0), F.call_function("div", v, F.when(x["arg"] == 0, 1).otherwise(x["arg"])))
        return out.when(x["op"] == "=", x["arg"].cast("long"))

    return F.aggregate(ops, value.cast("long"), step)


def run_script(value: int, ops: list[tuple[str, int]]) -> int:
    """The same for one number."""
    for op, arg in ops:
        if op == "+":
            value += arg
        elif op == "-":
            value -= arg
        elif op == "*":
            value *= arg
        elif op == "/":
            value = abs(value) // abs(arg) * (1 if (value < 0) == (arg < 0) else -1)
        elif op == "=":
            value = arg
        else:
            raise ValueError(f"unknown operation {op!r}")
    return value
