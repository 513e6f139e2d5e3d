"""One way to write a formula, three ways to run it: Spark columns, NumPy arrays, SQL text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Sql(str):
    """SQL text with operators; every result is in brackets."""

    def _two(op):  # noqa: N805
        return lambda self, other: Sql(f"({self} {op} {_text(other)})"), lambda self, other: Sql(f"({_text(other)} {op} {self})")

    __add__, __radd__ = _two("+")
    __sub__, __rsub__ = _two("-")
    __mul__, __rmul__ = _two("*")
    __truediv__, __rtruediv__ = _two("/")
    __le__, __ge__ = _two("<=")
    __lt__, __gt__ = _two("<")


def _text(x) -> str:
    return x if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)"


class ColumnAlgebra:
    least, greatest, sqrt, sin, abs = staticmethod(F.least), staticmethod(F.greatest), staticmethod(F.sqrt), staticmethod(F.sin), staticmethod(F.abs)

    @staticmethod
    def number(x: float) -> Column:
        return F.lit(float(x))

    @staticmethod
    def power(x: Column, p: float) -> Column:
        return F.pow(x, F.lit(float(p)))

    @staticmethod
    def choose(*cases) -> Column:
        """(condition, value)..., otherwise."""
        *some, last = cases
        out = None
        for c, v in some:
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(last)


class ArrayAlgebra:
    least, greatest, sqrt, sin, abs = staticmethod(np.minimum), staticmethod(np.maximum), staticmethod(np.sqrt), staticmethod(np.sin), staticmethod(np.abs)
    number = staticmethod(float)
    power = staticmethod(np.power)

    @staticmethod
    def choose(*cases):
        *some, last = cases
        return np.select([c for c, _ in some], [v for _, v in some], last)


class SqlAlgebra:
    @staticmethod
    def _call(name: str):
        return lambda *a: Sql(f"{name}({', '.join(_text(x) for x in a)})")

    def __init__(self):
        for name in ("least", "greatest", "sqrt", "sin", "abs", "power"):
            setattr(self, name, self._call(name))

    @staticmethod
    def number(x: float) -> Sql:
        return Sql(_text(float(x)))

    @staticmethod
    def choose(*cases) -> Sql:
        *some, last = cases
        return Sql("(CASE " + " ".join(f"WHEN {c} THEN {_text(v)}" for c, v in some) + f" ELSE {_text(last)} END)")


COLUMNS, ARRAYS, SQL = ColumnAlgebra(), ArrayAlgebra(), SqlAlgebra()
