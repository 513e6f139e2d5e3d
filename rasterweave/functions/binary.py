"""Registry of binary functions on [0,1] that integrals are built from.

Each is written once over an algebra (see ``algebra``); ``column`` gives a Column builder that Catalyst compiles,
``array`` a NumPy function, ``sql`` text.  x is the value, y the capacity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from .algebra import ARRAYS, COLUMNS, SQL, Sql

EPS = 1e-12
_REGISTRY: dict[str, tuple[Callable, bool]] = {}


def register_function(name: str, clipped: bool = True):
    """Add a formula (algebra, x, y); ``clipped`` first brings both arguments into [0,1]."""

    def add(formula: Callable) -> Callable:
        _REGISTRY[name] = (formula, clipped)
        return formula

    return add


def names() -> list[str]:
    return list(_REGISTRY)


def _run(name: str, o, x, y):
    try:
        formula, clipped = _REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown function: {name}") from None
    if clipped:
        x, y = (o.least(o.number(1), o.greatest(o.number(0), v)) for v in (x, y))
    return formula(o, x, y)


def column(name: str) -> Callable:
    return lambda x, y: _run(name, COLUMNS, x, y)


def array(name: str) -> Callable:
    return lambda x, y: _run(name, ARRAYS, x, y)


def sql(name: str, x: str, y: str) -> str:
    return _run(name, SQL, Sql(x), Sql(y))


def _close(o, a, b: float):
    """The default closeness of array libraries: 1e-8 + 1e-5 |b|."""
    return o.abs(a - o.number(b)) <= o.number(1e-8 + 1e-5 * abs(b))


register_function("TP", False)(lambda o, x, y: x * y)
register_function("TM", False)(lambda o, x, y: o.least(x, y))
register_function("TL", False)(lambda o, x, y: o.greatest(o.number(0), x + y - 1.0))
register_function("AVG", False)(lambda o, x, y: (x + y) * 0.5)
register_function("OB")(lambda o, x, y: o.least(x * o.sqrt(y), y * o.sqrt(x)))
register_function("OmM")(lambda o, x, y: o.least(x, y) * o.greatest(x * x, y * y))
register_function("ODiv")(lambda o, x, y: (x * y + o.least(x, y)) * 0.5)
register_function("GM")(lambda o, x, y: o.sqrt(x * y))
register_function("S")(lambda o, x, y: o.sin(o.power(x * y, 0.25) * (math.pi / 2)))
register_function("ORS")(lambda o, x, y: o.least((x + 1.0) * o.sqrt(y) * 0.5, y * o.sqrt(x)))
register_function("CF")(lambda o, x, y: x * y + x * x * y * (1.0 - x) * (1.0 - y))
register_function("CL")(lambda o, x, y: o.greatest(o.least(x, y * 0.5), x + y - 1.0))
register_function("FGL")(lambda o, x, y: o.sqrt(x * (y + 1.0) * 0.5))
register_function("FBPC")(lambda o, x, y: x * y * y)
register_function("FNA")(lambda o, x, y: o.choose((x <= y, x), o.least(x * 0.5, y)))
register_function("FNA2")(lambda o, x, y: o.choose((_close(o, x, 0.0), x * 0.0), (x <= y, (x + y) * 0.5), o.least(x * 0.5, y)))
register_function("FIM")(lambda o, x, y: o.greatest(1.0 - y, x))
register_function("FIP")(lambda o, x, y: 1.0 - y + x * y)


@register_function("THP", False)
def _hamacher(o, x, y):
    den = x + y - x * y
    small = o.abs(den) < o.number(EPS)
    return o.choose((small, x * 0.0), x * y / o.choose((small, den * 0.0 + 1.0), den))


@register_function("TDP", False)
def _drastic(o, x, y):
    return o.choose((_close(o, y, 1.0), x), (_close(o, x, 1.0), y), x * 0.0)


@register_function("HM")
def _harmonic(o, x, y):
    den = x + y
    small = den < o.number(EPS)
    return o.choose((small, x * 0.0), x * y * 2.0 / o.choose((small, den * 0.0 + 1.0), den))


# The functions that behave like copulas, and the pairs known to be admissible for CF1F2.
COPULA_LIKE = ["TP", "TM", "TL", "THP", "TDP", "OB", "OmM", "ODiv", "GM", "HM", "S", "CF", "CL", "ORS"]
KNOWN_PAIRS = [("TP", "TL"), ("TM", "FNA"), ("TP", "FBPC"), ("FBPC", "FBPC"), ("TM", "TM"), ("FIP", "FIP"), ("FGL", "TM")]
