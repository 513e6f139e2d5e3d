"""Fuzzy measures: specifications, capacity tables and tail capacities as columns.

A specification is a dict with a ``kind``.  Tables over 2**n coalitions (bit i for criterion i) are small and
built on the driver; ``tail_capacities`` turns a specification into an array column aligned with the
ascending order of a descriptor array, with no UDF and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache
from itertools import combinations, permutations
from math import factorial
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
MAX_BITS = 62
DEFAULT = {"kind": "power", "q": 0.1}
_KINDS: dict[str, Callable] = {}


# ---- capacity tables (driver)


def normalised_weights(w: Sequence[float]) -> np.ndarray:
    w = np.maximum(np.asarray(w, float), 0)
    return w / w.sum() if w.sum() > EPS else np.full(len(w), 1 / len(w))


def _bits(n: int) -> np.ndarray:
    """2**n rows of n membership bits."""
    if n > MAX_BITS:
        raise ValueError(f"at most {MAX_BITS} criteria")
    return (np.arange(1 << n)[:, None] >> np.arange(n)) & 1


def additive_table(weights: Sequence[float]) -> np.ndarray:
    w = normalised_weights(weights)
    return _bits(len(w)) @ w


def sugeno_lambda(densities: Sequence[float]) -> float:
    """The non-zero root over -1 of prod(1 + z g) = 1 + z, or 0 where the densities sum to one."""
    g = np.clip(np.asarray(densities, float), 0, 1)
    s = g.sum()
    if abs(s - 1) < 1e-9:
        return 0.0
    f = lambda z: np.log1p(z * g).sum() - np.log1p(z)
    if s < 1:
        lo, hi = 1e-9, 1.0
        while f(hi) <= 0:
            hi *= 2
            if hi >= 1e9:
                return 0.0
    else:
        lo, hi = -1 + 1e-12, -1e-12
        if f(lo) * f(hi) > 0:
            return 0.0
    side = f(lo) > 0
    for _ in range(300):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if (f(mid) > 0) == side else (lo, mid)
    return float((lo + hi) / 2)


def sugeno_table(densities: Sequence[float]) -> np.ndarray:
    g, z = np.clip(np.asarray(densities, float), 0, 1), sugeno_lambda(densities)
    if abs(z) < 1e-10:
        return additive_table(g)
    out = (np.prod(np.where(_bits(len(g)) == 1, 1 + z * g, 1.0), 1) - 1) / z
    out[0], out[-1] = 0.0, 1.0
    return np.clip(out, 0, 1)


def two_additive_table(singletons: Sequence[float], pairs: Sequence[Sequence[float]]) -> np.ndarray:
    m, p = np.asarray(singletons, float), np.asarray(pairs, float)
    if p.shape != (len(m), len(m)):
        raise ValueError("pairs must be a square matrix over the singletons")
    b = _bits(len(m)).astype(float)
    upper = np.triu(p, 1)
    out = b @ m + np.einsum("si,ij,sj->s", b, upper, b)
    if abs(out[-1]) < EPS:
        raise ValueError("the whole set has no measure")
    return out / out[-1]


def is_capacity(table: Sequence[float], tol: float = 1e-8) -> bool:
    t = np.asarray(table, float)
    n = len(t).bit_length() - 1
    if len(t) != 1 << n or abs(t[0]) > tol or abs(t[-1] - 1) > tol or t.min() < -tol or t.max() > 1 + tol:
        return False
    masks = np.arange(len(t))
    return all((t[masks | 1 << i] - t >= -tol).all() for i in range(n))


def shapley(table: Sequence[float]) -> np.ndarray:
    t = np.asarray(table, float)
    n = len(t).bit_length() - 1
    size = _bits(n).sum(1)
    weight = np.array([factorial(s) * factorial(n - s - 1) / factorial(n) if s < n else 0.0 for s in range(n + 1)])
    masks = np.arange(len(t))
    return np.array([(weight[size] * (t[masks | 1 << i] - t))[masks & 1 << i == 0].sum() for i in range(n)])


def interaction(table: Sequence[float]) -> np.ndarray:
    t = np.asarray(table, float)
    n = len(t).bit_length() - 1
    size, masks, out = _bits(n).sum(1), np.arange(len(t)), np.zeros((n, n))
    weight = np.array([factorial(s) * factorial(n - s - 2) / factorial(max(n - 1, 1)) if s <= n - 2 else 0.0 for s in range(n + 1)])
    for i in range(n):
        for j in range(i + 1, n):
            a, b = 1 << i, 1 << j
            d = weight[size] * (t[masks | a | b] - t[masks | a] - t[masks | b] + t)
            out[i, j] = out[j, i] = d[masks & (a | b) == 0].sum()
    return out


# ---- specifications


def registry(n: int, learned: Mapping[str, Mapping] | None = None) -> list[dict[str, Any]]:
    """The baseline measures over n criteria, then learned ones by name."""
    out: list[dict[str, Any]] = [{"name": f"power_q{q:g}", "kind": "power", "q": q} for q in (0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.0)]
    out.append({"name": "additive_uniform", "kind": "additive", "weights": [1 / n] * n})
    out += [{"name": f"adaptive_power_{m}", "kind": "adaptive_power", "mode": m, "q_min": 0.02, "q_max": 1.0} for m in Q_MODES]
    out += [{"name": f"hetero_power_{'inverse' if v else 'direct'}", "kind": "heterogeneity_power", "q_min": 0.05, "q_max": 1.2, "inverse": v} for v in (False, True)]
    out.append({"name": "local_additive_evidence", "kind": "local_additive", "mode": "evidence", "gamma": 1.5})
    out.append({"name": "local_additive_softmax", "kind": "local_additive", "mode": "softmax", "temperature": 4.0})
    out.append({"name": "local_additive_reliability", "kind": "local_additive", "mode": "reliability", "window": 5})
    return out + [{**spec, "name": name} for name, spec in (learned or {}).items()]


def resolve(spec: Mapping[str, Any] | None, scale=None, label: str | None = None) -> dict[str, Any]:
    """Follow a router, one level."""
    spec = dict(spec or DEFAULT)
    kind = str(spec.get("kind", "power")).lower()
    some = spec.get("measures", {})
    if kind == "scale_router":
        return dict(some.get(str(scale), some.get(scale, spec.get("default", DEFAULT))))
    if kind == "context_router":
        return dict(some.get(label or "default", spec.get("default", DEFAULT)))
    return spec


# ---- columns


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, v: s * v)


def ordered(x: Column) -> Column:
    """Ascending structs of value v and index i; equal values keep their order."""
    return F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))


Q_MODES = ["max", "min", "prod", "mean", "geomean", "harmmean", "lukasiewicz", "hamacher", "odiv", "dispersion"]


def raw_q(x: Column, mode: str) -> Column:
    """A local exponent from a descriptor array, before clipping; dispersion is still to be normalised over its image."""
    x = F.transform(x, lambda v: clip(v, EPS))
    n = F.size(x)
    s = total(x)
    mean = s / n
    forms = {
        "max": lambda: F.array_max(x),
        "min": lambda: F.array_min(x),
        "prod": lambda: product(x),
        "mean": lambda: mean,
        "geomean": lambda: F.exp(total(F.transform(x, F.ln)) / n),
        "harmmean": lambda: n / total(F.transform(x, lambda v: 1 / v)),
        "lukasiewicz": lambda: F.greatest(s - (n - 1.0), F.lit(0.0)),
        "hamacher": lambda: F.when(s - product(x) > EPS, product(x) / (s - product(x))).otherwise(0.0),
        "odiv": lambda: (product(x) + F.array_min(x)) / n,
        "dispersion": lambda: F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))) / n) / (mean + EPS),
    }
    alias = {"geometric": "geomean", "harmonic": "harmmean", "tl": "lukasiewicz", "thp": "hamacher"}
    mode = alias.get(mode.lower(), mode.lower())
    if mode not in forms:
        raise ValueError(f"unknown adaptive-q mode: {mode}")
    return forms[mode]()


def register_measure(*kinds: str):
    """Add a builder (x, sorted, n, spec, context) -> array column of tail capacities."""

    def add(build: Callable) -> Callable:
        _KINDS.update(dict.fromkeys(kinds, build))
        return build

    return add


def tail_capacities(x: Column, n: int, spec: Mapping[str, Any] | None = None, *, scale=None, label: str | None = None, context: Mapping[str, Column] | None = None) -> Column:
    """mu of the coalition of the i-th smallest value and all larger ones, for i = 1..n.

    ``context`` names columns: ``dispersion`` and ``heterogeneity`` (normalised to [0,1] over their image),
    ``weights`` (an array, for local reliability), and ``raster`` where rows are pixels (reliability then asks for weights).
    """
    spec = resolve(spec, scale, label)
    kind = str(spec.get("kind", "power")).lower()
    if kind not in _KINDS:
        raise ValueError(f"unknown fuzzy-measure kind: {kind}")
    # the clipped descriptors are bound once, however often a builder names them
    once = F.transform(F.array(F.transform(x, lambda v: clip(v))), lambda v: _KINDS[kind](v, n, spec, dict(context or {})))
    return F.element_at(once, 1)


def _power(n: int, q: Column | float) -> Column:
    q = q if isinstance(q, Column) else F.lit(float(q))
    return F.array(*[F.pow(F.lit((n - i) / n), q) for i in range(n)])


@register_measure("power", "symmetric_power")
def _symmetric(x, n, spec, context):
    return F.lit([float(((n - i) / n) ** float(spec.get("q", 0.1))) for i in range(n)])


@register_measure("adaptive_power", "swafed_power", "local_power")
def _adaptive(x, n, spec, context):
    mode = str(spec.get("mode", "mean")).lower()
    q = context["dispersion"] if mode == "dispersion" else raw_q(x, mode)
    return _power(n, clip(q, float(spec.get("q_min", 0.02)), float(spec.get("q_max", 1.0))))


@register_measure("heterogeneity_power", "context_power")
def _heterogeneity(x, n, spec, context):
    if "heterogeneity" not in context:
        raise ValueError("heterogeneity_power needs context['heterogeneity']")
    z = 1 - context["heterogeneity"] if spec.get("inverse") else context["heterogeneity"]
    lo, hi = float(spec.get("q_min", 0.05)), float(spec.get("q_max", 1.0))
    return _power(n, lo + z * (hi - lo))


def _suffix_sums(x: Column, n: int, w: Column) -> Column:
    both = F.zip_with(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), w, lambda p, y: F.struct(p["v"].alias("v"), p["i"].alias("i"), y.alias("w")))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all"))
    step = lambda a, p: F.struct((a["s"] + p["w"]).alias("s"), F.concat(F.array(a["s"] + p["w"]), a["all"]).alias("all"))
    return F.aggregate(F.reverse(F.array_sort(both)), start, step, lambda a: a["all"])


@register_measure("additive", "weighted")
def _additive(x, n, spec, context):
    return _suffix_sums(x, n, F.lit(normalised_weights(spec.get("weights", np.ones(n))).tolist()))


@register_measure("local_additive", "adaptive_additive")
def _local(x, n, spec, context):
    mode, floor = str(spec.get("mode", "reliability")).lower(), float(spec.get("floor", 1e-3))
    if mode in ("reliability", "snr") and "weights" in context:
        z = context["weights"]
    elif mode in ("reliability", "snr") and context.get("raster"):
        raise ValueError("reliability on rasters needs the pixels' weights in the context")
    elif mode in ("evidence", "reliability", "snr"):  # without an image, reliability is evidence
        z = F.transform(x, lambda v: F.pow(v + floor, F.lit(float(spec.get("gamma", 1.0)))))
    elif mode == "softmax":
        z = F.transform(x, lambda v: F.exp((v - F.array_max(x)) * float(spec.get("temperature", 4.0))))
    else:
        raise ValueError(f"unknown local additive mode: {mode}")
    share = F.element_at(F.transform(F.array(z), lambda a: F.element_at(F.transform(F.array(F.greatest(total(a), F.lit(EPS))), lambda t: F.transform(a, lambda v: v / t)), 1)), 1)
    return _suffix_sums(x, n, share)


#: Descriptors whose order is one of a few codes, so that an integral is plain arithmetic.
FLAT = 4


def order_code(x: Sequence[Column]) -> Column:
    """A bit for each pair i < j of the values: x[i] <= x[j], that is, i comes before j."""
    bits = [F.when(x[i] <= x[j], 1 << b).otherwise(0) for b, (i, j) in enumerate(combinations(range(len(x)), 2))]
    return sum(bits[1:], bits[0]) if bits else F.lit(0)


@cache
def orders(n: int) -> tuple[tuple[int, ...], ...]:
    """For each code the places of the values in ascending order; codes that no values have are empty."""
    out: list[tuple[int, ...]] = [()] * (1 << n * (n - 1) // 2)
    for p in permutations(range(n)):
        at = {i: k for k, i in enumerate(p)}
        out[sum(1 << b for b, (i, j) in enumerate(combinations(range(n), 2)) if at[i] < at[j])] = p
    return tuple(out)


def _tails(weights: Sequence[Any]) -> list[Any]:
    """Sums from each weight to the last, added up from the last."""
    out = [weights[-1] + 0.0]
    for w in reversed(weights[:-1]):
        out.insert(0, out[0] + w)
    return out


def flat_capacities(x: Column, n: int, spec: Mapping[str, Any] | None = None, *, scale=None, label: str | None = None, context: Mapping[str, Column] | None = None) -> list[Column] | None:
    """``tail_capacities`` as n columns without functions over arrays, which Spark does not compile; None where a kind has no such form."""
    spec = resolve(spec, scale, label)
    kind, mode = str(spec.get("kind", "power")).lower(), str(spec.get("mode", "reliability")).lower()
    if n > FLAT or getattr(_KINDS.get(kind), "__module__", None) != __name__:  # a kind may have been given a builder of its own
        return None
    if kind in ("power", "symmetric_power"):
        return [F.lit(float(((n - i) / n) ** float(spec.get("q", 0.1)))) for i in range(n)]
    v = [clip(F.get(x, F.lit(i))) for i in range(n)]
    pick = lambda k, of, none: F.get(F.lit([of(p)[k] if p else none for p in orders(n)]), order_code(v))
    if kind in ("additive", "weighted"):
        w = normalised_weights(spec.get("weights", np.ones(n))).tolist()
        return [pick(k, lambda p: _tails([w[i] for i in p]), 0.0) for k in range(n)]
    tables = {
        **dict.fromkeys(("sugeno_lambda", "lambda"), lambda: sugeno_table(spec.get("densities", np.full(n, 1 / n)))),
        **dict.fromkeys(("two_additive", "2additive", "2-additive"), lambda: two_additive_table(spec["singletons"], spec["pairs"])),
        **dict.fromkeys(("capacity", "learned_capacity", "full_capacity"), lambda: spec["capacity_table"]),
    }
    if kind in tables:
        t = [float(c) for c in (spec["capacity_table"] if "capacity_table" in spec else tables[kind]())]
        if len(t) != 1 << n:
            raise ValueError("the capacity table does not fit the criteria")
        return [pick(k, lambda p: [t[sum(1 << i for i in p[j:])] for j in range(n)], 0.0) for k in range(n)]
    if kind in ("local_additive", "adaptive_additive") and not (mode in ("reliability", "snr") and (context or {}).keys() & {"weights", "raster"}):
        if mode == "softmax":
            top = F.greatest(*v) if n > 1 else v[0]
            z = [F.exp((u - top) * float(spec.get("temperature", 4.0))) for u in v]
        elif mode in ("evidence", "reliability", "snr"):
            z = [F.pow(u + float(spec.get("floor", 1e-3)), F.lit(float(spec.get("gamma", 1.0)))) for u in v]
        else:
            return None
        whole = F.greatest(sum(z, F.lit(0.0)), F.lit(EPS))
        return _tails([F.get(F.array(*[a / whole for a in z]), pick(k, lambda p: p, 0)) for k in range(n)])
    return None


def tail_masks(x: Column) -> Column:
    """Bit masks of the coalitions, for i = 1..n."""
    step = lambda a, p: F.struct((a["m"].bitwiseOR(F.expr("0L") + F.call_function("shiftleft", F.lit(1).cast("long"), p["i"]))).alias("m"), F.concat(F.array(a["m"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p["i"]))), a["all"]).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("m"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(F.reverse(ordered(x)), start, step, lambda a: a["all"])


def _lookup(x: Column, table: Sequence[float]) -> Column:
    t = F.lit([float(v) for v in table])
    return F.transform(tail_masks(x), lambda m: F.element_at(t, (m + 1).cast("int")))


@register_measure("sugeno_lambda", "lambda")
def _sugeno(x, n, spec, context):
    return _lookup(x, spec["capacity_table"] if "capacity_table" in spec else sugeno_table(spec.get("densities", np.full(n, 1 / n))))


@register_measure("two_additive", "2additive", "2-additive")
def _two_additive(x, n, spec, context):
    return _lookup(x, spec["capacity_table"] if "capacity_table" in spec else two_additive_table(spec["singletons"], spec["pairs"]))


@register_measure("capacity", "learned_capacity", "full_capacity")
def _capacity(x, n, spec, context):
    if len(spec["capacity_table"]) != 1 << n:
        raise ValueError("the capacity table does not fit the criteria")
    return _lookup(x, spec["capacity_table"])


# ---- arrays


def _array_q(x: np.ndarray, mode: str) -> np.ndarray:
    """``raw_q`` over the last axis."""
    x = np.clip(x, EPS, 1)
    n, s, p, mean = x.shape[-1], x.sum(-1), x.prod(-1), x.mean(-1)
    forms = {
        "max": lambda: x.max(-1),
        "min": lambda: x.min(-1),
        "prod": lambda: p,
        "mean": lambda: mean,
        "geomean": lambda: np.exp(np.log(x).mean(-1)),
        "harmmean": lambda: n / (1 / x).sum(-1),
        "lukasiewicz": lambda: np.maximum(s - (n - 1.0), 0),
        "hamacher": lambda: np.where(s - p > EPS, p / np.maximum(s - p, EPS), 0.0),
        "odiv": lambda: (p + x.min(-1)) / n,
        "dispersion": lambda: x.std(-1) / (mean + EPS),
    }
    return forms[mode]()


def array_tails(x: np.ndarray, spec: Mapping[str, Any], scale=None, label: str | None = None, context: Mapping[str, Callable] | None = None) -> np.ndarray:
    """``tail_capacities`` of arrays (..., n) for the kinds of ``registry``; ``context`` holds functions that give what it names."""
    spec, x, n = resolve(spec, scale, label), np.clip(x, 0, 1), x.shape[-1]
    kind, mode = str(spec.get("kind", "power")).lower(), str(spec.get("mode", "reliability")).lower()
    power = lambda q: ((n - np.arange(n)) / n) ** np.asarray(q, float)[..., None]
    order = np.argsort(x, axis=-1, kind="stable")
    if kind == "power":
        return power(np.full(x.shape[:-1], float(spec.get("q", 0.1))))
    if kind == "adaptive_power":
        q = context["dispersion"]() if mode == "dispersion" else _array_q(x, mode)
        return power(np.clip(q, float(spec.get("q_min", 0.02)), float(spec.get("q_max", 1.0))))
    if kind == "heterogeneity_power":
        z = context["heterogeneity"]()
        lo, hi = float(spec.get("q_min", 0.05)), float(spec.get("q_max", 1.0))
        return power(lo + (1 - z if spec.get("inverse") else z) * (hi - lo))
    if kind in ("additive", "local_additive"):
        if kind == "additive":
            w = np.broadcast_to(normalised_weights(spec["weights"]), x.shape)
        else:
            floor = float(spec.get("floor", 1e-3))
            if mode == "reliability":
                w = context["weights"](int(spec.get("window", 5)), floor)
            elif mode == "evidence":
                w = (x + floor) ** float(spec.get("gamma", 1.0))
            else:
                w = np.exp((x - x.max(-1, keepdims=True)) * float(spec.get("temperature", 4.0)))
            w = w / np.maximum(w.sum(-1, keepdims=True), EPS)
        return np.cumsum(np.take_along_axis(w, order, -1)[..., ::-1], -1)[..., ::-1]
    if "capacity_table" in spec:
        return np.asarray(spec["capacity_table"], float)[np.cumsum((1 << order)[..., ::-1], -1)[..., ::-1]]
    raise ValueError(f"no array form of the measure kind: {kind}")
