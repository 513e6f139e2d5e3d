"""Learning capacities: distributed sufficient statistics, small convex programs on the driver.

Every learner is least squares in the capacity's parameters, so the data enter by one aggregate (a Gram matrix); its
size depends on the number of criteria only.  The programs are solved by operator splitting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from .information import clip01, finite
from .ordering import laid_out


FEW = 12  # columns of a design whose products are summed in one aggregate
MOST = 12  # criteria of a full capacity


def clean(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with finite descriptors and target; descriptors in [0,1]."""
    ok = F.forall(x, finite) & finite(F.col(y))
    return df.where(ok).withColumn(x, F.transform(x, clip01))


def balanced_sample(df: DataFrame, x: str = "x", y: str = "y", max_samples: int = 20_000, seed: int = 0, by: Sequence[str] = (), key: str = "id") -> DataFrame:
    """As many positives as negatives, at most max_samples / 2 of each (of each group), in the order of a hash of ``key``.

    A group without both classes gives up to max_samples of what it has.
    """
    df = clean(df, x, y).withColumn("_pos", F.col(y) >= 0.5)
    n = df.groupBy(*by).agg(F.count_if("_pos").alias("_p"), F.count_if(~F.col("_pos")).alias("_n"))
    each = F.least("_p", "_n", F.lit(max_samples // 2))
    n = n.select(*by, F.when(each > 0, each).otherwise(max_samples).alias("_each"))
    df = df.join(n, list(by)) if by else df.crossJoin(F.broadcast(n))  # one row
    # a class may be most of the table: places come from ranges of the hash
    placed = laid_out(df.withColumn("_order", F.xxhash64(F.lit(seed), key)), [*by, "_pos"], ["_order", key])
    return placed.where("_before < _each").drop("_before", "_all", "_order", "_each", "_pos")


def reliability(df: DataFrame, n: int, x: str = "x", y: str = "y", floor: float = 0.02) -> DataFrame:
    """i, weight: how far a descriptor's mean rises with the target, by its spread; weights sum to one."""
    pos = F.col(y) >= 0.5
    long = df.select(pos.alias("p"), F.posexplode(x).alias("i", "v"))
    s = long.groupBy("i").agg(*[f(F.when(c, F.col("v"))).alias(a) for c, k in ((F.col("p"), "p"), (~F.col("p"), "n")) for f, a in ((F.avg, "m" + k), (F.stddev_pop, "s" + k))])
    effect = F.greatest(F.greatest(F.col("mp") - F.col("mn"), F.lit(0.0)) / (0.5 * (F.col("sp") + F.col("sn")) + 0.05), F.lit(floor))
    one_class = F.col("mp").isNull() | F.col("mn").isNull()
    e = s.select("i", F.when(one_class, 1.0).otherwise(effect).alias("e"))
    return e.select("i", (F.col("e") / F.sum("e").over(Window.partitionBy())).alias("weight"))  # n rows


def reliability_weights(df: DataFrame, n: int, x: str = "x", y: str = "y", floor: float = 0.02) -> np.ndarray:
    return np.array([r.weight for r in reliability(df, n, x, y, floor).orderBy("i").collect()])


def gram(df: DataFrame, design: Sequence[Column], y: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """(D'D / m, D'y / m, m) over the rows without nulls: sums of products in one aggregate where they are few; else each task multiplies
    its rows in NumPy, and the tasks' sums are added up."""
    p = len(design)
    d = df.select(F.array(*design, y.cast("double")).alias("d")).where(~F.exists("d", lambda v: v.isNull()))
    if p <= FEW:
        at = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
        r = d.agg(F.count(F.lit(1)), *[F.sum(F.col("d")[i] * F.col("d")[j]) for i, j in at]).first()
        g = np.zeros((p + 1, p + 1))
        for (i, j), s in zip(at, r[1:], strict=True):
            g[i, j] = g[j, i] = s or 0.0
        g /= max(r[0], 1)
        return g[:p, :p], g[:p, p], r[0]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((p + 1, p + 1)), 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, p + 1)
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange((p + 1) ** 2), p + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), n))], names=["i", "j", "s"])

    g = np.zeros((p + 1, p + 1))
    size = 0
    for r in d.mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (p + 1)**2 + 1 rows
        if r.i < 0:
            size = int(r.s)
        else:
            g[r.i, r.j] = r.s
    g /= max(size, 1)
    return g[:p, :p], g[:p, p], size


def sparse_gram(df: DataFrame, n: int, x: str = "x", y: str = "y") -> tuple[np.ndarray, np.ndarray, int]:
    """The Gram matrix of the Choquet integral's coefficients by coalition (masks 1..2**n - 2), the full coalition's part taken from y.

    A row touches n coalitions, so its n**2 products are exploded and summed before the shuffle.
    """
    full = (1 << n) - 1
    v = F.transform(M.ordered(F.col(x)), lambda p: p["v"])
    s = df.select(F.col(y).cast("double").alias("y"), v.alias("v"), M.tail_masks(F.col(x)).alias("m"))
    delta = F.transform("v", lambda a, i: a - F.when(i > 0, F.get("v", i - 1)).otherwise(0.0))
    s = s.select("y", F.filter(F.arrays_zip(F.col("m").alias("m"), delta.alias("d")), lambda t: t["d"] != 0).alias("t"))
    base = F.aggregate("t", F.lit(0.0), lambda a, t: a + F.when(t["m"] == full, t["d"]).otherwise(0.0))
    s = s.select((F.col("y") - base).alias("r"), F.filter("t", lambda t: t["m"] != full).alias("t"))
    size = s.count()
    pairs = s.select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b")).groupBy(F.col("a.m").alias("i"), F.col("b.m").alias("j")).agg(F.sum(F.col("a.d") * F.col("b.d")).alias("s"))
    g, c = np.zeros((full - 1, full - 1)), np.zeros(full - 1)
    got = pairs.toArrow()  # at most 2**(2n) rows, n <= MOST
    g[got.column(0).to_numpy() - 1, got.column(1).to_numpy() - 1] = got.column(2).to_numpy() / max(size, 1)
    for r in s.select("r", F.explode("t").alias("a")).groupBy(F.col("a.m").alias("i")).agg(F.sum(F.col("a.d") * F.col("r")).alias("s")).collect():
        c[r.i - 1] = r.s / max(size, 1)
    return g, c, size


def solve(g: np.ndarray, c: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, iterations: int = 4000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(z, multipliers): min z'gz/2 - c'z with lo <= az <= hi, by operator splitting (ADMM) with a step that adapts."""
    rho, z = 1.0, start.copy()
    w, u = np.clip(a @ z, lo, hi), np.zeros(len(a))
    ata, eye = a.T @ a, np.eye(len(z)) * 1e-9
    inverse = np.linalg.inv(g + rho * ata + eye)
    for k in range(iterations):
        z = inverse @ (c + a.T @ (rho * w - u))
        az = a @ z
        old, w = w, np.clip(az + u / rho, lo, hi)
        u = u + rho * (az - w)
        primal, dual = np.abs(az - w).max(), rho * np.abs(a.T @ (w - old)).max()
        if primal < tol and dual < tol:
            break
        if k % 50 == 49 and not 0.1 < primal / max(dual, 1e-15) < 10:
            rho = float(np.clip(rho * np.sqrt(primal / max(dual, 1e-15)), 1e-6, 1e6))
            inverse = np.linalg.inv(g + rho * ata + eye)
    return z, u


def solve_lazily(g: np.ndarray, c: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, violated: Callable[[np.ndarray, int], np.ndarray], most: int = 512, rounds: int = 200, tol: float = 1e-8, **options: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, multipliers, rows): as ``solve`` with further rows that must not fall below zero, of which only those that a solution breaks are
    put in: ``violated(z, most)`` makes the ones broken most, and where it makes none, the solution is the whole program's."""
    rows = np.zeros((0, len(z0 := start)))
    for _ in range(rounds):
        z, u = solve(g, c, np.vstack([a, rows]), np.concatenate([lo, np.zeros(len(rows))]), np.concatenate([hi, np.full(len(rows), np.inf)]), z0, **options)
        new = violated(z, most)
        new = new[new @ z < -tol] if len(new) else new
        if len(rows) and len(new):  # a row that is there already is broken within the solver's tolerance only
            have = {r.tobytes() for r in rows}
            new = new[[r.tobytes() not in have for r in new]]
        if not len(new):
            break
        rows, z0 = np.vstack([rows, new]), z
    return z, u, rows


def learn_additive(df: DataFrame, n: int, x: str = "x", y: str = "y", ridge: float = 1e-4) -> dict[str, Any]:
    """Weights on the simplex."""
    first = reliability_weights(df, n, x, y)
    g, c, _ = gram(df, [F.col(x)[i] for i in range(n)], F.col(y))
    a = np.vstack([np.eye(n), np.ones((1, n))])
    lo, hi = np.append(np.zeros(n), 1.0), np.append(np.ones(n), 1.0)
    w = np.clip(solve(g + ridge * np.eye(n), c + ridge / n, a, lo, hi, first)[0], 0, None)
    w /= max(w.sum(), M.EPS)
    return {"kind": "additive", "weights": w.tolist(), "capacity_table": M.additive_table(w).tolist(), "fit_success": True}


def two_additive_broken(n: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """Monotonicity of a 2-additive capacity: a criterion's own weight and its pair weights with any set of others do not fall below zero.

    Of a criterion's 2**(n - 1) rows the one with all negative pair weights is broken most, so n rows tell whether any is."""
    pairs = {p: n + k for k, p in enumerate(combinations(range(n), 2))}

    def broken(z: np.ndarray, most: int) -> np.ndarray:
        rows = np.zeros((n, n + len(pairs)))
        for i in range(n):
            rows[i, i] = 1
            for j in range(n):
                if j != i and z[pairs[min(i, j), max(i, j)]] < 0:
                    rows[i, pairs[min(i, j), max(i, j)]] = 1
        return rows

    return broken


def _report(kind: str, table: np.ndarray, **more: Any) -> dict[str, Any]:
    return {"kind": kind, "capacity_table": table.tolist(), "shapley": M.shapley(table).tolist(), "interaction": M.interaction(table).tolist(), **more}


def learn_two_additive(df: DataFrame, n: int, x: str = "x", y: str = "y", ridge: float = 1e-4) -> dict[str, Any]:
    pairs = list(combinations(range(n), 2))
    design = [F.col(x)[i] for i in range(n)] + [F.least(F.col(x)[i], F.col(x)[j]) for i, j in pairs]
    g, c, _ = gram(df, design, F.col(y))
    p = n + len(pairs)
    g[n:, n:] += ridge * np.eye(len(pairs))
    a = np.vstack([np.eye(p), np.ones((1, p))])
    lo, hi = np.concatenate([np.zeros(n), -np.ones(len(pairs)), [1.0]]), np.ones(p + 1)
    first = np.append(reliability_weights(df, n, x, y), np.zeros(len(pairs)))
    z, _, _ = solve_lazily(g, c, a, lo, hi, first, two_additive_broken(n))
    single, matrix = np.maximum(z[:n], 0), np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        matrix[i, j] = matrix[j, i] = z[n + k]
    table = M.two_additive_table(single, matrix)
    ok = M.is_capacity(table, 5e-6)
    if not ok:  # keep what surely is one: singletons and positive pairs
        matrix = np.maximum(matrix, 0)
        table = M.two_additive_table(single, matrix)
    return _report("two_additive", table, singletons=single.tolist(), pairs=matrix.tolist(), fit_success=bool(ok))


def full_broken(n: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """Differences along the lattice's inner edges, over masks 1..2**n - 2, that fall below zero; the worst ones first."""
    full = (1 << n) - 1
    low = np.array([m for i in range(n) for m in range(1, full) if not m >> i & 1 and m | 1 << i != full])
    high = np.array([m | 1 << i for i in range(n) for m in range(1, full) if not m >> i & 1 and m | 1 << i != full])

    def broken(z: np.ndarray, most: int) -> np.ndarray:
        gap = z[high - 1] - z[low - 1]
        worst = np.argsort(gap, kind="stable")[:most]
        worst = worst[gap[worst] < 0]
        rows = np.zeros((len(worst), full - 1))
        rows[np.arange(len(worst)), high[worst] - 1] = 1
        rows[np.arange(len(worst)), low[worst] - 1] = -1
        return rows

    return broken


def learn_full(df: DataFrame, n: int, x: str = "x", y: str = "y", ridge: float = 5e-4, prior_q: float = 0.1) -> dict[str, Any]:
    """A full capacity; of the n * 2**(n - 1) edges of the lattice only those that a solution breaks become rows of the program."""
    if n > MOST:
        raise ValueError(f"a full capacity is learned over {MOST} criteria at most")
    g, c, _ = sparse_gram(df, n, x, y)
    p = len(c)
    prior = np.array([(m.bit_count() / n) ** prior_q for m in range(1, p + 1)])
    z, _, rows = solve_lazily(g + ridge / p * np.eye(p), c + ridge / p * prior, np.eye(p), np.zeros(p), np.ones(p), prior, full_broken(n))
    table = np.concatenate([[0.0], np.clip(z, 0, 1), [1.0]])
    for m in range(1, p + 1):  # level what the solver's tolerance left
        table[m] = max(table[m], *(table[m & ~(1 << i)] for i in range(n) if m >> i & 1))
    return _report("full_capacity", table, fit_success=M.is_capacity(table, 1e-8), n_edges=len(rows))


def learn_sugeno(df: DataFrame, n: int, x: str = "x", y: str = "y", target_sum: float = 0.7) -> dict[str, Any]:
    g = np.clip(reliability_weights(df, n, x, y) * target_sum, 1e-5, 0.95)
    return _report("sugeno_lambda", M.sugeno_table(g), densities=g.tolist(), target_sum=float(target_sum))


def learned_specs(df: DataFrame, n: int, x: str = "x", y: str = "y", scale: str | None = None, context: str | None = None, sums: Sequence[float] = (0.6, 0.8, 1.0, 1.2, 1.4)) -> dict[str, dict[str, Any]]:
    """Global measures, and banks by scale and by context where those columns are given."""
    out: dict[str, dict[str, Any]] = {"additive_learned": learn_additive(df, n, x, y)}
    out |= {f"sugeno_sum{s:g}": learn_sugeno(df, n, x, y, s) for s in sums}
    out["two_additive_learned"] = learn_two_additive(df, n, x, y)
    if n <= MOST:
        out["full_learned"] = learn_full(df, n, x, y)
    for column, kind in ((scale, "scale_router"), (context, "context_router")):
        if column:
            keys = [r[0] for r in df.select(F.col(column).cast("string")).distinct().orderBy(column).collect()]
            part = lambda k, c=column: df.where(F.col(c).cast("string") == k)
            out[f"additive_by_{column}"] = {"kind": kind, "measures": {k: learn_additive(part(k), n, x, y) for k in keys}, "default": out["additive_learned"]}
            out[f"two_additive_by_{column}"] = {"kind": kind, "measures": {k: learn_two_additive(part(k), n, x, y) for k in keys}, "default": out["two_additive_learned"]}
    return out


def interpretability(specs: dict[str, dict[str, Any]], names: Sequence[str]) -> list[tuple[str, str, str | None, float]]:
    """(measure, feature, partner or None, value): Shapley values and pair interactions."""
    out = []
    for k, s in specs.items():
        out += [(k, names[i], None, v) for i, v in enumerate(s.get("shapley", []))]
        m = s.get("interaction", [])
        out += [(k, names[i], names[j], m[i][j]) for i in range(len(m)) for j in range(i + 1, len(m))]
    return out


def fit_centroids(df: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(label and mean of each standardised feature, one row of means and spreads)."""
    scale = df.agg(*[f(c).alias(f"{a}_{c}") for c in features for f, a in ((F.avg, "m"), (F.stddev_pop, "s"))])
    z = standardise(df, scale, features)
    return z.groupBy(label).agg(*[F.avg(f"z_{c}").alias(f"c_{c}") for c in features]), scale


def standardise(df: DataFrame, scale: DataFrame, features: Sequence[str]) -> DataFrame:
    d = df.crossJoin(F.broadcast(scale))  # one row
    return d.withColumns({f"z_{c}": (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8) for c in features}).drop(*[f"{a}_{c}" for c in features for a in "ms"])


def nearest_centroid(df: DataFrame, key: str, label: str, centroids: DataFrame, scale: DataFrame, features: Sequence[str]) -> DataFrame:
    """key, label of the nearest centroid; ties go to the first label."""
    packed = centroids.agg(F.sort_array(F.collect_list(F.struct(label, F.array(*[f"c_{c}" for c in features]).alias("c")))).alias("all"))  # a row of labels
    z = standardise(df, scale, features).crossJoin(F.broadcast(packed)).withColumn("z", F.array(*[f"z_{c}" for c in features]))
    gap = lambda c: F.aggregate(F.zip_with(F.col("z"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("all", lambda t: F.struct(gap(t["c"]).alias("d"), t[label].alias("l"))))
    return z.select(key, best["l"].alias("predicted"), best["d"].alias("distance"))
