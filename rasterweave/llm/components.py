"""Connected components of an edge table, by alternating large-star and small-star rounds.

Nothing but a row count reaches the driver.  Each round is written to the shared folder, so a lost executor
repeats one round at most.  Stars are aggregated before the shuffle, and a hub's edges are only mapped,
never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, tidy

SCHEMA = "u long, v long"


def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's edges as stars around the smallest node of a component, by union-find."""
    for f in frames:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for u, v in zip(f["u"].tolist(), f["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        out = pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}, dtype="int64")
        yield out[out["u"] != out["v"]]
    tidy()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with v < u."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:  # neighbours above u move to the least of u's neighbourhood
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # neighbours below u, and u, move to the least of them
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """u, v: each node that has an edge, but its component's smallest, with that smallest."""
    edges = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now = materialize(edges.mapInPandas(contract, SCHEMA).distinct(), "stars")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            return now
        before, last = state, now
        now = materialize(_star(_star(last, True), False), "stars")
        release(last)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
