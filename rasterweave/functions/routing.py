"""Measures chosen by label in the plan: models as JSON, read as VARIANT into a map column.

A model is a JSON object (``{"kind": "power", "q": 0.4}``, ``{"kind": "additive", "weights": [...]}``).  Models by label are a map column of one row,
whose size is that of the models, not of the data; a row looks its label up in it, with a default, and takes the tail capacities of the model it finds.
So labels and models may come from tables, and no dictionary of the driver decides for a row.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measures import EPS, _suffix_sums, clip

MODEL = "struct<kind: string, q: double, weights: array<double>>"
DEFAULT = "default"


def models(table: DataFrame, label: str = "label", model: str = "model") -> DataFrame:
    """One row with ``models``: a map from label to model, from a table of labels and JSON texts.

    Texts that are no JSON, or no model of a known kind, are left out; of a label's models the last text in order counts."""
    v = F.try_parse_json(F.col(model))
    read = F.struct(
        F.lower(F.try_variant_get(v, "$.kind", "string")).alias("kind"),
        F.try_variant_get(v, "$.q", "double").alias("q"),
        F.try_variant_get(v, "$.weights", "array<double>").alias("weights"),
    )
    known = table.groupBy(F.col(label).alias("label")).agg(F.max(model).alias("text"))
    known = known.select("label", F.col("text").alias(model)).select("label", read.cast(MODEL).alias("model")).where("label IS NOT NULL")
    sound = lambda k, m: F.coalesce((m["kind"].isin("power", "symmetric_power") & (m["q"] > 0)) | (m["kind"].isin("additive", "weighted") & (F.size(m["weights"]) > 0)), F.lit(False))
    return known.agg(F.map_filter(F.map_from_entries(F.collect_list(F.struct("label", "model"))), sound).alias("models"))


def spec_map(specs: Mapping[str, Mapping[str, Any]]) -> Column:
    """A map column of constant models."""
    entries = [F.struct(F.lit(k).alias("key"), F.from_json(F.lit(json.dumps(dict(v))), MODEL).alias("value")) for k, v in sorted(specs.items())]
    return F.map_from_entries(F.array(*entries))


def override(base: Column, more: Column) -> Column:
    """``base`` with the models of ``more`` in place of its own (``map_concat`` would not take a label twice)."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def route(of: Column, label: Column) -> Column:
    """The model of a label, or of ``default``, or the power measure of exponent 0.1."""
    last = F.struct(F.lit("power").alias("kind"), F.lit(0.1).alias("q"), F.lit(None).cast("array<double>").alias("weights"))
    return F.coalesce(F.try_element_at(of, F.coalesce(label, F.lit(DEFAULT))), F.try_element_at(of, F.lit(DEFAULT)), last)


def routed_tails(x: Column, n: int, model: Column) -> Column:
    """Tail capacities of array column ``x`` under the row's own model; weights are cut or filled up with zeros to n."""
    x = F.transform(x, lambda v: clip(v))
    power = F.array(*[F.pow(F.lit((n - i) / n), model["q"]) for i in range(n)])
    w = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.coalesce(F.get(model["weights"], i), F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
    even = F.transform(w, lambda v: F.when(total > EPS, v / total).otherwise(1.0 / n))
    return F.when(model["kind"].isin("additive", "weighted"), _suffix_sums(x, n, even)).otherwise(power)


def routed_choquet(x: Column, n: int, model: Column) -> Column:
    """The Choquet integral of the row's descriptors under the row's model."""
    v = F.array_sort(F.transform(x, lambda e: clip(e)))
    steps = F.zip_with(F.transform(v, lambda e, i: e - F.when(i > 0, F.get(v, i - 1)).otherwise(0.0)), routed_tails(x, n, model), lambda d, m: d * m)
    return F.aggregate(steps, F.lit(0.0), lambda a, e: a + e)
