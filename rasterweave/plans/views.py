"""Views of the driver's tables as descriptors, rasters and labelled samples, in Spark and as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.information import exact_quantiles, scaled
from ..operators.storage import tasks

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with x: four descriptors in [0,1]."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", *LI_COLS)
    q = exact_quantiles(li, dict.fromkeys(LI_COLS, [0.01, 0.99]))
    return li.withColumn("x", F.array(*[F.round(scaled(F.col(c), *q[c]), 9) for c in LI_COLS]))


LI_SQL = "lq AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in LI_COLS) + " FROM lineitem), li AS (SELECT row_number() OVER () AS rid, lineitem.*, [" + ", ".join(f"round(CASE WHEN {c}_hi <= {c}_lo + 1e-12 THEN 0 ELSE least(1, greatest(0, ({c} - {c}_lo) / ({c}_hi - {c}_lo))) END, 9)" for c in LI_COLS) + "] AS x FROM lineitem, lq)"


def ev_img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, x, v: event value by user and day, one image for each event type, zero where nothing happened."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "value")
    day = F.dayofmonth("ts") - 1
    sums = e.groupBy(F.col("event_type").alias("img"), F.col("user_id").cast("int").alias("y"), day.alias("x")).agg(F.round(F.sum("value"), 6).alias("v"))
    # a line of an image is a row until the end; lines are merged, as their small files would let Spark send them all to the driver and every task
    lines = sums.where("x BETWEEN 0 AND 29").groupBy("img", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("days"))
    users = e.select(F.col("user_id").cast("int").alias("y")).distinct()
    kinds = e.select(F.col("event_type").alias("img")).distinct()
    grid = users.crossJoin(F.broadcast(kinds)).repartition(tasks(spark), "img", "y").join(lines.hint("merge"), ["img", "y"], "left")
    return grid.select("img", "y", "days", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("x")).select("img", "y", "x", F.coalesce(F.col("days")[F.col("x")], F.lit(0.0)).alias("v"))


EV_SQL = """ev AS (
  SELECT g.img, g.y, g.x, coalesce(s.v, 0.0) AS v FROM
  (SELECT img, y, x FROM (SELECT DISTINCT event_type AS img FROM events), (SELECT DISTINCT user_id::INTEGER AS y FROM events), (SELECT unnest(range(0, 30))::INTEGER AS x)) g
  LEFT JOIN (SELECT event_type AS img, user_id::INTEGER AS y, (day(ts) - 1)::INTEGER AS x, round(sum(value), 6) AS v FROM events GROUP BY ALL) s USING (img, y, x))"""


def emb8(spark: SparkSession, sf_dir: str, label: int = 0) -> DataFrame:
    """vec_id, x (first eight components in [0,1] by their percentiles), y (label is this one)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    q = exact_quantiles(e, {f"e{i}": [0.01, 0.99] for i in range(8)})
    return e.select("vec_id", "label", F.array(*[F.round(scaled(F.col(f"e{i}"), *q[f"e{i}"]), 9) for i in range(8)]).alias("x"), (F.col("label") == label).cast("double").alias("y"))


EMB_SQL = "eq AS (SELECT " + ", ".join(f"quantile_cont(embedding[{i + 1}]::DOUBLE, 0.01) AS lo{i}, quantile_cont(embedding[{i + 1}]::DOUBLE, 0.99) AS hi{i}" for i in range(8)) + " FROM embeddings), emb AS (SELECT vec_id, label, [" + ", ".join(f"round(CASE WHEN hi{i} <= lo{i} + 1e-12 THEN 0 ELSE least(1, greatest(0, (embedding[{i + 1}]::DOUBLE - lo{i}) / (hi{i} - lo{i}))) END, 9)" for i in range(8)) + "] AS x, (label = 0)::INTEGER::DOUBLE AS y FROM embeddings, eq)"


def doc_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (length of the text in thousands of characters), y (quality is 1), img (the language)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("img"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "img", (F.col("n_chars") / 1000.0).alias("score"), (F.col("quality") == 1).alias("y"))


DOC_SQL = "de AS (SELECT doc_id, lang AS img, n_chars / 1000.0 AS score, quality = 1 AS y FROM documents JOIN labels USING (doc_id))"
