"""The training-data pipeline: five stages, each written and read again.

language     documents whose language the byte network cannot tell go (``und``, or hardly likelier than chance);
             a missing lang is filled with the predicted one
near copies  one document of each group of n-gram Jaccard links stays, the one with the smallest doc_id
leaks        passages of benchmark items are cut out; documents that are mostly such passages go
mixing       sources to target weights: documents are repeated, cut at a block's edge or left out
tokens       ids written under the range coder, read back and digested
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.common import materialize, private, settings, table
from rasterweave.llm.decontaminate import clean
from rasterweave.llm.jaccard import one_of_each
from rasterweave.llm.langid import UND, fit, fold, identify
from rasterweave.llm.mixing import mixed
from rasterweave.llm.tokenfile import encode_and_read

#: A document stays if its best language is this much likelier than chance (one in as many as were learned) at least.
OVER_CHANCE = 1.2


def settle(spark: SparkSession) -> None:
    """The pipeline's settings for its long texts: a stage's result is read and written by its caller, so they hold from here on; ``run`` puts
    the session's own back in the end."""
    for key, value in settings(spark).items():
        spark.conf.set(key, value)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; other rows are judged by their text alone, repeated ones alike; without any labelled
    row nothing can be told and all stay; further columns pass through under any names."""
    settle(spark)
    names = docs.columns
    network = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    if not network.labels:
        return docs
    lang, score = private(names, "lang", "score")
    told = identify(docs, network, keep=names, lang=lang, score=score)
    least = OVER_CHANCE / len(network.labels) if len(network.labels) > 1 else 0.0
    told = told.where((F.col(lang) != UND) & (F.col(score) >= least))
    return told.select(*[F.coalesce(F.col("lang"), F.col(lang)).alias(c) if c == "lang" else F.col(f"`{c}`") for c in names])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text: of linked ones (equal texts among them) one stays, whatever their ids, and unlinked ones all
    stay, those without words too; ties go to the smaller text hash and columns; names may be any."""
    settle(spark)
    return one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row by itself, repeated ids or not; null texts stay; without items all stay as they are; names may be any."""
    settle(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one id are documents of their own; a null source is a source; texts without words are never taken; names may be any."""
    settle(spark)
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, null ids first, rows of one id by a hash of their text; null texts hold the end id only; only doc_id and
    text are read."""
    settle(spark)
    return encode_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near copies", near_copies), ("leaks", leaks), ("mixing", mixing), ("tokens", tokens)]

#: The learned and coded stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = {key: spark.conf.get(key, None) for key in settings(spark)}
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        return docs
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
