"""Joins and ranks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, parts: int = 32) -> DataFrame:
    """Keys that hold more than ``1/parts`` of the rows of ``df``: at most ``parts`` rows by counting.

    The count is combined before the shuffle, so the hot keys themselves cost nothing extra.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (
        per_key.join(F.broadcast(total), F.col("_n") * parts > F.col("_total"))
        .select(key)
    )


def salted_join(fact: DataFrame, dim: DataFrame, key: str, spread: Column, how: str = "inner",
                salts: int = 16, parts: int = 32) -> DataFrame:
    """Join ``fact`` to ``dim`` on ``key``; rows of hot keys are spread over ``salts`` reducers.

    ``dim`` has one row per key (or few); only its rows of hot keys are replicated. ``spread`` is a
    column of ``fact`` that differs between rows of one key. ``parts`` bounds the number of hot keys,
    and with it the broadcast list of them. Null keys join nothing, as in SQL.
    """
    hot = F.broadcast(hot_keys(fact.where(F.col(key).isNotNull()), key, parts).withColumn("_hot", F.lit(True)))
    salted = fact.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    copies = dim.join(hot, key, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    ).drop("_hot")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
