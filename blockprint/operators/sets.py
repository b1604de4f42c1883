"""Set operations on digests: rows are compared by their normal digest, so raw forms of one digest are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame

from blockprint.operators.joins import distinct_digests


def distinct(df: DataFrame, digest: str = "digest") -> DataFrame:
    """digest: the different normal digests of df."""
    return distinct_digests(df, digest).select("h").toDF("digest")


def union(a: DataFrame, b: DataFrame, digest: str = "digest") -> DataFrame:
    return distinct(a, digest).union(distinct(b, digest)).distinct()


def intersect(a: DataFrame, b: DataFrame, digest: str = "digest") -> DataFrame:
    return distinct_digests(a, digest).join(distinct_digests(b, digest).select("key"), "key", "left_semi").select("h").toDF("digest")


def subtract(a: DataFrame, b: DataFrame, digest: str = "digest") -> DataFrame:
    return distinct_digests(a, digest).join(distinct_digests(b, digest).select("key"), "key", "left_anti").select("h").toDF("digest")
