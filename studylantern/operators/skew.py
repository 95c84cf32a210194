"""Joins whose fact side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_facts(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``facts`` (any number of rows per key) to ``dim`` (one row per key) with skew handling.

    Spark splits a hot partition of a sorted join only when both inputs come
    straight out of an exchange. A ``dim`` that was itself aggregated or joined
    on the key has none there, so the key's hash is added to the join keys:
    both sides are then exchanged on the longer key. That moves the small side
    once more and lets the hot partitions of the large side be split. Below
    the broadcast threshold nothing is exchanged at all.
    """
    tag = F.xxhash64(*keys).alias("_tag")
    tagged = facts.select("*", tag).join(dim.select("*", tag), [*keys, "_tag"], how)
    return tagged.drop("_tag")
