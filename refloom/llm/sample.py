"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample_ids(ids: DataFrame, most: int, column: str = "doc_id") -> DataFrame:
    """At most ``most`` rows in the order of a hash of the id: a uniform sample that does not depend on partitions."""
    return ids.orderBy(F.xxhash64(F.col(column)), F.col(column)).limit(most)


def with_sample(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Documents of a bounded sample.  The sample is broadcast: its bound is the caller's row limit."""
    return docs.join(F.broadcast(ids), column)
