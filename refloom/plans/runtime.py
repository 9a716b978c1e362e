"""Durable cut points for iterative plans and size-checked broadcasts.

Every iterative operator is a driver loop whose state lives in reliable checkpoints, so a lost
executor never loses an iteration.  The checkpoint folder is the one the cluster names in
``spark.checkpoint.dir``; a scratch folder is used only when that is unset and Spark runs in one process.
"""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured payload is below this bound.
BROADCAST_BYTES = 32 * 1024 * 1024
# Level tables are folded into one checkpoint when a traversal gets this deep.
MAX_UNION_PARTS = 24


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not re.match(r"local($|\[)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """Data that no join may broadcast, however small Spark takes it for.

    Estimates start from the size of compressed files and follow the widths of column types, so rows made from documents are
    taken for a few KB, and checkpoints inherit that.  The hint holds up to the next join, aggregates included.
    """
    return df.hint("merge")


@dataclass(frozen=True)
class Cut:
    """A checkpointed DataFrame with the row count and payload measured while writing it; never broadcast beyond the bound."""

    df: DataFrame
    rows: int
    nbytes: int

    @property
    def empty(self) -> bool:
        return self.rows == 0

    def hinted(self) -> DataFrame:
        """The data with a broadcast hint, only if its measured size is within the bound."""
        return F.broadcast(self.df) if self.nbytes <= BROADCAST_BYTES else self.df


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Measured size of a value; only maps and arrays of compound elements are written out as text for it."""
    zero = F.lit(0)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), zero) + 8
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.size(c), zero) * 8 + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.coalesce(F.octet_length(F.concat_ws("", c)), zero) + F.coalesce(F.size(c), zero) * 8 + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda x, y: x + y, [_bytes(c.getField(f.name), f.dataType) for f in kind.fields], F.lit(8))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        # elements are measured; the text form is longer than the binary one
        return F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("v")))), zero) + 48
    if isinstance(kind, T.VariantType):
        return F.lit(1 << 20)  # not measured, hence never within the broadcast bound
    return F.lit(8)


def _payload(df: DataFrame) -> Column:
    parts = [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return F.sum(reduce(lambda a, b: a + b, parts, F.lit(16)).cast("long"))


def cut(df: DataFrame) -> Cut:
    """Checkpoint ``df`` in one job, counting rows and bytes on the way."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), _payload(df).alias("nbytes"))
    out = observed.checkpoint(eager=True)
    got = seen.get
    rows, nbytes = int(got["rows"]), int(got["nbytes"] or 0)
    return Cut(out if nbytes <= BROADCAST_BYTES else spread(out), rows, nbytes)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


class Levels:
    """The append-only history of a traversal: one checkpoint per level, folded when long."""

    def __init__(self) -> None:
        self._parts: list[Cut] = []

    def add(self, part: Cut) -> None:
        self._parts.append(part)
        if len(self._parts) >= MAX_UNION_PARTS:
            self._parts = [cut(union_all([p.df for p in self._parts]))]

    @property
    def nbytes(self) -> int:
        return sum(p.nbytes for p in self._parts)

    def frame(self) -> DataFrame:
        df = union_all([p.df for p in self._parts])
        return df if self.nbytes <= BROADCAST_BYTES else spread(df)

    def hinted(self) -> DataFrame:
        df = self.frame()
        return F.broadcast(df) if self.nbytes <= BROADCAST_BYTES else df

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self._parts)


def join_frontier(frontier: Cut, edges: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join a traversal frontier with the edge table without shuffling the edges if it is small."""
    return edges.join(frontier.hinted(), on, how)


def cached(df: DataFrame) -> DataFrame:
    """Keep a reused input on executors (memory, spilling to disk; recomputed if one is lost)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def session_tuning(builder: SparkSession.Builder, cores: int = 8) -> SparkSession.Builder:
    """Settings used by the tests and the benchmark on one machine."""
    return (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
