"""Positions in a sorted order without putting a group, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.plans.runtime import cut, spread

_LOCAL = (1 << 33) - 1


def global_positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row under ``order`` (columns must make the order total).

    Range partitioning splits even a hot group over tasks; each task numbers its own rows and a
    table of per-partition counts (one row per partition) supplies the offset.
    """
    tagged = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = cut(tagged).df
    pid = F.shiftright(F.col("_mid"), 33)
    counts = placed.groupBy(pid.alias("pid")).count().collect()  # one row per partition
    base, acc = [], 0
    for r in sorted(counts, key=lambda r: r["pid"]):
        base.append((int(r["pid"]), acc))
        acc += int(r["count"])
    if not base:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_mid")
    offsets = df.sparkSession.createDataFrame(base, "_pid long, _base long")
    return (
        placed.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_base") + F.col("_mid").bitwiseAND(F.lit(_LOCAL)))
        .drop("_pid", "_base", "_mid")
    )


def positions_within(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row inside its group; safe for groups larger than one task."""
    ranked = spread(global_positions(df, group + order, "_gpos"))
    starts = ranked.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group]).agg(F.min("_gpos").alias("_start"))
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    return ranked.join(starts, on).select(*df.columns, (F.col("_gpos") - F.col("_start")).alias(name))


def running_sum(df: DataFrame, group: list[str], pos: str, value: str, most: int, name: str = "run", bits: int = 12) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to ``pos`` (unique, 0 to ``most``), block by block.

    A window never holds more than 2**``bits`` rows, so a group that has very many rows is shared by many tasks.
    """
    frame = Window.partitionBy(*group, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_block", F.shiftright(pos, bits)).withColumn(name, F.sum(value).over(frame))
    if most < 1 << bits:
        return local.drop("_block")
    blocks = local.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    carried = running_sum(blocks, group, "_block", "_sum", most >> bits, "_carry", bits)
    carried = carried.select(*group, "_block", (F.col("_carry") - F.col("_sum")).alias("_carry"))
    return local.join(carried, [*group, "_block"]).select(*df.columns, (F.col(name) + F.col("_carry")).alias(name))
