"""Dense 0-based positions without putting a whole table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import local_frame, materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def dense_positions(
    df: DataFrame,
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    out: str = "row_id",
) -> DataFrame:
    """Add the 0-based position of every row in ``order_by`` order within its group.

    The rows are range partitioned on (group, order, arrival number) - the last one splits runs of
    equal keys - and written once; positions are then (offset of the partition) + (place in the
    partition), minus the first position of the group. No group, however hot, is held by one task.
    """
    order_by, group_by = list(order_by), list(group_by)
    tagged = df.withColumn("_arrival", F.monotonically_increasing_id())
    sort_keys = [*group_by, *order_by, "_arrival"]
    ordered = (
        tagged.repartitionByRange(*[F.col(k) for k in sort_keys])
        .sortWithinPartitions(*sort_keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
        .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1))
        .drop("_mid", "_arrival")
    )
    stored = materialize(ordered, "positions")
    # one row per shuffle partition of the write above, so the size is known and small
    sizes = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    offset_df = local_frame(df.sparkSession, offsets, "_part long, _offset long")
    placed = stored.join(offset_df, "_part").withColumn(out, F.col("_offset") + F.col("_local"))
    placed = placed.drop("_part", "_local", "_offset")
    if not group_by:
        return placed
    # written, so that both sides of the join are plain tables and hot groups are split
    first = materialize(placed.groupBy(*group_by).agg(F.min(out).alias("_first")), "first")
    keys = {g: f"_first_{g}" for g in group_by}  # null is a group like any other
    first = first.withColumnsRenamed(keys)
    joined = placed.join(first, [placed[g].eqNullSafe(first[k]) for g, k in keys.items()])
    return joined.withColumn(out, F.col(out) - F.col("_first")).drop("_first", *keys.values())


#: Rows of a group up to which one task numbers it.
GROUP_ROWS = 100_000


def group_positions(
    df: DataFrame, order_by: Sequence[str], group_by: Sequence[str], out: str = "row_id", most: int = GROUP_ROWS
) -> DataFrame:
    """:func:`dense_positions` in many groups. Groups of up to ``most`` rows are numbered after one shuffle by their key,
    which a join on that key can use as well; only larger ones are range partitioned and written."""
    keys = {g: f"_large_{g}" for g in group_by}
    sizes = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.filter(F.col("_n") > most).select(*[F.col(g).alias(k) for g, k in keys.items()]), "large-groups")
    window = Window.partitionBy(*group_by).orderBy(*order_by)
    place = F.row_number().over(window).cast("long") - 1
    if large.isEmpty():
        return df.withColumn(out, place)
    same = [df[g].eqNullSafe(large[k]) for g, k in keys.items()]
    few = df.join(F.broadcast(large), same, "left_anti").withColumn(out, place)
    return few.unionByName(dense_positions(df.join(F.broadcast(large), same, "left_semi"), order_by, group_by, out))


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A seeded pseudo-random sort key that depends only on the row's own key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
