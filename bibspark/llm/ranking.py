"""Exact ranks and running sums of all rows within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


def rank_within(df: DataFrame, group: str | None, order: list) -> DataFrame:
    """Adds rank (long, from 1) of each row in its group by the order.

    Rows are dealt by range of (group, order), so a group of a third of all rows spans a third of the partitions;
    the table is written with its partition numbers. Then only counts per partition and group are summed up, and
    each part is numbered by itself. Pass narrow tables: the rows are shuffled twice."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_last()] if group else []
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt.withColumn("_group", F.xxhash64(F.col(group)) if group else F.lit(0).cast("long")))
    counts = dealt.groupBy("_group", "_part").agg(F.count("*").alias("_count"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_group", "_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_group", "_part").orderBy(*order)
    numbered = dealt.withColumn("_own", F.row_number().over(own))
    return numbered.join(offsets, ["_group", "_part"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_group", "_part", "_own", "_before")


def sums_before(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds, by name, the sum of a column over all rows that come earlier in the order (a total one), and `all_<name>`, the sum
    over all rows. Rows are dealt by range; only sums per partition are summed up in one place."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    kind = "decimal(38,0)"
    each = dealt.groupBy("_part").agg(*[F.sum(F.col(c).cast(kind)).alias(f"_{n}") for n, c in sums.items()])
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = each.select("_part", *[F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).cast(kind).alias(f"_{n}") for n in sums], *[F.sum(f"_{n}").over(whole).cast(kind).alias(f"all_{n}") for n in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(F.col(c).cast(kind)).over(own), F.lit(0)).alias(n) for n, c in sums.items()]).join(offsets, "_part")
    for n in sums:
        out = out.withColumn(n, (F.col(n) + F.col(f"_{n}")).cast(kind)).drop(f"_{n}")
    return out.drop("_part")
