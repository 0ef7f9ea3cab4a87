"""Running sums, maxima and places inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sigloom.operators.rounds import settle


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], of=F.sum) -> DataFrame:
    """rows with the sums (or maxima, by ``of``) over their group's rows up to and with each, in ``order``.

    Rows are laid out by ranges of group and order, so a large group lies in many parts.  The
    layout is settled with its part number; totals per part (one row each) say what lies
    ahead of a part, and only inside a part are rows summed in order.  Null is a group.
    """
    laid = rows.withColumns({f"_{n}": c for n, c in sums.items()})
    laid = settle(laid.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = laid.groupBy(*by, "_part").agg(*[of(f"_{n}").alias(f"_t{n}") for n in sums])
    ahead = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_at"), *[of(f"_t{n}").over(before).alias(f"_a{n}") for n in sums])
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = laid.withColumns({f"_i{n}": of(f"_{n}").over(inside) for n in sums})
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    both = lambda n: F.col(f"_i{n}") + F.coalesce(F.col(f"_a{n}"), F.lit(0)) if of is F.sum else F.greatest(f"_i{n}", f"_a{n}")
    return summed.join(ahead, same).select(*rows.columns, *[both(n).alias(n) for n in sums])
