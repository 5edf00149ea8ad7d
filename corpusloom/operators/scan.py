"""Running sums and carried values along an order, without a group in one task.

Rows are dealt to ranges of (group, order), so a long group goes on over many ranges. Each range scans its own rows; its totals for a group, one narrow row, are then scanned along the group's ranges, and every row adds what the ranges before it carry. The rows' ranges are written with them, so that all steps see the same ones.

Defined results: rows that share group and order stay in one range and follow one another in the order given by ``order`` (make it total for a stated result); a null in a sum adds nothing, a null in a carried value leaves what was there; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.steps import written


def running(df: DataFrame, by: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (the sum up to this row, itself included) and ``lasts`` (the last non-null value up to this row), both along ``order`` within ``by``. ``ranges``: how many to deal, by default as many as Spark finds fit."""
    sums, lasts = sums or {}, lasts or {}
    valued = df.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()})
    dealt = valued.repartitionByRange(*([ranges] if ranges else []), by, *order)
    known = written(dealt.withColumn("_range", F.spark_partition_id()))
    totals = known.groupBy("_range", by).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums], *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.struct(*order))).alias(f"_l_{n}") for n in lasts], F.lit(1).alias("_one"))
    # a row for each group and range
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(totals.select(F.col("_range").alias("_r"), F.col(by).alias("_by"), *[F.sum(f"_s_{n}").over(before).alias(f"_cs_{n}") for n in sums], *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts]))
    own = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = known.withColumns({f"_s_{n}": F.sum(f"_s_{n}").over(own) for n in sums} | {f"_l_{n}": F.last(f"_l_{n}", ignorenulls=True).over(own) for n in lasts})
    joined = local.join(carried, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    zero = F.lit(0).cast("long")
    return joined.select(
        *df.columns, *[(F.coalesce(f"_s_{n}", zero) + F.coalesce(f"_cs_{n}", zero)).alias(n) for n in sums], *[F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in lasts]
    )
