"""Running sums and ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an ordering column is cut into; their sums are one row each. Quantiles are right to a part in ACCURACY of the rows.
RANGES, ACCURACY = 1024, 10_000


def running(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum over the rows before in the order of a unique integer column.

    The column is cut at its quantiles into RANGES ranges of about as many rows, however its values are spread: sums within a
    range by a window a range, sums of the ranges before by a window over RANGES rows. Rows without a value come last, in any order.
    """
    quantiles = df.agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], ACCURACY)).first()[0] or [0]
    part = Bucketizer(splits=[-inf, *sorted({float(q) for q in quantiles}), inf], inputCol=order, outputCol="_part", handleInvalid="keep")
    cut = part.transform(df).withColumns({f"_{k}": v.cast("long") for k, v in sums.items()})
    parts = cut.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns({f"_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    out = cut.join(F.broadcast(parts), "_part")
    return out.withColumns({k: F.col(f"_{k}") + F.col(f"_b_{k}") for k in sums}).drop("_part", *[f"_{k}" for k in sums], *[f"_b_{k}" for k in sums])
