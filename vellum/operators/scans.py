"""Running values within groups of any size: previous rows, sums and last set values, in two levels.

Rows are dealt by ranges of (group, order), so a group that holds a third of all rows is many tasks; each range is scanned on
its own, and what the ranges before it carry over is one row a group and range. Rows that tie in order stay in one range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.shared import written


def scan(rows: DataFrame, group: str, order: list[str], *, previous: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with `nth_is_first` (is it its group's first row?) and, by name: a column's value in the row before (null in the first), its
    sum so far, its last set value so far. Names must be new. A null group is a group."""
    previous, sums, lasts = previous or {}, sums or {}, lasts or {}
    values = {**{f"__p_{k}": v for k, v in previous.items()}, **{f"__s_{k}": v for k, v in sums.items()}, **{f"__l_{k}": v for k, v in lasts.items()}}
    cut = rows.withColumns(values) if values else rows
    cut = written(cut.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy(group, "__part").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"__n": F.row_number().over(here)}
    local |= {f"__p_{k}_here": F.lag(f"__p_{k}").over(here) for k in previous} | {f"__s_{k}_here": F.sum(f"__s_{k}").over(upto) for k in sums} | {f"__l_{k}_here": F.last(f"__l_{k}", ignorenulls=True).over(upto) for k in lasts}
    scanned = cut.withColumns(local)
    at = F.struct(*order)
    ends = cut.groupBy(group, "__part").agg(
        F.lit(True).alias("__any"), *[F.max_by(F.struct(F.col(f"__p_{k}").alias("v")), at).alias(f"__p_{k}") for k in previous], *[F.sum(f"__s_{k}").alias(f"__s_{k}") for k in sums],
        *[F.max_by(f"__l_{k}", F.when(F.col(f"__l_{k}").isNotNull(), at)).alias(f"__l_{k}") for k in lasts],
    )
    parts = Window.partitionBy(group).orderBy("__part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col(group).alias("__group"), F.col("__part").alias("__at"), (F.row_number().over(parts) > 1).alias("__later"), *[F.lag(f"__p_{k}").over(parts)["v"].alias(f"__p_{k}_before") for k in previous],
        *[F.sum(f"__s_{k}").over(before).alias(f"__s_{k}_before") for k in sums], *[F.last(f"__l_{k}", ignorenulls=True).over(before).alias(f"__l_{k}_before") for k in lasts],
    )
    both = scanned.join(carried, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    first = F.col("__n") == 1
    out = [*[F.col(f"`{c}`") for c in rows.columns], (first & ~F.col("__later")).alias("nth_is_first")]
    out += [F.when(first, F.col(f"__p_{k}_before")).otherwise(F.col(f"__p_{k}_here")).alias(k) for k in previous]
    out += [F.when(F.col(f"__s_{k}_here").isNotNull() | F.col(f"__s_{k}_before").isNotNull(), F.coalesce(f"__s_{k}_here", F.lit(0)) + F.coalesce(f"__s_{k}_before", F.lit(0))).alias(k) for k in sums]
    out += [F.coalesce(f"__l_{k}_here", f"__l_{k}_before").alias(k) for k in lasts]
    return both.select(*out)
