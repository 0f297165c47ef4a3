"""Ranks and running sums over a global order, without one task that holds all rows or all of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import materialise


def running(rows: DataFrame, group: list[str], order: list[str], value: str | None, name: str) -> DataFrame:
    """rows and `name`: the sum of `value` (None: the count) over the rows of the same group that come before, in order.

    Rows are dealt by ranges of group and order, so that a large group spans many tasks; each task's totals, a row for
    each group in it, give the others their start. Nulls come first. Rows equal in order count in any sequence.
    """
    keys = [*group, *order]
    dealt = rows.repartitionByRange(*keys) if keys else rows
    dealt = materialise(dealt.withColumn("_task", F.spark_partition_id()), "dealt")
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    totals = dealt.groupBy(*group, "_task").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_task", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_own", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    on = [summed[k].eqNullSafe(totals[k]) for k in [*group, "_task"]]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return summed.join(totals, cond).select(*[summed[c] for c in rows.columns], (F.col("_own") + F.col("_start")).alias(name))
