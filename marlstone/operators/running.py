"""Running sums and places over a whole relation, without one task that sees all rows.

Rows are dealt to ranges of the order and written, so that a row keeps its range. Each range adds up what it has; the
sums before a range, one number for each, are its offset, and inside a range an ordinary window runs. The order should tell rows apart:
rows that tie in all of it share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.workspace import materialize


def running_sum(df: DataFrame, value: Column | str, name: str, *order: Column | str, parts: int | None = None) -> DataFrame:
    """df with the sum of value (a whole number or null) over the rows up to each, itself included; ties in the order are broken somehow."""
    taken = {c.lower() for c in df.columns} | {name.lower()}
    part, own = (next(n for k in range(len(taken) + 2) if (n := stem + "_" * k) not in taken) for stem in ("range", "addend"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = tuple(F.col(o) if isinstance(o, str) else o for o in order)
    added = df.withColumn(own, F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast("long"))
    dealt = materialize(added.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "running")
    totals = dealt.groupBy(part).agg(F.sum(own).alias("total"))
    # as many numbers as there are ranges
    each = totals.agg(F.array_sort(F.collect_list(F.struct(F.col(part), "total"))).alias("all"))
    before = F.transform("all", lambda x, k: F.struct(x[part].alias(part), F.aggregate(F.slice("all", 1, k), F.lit(0).cast("long"), lambda s, y: s + y["total"]).alias("offset")))
    offsets = each.select(F.explode(before).alias("o")).select("o.*")
    inside = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn(name, inside).join(F.broadcast(offsets), part)
    return out.withColumn(name, F.col(name) + F.col("offset")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def numbered(df: DataFrame, name: str, *order: Column | str, parts: int | None = None) -> DataFrame:
    """df with each row's place, from 1 on, in the order."""
    return running_sum(df, F.lit(1), name, *order, parts=parts)
