"""Row-drop audit (A14): rows before/after a sequence of filters, in one pass.

The reference counts before and after every filter (two jobs per step). Here
the cumulative keep-predicates are evaluated together in one aggregate and
the single result row is unpivoted into (step, rows_before, rows_after, dropped).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_drop_audit(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    keep = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("s0")]
    for i, (_, predicate) in enumerate(steps, start=1):
        keep = keep & F.coalesce(predicate, F.lit(False))
        aggs.append(F.count(F.when(keep, F.lit(1))).alias(f"s{i}"))
    counts = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                     F.col(f"s{i - 1}").alias("rows_before"), F.col(f"s{i}").alias("rows_after"))
            for i, (name, _) in enumerate(steps, start=1)]
    out = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("dropped", F.col("rows_before") - F.col("rows_after"))
