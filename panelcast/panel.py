"""Panel description: which column names the entity, which orders time.

The reference orders every window by the date alone, so rows that share a
date come out in shuffle order. A ``PanelSpec`` always carries explicit
tie-breakers so that lead/lag/rolling results do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "city"
    time: str = "date_parsed"
    tie_breakers: tuple[str, ...] = field(default_factory=tuple)
    unique_time: bool = False
    time_bucket: int | None = None  # width of a bucket of an integer time column

    def __post_init__(self):
        if not self.tie_breakers and not self.unique_time:
            raise ValueError("PanelSpec needs tie_breakers that make the order unique within an entity "
                             "(or unique_time=True where no two rows of an entity share a time)")

    @property
    def order_cols(self) -> list[str]:
        return [self.time, *self.tie_breakers]

    def order_exprs(self) -> list[Column]:
        # ascending, nulls first: Spark's default, and what the reference uses
        return [F.col(c).asc_nulls_first() for c in self.order_cols]

    def window(self, *extra_partition: str | Column) -> WindowSpec:
        return Window.partitionBy(F.col(self.entity), *extra_partition).orderBy(*self.order_exprs())

    def bucket_expr(self, df: DataFrame) -> Column:
        """Coarse, order-preserving bucket of the time column: a day, or ``time_bucket``
        units of an integer column. Other types have no bounded buckets and raise.

        Used to pre-aggregate row counts per entity before shuffling; the
        number of buckets per entity is bounded by its calendar span.
        """
        dtype = df.schema[self.time].dataType
        if isinstance(dtype, (TimestampType, TimestampNTZType)):
            return F.to_date(F.col(self.time))
        if isinstance(dtype, DateType):
            return F.col(self.time)
        if isinstance(dtype, IntegralType) and self.time_bucket:
            return F.floor(F.col(self.time) / F.lit(self.time_bucket)).cast("long")
        raise TypeError(f"{self.time}: {dtype.simpleString()} has no buckets; use a date, a timestamp, "
                        "or an integer with time_bucket set")
