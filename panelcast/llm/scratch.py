"""Tables written to the session's shared folder and read again.

They cut the lineage: a lost executor costs the tasks of the current stage,
never the work before the table. ``spark.checkpoint.dir`` must name a folder
that all executors share (see ``panelcast.session``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelcast.session import scratch_path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared folder, read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
