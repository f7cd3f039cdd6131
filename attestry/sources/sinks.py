"""Writers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_dataset(df: DataFrame, path: str, drop_cols: Sequence[str] = (), date_stamp: dt.date | None = None,
                  fmt: str = "parquet", partition_by: Sequence[str] = (), suffix: str = "data") -> str:
    """Write a dataset, optionally without derived columns and under a dated name; returns the path."""
    target = f"{path}/{date_stamp.isoformat()}_{suffix}" if date_stamp else path
    writer = df.drop(*drop_cols).write.mode("errorifexists").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(target)
    else:
        writer.format(fmt).save(target)
    return target
