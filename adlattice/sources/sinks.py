"""Writers. Spark's commit protocol makes each write all-or-nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str) -> int:
    """Append without conflict check; returns the number of rows written, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, every text quoted, backslash escapes, no index column."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape="\\", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_pages(df: DataFrame, path: str) -> None:
    """Raw pages as JSON lines: names and line breaks are kept, so that they read back as they were."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, folder: str, name: str) -> str:
    """An export under the name of its search; the path written."""
    path = f"{folder.rstrip('/')}/{name}"
    write_csv(df, path)
    return path
