"""Sinks: the parquet table store (E24, see ``Tables.write``) and delimited
text output of a query result (E27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_text_columns(df: DataFrame) -> DataFrame:
    """Every column as text, NULL as empty, column order kept."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_delimited(df: DataFrame, path: str, sep: str = ", ", header: bool = True) -> None:
    """Header line plus one line per row, values joined by ``sep`` (the
    reference prints ``", "``), NULL written as an empty field. Part files are
    written in parallel; the header is the first line of the first one, so that
    the parts in the order of their names read as one result."""
    line = F.concat_ws(sep, *[F.col(f"`{c}`") for c in df.columns]).alias("value")
    body = to_text_columns(df).select(line)
    if header:
        head = df.sparkSession.createDataFrame([(sep.join(df.columns),)], "value string").coalesce(1)
        body = head.unionAll(body)
    body.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Standard CSV with header; NULL as empty."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
