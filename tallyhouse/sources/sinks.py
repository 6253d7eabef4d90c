"""CSV output: plain results and reports with a few lines of metadata on top."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import plain_number

WRITER_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\n",
}


def as_text(df: DataFrame) -> DataFrame:
    """All columns as report text; numbers without exponent or '.0'."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            (plain_number(F.col(f"`{f.name}`")) if isinstance(f.dataType, floating) else F.col(f"`{f.name}`").cast("string"))
            .alias(f.name)
            for f in df.schema
        ]
    )


def csv_field(c: Column) -> Column:
    """One field: in quotes if it holds a quote, a comma or a line break; NULL is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(
        text
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a result as CSV with a header, in parallel."""
    as_text(df).write.mode(mode).options(**WRITER_OPTIONS).csv(path)


def report_lines(df: DataFrame, metadata: Mapping[str, object], order_by: tuple[str, ...]) -> DataFrame:
    """The lines of a report in order: `name,value` metadata, an empty line, the header, the rows."""
    top = [f"{name},{value}" for name, value in metadata.items()] + ["", ",".join(df.columns)]
    text = as_text(df)
    keys = [f"_key{i}" for i in range(len(order_by))]
    rows = text.select(
        F.lit(len(top)).alias("_part"),
        *[F.col(c).alias(k) for c, k in zip(order_by, keys)],
        F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in text.columns]).alias("value"),
    )
    lines = df.sparkSession.range(0, 1, 1, 1).select(F.posexplode(F.array(*[F.lit(t) for t in top])))
    head = lines.select(
        F.col("pos").alias("_part"), *[F.lit(None).cast("string").alias(k) for k in keys], F.col("col").alias("value")
    )
    return head.unionByName(rows).orderBy("_part", *keys).select("value")


def write_report(
    df: DataFrame, path: str, metadata: Mapping[str, object], order_by: tuple[str, ...], mode: str = "error"
) -> None:
    """Write a report as text; its part files, in the order of their names, make the whole.

    The sort is by range, so a report of any length is written in parallel; a short one comes out as one file.
    """
    report_lines(df, metadata, order_by).write.mode(mode).text(path)


def write_metrics_report(
    df: DataFrame, path: str, months: int = 12, generated_at: dt.datetime | None = None, mode: str = "error"
) -> None:
    """The usage report with its window and the time it was made."""
    now = (generated_at or dt.datetime.now(dt.timezone.utc)).astimezone(dt.timezone.utc)
    stamp = now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
    write_report(df, path, {"window_months": months, "generated_at": stamp}, ("period",), mode)


def write_demographics_report(df: DataFrame, path: str, total_persons: int, mode: str = "error") -> None:
    """The demographics profile with the number of persons."""
    write_report(df, path, {"total_persons": total_persons}, ("category", "value"), mode)
