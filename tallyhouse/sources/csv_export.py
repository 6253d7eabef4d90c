"""CSV exports: positional columns, empty apart from missing, and a strict row width."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import once
from tallyhouse.session import stored
from tallyhouse.sources.records import read_records

#: Column that tells the loads of an export table apart, if it is partitioned by it.
BATCH = "batch_id"
BAD = "_bad"
WIDTH = "_width"
BATCH_NAME = re.compile(r"[A-Za-z0-9._-]+")
# A quoted field with its leading delimiter, and a record of empty fields only. Possessive throughout: the matcher neither
# goes back nor recurses, however long a field or a record is.
QUOTED_FIELD = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
EMPTY_RECORD = r'^(?:"")?+(?:,(?:"")?+)*+\r?$'


class WideRowError(ValueError):
    """A row has more fields than the table has columns; nothing was written."""


class OpenQuoteError(ValueError):
    """A line ends inside a quoted field, and records were read line by line; nothing was written."""


@dataclass(frozen=True)
class AppendResult:
    rows_parsed: int
    rows_inserted: int
    columns_used: int


def reader_options(has_header: bool, multi_line: bool) -> dict[str, str]:
    return {
        "header": str(has_header).lower(),
        "multiLine": str(multi_line).lower(),
        "quote": '"',
        "escape": '"',
        "emptyValue": "",
        # Not detected from the first line: a file may mix line ends. The CR before a line break is taken off afterwards.
        "lineSep": "\n",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": BAD,
    }


def reader_schema(columns: list[str]) -> T.StructType:
    """All text; with a place for records that do not have as many fields as there are columns."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD]])


def field_count(record: Column) -> Column:
    """Fields of a raw record: delimiters outside quoted fields, plus one. Linear in the length of the record."""
    outside = F.regexp_replace(record, QUOTED_FIELD, "$1")
    return F.char_length(outside) - F.char_length(F.translate(outside, ",", "")) + 1


def with_width(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """Tell empty from missing, and drop records of empty fields.

    The parser gives NULL for an empty field and for one that is not there. A field that is there becomes '', one beyond the
    end of a short record stays NULL. `_width` is the number of fields.
    """
    width = F.when(F.col(BAD).isNull(), F.lit(len(columns))).otherwise(field_count(F.col(BAD)))

    def value(at: int, name: str) -> Column:
        c = F.col(f"`{name}`")
        text = F.when(c.endswith("\r"), F.regexp_replace(c, r"\r\z", "")).otherwise(c)
        return F.coalesce(text, F.when(F.col(WIDTH) > at, F.lit(""))).alias(name)

    extra = [c for c in parsed.columns if c not in columns]
    rows = parsed.withColumn(WIDTH, width).select(*[value(at, c) for at, c in enumerate(columns)], *extra, WIDTH)
    filled = F.greatest(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns], F.lit("")) != ""
    # The columns of a record that is too wide do not show all of it.
    hidden = (F.col(WIDTH) > len(columns)) & ~F.col(BAD).rlike(EMPTY_RECORD)
    return rows.filter(filled | hidden).drop(BAD)


def scan_export(
    spark: SparkSession, path: str | list[str], columns: list[str], has_header: bool = False, multi_line: bool = True
) -> DataFrame:
    """Rows of the export with their `_width`, too wide ones included.

    With `multi_line` a file is read by as many tasks as it has splits (`records.read_records`), and its records go through the same parser.
    """
    options = reader_options(has_header, multi_line)
    if multi_line and (records := read_records(spark, path, has_header)) is not None:
        return with_width(parse_records(records, columns), columns)
    parsed = spark.read.schema(reader_schema(columns)).options(**options).csv(path)
    return with_width(parsed, columns)


def parse_records(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records (text) as the columns of `reader_schema`, by Spark's parser; each is parsed once, whatever columns and filters refer to it."""
    names = [f"_{k}" for k in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in [*names, BAD])
    options = {k: v for k, v in reader_options(False, True).items() if k != "header"}
    fields = once(records, F.from_csv("text", schema, options).alias("_r"))
    return fields.select(*[F.col(f"_r.{n}").alias(c) for n, c in zip(names, columns, strict=True)], F.col(f"_r.{BAD}").alias(BAD))


def read_export_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | list[str],
    has_header: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Export rows as text, mapped by position; a header is skipped, never matched.

    Doubled quotes stand for one, blanks are kept, rows of empty fields are dropped. `multi_line` allows line breaks inside
    quotes, for which the text is looked through once before it is read; without it a file that has any is refused.
    Rows that are too wide lose their surplus here; `append_export` rejects them.
    """
    refuse_cut_records(spark, path, multi_line)
    columns = schema.fieldNames() if isinstance(schema, T.StructType) else list(schema)
    return scan_export(spark, path, columns, has_header, multi_line).drop(WIDTH)


def width_report(rows: DataFrame, columns: int) -> tuple[int, int, int]:
    """(rows, rows that are too wide, widest row) of a scan."""
    found = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(WIDTH) > columns).alias("wide"),
        F.coalesce(F.max(WIDTH), F.lit(0)).alias("widest"),
    ).first()
    return found["rows"], found["wide"], found["widest"]


def open_lines(spark: SparkSession, path: str | list[str]) -> int:
    """Lines with an odd number of quotes: where one is found, a quoted field goes on in the next line."""
    lines = spark.read.text(path, lineSep="\n")
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return lines.filter(quotes % 2 == 1).count()


def refuse_cut_records(spark: SparkSession, path: str | list[str], multi_line: bool) -> None:
    """Read line by line, a record with a line break inside quotes would come apart unnoticed."""
    if not multi_line and (cut := open_lines(spark, path)):
        raise OpenQuoteError(f"{cut} lines end or begin inside a quoted field: load them with multi_line=True")


def insertable_columns(spark: SparkSession, table: str, generated: tuple[str, ...] = ()) -> list[str]:
    """Columns of a table in their order, without those that are generated."""
    return [c for c in spark.table(table).columns if c not in generated]


def append_export(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    has_header: bool = False,
    multi_line: bool = True,
    generated: tuple[str, ...] = (),
    batch: str | None = None,
) -> AppendResult:
    """Append a CSV export to a table by position: all of it, or nothing if one row is too wide.

    In a table that is partitioned by `batch_id` the rows become the partition `batch`, in the place of what it held.

    The text is parsed once, into a scratch table that is counted, checked and then written. A pass before that looks for quoted line breaks:
    with `multi_line`, in loads larger than a split, to find where records begin; without, to refuse what would be cut into two records.
    """
    batched = BATCH in spark.table(table).columns
    if batched and not batch:
        raise ValueError(f"table {table} is partitioned by {BATCH}: name the batch")
    generated = (*generated, BATCH) if batched else generated
    columns = insertable_columns(spark, table, generated)
    if not columns:
        raise ValueError(f"no columns to fill in table {table}")
    refuse_cut_records(spark, path, multi_line)
    rows = stored(scan_export(spark, path, columns, has_header, multi_line), "parsed")
    parsed, wide, widest = width_report(rows, len(columns))
    if wide:
        raise WideRowError(f"{wide} of {parsed} rows have up to {widest} columns, but table {table} has {len(columns)}")
    target = [f for f in spark.table(table).schema if not (batched and f.name == BATCH)]
    typed = rows.select(
        *[
            (F.lit(None) if f.name in generated else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
            for f in target
        ]
    )
    if batched:
        replace_batch(typed, table, batch)
    else:
        typed.write.insertInto(table)
    return AppendResult(parsed, parsed, len(columns))


def replace_batch(rows: DataFrame, table: str, batch: str) -> None:
    """Make `rows` the partition `batch` of a table, in the place of what it held: doing it again adds nothing."""
    if not BATCH_NAME.fullmatch(batch):
        raise ValueError(f"a batch is named by letters, digits, '.', '_' and '-', not {batch!r}")
    rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = '{batch}') SELECT * FROM {{rows}}", rows=rows)
