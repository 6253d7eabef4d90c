"""New CSV files in a folder are appended once, file by file under the same width rule as a single load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.plans.ingest import merge_new_batches
from tallyhouse.session import stored
from tallyhouse.sources.csv_export import BATCH, OpenQuoteError, WIDTH, insertable_columns, open_lines, reader_options, reader_schema, replace_batch, with_width

FILE = "_file"
#: Files of one batch at most; the names of refused ones are broadcast.
MOST_FILES = 10_000


def _source(spark: SparkSession, folder: str, columns: list[str], has_header: bool, multi_line: bool, max_files: int) -> DataFrame:
    if not 1 <= max_files <= MOST_FILES:
        raise ValueError(f"max_files must be between 1 and {MOST_FILES}, not {max_files}")
    return (
        spark.readStream.schema(reader_schema(columns))
        .options(**reader_options(has_header, multi_line))
        .option("maxFilesPerTrigger", str(max_files))
        .csv(folder)
        .withColumn(FILE, F.col("_metadata.file_path"))
    )


def _accepted(batch: DataFrame, batch_id: int, columns: list[str], rejects: str, multi_line: bool) -> DataFrame:
    """The rows of all files of a batch without one that is too wide; files left out are named in `rejects`.

    Read line by line, a file with a line break inside quotes would come apart unnoticed: then the batch fails instead.
    """
    spark = batch.sparkSession
    if not multi_line:
        files = [r[0] for r in batch.select(FILE).distinct().collect()]
        if files and (cut := open_lines(spark, files)):
            raise OpenQuoteError(f"{cut} lines end or begin inside a quoted field: read them with multi_line=True")
    # Parsed once: the rows are read for the check and for the append.
    rows = stored(with_width(batch, columns), "arrived")
    wide = rows.filter(F.col(WIDTH) > len(columns)).groupBy(FILE).agg(F.count(F.lit(1)).alias("wide_rows"))
    out = rejects_path(rejects, batch_id)
    wide.write.mode("overwrite").parquet(out)
    # At most `max_files` names.
    refused = spark.read.schema(f"{FILE} string, wide_rows bigint").parquet(out).select(FILE)
    return rows.join(F.broadcast(refused), FILE, "left_anti").drop(FILE, WIDTH)


def stream_exports(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    target: str,
    rejects: str,
    checkpoint: str,
    has_header: bool = False,
    multi_line: bool = True,
    after_batch: Callable[[SparkSession], object] | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Append what lies in `folder` and was not read before to the Parquet folder `target`, then stop.

    A file with a row that is too wide is left out as a whole, and named in `rejects`. Both outputs are partitioned by batch and
    a batch replaces its own partition, so one that runs again after a failure adds nothing twice. `after_batch` is the place for
    more steps. There is no watermark: a late row counts in its own month the next time a report is run.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        kept = _accepted(batch, batch_id, columns, rejects, multi_line)
        kept.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")
        if after_batch:
            after_batch(batch.sparkSession)

    source = _source(spark, folder, columns, has_header, multi_line, max_files)
    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_and_merge(
    spark: SparkSession,
    folder: str,
    table: str,
    rejects: str,
    checkpoint: str,
    has_header: bool = False,
    multi_line: bool = True,
    max_files: int = 1000,
    merge: Callable[[SparkSession], object] = merge_new_batches,
) -> StreamingQuery:
    """Append new files of `folder` to an export table, merge them into persons and households, then stop.

    The table is partitioned by batch (`plans.ingest.create_export_table`). A batch is the partition named by the stream and the number
    of the batch; the merge folds in the batches that the state in force does not hold yet. So wherever a batch fails, between the append
    and the merge or after the merge, running it again writes the same partition and merges it once.
    """
    if BATCH not in spark.table(table).columns:
        raise ValueError(f"table {table} is not partitioned by {BATCH}")
    columns = insertable_columns(spark, table, (BATCH,))

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        kept = _accepted(batch, batch_id, columns, rejects, multi_line)
        replace_batch(kept.select(*[F.col(f"`{c}`") for c in columns]), table, f"{stream}-{batch_id}")
        merge(session)

    source = _source(spark, folder, columns, has_header, multi_line, max_files)
    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rejects_path(rejects: str, batch_id: int) -> str:
    return f"{rejects}/{BATCH}={batch_id}"
