"""Records of large CSV files, read by many tasks although fields may hold line breaks.

Spark splits a text file at line ends anywhere, so a split may begin inside a quoted field. What a line does is a function of how it
begins, outside or inside quotes; what a split does is the composition of its lines, which is one row. Composed along a file these tell how every
split begins. Then each task puts its own lines together to records, and only the pieces of records that lie across splits, two a split
at most, are sent on to be joined. Both passes read the text in the splits of the scan; no line is shuffled. A quoted field that is never
closed takes the rest of its file, but for the last line break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits that begin inside quotes and may be named in a broadcast, some 100 bytes each. With more of them, a file is read by one task.
MOST_OPEN_SPLITS = 200_000
# A quoted field with its leading delimiter and a quote that is opened by a line. Possessive: linear in the line.
QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
OPENED = r'(?:^|,)"'
_PIECES = "file string, block bigint, place int, text string, first boolean"


def ends_inside(line: Column) -> Column:
    """Does a line that begins outside quotes end inside a quoted field?"""
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, QUOTED, "$1").rlike(OPENED)).otherwise(F.lit(False))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (the first byte of the split), line, and how it ends after beginning outside or inside quotes. In the order of the scan."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("text"),
        ends_inside(F.col("value")).alias("from_outside"),
        F.when(F.contains("value", F.lit('"')), ends_inside(F.concat(F.lit('"'), F.col("value")))).otherwise(F.lit(True)).alias("from_inside"),
    )


def _states(outside: np.ndarray, inside: np.ndarray, begins: bool) -> np.ndarray:
    """The state behind each line, from what the lines do and the state before the first: a line that does the same from both states
    decides, one that does the opposite turns."""
    fixed, turned = outside == inside, outside & ~inside
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(outside)), -1))
    turns = np.concatenate([[0], np.cumsum(turned)])
    start = np.where(last >= 0, outside[np.maximum(last, 0)], begins)
    return start ^ ((turns[1:] - turns[last + 1]) % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, block), low, high) of the rows of each split in a batch."""
    files, blocks = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
    number = np.asarray(files.indices)
    cuts = np.flatnonzero((number[1:] != number[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if low < high:
            yield (files.dictionary[int(number[low])].as_py(), int(blocks[low])), low, high


def split_effects(lines: DataFrame) -> DataFrame:
    """file, block, from_outside, from_inside: how each split ends. One row a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ends = None, (False, True)

        def out() -> pa.RecordBatch:
            values = [[current[0]], [current[1]], [ends[0]], [ends[1]]]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["file", "block", "from_outside", "from_inside"])

        for batch in batches:
            for split, low, high in _runs(batch):
                if split != current:
                    if current is not None:
                        yield out()
                    current, ends = split, (False, True)
                does = [np.asarray(batch.column(k).slice(low, high - low), dtype=bool) for k in (2, 3)]
                ends = tuple(bool(_states(*does, begins)[-1]) for begins in ends)
        if current is not None:
            yield out()

    return lines.select("file", "block", "from_outside", "from_inside").mapInArrow(
        run, "file string, block bigint, from_outside boolean, from_inside boolean"
    )


def open_splits(effects: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside quotes. Rows of one file, one a split, are sorted in one task."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, turned = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    turns = F.coalesce(F.sum(turned.cast("bigint")).over(before), F.lit(0))
    through = F.sum(turned.cast("bigint")).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    decided = F.last(F.when(fixed, F.struct(F.col("from_outside").alias("state"), F.col("_through").alias("turns"))), ignorenulls=True).over(before)
    counted = effects.withColumn("_through", through).select("file", "block", decided.alias("_last"), turns.alias("_turns"))
    state = F.coalesce(F.col("_last.state"), F.lit(False)).cast("int")
    return counted.where((state + F.col("_turns") - F.coalesce(F.col("_last.turns"), F.lit(0))) % 2 == 1).select("file", "block")


def _pieces(lines: DataFrame, has_header: bool) -> DataFrame:
    """Records, and pieces of records: place 0 is whole, 1 the end of a record from the split before, 2 the beginning of one that goes
    on, 3 all of a split inside one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        current, begins, head, leading = None, False, False, False

        def emit(places, texts, firsts):
            n = len(places)
            columns = [pa.array([current[0]] * n, pa.string()), pa.array([current[1]] * n, pa.int64()), pa.array(places, pa.int32()), texts, pa.array(firsts, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "place", "text", "first"])

        def close():
            # What is held goes on in the next split, or the file ends inside quotes.
            place = 3 if head else 2
            return emit([place], pa.array(["\n".join(held)], pa.string()), [leading])

        for batch in batches:
            for split, low, high in _runs(batch):
                if split != current:
                    if held:
                        yield close()
                    part = batch.slice(low, 1)
                    current, held = split, []
                    begins = head = bool(part.column(5)[0].as_py())
                    leading = has_header and split[1] == 0
                does = [np.asarray(batch.column(k).slice(low, high - low), dtype=bool) for k in (3, 4)]
                after = _states(*does, begins)
                texts = batch.column(2).slice(low, high - low)
                ends = np.flatnonzero(~after)
                if not len(ends):
                    held += texts.to_pylist()
                    begins = True
                    continue
                # Lines of one record are joined; most records are one line.
                starts = np.concatenate([[0], ends[:-1] + 1])
                single = starts == ends
                if held:
                    single[0] = False
                merged = texts.take(pa.array(ends)).to_pylist() if not single.all() else None
                if merged is None:
                    column = texts.take(pa.array(ends))
                else:
                    for k in np.flatnonzero(~single):
                        own = texts.slice(starts[k], ends[k] - starts[k] + 1).to_pylist()
                        merged[k] = "\n".join([*held, *own]) if k == 0 else "\n".join(own)
                    column = pa.array(merged, pa.string())
                places, firsts = [0] * len(ends), [False] * len(ends)
                if head:
                    places[0] = 1
                    head = False
                if leading:
                    own = [k for k, t in enumerate(column.to_pylist()) if t.strip("\r") or places[k]]
                    if own:
                        firsts[own[0]], leading = True, False
                held = texts.slice(ends[-1] + 1).to_pylist()
                begins = bool(after[-1])
                yield emit(places, column.cast(pa.string()), firsts)
        if held:
            yield close()

    return lines.mapInArrow(run, _PIECES)


def _bytes(text: DataFrame) -> int:
    """The size of the files of a scan, as the optimizer knows it: nothing is read."""
    return int(str(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def split_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def read_records(spark: SparkSession, path: str | list[str], has_header: bool = False) -> DataFrame | None:
    """(text): one row a record, without the first one of each file if `has_header`.

    None where reading whole files is as good, all of them together being no larger than a split, or where too many splits begin inside
    quotes. The rows are the same either way.
    """
    if _bytes(spark.read.text(path, lineSep="\n")) <= split_bytes(spark):
        return None
    lines = _lines(spark, path)
    inside = open_splits(split_effects(lines))
    found = inside.limit(MOST_OPEN_SPLITS + 1).collect()
    if len(found) > MOST_OPEN_SPLITS:
        return None
    known = spark.createDataFrame([(r["file"], r["block"], True) for r in found], "file string, block bigint, _inside boolean")
    marked = lines.join(F.broadcast(known), ["file", "block"], "left").select(
        "file", "block", "text", "from_outside", "from_inside", F.coalesce("_inside", F.lit(False)).alias("inside")
    )
    pieces = _pieces(marked, has_header)
    if not found:
        # Records lie in their splits; a file that ends inside quotes leaves a beginning without an end, which is its last record.
        return pieces.where("NOT first").select("text")
    whole = pieces.where("place = 0 AND NOT first").select("text")
    # Beginning, splits in between, end: a beginning opens a record of its own.
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("place") == 1, 0).otherwise(1))
    parts = pieces.where("place > 0").withColumn("_record", F.sum((F.col("place") == 2).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy("file", "_record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"), F.max("first").alias("first")
    )
    return whole.unionByName(joined.where("NOT first").select("text"))
