"""Repeated passages of `window` words, found exactly by super-k-mer partitioning.

Every window has a minimiser: the least of its word `gram`s under a fixed order. Consecutive windows of a text that share one travel
together, as one packed string of their words, to the minimiser's bucket; equal windows have equal minimisers, so they meet there. The
bucket sorts the hashes (128 bits) of its windows; in each run of equal ones the smallest document id stays, windows of other ids are
repeats. Words under a repeat are removed.

Order of grams: grams that are frequent in the corpus come last, the others by their hash. So a window only goes to the bucket of a
frequent gram if all its grams are frequent, which means it lies within a frequent passage; of such strings each slice of texts sends one,
and the bucket of a passage that a third of all documents share does not grow with what surrounds it. Frequent grams are those of cells of
a hashed count table above a share of the total, so there are at most 1 / `FREQUENT` of them. Only the balance depends on them.

Documents of which nothing is left are kept as empty ones. Defined cases. A null text has no words. Texts of fewer words than a window
lose nothing. Windows that repeat within one id, or in rows of the same id, are no repeats, since no id is smaller; repeated rows get
equal results. A null id is smaller than all others.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Rolling, gather, inside_values, long_ranges, mix, partitions, raw, slices, texts, word_hashes, word_ranges

GRAM = 4
CELLS = 1 << 20
FREQUENT = 1 / 50_000

_WORDS, _ONE, _TWO = Rolling("k-mer words"), Rolling("k-mer windows"), Rolling("k-mer windows, second")
_U = np.uint64


def word_grams(column: pa.Array, gram: int) -> np.ndarray:
    data, offsets = raw(column)
    starts, ends, bounds = word_ranges(data, offsets)
    grams = _ONE.windows(_ONE.prefix(word_hashes(data, starts, ends, _WORDS)), gram)
    return grams[inside_values(bounds, gram, len(starts))]


def frequent_cells(docs: DataFrame, grams_of: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """For each cell of hashed grams 0, or how frequent it is (1 to 7, by powers of two), counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            cells += np.bincount((grams_of(batch.column(1)) % _U(CELLS)).astype(np.int64), minlength=CELLS)
        total = int(cells.sum())
        # A cell above the share overall is above half of it in tasks that hold half of its grams or more.
        at = np.flatnonzero(cells > max(2, FREQUENT / 2 * total))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(cells[at], total))], ["cell", "n"])

    sums = texts(docs).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = {r[0]: r[1] for r in sums.orderBy(F.desc("n")).limit(int(2 / FREQUENT)).collect()}
    level = np.zeros(CELLS, np.uint8)
    least = max(8.0, FREQUENT * found.pop(-1, 0))
    for cell, n in found.items():
        if n >= least:
            level[cell] = min(7, 1 + int(np.log2(n / least)))
    return level


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    out, span = values, 1
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def super_kmers(hashes: np.ndarray, bounds: np.ndarray, level: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window of each super-k-mer (numbers of words), and their minimisers."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    grams = _ONE.windows(_ONE.prefix(hashes), gram)
    order = (level[(grams % _U(CELLS)).astype(np.int64)].astype(_U) << _U(60)) | (grams >> _U(4))
    least = sliding_least(order, window - gram + 1)
    at = np.flatnonzero(inside_values(bounds, window, len(hashes)))
    if not len(at):
        return at, at, np.zeros(0, _U)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
    heads = np.flatnonzero(new)
    return at[heads], at[np.append(heads[1:] - 1, len(at) - 1)], least[at[heads]]


# Rows on their way: a packed bundle, or (packed is null) words of a document found to be repeats already.
TRAVEL = "bucket int, packed binary, id bigint, hash bigint, first bigint, last bigint"
FOUND = "id bigint, hash bigint, first bigint, last bigint"


def bundle(columns: list[np.ndarray], data: np.ndarray) -> bytes:
    """Columns of whole numbers and bytes, packed."""
    head = struct.pack("<q", len(columns[0])) + b"".join(x.astype("<i8").tobytes() for x in columns)
    return zstandard.ZstdCompressor(level=1).compress(head + data.tobytes())


def unbundle(packed: bytes, width: int) -> tuple[np.ndarray, ...]:
    plain = zstandard.ZstdDecompressor().decompress(packed)
    (count,) = struct.unpack_from("<q", plain)
    columns = np.frombuffer(plain, "<i8", width * count, 8).reshape(width, count)
    return (*columns, np.frombuffer(plain, np.uint8, offset=8 * (1 + width * count)))


def found_rows(bucket, ids, hashes, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.nulls(len(ids), pa.binary()), *[pa.array(x, pa.int64()) for x in (ids, hashes, first, last)]],
        ["bucket", "packed", "id", "hash", "first", "last"],
    )


def repeated_windows(docs: DataFrame, window: int = 50, gram: int = GRAM) -> DataFrame:
    """id, hash (of the text), first and last: runs of windows (by the word they start at) that start in a smaller id too."""
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = 8 * parts
    level = frequent_cells(docs, lambda column: word_grams(column, gram))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}  # strings of frequent grams that this task has sent, with the smallest id
        for batch in slices(batches):
            data, offsets = raw(batch.column(1))
            starts, ends, bounds = word_ranges(data, offsets)
            hashes = word_hashes(data, starts, ends, _WORDS)
            low, high, least = super_kmers(hashes, bounds, level, window, gram)
            if not len(low):
                continue
            stop = high + window
            one = long_ranges(_ONE, _ONE.prefix(hashes), low, stop)
            two = long_ranges(_TWO, _TWO.prefix(hashes), low, stop)
            doc = np.searchsorted(bounds, low, "right") - 1
            ids, marks = np.asarray(batch.column(0))[doc], np.asarray(batch.column(2))[doc]
            first, last = low - bounds[doc], high - bounds[doc]
            order = np.lexsort((ids, two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
            smallest = np.empty(len(order), np.int64)
            smallest[order] = ids[order][new][np.cumsum(new) - 1]
            known = ids > smallest
            for k in np.flatnonzero((least >> _U(60) > 0) & ~known):
                key = (int(one[k]), int(two[k]))
                before = sent.get(key)
                if before is not None and before < ids[k]:
                    known[k] = True
                else:
                    sent[key] = int(ids[k])
            if len(sent) > 500_000:
                sent.clear()
            if known.any():
                spread = (mix(ids[known].astype(_U)) % _U(buckets)).astype(np.int32)
                yield found_rows(spread, ids[known], marks[known], first[known], last[known])
            go = np.flatnonzero(~known)
            bucket = (mix(least[go]) % _U(buckets)).astype(np.int64)
            go = go[np.argsort(bucket, kind="stable")]
            at = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            text, text_at = gather(data, starts[low[go]], ends[stop[go] - 1])
            used = np.flatnonzero(np.diff(at))
            packed = []
            for b in used:
                own = slice(at[b], at[b + 1])
                k = go[own]
                sizes = np.diff(text_at[at[b] : at[b + 1] + 1])
                packed.append(bundle([ids[k], marks[k], first[k], sizes], text[text_at[at[b]] : text_at[at[b + 1]]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(packed, pa.binary()), *[pa.nulls(len(used), pa.int64())] * 4],
                ["bucket", "packed", "id", "hash", "first", "last"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_bucket(batches, lambda held: _count_bucket(held, window))

    rows = texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    dealt = rows.mapInArrow(deal, TRAVEL).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, FOUND)


def by_bucket(batches: Iterator[pa.RecordBatch], work: Callable[[list[bytes]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of finds as they are, and `work` on all bundles of each bucket; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        done = batch.filter(batch.column(1).is_null())
        if done.num_rows:
            yield done.select(["id", "hash", "first", "last"])
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if packed is None:
                continue
            if bucket != now:
                if held:
                    yield work(held)
                now, held = bucket, []
            held.append(packed)
    if held:
        yield work(held)


def runs_of(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive finds of one owner."""
    head = np.ones(len(found), bool)
    head[1:] = (np.diff(found) > 1) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(head)
    return heads, np.append(heads[1:] - 1, len(found) - 1)[: len(heads)]


def _count_bucket(held: list[bytes], window: int) -> pa.RecordBatch:
    """Sort a bucket's windows; the runs of those that a smaller id has too."""
    ids, marks, first, sizes, data = (np.concatenate(x) for x in zip(*(unbundle(x, 4) for x in held), strict=True))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts, ends, bounds = word_ranges(data, offsets)
    hashes = word_hashes(data, starts, ends, _WORDS)
    at = np.flatnonzero(inside_values(bounds, window, len(hashes)))
    owner = np.searchsorted(bounds, at, "right") - 1
    one = _ONE.windows(_ONE.prefix(hashes), window)[at]
    two = _TWO.windows(_TWO.prefix(hashes), window)[at]
    order = np.argsort(one, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = one[order[1:]] != one[order[:-1]]
    if (two[order[1:]] != two[order[:-1]])[~new[1:]].any():
        order = np.lexsort((two, one))
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    own = ids[owner[order]]
    smallest = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    repeat = np.zeros(len(at), bool)
    repeat[order] = own > smallest
    found, owner = at[repeat], owner[repeat]
    heads, tails = runs_of(found, owner)
    which = owner[heads]
    base = first[which] - bounds[which]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (ids[which], marks[which], base + found[heads], base + found[tails])], ["id", "hash", "first", "last"]
    )


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = GRAM) -> DataFrame:
    """id, text (words that are left, joined by one blank), n_words and n_removed of every row."""
    found = repeated_windows(docs, window, gram)
    lists = found.groupBy("id", "hash").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    rows = texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    both = rows.join(lists, ["id", "hash"], "left").select("id", "text", "first", "last")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = raw(batch.column(1))
            starts, ends, bounds = word_ranges(data, offsets)
            marks = np.zeros(len(starts) + 1, np.int64)
            first, number = lists_of(batch.column(2))
            last, _ = lists_of(batch.column(3))
            base = np.repeat(bounds[:-1], number)
            np.add.at(marks, base + first, 1)
            np.add.at(marks, base + last + window, -1)
            left = np.cumsum(marks[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(left)])[bounds]
            # Each word with the byte after it, which becomes a blank.
            padded = np.append(data, np.uint8(0x20))
            out, out_at = gather(padded, starts[left], ends[left] + 1)
            out = out.copy()
            out[out_at[1:] - 1] = 0x20
            low, high = out_at[before[:-1]], np.maximum(out_at[before[1:]] - 1, out_at[before[:-1]])
            words = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([out[a:b].tobytes().decode() for a, b in zip(low, high, strict=True)], pa.string()),
                    pa.array(words),
                    pa.array(words - np.diff(before)),
                ],
                ["id", "text", "n_words", "n_removed"],
            )

    return both.mapInArrow(keep, "id bigint, text string, n_words bigint, n_removed bigint")


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a column of lists (null: none), and how many each row has."""
    number = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(column.flatten(), dtype=np.int64), number
