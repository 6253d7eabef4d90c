"""Repeated strings of `length` bytes, found by suffix arrays of shards.

A window of `length` bytes has a minimiser, the least of its byte grams (frequent ones last, see `superkmers`). Consecutive windows of a
text that share one form a string; equal windows lie in strings of one minimiser, so shards dealt by minimisers find all repeats.
First only the minimisers travel: a string whose minimiser occurs in no other string, and once in its own, holds no repeat. The other
strings go to their shards. One that equals a string before it (smaller id, or the same document and an earlier start) is a repeat as a
whole, and is not sorted. Of the rest, the stretches whose windows have a hash that occurs again are put together, and their suffixes
sorted by external induction (`induced`); neighbours with a common prefix of `length` bytes or more, known by 128-bit hashes, are the places of one window. All but
the first (smallest id, then within that document the first start) are removed.

Bytes are judged on the input; matches never cross documents. What is left may break a character of several bytes, so it is binary.

Defined cases. A null text is an empty one. Rows may repeat: rows of one id are no earlier than each other, so repeated rows get equal
results. A null id is smaller than all others. Texts shorter than `length` lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Rolling, gather, inside_values, long_ranges, mix, partitions, raw, slices, texts
from tallyhouse.llm.induced import sort_suffixes
from tallyhouse.llm.superkmers import (
    CELLS,
    FOUND,
    TRAVEL,
    bundle,
    by_bucket,
    found_rows,
    frequent_cells,
    lists_of,
    runs_of,
    sliding_least,
    unbundle,
)

GRAM = 20
SLICE_BYTES = 2 << 20

_ONE, _TWO = Rolling("suffix bytes"), Rolling("suffix bytes, second")
_U = np.uint64


def byte_grams(column: pa.Array, gram: int) -> np.ndarray:
    data, offsets = raw(column)
    return _ONE.windows(_ONE.prefix(data), gram)[inside_values(offsets, gram, len(data))]


def _strings(sums: np.ndarray, bounds: np.ndarray, level: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window of each string, its minimiser, and whether that occurs in it more than once."""
    total = len(sums) - 1
    nothing = np.zeros(0, np.int64)
    at = np.flatnonzero(inside_values(bounds, length, total))
    if not len(at):
        return nothing, nothing, np.zeros(0, _U), np.zeros(0, bool)
    grams = _ONE.windows(sums, gram)
    order = (level[(grams % _U(CELLS)).astype(np.int64)].astype(_U) << _U(60)) | (grams >> _U(4))
    width = length - gram + 1
    least = sliding_least(order, width)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
    heads = np.flatnonzero(new)
    low, high = at[heads], at[np.append(heads[1:] - 1, len(at) - 1)]
    # The first occurrence in the first window and the last one in the last window are the same where there is but one.
    view = np.lib.stride_tricks.sliding_window_view(order, width)
    several = np.empty(len(low), bool)
    for k in range(0, len(low), 20_000):
        a, b = low[k : k + 20_000], high[k : k + 20_000]
        several[k : k + 20_000] = a + view[a].argmin(1) != b + width - 1 - view[b][:, ::-1].argmin(1)
    return low, high, least[low], several


def _earlier(one: np.ndarray, two: np.ndarray, ids: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which strings repeat an equal one before them (all of their windows do, then)."""
    order = np.lexsort((first, marks, ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    return _not_first(order, new, ids, marks, first)


def _not_first(order: np.ndarray, new: np.ndarray, ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of items sorted by (group, id, mark, start): those of a larger id than the group's, or later than the first of their document.

    Repeated rows give items that are equal in all of these; none of them is later than another.
    """
    out = np.zeros(len(order), bool)
    if not len(order):
        return out
    own, mark, at = ids[order], marks[order], start[order]
    smallest = own[new][np.cumsum(new) - 1]
    document = new.copy()
    document[1:] |= (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])
    out[order] = (own > smallest) | (at > at[document][np.cumsum(document) - 1])
    return out


def _shared_minimisers(docs: DataFrame, level: np.ndarray, length: int, gram: int) -> DataFrame:
    """id, key: minimisers of an id's strings that occur in another string too, or more than once in one.

    A slice of texts settles what it holds twice itself and sends every minimiser once, so a frequent one does not grow its bucket.
    """
    parts = partitions(docs.sparkSession)
    buckets = 4 * parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            data, bounds = raw(batch.column(1))
            low, _, least, several = _strings(_ONE.prefix(data), bounds, level, length, gram)
            if not len(low):
                continue
            ids = np.asarray(batch.column(0))[np.searchsorted(bounds, low, "right") - 1]
            known = _shared(least) | several
            pairs = np.unique(np.stack([ids[known], least[known].view(np.int64)], 1), axis=0)
            yield _keys((mix(pairs[:, 0].astype(_U)) % _U(buckets)).astype(np.int32), None, pairs[:, 0], pairs[:, 1])
            _, first = np.unique(least, return_index=True)
            bucket = (mix(least[first]) % _U(buckets)).astype(np.int64)
            order = np.lexsort((ids[first], bucket))
            first, at = first[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(at))
            empty = np.zeros(0, np.uint8)
            packed = []
            for b in used:
                own = first[at[b] : at[b + 1]]
                packed.append(bundle([np.diff(ids[own], prepend=0), least[own].view(np.int64)], empty))
            yield _keys(used, packed, None, None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, keys = (np.concatenate(x) for x in zip(*held, strict=True))
                both = _shared(keys)
                yield pa.RecordBatch.from_arrays([pa.array(ids[both]), pa.array(keys[both])], ["id", "key"])

        for batch in batches:
            done = batch.filter(batch.column(1).is_null())
            if done.num_rows:
                yield done.select(["id", "key"])
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if packed is None:
                    continue
                if bucket != now:
                    yield from close()
                    now, held = bucket, []
                ids, keys, _ = unbundle(packed, 2)
                held.append((np.cumsum(ids), keys))
        yield from close()

    dealt = texts(docs).mapInArrow(send, "bucket int, packed binary, id bigint, key bigint").repartition(parts, "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(count, "id bigint, key bigint")


def _keys(bucket, packed, ids, keys) -> pa.RecordBatch:
    count = len(bucket)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()),
            pa.nulls(count, pa.binary()) if packed is None else pa.array(packed, pa.binary()),
            *[pa.nulls(count, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (ids, keys)],
        ],
        ["bucket", "packed", "id", "key"],
    )


def repeated_strings(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """id, hash (of the text), first and last: runs of byte positions where a repeated string starts."""
    parts = partitions(docs.sparkSession)
    buckets = 8 * parts
    level = frequent_cells(docs, lambda column: byte_grams(column, gram))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for batch in slices(batches, size=SLICE_BYTES):
            data, bounds = raw(batch.column(1))
            sums = _ONE.prefix(data)
            low, high, least, several = _strings(sums, bounds, level, length, gram)
            doc = np.searchsorted(bounds, low, "right") - 1
            keys, number = lists_of(batch.column(3))
            shared = keys.view(_U) ^ mix(np.repeat(np.arange(batch.num_rows, dtype=_U), number))
            wanted = np.isin(least ^ mix(doc.astype(_U)), shared)
            low, high, least, several, doc = low[wanted], high[wanted], least[wanted], several[wanted], doc[wanted]
            if not len(low):
                continue
            stop = high + length
            one, two = long_ranges(_ONE, sums, low, stop), long_ranges(_TWO, _TWO.prefix(data), low, stop)
            ids, marks = np.asarray(batch.column(0))[doc], np.asarray(batch.column(2))[doc]
            first, last = low - bounds[doc], high - bounds[doc]
            known = _earlier(one, two, ids, marks, first)
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
            text, text_at = gather(data, low[go], stop[go])
            used = np.flatnonzero(np.diff(at))
            packed = []
            for b in used:
                k = go[at[b] : at[b + 1]]
                columns = [ids[k], marks[k], first[k], stop[k] - low[k], least[k].view(np.int64), several[k].astype(np.int64)]
                packed.append(bundle(columns, text[text_at[at[b]] : text_at[at[b + 1]]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(packed, pa.binary()), *[pa.nulls(len(used), pa.int64())] * 4],
                ["bucket", "packed", "id", "hash", "first", "last"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_bucket(batches, lambda held: _sort_shard(held, length))

    rows = texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    shared = _shared_minimisers(docs, level, length, gram).groupBy("id").agg(F.collect_set("key").alias("keys"))
    some = rows.join(shared, "id").select("id", "text", "hash", "keys")
    dealt = some.mapInArrow(deal, TRAVEL).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, FOUND)


def _shared(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, which, number = np.unique(keys, return_inverse=True, return_counts=True)
    return number[which] > 1


def _sort_shard(held: list[bytes], length: int) -> pa.RecordBatch:
    # Only strings whose minimiser occurs elsewhere are kept, bundle by bundle, so that a shard's memory follows what it sorts.
    keys = np.concatenate([unbundle(x, 6)[4] for x in held])
    wanted = _shared(keys)
    columns, datas, at = [], [], 0
    for x in held:
        *own, data = unbundle(x, 6)
        keep = wanted[at : at + len(own[0])] | (own[5] > 0)
        at += len(own[0])
        begin = np.cumsum(own[3]) - own[3]
        datas.append(gather(data, begin[keep], (begin + own[3])[keep])[0])
        columns.append(np.stack([c[keep] for c in own]))
    ids, marks, first, sizes, keys, several = np.concatenate(columns, axis=1)
    data = np.concatenate(datas)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    one, two = (long_ranges(roll, roll.prefix(data), offsets[:-1], offsets[1:]) for roll in (_ONE, _TWO))
    whole = _earlier(one, two, ids, marks, first)
    rows = [(ids[whole], marks[whole], first[whole], first[whole] + sizes[whole] - length)]

    # Different strings of one minimiser, and those that may repeat within themselves.
    left = np.flatnonzero(~whole)
    left = left[_shared(keys[left]) | (several[left] > 0)]
    # Of those only the stretches of windows whose hash occurs again.
    data, starts = gather(data, offsets[left], offsets[left + 1])
    at = np.flatnonzero(inside_values(starts, length, len(data)))
    at = at[_shared(_ONE.windows(_ONE.prefix(data), length)[at])]
    owner = np.searchsorted(starts, at, "right") - 1
    heads, tails = runs_of(at, owner)
    begin, end, owner = at[heads], at[tails] + length, owner[heads]
    first = first[left[owner]] + begin - starts[owner]
    ids, marks = ids[left[owner]], marks[left[owner]]
    # Copies that differ elsewhere have equal stretches: one of those is enough, as for whole strings.
    one, two = (long_ranges(roll, roll.prefix(data), begin, end) for roll in (_ONE, _TWO))
    whole = _earlier(one, two, ids, marks, first)
    rows.append((ids[whole], marks[whole], first[whole], first[whole] + (end - begin)[whole] - length))
    begin, end, first, ids, marks = begin[~whole], end[~whole], first[~whole], ids[~whole], marks[~whole]
    if len(begin):
        data, starts = gather(data, begin, end)
        text, place = _with_ends(data, starts)
        order = sort_suffixes(text, 257)
        order = order[text[order] > 0]
        at = place[order]
        owner = np.searchsorted(starts, at, "right") - 1
        fits = at + length <= starts[owner + 1]
        at, owner = at[fits], owner[fits]
        one, two = _ONE.windows(_ONE.prefix(data), length), _TWO.windows(_TWO.prefix(data), length)
        # Suffixes that share a prefix of this length are neighbours; shorter suffixes between them do not.
        new = np.ones(len(at), bool)
        new[1:] = (one[at[1:]] != one[at[:-1]]) | (two[at[1:]] != two[at[:-1]])
        group = np.cumsum(new)
        start = first[owner] + at - starts[owner]
        order = np.lexsort((start, marks[owner], ids[owner], group))
        head = np.ones(len(order), bool)
        head[1:] = group[order[1:]] != group[order[:-1]]
        repeat = _not_first(order, head, ids[owner], marks[owner], start)
        found = np.sort(at[repeat])
        owner = np.searchsorted(starts, found, "right") - 1
        heads, tails = runs_of(found, owner)
        which = owner[heads]
        base = first[which] - starts[which]
        rows.append((ids[which], marks[which], base + found[heads], base + found[tails]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows, strict=True)], ["id", "hash", "first", "last"])


def _with_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings as numbers from 1, each ended by a 0, and which byte each number is."""
    sizes = np.diff(starts)
    text = np.zeros(len(data) + len(sizes), np.int64)
    place = np.full(len(text), -1, np.int64)
    inner = np.ones(len(text), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    text[inner] = data.astype(np.int64) + 1
    place[inner] = np.arange(len(data))
    return text, place


def remove_strings(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """id, kept (the bytes that are left), n_bytes, n_removed and n_spans (maximal removed runs) of every row."""
    found = repeated_strings(docs, length, gram)
    # Both joins of the texts go by the id alone, so the texts are shuffled once; of rows with one id, those of another text are told apart
    # by a condition that is not a key.
    lists = found.withColumnsRenamed({"id": "_id", "hash": "_hash"}).repartition("_id").groupBy("_id", "_hash")
    lists = lists.agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    rows = texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    same = (F.col("id") == F.col("_id")) & (F.col("hash").bitwiseXOR(F.col("_hash")) == 0)
    both = rows.join(lists, same, "left").select("id", "text", "first", "last")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = raw(batch.column(1))
            marks = np.zeros(len(data) + 1, np.int32)
            first, number = lists_of(batch.column(2))
            last, _ = lists_of(batch.column(3))
            base = np.repeat(bounds[:-1], number)
            np.add.at(marks, base + first, 1)
            np.add.at(marks, base + last + length, -1)
            gone = np.cumsum(marks[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = bounds[:-1][np.diff(bounds) > 0]
            begins[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(begins)])[bounds]
            kept = data[~gone]
            at = np.concatenate([[0], np.cumsum(~gone)])[bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([kept[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                    pa.array(np.diff(bounds)),
                    pa.array(np.diff(bounds) - np.diff(at)),
                    pa.array(np.diff(spans)),
                ],
                ["id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return both.mapInArrow(keep, "id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
