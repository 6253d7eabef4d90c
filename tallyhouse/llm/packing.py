"""Best-fit packing of token pieces after a Martello-Toth reduction.

Lengths are whole numbers of at most `capacity`, so the instance is a histogram with as many entries as there are lengths, whatever the
number of documents. The plan is made on that histogram: first bins that provably belong to some best packing are fixed (dominance),
then what is left goes best-fit, longest first. A plan is a list of runs: `times` equal sequences that each take the same lengths.
Spark tokenises, counts, ranks the pieces of each length and joins every piece to the run that its rank falls into.

Defined cases. A null text is an empty one: its only token is the end mark. Rows may repeat; each is packed. An empty table gives no
rows. Texts are whole, however long; only documents above the capacity are cut, so that all but the first piece are full.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import cut_batch, gather, slices, stored, texts

#: Two white-space or control characters in a row: such texts are not split at blanks before they are tokenised.
_NOT_SPLIT = r"[\s\x0B\x1C-\x1F\x85\p{Z}\p{C}]{2}|^ | $"


#: Larger slices than elsewhere: more of their chunks are equal.
SLICE_BYTES = 12 << 20
#: Of a slice so much is split and laid out at a time, since its chunks and tokens take many times the room of its text.
PART_BYTES = 1 << 20


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Fixed value: how byte-level vocabularies of this family split a text before the merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _ranked(path: str):
    """The same vocabulary for merging by rank, which is several times as fast; None unless it gives the same ids by construction: plain
    byte-level merges, numbered in their order."""
    import tiktoken

    given = json.loads(Path(path).read_text())
    model, before = given["model"], given.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    )
    if not plain or given.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    byte, ranks = _byte_characters(), {}
    special = {t["content"] for t in given.get("added_tokens", [])}
    for token, number in model["vocab"].items():
        if token not in special:
            ranks[bytes(byte[c] for c in token)] = number
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    numbers = [model["vocab"][a + b] for a, b in merges]
    if numbers != sorted(numbers) or len(numbers) + 256 != len(ranks) or numbers[0] != 256:
        return None
    return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), frozenset(special)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=at[1:])
    out = np.empty(at[-1], np.uint32)
    for k, x in enumerate(lists):
        out[at[k] : at[k + 1]] = x
    return out, at


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> np.ndarray:
    """Bytes of each token: its characters stand for one byte each."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, number in vocabulary.items():
        out[number] = len(token)
    return out


def _encode_chunks(chunks: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks one after another, and where each chunk's begin.

    Blank-led chunks are tokenised as one text, since tokens never cross a blank, and parted again by the bytes of the tokens.
    """
    tokenizer, led = _tokenizer(path), np.asarray(pc.starts_with(chunks, " "), dtype=bool)
    long = chunks.filter(pa.array(led))
    sizes = np.asarray(pc.binary_length(long), dtype=np.int64)
    text, ranked = "".join(long.to_pylist()), _ranked(path)
    if ranked is None or any(mark in text for mark in ranked[1]):
        one = np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        one = ranked[0].encode_to_numpy(text)
    ends = np.searchsorted(np.cumsum(_token_bytes(path)[one]), np.cumsum(sizes)) + 1 if len(one) else sizes
    other, other_at = _flat([e.ids for e in tokenizer.encode_batch_fast(chunks.filter(pa.array(~led)).to_pylist(), add_special_tokens=False)])
    number = np.zeros(len(chunks), np.int64)
    number[led] = np.diff(np.concatenate([[0], ends]))
    number[~led] = np.diff(other_at)
    at = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    ids = np.empty(at[-1], np.uint32)
    mine = np.repeat(led, number)
    ids[mine], ids[~mine] = one, other
    return ids, at


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Which texts go in whole; of the others the blank-led chunks, and where each text's begin."""
    whole = np.asarray(pc.match_substring_regex(column, _NOT_SPLIT), dtype=bool)
    parts = pc.split_pattern(column.filter(pa.array(~whole)), " ")
    bounds = np.asarray(parts.offsets, dtype=np.int32) - np.int32(parts.offsets[0].as_py())
    values = parts.flatten()
    lead = np.ones(len(values), bool)
    lead[bounds[:-1][np.diff(bounds) > 0]] = False
    return whole, bounds, pc.binary_join_element_wise(pc.if_else(pa.array(lead), " ", ""), values, "").dictionary_encode()


def encode_parts(columns: list[pa.Array], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each column: ids of all its texts one after another, and where each text starts among them.

    In a byte-level vocabulary that never joins across a single blank, a text is its blank-led chunks one after another, and a chunk's
    ids do not depend on what surrounds it. Equal chunks of all the columns are tokenised once. Texts with other white space go in whole.
    """
    split = [_split(column) for column in columns]
    chunks = pa.chunked_array([s[2] for s in split]).unify_dictionaries()
    ids, at = _encode_chunks(chunks.chunk(0).dictionary, path)
    for column, (whole, bounds, _), own in zip(columns, split, chunks.chunks, strict=True):
        which = np.asarray(own.indices)
        split_at = np.concatenate([[0], np.cumsum(np.diff(at)[which])])[bounds]
        # Lay out all texts in order: the split ones from their chunks, the others as they came.
        total = np.zeros(len(column), np.int64)
        total[~whole] = np.diff(split_at)
        laid = gather(ids, at[which], at[which + 1])[0]
        if whole.any():
            texts_ = column.filter(pa.array(whole)).to_pylist()
            odd = [np.array(e.ids, np.uint32) for e in _tokenizer(path).encode_batch_fast(texts_, add_special_tokens=False)]
            total[whole] = [len(x) for x in odd]
            from_chunks = np.repeat(~whole, total)
            out = np.empty(len(from_chunks), np.uint32)
            out[from_chunks], out[~from_chunks] = laid, np.concatenate(odd)
            laid = out
        yield laid, np.concatenate([[0], np.cumsum(total)])


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """`encode_parts` of one column."""
    return next(encode_parts([column], path))


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids: each text's tokens and the end mark, cut to the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            parts = list(cut_batch(batch, size=PART_BYTES))
            for part, (ids, at) in zip(parts, encode_parts([p.column("text") for p in parts], path), strict=True):
                yield cut_part(part, ids, at)

    def cut_part(batch: pa.RecordBatch, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        row, piece, start, length, crc, kept = [], [], [], [], [], []
        for k in range(batch.num_rows):
            own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
            first = len(own) % capacity or capacity
            cuts = [0, *range(first, len(own) + 1, capacity)]
            for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row.append(k)
                piece.append(n)
                start.append(low)
                length.append(high - low)
                crc.append(zlib.crc32(own[low:high].tobytes()))
                if with_ids:
                    kept.append(own[low:high].astype(np.int32))
        columns = {
            "id": batch.column(0).take(pa.array(row, pa.int64())),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return texts(docs).mapInArrow(cut, schema)


class _Stock:
    """How many items of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c}
        self.lengths = sorted(self.counts)

    def take(self, length: int, times: int) -> None:
        self.counts[length] -= times
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def without(self, *items: int) -> _Stock:
        left = dict(self.counts)
        for n in items:
            left[n] -= 1
        return _Stock(left)

    def largest(self, most: int) -> int:
        """The longest that is at most `most`; 0 if there is none."""
        k = bisect_right(self.lengths, most)
        return self.lengths[k - 1] if k else 0

    def smallest(self, number: int) -> list[int]:
        found: list[int] = []
        for n in self.lengths:
            found += [n] * min(self.counts[n], number - len(found))
            if len(found) == number:
                break
        return found


def _best_pair(stock: _Stock, room: int) -> tuple[int, int] | None:
    """The two items (longer first) with the largest sum of at most `room`; of equal sums the one with the longest item."""
    best: tuple[int, int, int] | None = None
    low, high = 0, len(stock.lengths) - 1
    while low <= high:
        a, b = stock.lengths[high], stock.lengths[low]
        if a + b > room or (low == high and stock.counts[a] < 2):
            high -= 1
            continue
        if best is None or a + b > best[0]:
            best = (a + b, a, b)
        low += 1
    return best[1:] if best else None


def _dominant(stock: _Stock, longest: int, capacity: int) -> tuple[int, ...] | None:
    """A set with `longest` in it that dominates all others with it, after Martello and Toth; None if none is proven.

    Sets of up to three items are looked at. With k the number of smallest items that fit beside `longest`: if none fits, it stands
    alone. If only one fits, or one fills the bin, that one (the longest that fits) is best. If two fit, the longest single item is best
    where no pair is longer; else the best pair is, if it starts with the longest item and no two items between its members fit.
    """
    others = stock.without(longest)
    room = capacity - longest
    least = others.smallest(3)
    fit = int(np.searchsorted(np.cumsum(least), room, "right")) if least else 0
    if fit == 0:
        return (longest,)
    star = others.largest(room)
    if fit == 1 or star == room:
        return (longest, star)
    if fit == 2:
        pair = _best_pair(others, room)
        if pair is None or star >= sum(pair):
            return (longest, star)
        if pair[0] == star:
            between = others.without(star)
            above = [n for n in between.lengths if pair[1] < n <= star]
            lightest = [n for n in above for _ in range(min(2, between.counts[n]))][:2]
            if len(lightest) < 2 or sum(lightest) > room:
                return (longest, *pair)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Bins that belong to some best packing, as (times, lengths), and the histogram of what is left."""
    stock, fixed = _Stock(counts), []
    again = True
    while again:
        again = False
        for length in sorted(stock.counts, reverse=True):
            while stock.counts.get(length):
                found = _dominant(stock, length, capacity)
                if found is None:
                    break
                need = {n: found.count(n) for n in found}
                times = min(stock.counts[n] // c for n, c in need.items())
                # A set of several items stays dominant while no length of it runs out; the last ones are looked at again.
                for n, c in need.items():
                    stock.take(n, c * times)
                fixed.append((times, found))
                again = len(found) > 1
    return fixed, stock.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each item into the fullest bin that has room; bins in the same state are filled together."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(times: int, room: int, items: tuple[int, ...]) -> None:
        if room not in by_room:
            rooms.insert(bisect_right(rooms, room), room)
        by_room.setdefault(room, []).append([times, items])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_right(rooms, length - 1)
            if k < len(rooms):
                room = rooms[k]
                times, items = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            else:
                room, items = capacity, ()
                times = -(-left // (capacity // length))
            each = room // length
            full = min(times, left // each)
            some = left - full * each if full < times else 0
            if full:
                put(full, room - each * length, items + (length,) * each)
            if some:
                put(1, room - some * length, items + (length,) * some)
            if rest := times - full - (some > 0):
                put(rest, room, items)
            left -= full * each + some
    return [(times, items) for bins in by_room.values() for times, items in bins if items]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first sequence, times, offset): pieces of this length with a rank in [low, high) belong to the slot, and the
    rank's distance from low picks the sequence."""
    ranks: dict[int, int] = {}
    found, sequence = [], 0
    for times, items in runs:
        offset = 0
        for length in items:
            low = ranks.get(length, 0)
            found.append((length, low, low + times, sequence, times, offset))
            ranks[length] = low + times
            offset += length
        sequence += times
    return found


#: Pieces ranked together; more of one length go to more groups.
GROUP_ROWS = 200_000


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces (id, piece, start, length, ids_crc32) with sequence_id and offset.

    What reaches the driver is the histogram (at most `capacity` rows). The slots are as many as runs times their lengths: runs are
    bounded by the number of pairs of length and free room, not by the data; they are broadcast. Ranks within a length are counted per
    (length, group), groups being dealt by a hash of the row, so that one length with a third of all rows is split.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    found = slots(plan(counts, capacity))
    groups = max(1, -(-sum(counts.values()) // GROUP_ROWS))
    table = spark.createDataFrame(
        found, "_length bigint, _low bigint, _high bigint, _sequence bigint, _times bigint, _offset bigint"
    )
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "_group").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_group", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_group").orderBy("id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("_own", own).join(bases, ["length", "_group"]).withColumn("_rank", F.col("_own") + F.col("_base"))
    slot = F.broadcast(table)
    joined = ranked.join(slot, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    return joined.select(
        *pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_low")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Where every piece of every document goes; see `sequences` for the packed ids."""
    return pack(stored(token_pieces(docs, path, end_id, capacity, with_ids=False), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """sequence_id and its ids, from the placement of the same documents."""
    pieces = token_pieces(docs, path, end_id, capacity)
    full = placed.join(pieces.select("id", "piece", "ids_crc32", "ids").distinct(), ["id", "piece", "ids_crc32"])
    parts = full.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))

