"""What the operators share: scratch tables, whole-column views of text, rolling hashes.

Rows and nulls. A null text counts as an empty one. A null `doc_id` sorts before every other id and comes back as null.
Rows may repeat, ids too: a row is known by its id and its text, so equal rows get equal results.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import scratch_path

NO_ID = -(1 << 63)
#: Text is worked on in slices of about so many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20

# Fixed by the contracts: white space is 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BREAK = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the Python workers, once a context, as `--py-files` would."""
    context = spark.sparkContext
    if getattr(context, "_tallyhouse_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tallyhouse-code-")) / "tallyhouse.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    context._tallyhouse_sent = True


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: the lineage ends, and consumers share one computation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be sent to all executors (some tens of MB).
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if a count finds at most `rows` rows; else it is left to a shuffle join. Pass something stored."""
    return F.broadcast(df) if df.count() <= rows else df


#: Bits that tell which keys may be wanted (16 MB, sent to all executors).
MAP_BITS = 1 << 27


def join_few(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of wide rows with some keys (pass something stored). Where the keys are too many to be sent, only rows that a map of
    their hashes lets through are shuffled: all that are wanted, and one in fifty others for two million keys."""
    if wanted.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(wanted), keys)
    place = (F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS)) + 1).alias("_place")
    bucket = F.bitmap_bucket_number("_place").alias("_bucket")
    maps = wanted.select(place).groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    maps = stored(maps, "wanted-maps")
    bit = "cast(bitmap_bit_position(_place) as int)"
    byte = F.conv(F.hex(F.expr(f"substring(_bits, {bit} div 8 + 1, 1)")), 16, 10).cast("int")
    marked = df.select("*", place).select("*", bucket).join(F.broadcast(maps), "_bucket")
    marked = marked.where(byte.bitwiseAND(F.expr(f"shiftleft(1, {bit} % 8)")) != 0)
    return marked.drop("_place", "_bucket", "_bits").join(wanted, keys)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """`id` (null as the smallest) and `text` (null as empty) of a table with doc_id and text, whatever else it holds."""
    ship(docs.sparkSession)
    return docs.select(
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *more
    )


def known_id(column: str = "id") -> Column:
    """Back from `id` to a doc_id that may be null."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def held_out(id_column: str = "id") -> Column:
    """Rows kept for evaluation: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False)) & (F.col(id_column) != NO_ID)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named column has about `size` bytes in each; a longer value stands alone.

    Workers live on after a task, so what the allocators keep is handed back at its end.
    """
    for batch in batches:
        yield from cut_batch(batch, column, size)
    release()


def cut_batch(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of one batch."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(lengths + 16)])
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each value starts in them (one more at the end)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges of `data` as one binary column."""
    out, offsets = gather(data, starts, ends)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of the ranges one after another, and where each range starts among them."""
    lengths = (ends - starts).astype(np.int64)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if not offsets[-1]:
        return data[:0], offsets
    step = np.ones(offsets[-1], np.int32 if len(data) < 1 << 31 else np.int64)
    full = lengths > 0
    first, begin, end = offsets[:-1][full], starts[full], ends[full]
    step[0] = begin[0]
    step[first[1:]] = begin[1:] - end[:-1] + 1
    return data[np.cumsum(step, dtype=step.dtype)], offsets


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of each value start and end, and the number of words before each value (one more at the end)."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    if len(data):
        edge[0], edge[-1] = word[0], word[-1]
        starts_here = np.concatenate([[False], word]) & False
        starts_here[:-1] = edge[:-1] & word
        ends_here = np.zeros(len(data) + 1, bool)
        ends_here[1:] = edge[1:] & word
        starts_here[inside] |= word[inside]
        ends_here[inside] |= word[inside - 1]
        starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def _random_words(label: str, count: int) -> np.ndarray:
    stream = hashlib.shake_256(label.encode()).digest(8 * count)
    return np.frombuffer(stream, dtype=np.uint64).copy()


class Rolling:
    """Hashes modulo 2^64 of any range of a sequence, from one pass: sums of codes times powers of an odd base.

    Sound for ranges of fewer than 1,024 items (see `word_hashes`); longer ones are hashed by `long_ranges`.
    """

    def __init__(self, label: str):
        self.label = label
        self.codes = _random_words(label, 256)
        self.base = (int(_random_words(label + "/base", 1)[0]) & ~7) | 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)
        self.places = np.ones(0, np.uint64)

    def __reduce__(self):
        return Rolling, (self.label,)

    def _powers(self, count: int) -> None:
        if len(self.up) < count:
            for name, base in (("up", self.base), ("down", self.inverse)):
                full = np.full(count, base, np.uint64)
                full[0] = 1
                setattr(self, name, np.cumprod(full, dtype=np.uint64))

    def factors(self, count: int) -> np.ndarray:
        """Random odd factors, one a place."""
        if len(self.places) < count:
            size = 1 << (count - 1).bit_length()
            self.places = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(self.base)) | np.uint64(1)
        return self.places

    def prefix(self, items: np.ndarray) -> np.ndarray:
        """Running sums over `items` (bytes, or hashes of 64 bits)."""
        self._powers(len(items) + 1)
        sums = np.zeros(len(items) + 1, np.uint64)
        values = self.codes[items] if items.dtype == np.uint8 else items
        np.cumsum(values * self.up[: len(items)], dtype=np.uint64, out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(sums))
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, sums: np.ndarray, size: int) -> np.ndarray:
        """One hash for each start of a window of `size` items."""
        self._powers(len(sums))
        count = max(0, len(sums) - size)
        return mix((sums[size : size + count] - sums[:count]) * self.down[:count])


#: Ranges of up to so many items go by one sum.
BLOCK = 512


def long_ranges(roll: Rolling, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of any length: a longer one by the hashes of its blocks, each with a random factor of its place."""
    lengths = ends - starts
    if not len(starts) or int(lengths.max()) <= BLOCK:
        return roll.ranges(sums, starts, ends)
    number = np.maximum(1, -(-lengths // BLOCK))
    first = np.cumsum(number) - number
    place = np.arange(int(number.sum())) - np.repeat(first, number)
    low = np.repeat(starts, number) + place * BLOCK
    parts = roll.ranges(sums, low, np.minimum(low + BLOCK, np.repeat(ends, number)))
    joined = np.add.reduceat(parts * roll.factors(int(number.max()))[place], first)
    return np.where(number == 1, parts[first], mix(joined + lengths.astype(np.uint64)))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64 bits so that any of them can be used for dealing."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roll: Rolling, piece: int = 1 << 19) -> np.ndarray:
    """A hash of each word, worked out for some bytes at a time.

    Every place in a word has a random factor of its own. Powers of one base will not do here: modulo 2^64 there are words of some 1,024
    letters (a text and its complement, doubled again and again) whose sums are equal whatever the base is.
    """
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + piece, "right")))
        base, own = starts[low], starts[low:high] - starts[low]
        lengths = ends[low:high] - starts[low:high]
        bytes_ = data[base : ends[high - 1]]
        place = np.arange(len(bytes_)) - np.repeat(own, np.diff(np.append(own, len(bytes_))))
        values = roll.codes[bytes_] * roll.factors(int(place.max(initial=0)) + 1)[place]
        # Every second sum is that of what lies between two words.
        cuts = np.empty(2 * len(own), np.int64)
        cuts[::2], cuts[1::2] = own, own + lengths
        sums = np.add.reduceat(np.append(values, np.uint64(0)), cuts)[::2]
        out[low:high] = mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        low = high
    return out


def inside_values(bounds: np.ndarray, size: int, total: int) -> np.ndarray:
    """For each start among `total` items: does a window of `size` stay within its value? `bounds`: items before each value."""
    good = np.zeros(max(0, total - size + 1), bool)
    if len(good):
        last = np.repeat(bounds[1:], np.diff(bounds))[: len(good)]
        good[:] = np.arange(len(good)) + size <= last
    return good


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of `total` items lie in a window of `size` that begins at one of `starts`."""
    marks = np.zeros(total + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, total), -1)
    return np.cumsum(marks[:-1]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
