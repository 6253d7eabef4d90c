"""MinHash fingerprints of documents, their likeness, and near copies by banding.

A fingerprint keeps, for each of `permutations` universal hash functions, the least hash of a text's word shingles (16 bits of it, as
hex digits). Hashes are made in numpy for a slice of texts at once. Near copies: signature bands are joined in Spark, each group first to its
smallest member; where that leaves a group in several components, its members are compared across these, blockwise. Every candidate's
Jaccard similarity is verified on the shingles.

Defined cases. A null text is an empty one. A text of fewer words than a shingle has its whole word sequence as one shingle; one without
words has none, its fingerprint is all `f`, and it is like another such text only. Equal texts have equal fingerprints. The next document
of repeated ids is by the text's hash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Rolling, mix, partitions, raw, slices, stored, texts, word_hashes, word_ranges
from tallyhouse.llm.graph import components

SHINGLE_WORDS = 5
PERMUTATIONS = 128

_WORDS, _SHINGLES = Rolling("fingerprint words"), Rolling("fingerprint shingles")


def shingle_hashes(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, text by text, and where each text's begin (one more at the end)."""
    data, offsets = raw(column)
    starts, ends, bounds = word_ranges(data, offsets)
    sums = _SHINGLES.prefix(word_hashes(data, starts, ends, _WORDS))
    count = np.diff(bounds)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(number) + 1, np.int64)
    np.cumsum(number, out=at[1:])
    first = np.repeat(bounds[:-1] - at[:-1], number) + np.arange(at[-1])
    last = np.minimum(first + size, np.repeat(bounds[1:], number))
    return _SHINGLES.ranges(sums, first, last), at


def signatures(column: pa.Array, permutations: int = PERMUTATIONS, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of `permutations` numbers of 16 bits for each text."""
    hashes, at = shingle_hashes(column, size)
    draw = np.random.default_rng(20_021).integers(0, 1 << 63, (2, permutations), dtype=np.uint64)
    out = np.full((len(column), permutations), 0xFFFF, np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        x = hashes >> np.uint64(32)
        work = np.empty_like(x)
        for k in range(permutations):
            np.multiply(x, draw[0, k] | np.uint64(1), out=work)
            np.add(work, draw[1, k], out=work)
            least = np.minimum.reduceat(work, at[some])
            out[some, k] = (mix(least >> np.uint64(32)) % np.uint64(0xFFFF)).astype(np.uint16)
    return out


def hexed(signs: np.ndarray) -> list[str]:
    text = signs.astype(">u2").tobytes().hex()
    width = 4 * signs.shape[1]
    return [text[k : k + width] for k in range(0, len(text), width)]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=1)


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, size: int = SHINGLE_WORDS) -> DataFrame:
    """id, text, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = pa.array(hexed(signatures(batch.column(1), permutations, size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], ["id", "text", "fingerprint"])

    return texts(docs).mapInArrow(run, "id bigint, text string, fingerprint string")


def half_replaced(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of another text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _beside_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to buckets of neighbouring ids; each bucket also gets the first rows of the bucket after it, marked as `tail`.

    Bucket bounds are quantiles of the ids, four a shuffle partition; the first ids of the buckets are as many at most.
    """
    rows = texts(docs)
    spark = docs.sparkSession
    number = 4 * partitions(spark)
    bounds = sorted(set(rows.approxQuantile("id", [k / number for k in range(1, number)], max(1e-4, 0.25 / number)) or []))
    edges = np.array(bounds, dtype=np.float64).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype(np.int32))

    ids = rows.select("id", bucket_of("id").alias("bucket"))
    firsts = sorted((r[1], r[0]) for r in ids.groupBy("bucket").agg(F.min("id")).collect())
    tails = [(first, firsts[k - 1][1]) for k, (first, _) in enumerate(firsts)]
    table = spark.createDataFrame(tails, "id bigint, _tail_of int")
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("_tail_of").alias("bucket"), F.lit(True).alias("tail"))
    dealt = rows.withColumn("bucket", bucket_of("id")).join(F.broadcast(table), "id", "left")
    dealt = dealt.select("id", "text", F.explode(F.when(F.col("_tail_of").isNull(), F.array(own)).otherwise(F.array(own, tail))).alias("to"))
    return (
        dealt.select(F.col("to.bucket").alias("bucket"), F.col("to.tail").alias("tail"), "id", "text")
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "tail", "id", F.xxhash64("text"))
    )


def edited_fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of each text and of its edited text (see `half_replaced`; the last document is followed by the first).

    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. No task sees more than its rows one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, tail, id, text, signature of the last row seen
        for batch in slices(batches, "text"):
            bucket, tail, ids, own = (c.to_pylist() for c in batch.columns)
            signs = signatures(batch.column(3), permutations, size)
            if held is not None:
                bucket, tail, ids, own = [held[0], *bucket], [held[1], *tail], [held[2], *ids], [held[3], *own]
                signs = np.concatenate([held[4][None], signs])
            take = [k for k in range(len(ids) - 1) if not tail[k]]
            held = (bucket[-1], tail[-1], ids[-1], own[-1], signs[-1])
            if not take:
                continue
            edited = [half_replaced(own[k], own[k + 1]) for k in take]
            changed = signatures(pa.array(edited, pa.large_string()), permutations, size)
            at = np.array(take)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([ids[k] for k in take], pa.int64()),
                    "n_chars": pa.array([len(own[k]) for k in take], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    "fingerprint": pa.array(hexed(signs[at])),
                    "edited_fingerprint": pa.array(hexed(changed)),
                    "near_edited": pa.array(likeness(signs[at], changed)),
                    "near_next": pa.array(likeness(signs[at], signs[at + 1])),
                }
            )

    schema = (
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return _beside_next(docs).mapInArrow(run, schema)


def near_copies(
    docs: DataFrame, threshold: float = 0.8, bands: int = 32, permutations: int = PERMUTATIONS, block: int = 4096
) -> DataFrame:
    """Verified pairs (head: the smaller id, id, their Jaccard similarity); equal texts form no pairs.

    One text stands for its exact copies. The pairs link all that any band brings together and that is similar, directly or by others: a
    band's group is joined to its smallest member, and where several components are left in it, members of different components are
    compared too. Members of one component are not, so copies in hot bands give no squares.
    """
    distinct = fingerprints(docs, permutations).groupBy("text", "fingerprint").agg(F.min("id").alias("id"))
    marked = stored(distinct, "fingerprints")
    width = 4 * permutations // bands
    keys = marked.select(
        "id",
        F.explode(F.array(*[F.concat(F.lit(f"{b}:"), F.substring("fingerprint", 1 + b * width, width)) for b in range(bands)])).alias("band"),
    )
    heads = keys.groupBy("band").agg(F.min("id").alias("head"))
    pairs = keys.join(heads, "band").where("id != head").select("head", "id").distinct()

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, left_at = shingle_hashes(batch.column(2))
            right, right_at = shingle_hashes(batch.column(3))
            found = []
            for k in range(batch.num_rows):
                a, b = np.unique(left[left_at[k] : left_at[k + 1]]), np.unique(right[right_at[k] : right_at[k + 1]])
                both = len(np.intersect1d(a, b, assume_unique=True))
                found.append(both / max(1, len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["head", "id", "jaccard"])

    own = marked.select("id", "text")
    full = pairs.join(own, "id").join(own.select(F.col("id").alias("head"), F.col("text").alias("head_text")), "head")
    to_heads = full.select("head", "id", "head_text", "text").mapInArrow(jaccard, "head bigint, id bigint, jaccard double").where(
        F.col("jaccard") >= threshold
    )
    to_heads = stored(to_heads, "near-heads")
    roots = components(to_heads.select(F.col("id").alias("a"), F.col("head").alias("b")), "near-components")
    member = keys.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Groups in several components; bands of the same members count once.
    member = stored(member, "near-members")
    open_groups = (
        member.groupBy("band")
        .agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), *[F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)])
        .where("a <> b")
        .groupBy("n", "h1", "h2")
        .agg(F.min("band").alias("band"))
        .select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    # One task for a group of one block, else one for every two blocks.
    placed = member.join(open_groups, "band").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("task", low * F.col("blocks") + high)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def close() -> pa.RecordBatch:
            found = _across(group, threshold)
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["head", "id", "jaccard"]
            )

        for batch in batches:
            hashes, at = shingle_hashes(batch.column(5))
            bands, tasks, blocks, roots, ids = (c.to_pylist() for c in batch.columns[:5])
            for k in range(batch.num_rows):
                if (bands[k], tasks[k]) != now:
                    yield close()
                    now, group = (bands[k], tasks[k]), []
                group.append((ids[k], roots[k], blocks[k], np.unique(hashes[at[k] : at[k + 1]])))
        yield close()

    dealt = (
        tasks.join(own, "id")
        .select("band", "task", "block", "root", "id", "text")
        .repartition(partitions(docs.sparkSession), "band", "task")
        .sortWithinPartitions("band", "task", "id")
    )
    return to_heads.unionByName(dealt.mapInArrow(across, "head bigint, id bigint, jaccard double")).distinct()


def _across(group: list[tuple[int, int, int, np.ndarray]], threshold: float) -> list[tuple[int, int, float]]:
    """Links (smaller id, larger id, Jaccard similarity) between members (id, component, block, set) of different components, until none is
    left that would join two. Members of one block are compared only where there is no other."""
    group = sorted(group, key=lambda m: len(m[3]))
    size = np.array([len(m[3]) for m in group])
    label = np.unique([m[1] for m in group], return_inverse=True)[1]
    block = np.array([m[2] for m in group])
    apart = len(np.unique(block)) > 1
    found = []
    for q, (own, _, _, left) in enumerate(group):
        most = int(np.searchsorted(size, size[q] / threshold + 1e-6, "right")) if threshold > 0 else len(group)
        near = np.arange(q + 1, most)
        near = near[label[near] != label[q]]
        if apart:
            near = near[block[near] != block[q]]
        for x in near:
            if label[x] == label[q]:
                continue
            other, _, _, right = group[x]
            both = len(np.intersect1d(left, right, assume_unique=True))
            value = both / max(1, len(left) + len(right) - both)
            if value >= threshold:
                label[label == label[x]] = label[q]
                found.append((min(own, other), max(own, other), value))
    return found
