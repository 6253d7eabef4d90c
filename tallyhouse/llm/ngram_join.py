"""Documents whose sets of word shingles have a Jaccard similarity of at least `percent`, as components, by a count-vector R-tree join.

A set's shingles are hashed into groups; how many fall into each group is a point. Two sets share at most the sum, over the groups, of
the smaller of their counts. An R-tree over the points (leaves of similar sizes, each with the largest count of every group) prunes with
that bound leaf by leaf and point by point; what survives is verified on the shingles themselves.

To keep the tree's work local, sets that may be linked are brought together first, exactly: sets of similar sizes differ in at most T
shingles, so of the blocks of shingles (dealt by a hash) all but T are equal in both. Two sets with as many equal blocks as that argument
asks of them (blocks without shingles aside) give an edge. Blocks that more than `FEW` sets share are hot and give no pairs: a set lists
its hot blocks, and two sets that share others need as many fewer of these as both have hot ones. Only sets with as many hot blocks as are
asked for can be linked by hot blocks alone; each of these leaves out its hottest ones, all but one of those asked for, since two linked
sets share a block that neither leaves out, and is joined to the smallest set of each block left. So a common block alone links nothing.
The components of these edges are families, and each family is joined by its own tree.
Families of more than `FAMILY_BLOCK` sets are cut into blocks by size, and every two blocks whose sizes allow a link are joined by a task.
Links found between sets that are in one component already are not looked for, so copies are never expanded into pairs.

Hot groups: equal sets are one node; where more than `FEW` sets of a slice of texts share a block, only the smallest travels to the bucket,
so a block that a third of all documents share does not grow it, and no group gives a square of edges.

Defined cases. A null text and one without words have an empty set: n_shingles 0, linked with nothing, component its own id. With fewer
words than a shingle has, the whole sequence is the one shingle. Rows may repeat: equal texts are one set. A null id is the smallest.
Sets are compared by 64-bit hashes of their shingles, and known by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import Rolling, broadcast_if_small, join_few, mix, partitions, raw, slices, stored, texts, word_hashes, word_ranges
from tallyhouse.llm.graph import components

GROUPS = 32
LEAF = 32
#: More sets than that make a block hot; up to there every two of them are counted as a pair.
FEW = 4
FAMILY_BLOCK = 16384
CLASS_RATIO = 1.4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORDS, _SHINGLES = Rolling("join words"), Rolling("join shingles")
_U = np.uint64


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles."""
    data, offsets = raw(column)
    data = _LOWER[data]
    starts, ends, bounds = word_ranges(data, offsets)
    sums = _SHINGLES.prefix(word_hashes(data, starts, ends, _WORDS))
    count = np.diff(bounds)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(number)])
    first = np.repeat(bounds[:-1] - at[:-1], number) + np.arange(at[-1])
    hashes = _SHINGLES.ranges(sums, first, np.minimum(first + size, np.repeat(bounds[1:], number)))
    return [np.unique(hashes[a:b]) for a, b in zip(at, at[1:], strict=False)]


def set_marks(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums of 64 bits that a set is known by (rows), whatever the order of its shingles."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    flat = np.concatenate([*sets, np.zeros(1, _U)])
    out = np.zeros((len(sets), 2), _U)
    for k, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(flat[:-1] ^ _U(seed)), dtype=_U)])
        out[:, k] = mix(sums[at[1:]] - sums[at[:-1]])
    return out


class Sizes:
    """Size classes, and for each the number of shingles in which two linked sets may differ and the number of blocks."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.differ, self.blocks = [1], [], []

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size or len(self.differ) < len(self.low) - 1:
            nxt = max(self.low[-1] + 1, int(self.low[-1] * CLASS_RATIO) + 1)
            differ = 2 * (nxt - 1) * (100 - self.percent) // (100 + self.percent)
            self.differ.append(differ)
            self.blocks.append(int(1.15 * (differ + 1)) + 1 if differ else 1)
            self.low.append(nxt)

    def of(self, size: int) -> list[int]:
        """The class of a size, and the next one if a linked set may be in it."""
        most = size * 100 // self.percent
        self._grow(2 * most + 2)
        k = int(np.searchsorted(self.low, size, "right")) - 1
        return [k, *(c for c in (k + 1,) if most >= self.low[c])]


def block_keys(own: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of blocks, and for each how many of its kind a linked, different set shares at least."""
    found, needed = [], []
    for c in sizes.of(len(own)):
        differ, blocks = sizes.differ[c], sizes.blocks[c]
        if not differ:
            continue  # only equal sets are linked
        spread = mix(own + _U((c + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        block = (spread >> _U(33)) % _U(blocks)
        sums, filled = _block_sums(block.astype(np.int64), spread, blocks)
        salt = mix(np.arange(blocks, dtype=_U) + _U(c << 32))
        found.append(mix(sums + salt)[filled])
        empty = np.flatnonzero(~filled)
        sure = blocks - len(empty) - differ
        needed.append(np.full(len(found[-1]), max(1, sure)))
        if sure < 1:
            # Too few blocks with shingles for the argument: an equal pair of blocks may be an empty one. Then some block of a second
            # dealing is equal too; keys of both together.
            other = mix(spread ^ _U(0xA0761D6478BD642F))
            sums, _ = _block_sums(((other >> _U(33)) % _U(blocks)).astype(np.int64), other, blocks)
            found += [mix(mix(sums + salt) + mix(salt[e : e + 1] + _U(1))) for e in empty]
            needed.append(np.ones(blocks * len(empty), np.int64))
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(needed)


def _block_sums(block: np.ndarray, values: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(block, kind="stable")
    at = np.searchsorted(block[order], np.arange(blocks + 1))
    sums = np.concatenate([[_U(0)], np.cumsum(values[order], dtype=_U)])
    return sums[at[1:]] - sums[at[:-1]], at[1:] > at[:-1]


#: A key on its way: how many such keys a linked set shares (0: the key is hot, and the node has it on its list already).
_KEY = np.dtype([("key", "<u8"), ("node", "<i8"), ("need", "u1")])
#: The same while it travels: 48 bits tell the keys of one bucket apart (two that meet by accident only widen a family).
_SENT = np.dtype([("low", "<u4"), ("mid", "<u2"), ("node", "<i8"), ("need", "u1")])


def _send(rows: np.ndarray) -> bytes:
    out = np.empty(len(rows), _SENT)
    out["low"], out["mid"] = rows["key"] & _U(0xFFFFFFFF), (rows["key"] >> _U(32)) & _U(0xFFFF)
    out["node"], out["need"] = rows["node"], rows["need"]
    return out.tobytes()


def _receive(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, _SENT)
    out = np.empty(len(rows), _KEY)
    out["key"] = rows["low"].astype(_U) | (rows["mid"].astype(_U) << _U(32))
    out["node"], out["need"] = rows["node"], rows["need"]
    return out


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key and node, the smallest need (0: the mark) of each; where each key's begin; which keys have many nodes or are marked."""
    rows = rows[np.lexsort((rows["need"], rows["node"], rows["key"]))]
    if len(rows):
        rows = rows[np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1]))]
    heads = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1])) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(rows)))
    many = (size > FEW) | (np.minimum.reduceat(rows["need"], heads) == 0) if len(rows) else np.zeros(0, bool)
    return rows, heads, many


def _inside(heads: np.ndarray, keys: np.ndarray, count: int) -> np.ndarray:
    """Which of `count` rows belong to one of the marked keys."""
    return np.repeat(keys, np.diff(np.append(heads, count)))


def _listed(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Hot keys (48 bits of them) of nodes, with the need."""
    return _rows(1, bucket, n=rows["need"].astype(np.int64), a=rows["node"], b=_signed(rows["key"] & _U((1 << 48) - 1)))


def _pairs(rows: np.ndarray, heads: np.ndarray, many: np.ndarray) -> np.ndarray:
    """(node, smaller node, keys needed) for every two nodes of a key with few of them, key by key."""
    size = np.diff(np.append(heads, len(rows)))
    found = []
    for n in range(2, FEW + 1):
        first = heads[~many & (size == n)]
        for i in range(1, n):
            for j in range(i):
                need = np.maximum(rows["need"][first + i], rows["need"][first + j])
                found.append(np.stack([rows["node"][first + i], rows["node"][first + j], need.astype(np.int64)], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


# Rows of the first pass: a set (kind 0), a hot key of a set (kind 1), keys on their way to a bucket (kind 2), counted pairs (kind 3).
_FIRST = "bucket int, kind tinyint, id bigint, hash bigint, n bigint, a bigint, b bigint, keys binary"
_NAMES = ["bucket", "kind", "id", "hash", "n", "a", "b", "keys"]


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _rows(kind: int, bucket: np.ndarray, **columns) -> pa.RecordBatch:
    count = len(bucket)
    kinds = {"bucket": pa.int32(), "kind": pa.int8(), "keys": pa.binary()}
    given = {"bucket": bucket, "kind": np.full(count, kind), **columns}
    return pa.RecordBatch.from_arrays(
        [
            pa.array(given[name], kinds.get(name, pa.int64())) if name in given else pa.nulls(count, kinds.get(name, pa.int64()))
            for name in _NAMES
        ],
        _NAMES,
    )


def _sets_and_edges(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Sets (kind 0: id, hash, n, a and b their marks), hot keys (kind 1: b) of sets (a: first mark) with the number of equal blocks needed
    (n), and pairs of sets (kind 3: first marks a and b) with the number of equal blocks found in one bucket (id) and needed overall (n)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = 4 * parts

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), size)
            marks = set_marks(sets)
            ids = np.asarray(batch.column(0))
            spread = (mix(ids.astype(_U)) % _U(buckets)).astype(np.int32)
            yield _rows(
                0, spread, id=ids, hash=np.asarray(batch.column(2)), n=np.array([len(s) for s in sets]), a=_signed(marks[:, 0]), b=_signed(marks[:, 1])
            )
            _, distinct = np.unique(marks[:, 0], return_index=True)
            distinct = [k for k in distinct if len(sets[k])]
            own = [block_keys(sets[k], sizes) for k in distinct]
            packed = np.empty(sum(len(k) for k, _ in own), _KEY)
            if not len(packed):
                continue
            packed["key"] = np.concatenate([k for k, _ in own])
            packed["node"] = np.repeat(_signed(marks[distinct, 0]), [len(k) for k, _ in own])
            packed["need"] = np.minimum(np.concatenate([n for _, n in own]), 250)
            packed, heads, many = _groups(packed)
            hot = _inside(heads, many, len(packed))
            if hot.any():
                listed = packed[hot]
                yield _listed((mix(listed["node"].astype(_U)) % _U(buckets)).astype(np.int32), listed)
            packed["need"][hot] = 0
            stays = hot.copy()
            stays[heads] = False
            packed = packed[~stays]
            bucket = (packed["key"] % _U(buckets)).astype(np.int64)
            packed = packed[np.argsort(bucket, kind="stable")]
            at = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(at))
            yield _rows(2, used, keys=[_send(packed[at[b] : at[b + 1]]) for b in used])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                packed, heads, many = _groups(_receive(b"".join(held)))
                listed = packed[_inside(heads, many, len(packed)) & (packed["need"] > 0)]
                if len(listed):
                    yield _listed(np.full(len(listed), now), listed).drop_columns(["keys"])
                pairs = _pairs(packed, heads, many)
                if len(pairs):
                    some, number = np.unique(pairs, axis=0, return_counts=True)
                    columns = {"id": number, "n": some[:, 2], "a": some[:, 0], "b": some[:, 1]}
                    yield _rows(3, np.full(len(some), now), **columns).drop_columns(["keys"])

        for batch in batches:
            kinds = np.asarray(batch.column(1))
            passed = batch.filter(pa.array(kinds != 2)).drop_columns(["keys"])
            if passed.num_rows:
                yield passed
            keyed = batch.filter(pa.array(kinds == 2))
            for bucket, keys in zip(keyed.column(0).to_pylist(), keyed.column(7).to_pylist(), strict=True):
                if bucket != now:
                    yield from close()
                    now, held = bucket, []
                held.append(keys)
        yield from close()

    rows = texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    dealt = rows.mapInArrow(first, _FIRST).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(second, _FIRST.removesuffix(", keys binary")), "join-sets")


def count_vector(own: np.ndarray) -> np.ndarray:
    return np.bincount((mix(own) >> _U(59)).astype(np.int64), minlength=GROUPS)


def linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Is the Jaccard similarity of two sorted sets at least `percent`?"""
    if len(left) > len(right):
        left, right = right, left
    if 100 * len(left) < percent * len(right):
        return False
    at = np.searchsorted(right, left)
    both = int((right[np.minimum(at, len(right) - 1)] == left).sum())
    return 100 * both >= percent * (len(left) + len(right) - both)


def tree_links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets to their components, one less than members each. `sides`: sets of one side are not compared with each
    other unless there is one side only."""
    count = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, points = size[order], np.array([count_vector(sets[k]) for k in order]).reshape(count, GROUPS)
    side = sides[order]
    apart = len(np.unique(side)) > 1
    heads = np.arange(0, count, LEAF)
    leaf_top = np.maximum.reduceat(points, heads, axis=0)
    leaf_low, leaf_high = size[heads], size[np.minimum(heads + LEAF, count) - 1]
    label = np.arange(count)
    found = []
    for q in range(count):
        # Linked sets share at least percent / (100 + percent) of the sum of their sizes; partners are not smaller (the rest came before).
        most = size[q] * 100 // percent
        leaves = np.flatnonzero((leaf_high >= size[q]) & (leaf_low <= most) & (heads + LEAF > q))
        if not len(leaves):
            continue
        bound = np.minimum(points[q], leaf_top[leaves]).sum(1)
        leaves = leaves[(100 + percent) * bound >= percent * (size[q] + np.maximum(leaf_low[leaves], size[q]))]
        near = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        near = near[(near > q) & (near < count)]
        near = near[(label[near] != label[q]) & (size[near] <= most)]
        if apart:
            near = near[side[near] != side[q]]
        if not len(near):
            continue
        bound = np.minimum(points[q], points[near]).sum(1)
        for x in near[(100 + percent) * bound >= percent * (size[q] + size[near])]:
            if label[x] != label[q] and linked(sets[order[q]], sets[order[x]], percent):
                label[label == label[x]] = label[q]
                found.append((int(order[q]), int(order[x])))
    return found


def _edges(both: DataFrame) -> DataFrame:
    """Edges a, b (first marks) whose components hold every two sets that may be linked, from what `_sets_and_edges` finds."""
    parts = partitions(both.sparkSession)
    own = Window.partitionBy("node", "need")
    hot = both.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("key"), F.col("n").alias("need"))
    hot = stored(hot.repartition(parts, "node").distinct().withColumn("h", F.count("*").over(own)), "join-hot")
    reach = stored(hot.groupBy("node").agg(F.max("h").alias("h")), "join-reach")
    counted = both.where("kind = 3").groupBy("a", "b", "n").agg(F.sum("id").alias("found"))
    for side in ("a", "b"):
        most = reach.select(F.col("node").alias(side), F.col("h").alias(f"h{side}"))
        counted = counted.join(broadcast_if_small(most), side, "left")
    pairs = counted.where(F.col("found") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.col("n"))
    # Sets that may be linked by hot keys alone. Any order of the keys will do, as long as it is one for all sets.
    alone = hot.where("h >= need").select("node", "key", "need")
    shared = stored(alone.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "join-often")
    left = alone.join(broadcast_if_small(shared), "key").withColumns({"h": F.count("*").over(own), "place": F.row_number().over(own.orderBy("often", "key"))})
    left = stored(left.where("place <= h - need + 1").select("node", "key").distinct(), "join-left")
    least = stored(left.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("often")).where("often > 1").drop("often"), "join-least")
    stars = left.join(broadcast_if_small(least), "key").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return pairs.select("a", "b").unionByName(stars)


def _dealt(named: DataFrame, percent: int, family_block: int) -> DataFrame:
    """One row a set: id, hash, a, b, family, block and tasks. A family of one block has one task. A larger one is sorted by size and cut
    into blocks; a set goes to its block's own task, and to one for every other block in which a linked set may be."""
    order = F.shiftleft(F.col("n"), 20) + F.col("b").bitwiseAND((1 << 20) - 1)  # sets of one size may fill several blocks
    large = named.groupBy("family").agg(F.ceil(F.count("*") / family_block).cast("int").alias("blocks")).where("blocks > 1")
    large = stored(large, "join-large")
    grid = 4 * (large.agg(F.max("blocks")).first()[0] or 1)
    points = F.percentile_approx(order, [k / grid for k in range(1, grid)], max(10_000, 20 * grid))
    cuts = F.transform(F.sequence(F.lit(1), F.col("blocks") - 1), lambda k: F.get("points", (k * F.lit(grid) / F.col("blocks")).cast("int") - 1))
    large = named.join(broadcast_if_small(large), "family").groupBy("family", "blocks").agg(points.alias("points"))
    large = stored(large.select("family", "blocks", cuts.alias("cuts")), "join-cuts")
    rows = named.join(broadcast_if_small(large), "family", "left").withColumn("order", order)
    rows = rows.withColumn("block", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda cut: cut <= F.col("order")))))
    size = lambda k: F.shiftright(F.get("cuts", k), 20)  # noqa: E731  the least of block k + 1, the most of block k

    def meets(other):
        above = (other > F.col("block")) & (size(other - 1) * percent <= F.col("n") * 100)
        below = (other < F.col("block")) & (F.col("n") * percent <= size(other) * 100)
        return (other == F.col("block")) | above | below

    met = F.filter(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), meets)
    task = lambda other: F.shiftleft(F.least(other, "block").cast("bigint"), 32) + F.greatest(other, "block")
    return rows.select("id", "hash", "a", "b", "family", "block", F.transform(met, task).alias("tasks"))


def _links(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a1, a2, b1, b2: marks of two sets) within families, from one row a set (see `_dealt`)."""
    spark = docs.sparkSession
    rows = texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    own = join_few(rows, reps, ["id", "hash"]).select("family", "tasks", "block", "a", "b", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(5), size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([s.tobytes() for s in sets], pa.binary())], ["family", "tasks", "block", "a", "b", "set"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, marks, sides, sets = None, [], [], []

        def close() -> list[tuple[int, int, int, int]]:
            if len(sets) < 2 or (now[1] >> 32 != now[1] & 0xFFFFFFFF and len(set(sides)) < 2):
                return []  # a task for two blocks compares none with its own
            return [(*marks[p], *marks[q]) for p, q in tree_links(sets, np.array(sides), percent)]

        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for family, task, block, a, b, own in zip(*columns, strict=True):
                if (family, task) != now:
                    out += close()
                    now, marks, sides, sets = (family, task), [], [], []
                if not marks or marks[-1] != (a, b):  # repeated rows of one set follow each other
                    marks.append((a, b))
                    sides.append(block)
                    sets.append(np.frombuffer(own, np.uint64))
            if out:
                yield _four(out)
        if out := close():
            yield _four(out)

    def _four(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["a1", "a2", "b1", "b2"])

    dealt = (
        own.mapInArrow(hashed, "family bigint, tasks array<bigint>, block int, a bigint, b bigint, set binary")
        .select("family", F.explode("tasks").alias("task"), "block", "a", "b", "set")
        .repartition(partitions(spark), "family", "task")
        .sortWithinPartitions("family", "task", "a", "b")
    )
    return dealt.mapInArrow(join, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80, family_block: int = FAMILY_BLOCK) -> DataFrame:
    """id, hash (of the text), n_shingles, component_id of every row: the smallest id that links lead to, its own included; and root, which
    tells components apart whose smallest ids are equal (ids may repeat)."""
    both = _sets_and_edges(docs, size, percent)
    sets = both.where("kind = 0").select("id", "hash", "n", "a", "b")
    families = components(_edges(both), "join-families")
    member = families.select(F.col("node").alias("a"), F.col("root").alias("family"))
    member = member.unionByName(families.select(F.col("root").alias("a"), F.col("root").alias("family")).distinct())
    first = sets.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("id", "hash")).alias("row"), F.max("n").alias("n"))
    named = stored(first.join(member, "a").select("family", "a", "b", "n", F.col("row.id").alias("id"), F.col("row.hash").alias("hash")), "join-named")
    spread = stored(_dealt(named, percent, family_block), "join-reps")
    links = stored(_links(spread, docs, size, percent), "join-links")
    key = lambda x, y: F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))
    roots = components(links.select(key("a1", "a2").alias("a"), key("b1", "b2").alias("b")), "join-components")
    known = sets.withColumn("node", key("a", "b")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    return known.join(least, "root", "left").select(
        "id", "hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "root"
    )
