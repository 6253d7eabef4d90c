"""Hard negatives for anchors: rows of another label that score nearly as well as the anchor's positives.

Vectors become whole numbers (`floor(scale * x)`), and a score is their inner product, exact. To spare most of the exact scores each
row also carries one-bit codes. The vector is turned by a fixed random rotation; its first code is the signs of what comes out, and the
stored alignment of a code is the projection on it, so that what is left is at right angles to the code. What is left is coded again
(`LEVELS` times), and the length of the last rest is stored. For an anchor, whose rotated vector is cut into bit planes, popcounts give
its product with each code, hence an estimate of the score; by Cauchy-Schwarz the rest can add no more than its length times the
length of the anchor's part at right angles to the last code. That interval is certain. Rows whose interval cannot reach the best found so
far (positives) or the wanted range of scores (negatives) are passed over; all others are scored in whole numbers.

Rows become blocks where they lie; anchors are dealt to blocks by a hash. Every block of rows meets every block of anchors: the anchors are
broadcast where they are few, else both are dealt by (anchor block, part), so that no task gets all rows. A task keeps the best of each
anchor over all its blocks, and only those are shuffled.

Defined cases. Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different lengths are
filled up with zeros. Rows are a set: those with one id and the same score to an anchor count once, and a row with the anchor's id is not
another row. A null id is never an anchor, comes last among equal scores, and is returned as null. Components and scores that do not
fit into 64 bits are cut to the nearest number that does. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import partitions, release, ship, stored

LAST_ID = (1 << 63) - 1
LEAST = np.int64(-(1 << 63))
#: One-bit codes a row; the interval gets narrower by some 0.6 with each.
LEVELS = 2
#: Bits that each component of an anchor is cut into.
PLANES = 4
#: Rows of a block and (on average) anchors of a block; both are held in memory at once, with a table of the two.
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 512
#: Anchor blocks that may be broadcast: 64 times 512 anchors.
BROADCAST_BLOCKS = 64
#: Anchors for which a task keeps its best rows before it hands them on.
HELD_ANCHORS = 1 << 17

_BLOCK = "block int, ids binary, labels binary, vectors binary"
_ROWS = f"{_BLOCK}, codes binary, aligned binary, rest binary"


def prepare(rows: DataFrame, id: str, label: str, vector: str, anchor: Column, scale: int) -> DataFrame:
    """id, label, v (whole numbers), anchor of the rows that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    kept = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    return kept.select(
        F.coalesce(F.col(id).cast("bigint"), F.lit(LAST_ID)).alias("id"),
        F.col(label).cast("bigint").alias("label"),
        whole.alias("v"),
        (F.coalesce(anchor, F.lit(False)) & F.col(id).isNotNull()).alias("anchor"),
    )


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(20)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    packed = np.packbits(signs, axis=-1)
    padded = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
    padded[..., : packed.shape[-1]] = packed
    return padded.view(np.uint64)


def encode_rows(vectors: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, word), alignments (row, level) and the length of the last rest."""
    rest = vectors.astype(np.float64) @ turn
    codes, aligned = [], []
    for _ in range(levels):
        positive = rest >= 0
        along = np.abs(rest).mean(axis=1)
        rest = rest - np.where(positive, along[:, None], -along[:, None])
        codes.append(_bits(positive))
        aligned.append(along)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.sqrt((rest * rest).sum(axis=1))


def intervals(anchors: np.ndarray, turn: np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible score for every anchor and row."""
    turned = anchors.astype(np.float64) @ turn
    size = turned.shape[1]
    least = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - least) / ((1 << PLANES) - 1), 1e-300)
    cut = np.rint((turned - least[:, None]) / step[:, None]).astype(np.int64)
    rounded = least[:, None] + step[:, None] * cut
    total = rounded.sum(axis=1)
    planes = np.stack([_bits((cut >> j) & 1 == 1) for j in range(PLANES)], axis=1)
    length = np.sqrt((turned * turned).sum(axis=1))
    off = turned - rounded
    off = np.sqrt((off * off).sum(axis=1)) * np.sqrt(size)
    estimate = np.zeros((len(anchors), len(codes)))
    for level in range(codes.shape[1]):
        ones = np.zeros(estimate.shape[1], np.int64)
        weighted = np.zeros(estimate.shape, np.int32)
        for word in range(codes.shape[2]):
            own = codes[:, level, word]
            ones += np.bitwise_count(own)
            for j in range(PLANES):
                weighted += np.bitwise_count(own[None, :] & planes[:, j, word][:, None]).astype(np.int32) << j
        product = 2 * (least[:, None] * ones[None, :] + step[:, None] * weighted) - total[:, None]
        estimate += product * aligned[None, :, level]
    # At right angles to the last code lies what the anchor's length leaves beside its part along the code.
    along = np.maximum(np.abs(product) - off[:, None], 0.0)
    across = np.sqrt(np.maximum(length[:, None] ** 2 - along**2 / size, 0.0))
    own_length = np.sqrt(size * (aligned**2).sum(axis=1)) + rest
    slack = 1e-9 * length[:, None] * own_length[None, :] + 1.0
    half = off[:, None] * aligned.sum(axis=1)[None, :] + across * rest[None, :] + slack
    return estimate - half, estimate + half


def exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: in doubles where they hold them exactly, else in 64 bits, else without bound and cut to 64 bits."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    top = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    bound = top(anchors) * top(rows) * anchors.shape[1]
    if bound < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return anchors @ rows.T
    found = anchors.astype(object) @ rows.astype(object).T
    return np.clip(found, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `number` different (score, id) of each group, higher scores first, then smaller ids."""
    order = np.lexsort((ident, ~score, group))
    group, score, ident = group[order], score[order], ident[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ident[1:] != ident[:-1])
    group, score, ident = group[new], score[new], ident[new]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    kept = rank < number
    return group[kept], score[kept], ident[kept]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), size), np.int64)
    at = np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at] = np.asarray(column.flatten(), dtype=np.int64)
    return out


def row_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows, made where the rows lie, sorted by id, with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, number = rotation(size), 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                ids = np.asarray(part.column(0))
                order = np.argsort(ids, kind="stable")
                vectors = _matrix(part.column(2), size)[order]
                coded = encode_rows(vectors, turn)
                cells = [ids[order], np.asarray(part.column(1))[order], vectors, *coded]
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([number], pa.int32())}
                    | {n: pa.array([c.tobytes()], pa.binary()) for n, c in zip("ids labels vectors codes aligned rest".split(), cells, strict=True)}
                )
                number += 1
        release()

    return rows.select("id", "label", "v").mapInArrow(run, _ROWS)


def anchor_blocks(anchors: DataFrame, size: int, number: int) -> DataFrame:
    """Different anchors dealt to `number` blocks by a hash: some `BLOCK_ANCHORS` each, however the ids lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(1).slice(k, 1).flatten()
                ids, labels = (np.asarray(own.field(i), dtype=np.int64) for i in (0, 1))
                cells = [ids, labels, _matrix(own.field(2), size)]
                yield pa.RecordBatch.from_pydict(
                    {"block": batch.column(0).slice(k, 1)}
                    | {n: pa.array([c.tobytes()], pa.binary()) for n, c in zip("ids labels vectors".split(), cells, strict=True)}
                )

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(number)).cast("int"))
    grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "label", "v"))).alias("rows"))
    return grouped.mapInArrow(run, _BLOCK)


def meet(rows: DataFrame, anchors: DataFrame, number: int) -> DataFrame:
    """Every block of rows beside every block of anchors."""
    spark = rows.sparkSession
    left = rows.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    right = anchors.select(F.col("block").alias("anchor_block"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"])
    if number <= BROADCAST_BLOCKS:
        return left.join(F.broadcast(right), "anchor_block")
    parts = max(1, -(-4 * partitions(spark) // number))
    left = left.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, ["anchor_block", "part"])


class _Best:
    """The best rows of every group that a task has seen, by anchor block."""

    def __init__(self, number: int):
        self.number, self.held = number, {}

    def reached(self, block: int, groups: int) -> np.ndarray:
        """The score of each group's last wanted row so far; the least number where rows are wanting."""
        out = np.full(groups, LEAST)
        if block in self.held:
            group, score, _ = self.held[block]
            count = np.bincount(group, minlength=groups)
            ends = np.cumsum(count)
            full = count == self.number
            out[full] = score[ends[full] - 1]
        return out

    def add(self, block: int, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if block in self.held:
            group, score, ident = (np.concatenate(p) for p in zip(self.held[block], (group, score, ident), strict=True))
        self.held[block] = best(group, score, ident, self.number)

    def hand_over(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for block, found in self.held.items():
            yield block, *found
        self.held = {}


def _cells(batch: pa.RecordBatch, k: int, size: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda name: np.frombuffer(batch.column(prefix + name)[k].as_buffer(), np.int64)
    return read("ids"), read("labels"), read("vectors").reshape(-1, size)


def _meetings(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(batch, place in it, anchor block, anchors, rows, lowest and highest scores) of each pair of blocks."""
    turn, words = rotation(size), -(-size // 64)
    for batch in batches:
        for k in range(batch.num_rows):
            rows, anchors = _cells(batch, k, size), _cells(batch, k, size, "a_")
            coded = [np.frombuffer(batch.column(n)[k].as_buffer(), t) for n, t in (("codes", np.uint64), ("aligned", np.float64), ("rest", np.float64))]
            low, high = intervals(anchors[2], turn, coded[0].reshape(-1, LEVELS, words), coded[1].reshape(-1, LEVELS), coded[2])
            yield batch, k, batch.column("anchor_block")[k].as_py(), anchors, rows, low, high


def _scored(anchors: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the wanted pairs."""
    columns = np.flatnonzero(wanted.any(axis=0))
    scores = exact_scores(anchors, rows[columns])
    at, column = np.nonzero(wanted[:, columns])
    return at, columns[column], scores[at, column]


def nearest_of_label(met: DataFrame, size: int, number: int) -> DataFrame:
    """anchor_block, at (the anchor's place in it), anchor_id, id, score: the best rows of the anchor's label in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ids_of = _Best(number), {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, group, score, ident in kept.hand_over():
                columns = [pa.array(np.full(len(group), block, np.int32)), pa.array(group.astype(np.int32)), pa.array(ids_of[block][group]), pa.array(ident), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_block", "at", "anchor_id", "id", "score"])
            ids_of.clear()

        for _, _, block, anchors, rows, low, high in _meetings(batches, size):
            ids_of[block] = anchors[0].copy()
            other = (anchors[1][:, None] == rows[1][None, :]) & (anchors[0][:, None] != rows[0][None, :])
            # Rows may repeat, so only different ids count towards the score that must be reached.
            reached = kept.reached(block, len(anchors[0])).astype(np.float64)
            if len(rows[0]) > number and (np.diff(rows[0]) > 0).all():
                sure = np.partition(np.where(other, low, -np.inf), -number, axis=1)[:, -number]
                reached = np.maximum(reached, sure)
            at, row, score = _scored(anchors[2], rows[2], other & (high >= reached[:, None]))
            kept.add(block, at, score, rows[0][row])
            if sum(map(len, ids_of.values())) > HELD_ANCHORS:
                yield from out()
        yield from out()
        release()

    return met.mapInArrow(run, "anchor_block int, at int, anchor_id bigint, id bigint, score bigint")


def negatives_in_range(met: DataFrame, size: int, number: int, low_percent: int, high_percent: int) -> DataFrame:
    """anchor_block, at, positive_id, positive_score, id, score: the best rows of other labels in each positive's range, in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, needs_of = _Best(number), {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, group, score, ident in kept.hand_over():
                at, positive, wanted = needs_of[block]
                columns = [pa.array(np.full(len(group), block, np.int32)), pa.array(at[group].astype(np.int32)), pa.array(positive[group]), pa.array(wanted[group]), pa.array(ident), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_block", "at", "positive_id", "positive_score", "id", "score"])
            needs_of.clear()

        for batch, k, block, anchors, rows, low, high in _meetings(batches, size):
            needs = batch.column("a_needs").slice(k, 1).flatten()
            at, positive, wanted = (np.asarray(needs.field(i), dtype=np.int64) for i in range(3))
            needs_of[block] = (at, positive, wanted)
            least = np.array([-((-low_percent * int(w)) // 100) for w in wanted], np.int64)
            most = np.array([high_percent * int(w) // 100 for w in wanted], np.int64)
            # The widest range of an anchor first; each need looks at its own part of what is left.
            lowest, highest = np.full(len(anchors[0]), np.inf), np.full(len(anchors[0]), -np.inf)
            open_ = least <= most
            np.minimum.at(lowest, at[open_], least[open_].astype(np.float64))
            np.maximum.at(highest, at[open_], most[open_].astype(np.float64))
            other = anchors[1][:, None] != rows[1][None, :]
            own, row, score = _scored(anchors[2], rows[2], other & (high >= lowest[:, None]) & (low <= highest[:, None]))
            starts = np.searchsorted(own, at, "left")
            counts = np.where(open_, np.searchsorted(own, at, "right") - starts, 0)
            reached = kept.reached(block, len(at))
            need = np.repeat(np.arange(len(at)), counts)
            pair = np.arange(len(need)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
            fits = (score[pair] >= np.maximum(least, reached)[need]) & (score[pair] <= most[need])
            need, pair = need[fits], pair[fits]
            kept.add(block, need, score[pair], rows[0][row[pair]])
            if sum(len(n[0]) for n in needs_of.values()) > HELD_ANCHORS:
                yield from out()
        yield from out()
        release()

    return met.mapInArrow(run, "anchor_block int, at int, positive_id bigint, positive_score bigint, id bigint, score bigint")


def first(found: DataFrame, keys: list[str], number: int) -> DataFrame:
    """The first different (score, id) of each group over all tasks, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.dropDuplicates([*keys, "score", "id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row where `anchor` holds and each of its best `positives` rows of the same label: the best `negatives` rows of other labels
    whose score lies within `low_percent` to `high_percent` of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    taking_part = prepare(rows, id, label, vector, anchor, scale)
    shape = taking_part.agg(F.max(F.size("v")).alias("size"), F.count_if("anchor").alias("anchors")).first()
    size, number = max(1, shape["size"] or 1), max(1, -(-(shape["anchors"] or 0) // BLOCK_ANCHORS))
    blocks = stored(row_blocks(taking_part, size), "negatives-rows")
    chosen = taking_part.where("anchor").select("id", "label", "v").dropDuplicates()
    anchors = stored(anchor_blocks(chosen, size, number), "negatives-anchors")
    near = first(nearest_of_label(meet(blocks, anchors, number), size, positives), ["anchor_block", "at", "anchor_id"], positives)
    near = stored(near.select("anchor_block", "at", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-near")
    need = F.struct("at", "positive_id", "positive_score")
    needs = near.groupBy(F.col("anchor_block").alias("block")).agg(F.sort_array(F.collect_list(need)).alias("needs"))
    met = meet(blocks, anchors.join(needs, "block"), number)
    found = negatives_in_range(met, size, negatives, low_percent, high_percent)
    ranked = first(found, ["anchor_block", "at", "positive_id", "positive_score"], negatives)
    named = ranked.join(near, ["anchor_block", "at", "positive_id", "positive_score"])
    return named.select(
        "anchor_id",
        F.nullif("positive_id", F.lit(LAST_ID)).alias("positive_id"),
        "rank",
        F.nullif("id", F.lit(LAST_ID)).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
