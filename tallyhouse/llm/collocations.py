"""Collocations: phrases whose words keep together, counted with weighted acyclic automata.

Each slice of text becomes the sorted list of its windows of `longest` words (shorter where a piece ends), led by the language, with their
counts. From it a count transducer is built layer by layer: paths are windows, equal beginnings share states, and so do states that go on
in the same single way; the last transition of a path carries its count. Transducers are cut at fixed splitters, so that each part
belongs to one range of windows, and only the parts are shuffled. A range unites its parts, equal paths adding their weights. The count of
any phrase is then the sum over the range of windows that begin with it, and only phrases at either end of a range can go on in the
next one: their partial sums are added up afterwards. A phrase that fills a third of the corpus is one path a slice.

What is frequent enough becomes transducers again, dealt by phrase, and the lists of first and last parts of all candidates are
composed with them: the walk along both at once gives each part its count. Salted copies keep a part that many candidates share from
gathering in one task.

Defined cases. A null text is an empty one and has no words; a null language is `und`. Rows may repeat and count as often; ids play
no role. An empty table gives no rows. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import gather, partitions, raw, release, ship, slices, stored, strings

#: Text of one range of windows; a task holds the windows of one range at a time, some fifteen times as many bytes.
RANGE_BYTES = 8 << 20
#: Text that the splitters between ranges are taken from; they decide how even ranges are, never what is counted.
SPLITTER_BYTES = 32 << 20
SPLITTER_SAMPLES = 32
#: Tasks that may share the requests for one part.
SALTS = 8

# Fixed by the contract: what ends a piece, and what ends a word inside it; only A to Z are lower-cased.
PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_BREAKS = b" \t"
UNKNOWN = "und"
_PIECE = np.isin(np.arange(256), list(PIECE_BREAKS))
_BREAK = _PIECE | np.isin(np.arange(256), list(WORD_BREAKS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.min_scalar_type(top))


class CountTransducer:
    """An acyclic automaton over sequences of symbols of one length, with a weight on the last transition of each.

    `degree[d]` has the number of transitions of each state of layer d, `symbol[d]` and `target[d]` their symbols and the states of the next
    layer they lead to, in the order of their states and, in a state, of their symbols.
    """

    def __init__(self, degree: list[np.ndarray], symbol: list[np.ndarray], target: list[np.ndarray], weight: np.ndarray):
        self.degree, self.symbol, self.target, self.weight = degree, symbol, target, weight

    @classmethod
    def from_sorted(cls, paths: np.ndarray, weights: np.ndarray) -> CountTransducer:
        """From different paths (one a row) in sorted order; built from the last layer to the first."""
        rows, size = paths.shape
        opens = _opens(paths)
        degree, symbol, target = [], [], []
        state, weight = np.zeros(rows, np.int64), weights.astype(np.int64)
        for layer in range(size - 1, -1, -1):
            # One transition a different beginning of layer + 1 symbols; its state is the beginning without the last symbol.
            own = np.flatnonzero(opens[:, layer])
            symbols, targets = paths[own, layer], state
            heads = opens[own, layer - 1] if layer else np.arange(len(own)) == 0
            starts = np.flatnonzero(heads)
            degrees = np.diff(np.append(starts, len(own)))
            last = layer == size - 1
            state, keep = cls._register(symbols, targets, weight if last else None, starts, degrees)
            moved = np.repeat(keep, degrees)
            degree.append(degrees[keep])
            symbol.append(symbols[moved])
            target.append(targets[moved])
            if last:
                weight = weight[moved]
        return cls(degree[::-1], symbol[::-1], target[::-1], weight)

    @staticmethod
    def _register(symbols, targets, weights, starts, degrees) -> tuple[np.ndarray, np.ndarray]:
        """The number of each state, and which states are kept: those with the same single transition become one."""
        single = np.flatnonzero(degrees == 1)
        keep = np.ones(len(starts), bool)
        first = np.arange(len(starts))
        if len(single) > 1:
            at = starts[single]
            keys = [symbols[at], targets[at]] + ([weights[at]] if weights is not None else [])
            order = np.lexsort(keys)
            new = np.zeros(len(order), bool)
            new[0] = True
            for key in keys:
                new[1:] |= key[order][1:] != key[order][:-1]
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            # Of equal states the first one in order stays.
            head = np.full(int(new.sum()), len(starts), np.int64)
            np.minimum.at(head, group, single)
            first[single] = head[group]
            keep[single] = first[single] == single
        numbers = np.cumsum(keep) - 1
        return numbers[first], keep

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in sorted order, and their weights."""
        state = np.zeros(1 if len(self.degree[0]) else 0, np.int64)
        rows = np.zeros((len(state), 0), np.int64)
        for degree, symbol, target in zip(self.degree, self.symbol, self.target, strict=True):
            ends = np.cumsum(degree)
            count = degree[state]
            at, _ = gather(np.arange(len(symbol)), ends[state] - count, ends[state])
            rows = np.column_stack([np.repeat(rows, count, axis=0), symbol[at]])
            state = target[at]
        return rows, self.weight[at] if len(rows) else self.weight[:0]

    def compose(self, wanted: np.ndarray) -> np.ndarray:
        """The weights of the wanted paths (one a row): both are walked along together, layer by layer; 0 where there is no such path."""
        state, alive = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.degree[0]) > 0)
        at = state
        for layer, (degree, symbol, target) in enumerate(zip(self.degree, self.symbol, self.target, strict=True)):
            if not len(symbol):
                return np.zeros(len(wanted), np.int64)
            # Transitions are in the order of (state, symbol).
            base = max(int(symbol.max()), int(wanted[:, layer].max(initial=0))) + 1
            keys = np.repeat(np.arange(len(degree)), degree) * base + symbol
            sought = state * base + wanted[:, layer]
            at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            alive &= keys[at] == sought
            state = np.where(alive, target[at], 0)
        return np.where(alive, self.weight[at], 0)

    def pack(self) -> bytes:
        """All arrays in their smallest types, behind a table of types and lengths."""
        arrays = [_small(a) for three in zip(self.degree, self.symbol, self.target, strict=True) for a in three] + [_small(self.weight)]
        head = np.array([[a.dtype.itemsize, len(a)] for a in arrays], "<i8")
        return np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def unpack(cls, data: bytes) -> CountTransducer:
        number = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", 2 * number, 8).reshape(-1, 2)
        at, arrays = 8 + 16 * number, []
        for size, length in head.tolist():
            arrays.append(np.frombuffer(data, f"<u{size}", length, at).astype(np.int64))
            at += size * length
        return cls(arrays[:-1:3], arrays[1:-1:3], arrays[2:-1:3], arrays[-1])


def _opens(paths: np.ndarray) -> np.ndarray:
    """For each sorted path and length: is its beginning of that length another one than that of the path before?"""
    opens = np.ones(paths.shape, bool)
    opens[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
    return opens


def unite(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different paths in sorted order; equal ones add their weights."""
    if not len(paths):
        return paths, weights
    # Several symbols share a sort key of 64 bits.
    bits = max(1, int(paths.max()).bit_length())
    each, keys = max(1, 63 // bits), []
    for low in range(0, paths.shape[1], each):
        key = paths[:, low].astype(np.int64)
        for column in range(low + 1, min(low + each, paths.shape[1])):
            key = (key << bits) | paths[:, column]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    del keys
    paths, weights = paths[order], weights[order]
    starts = np.flatnonzero(_opens(paths)[:, -1])
    return paths[starts], np.add.reduceat(weights, starts)


def _numbered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different values in byte order, and the number of each value among them."""
    coded = values.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary), dtype=np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[np.asarray(coded.indices, dtype=np.int64)]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, the number of its piece, and its text."""
    word = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_PIECE[data])[starts] + text if len(data) else starts
    return starts, ends, piece, text


def windows(batch: pa.RecordBatch, longest: int, more: list[list[bytes]] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in byte order, the different windows of a slice (text, lang) as sorted paths of symbol numbers from 1 (0: none), their
    counts, and the windows of `more` in the same numbers. The language of a window is its first symbol."""
    data, offsets = raw(batch.column(0))
    data = _LOWER[data]
    starts, ends, piece, text = word_places(data, offsets)
    words = strings(data, starts, ends)
    langs = batch.column(1).cast(pa.large_binary())
    extra = pa.array([s for one in more for s in one], pa.large_binary())
    # An empty symbol stands for none, and sorts first.
    symbols, number = _numbered(pa.concat_arrays([pa.array([b""], pa.large_binary()), words, langs, extra]))
    ids, own, asked = np.split(number[1:], np.cumsum([len(words), len(langs)]))
    paths = np.zeros((len(ids), longest + 1), np.int32)
    paths[:, 0] = own[text]
    for k in range(longest):
        here = ids[k:]
        paths[: len(here), k + 1] = np.where(piece[k:] == piece[: len(here)], here, 0)
    paths, counts = unite(paths, np.ones(len(paths), np.int64))
    return symbols, paths, counts, asked.reshape(len(more), longest + 1)


def _first_not_below(paths: np.ndarray, wanted: np.ndarray) -> int:
    """Where in the sorted paths those begin that are not below `wanted`."""
    low, high = 0, len(paths)
    for k, symbol in enumerate(wanted):
        column = paths[low:high, k]
        low, high = low + int(np.searchsorted(column, symbol, "left")), low + int(np.searchsorted(column, symbol, "right"))
    return low


def _texts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"), F.coalesce(docs["lang"], F.lit(UNKNOWN)).alias("lang"))


def splitters(docs: DataFrame, longest: int, total: int) -> list[list[bytes]]:
    """Windows that part all windows into ranges of about `RANGE_BYTES` of text; a hundred bytes of them for each such amount."""
    ranges = max(1, -(-total // RANGE_BYTES))
    every = max(1, total // SPLITTER_BYTES)
    step = max(1, min(total, SPLITTER_BYTES) // 6 // (SPLITTER_SAMPLES * ranges))
    if ranges == 1:
        return []

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            symbols, paths, _, _ = windows(batch, longest)
            for row in paths[step // 2 :: step]:
                yield pa.RecordBatch.from_pydict({"path": pa.array([symbols.take(pa.array(row)).to_pylist()], pa.list_(pa.binary()))})

    few = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0) if every > 1 else docs
    found = sorted([bytes(s) for s in r[0]] for r in few.mapInArrow(pick, "path array<binary>").collect())
    return [found[k * len(found) // ranges] for k in range(1, ranges)] if found else []


def shards(docs: DataFrame, longest: int, cuts: list[list[bytes]]) -> DataFrame:
    """window_range, symbols and transducer: the parts of each slice's count transducer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            symbols, paths, counts, wanted = windows(batch, longest, cuts)
            bounds = [0, *[_first_not_below(paths, w) for w in wanted], len(paths)]
            numbers, own, packed = [], [], []
            for number, (low, high) in enumerate(pairwise(bounds)):
                if low < high:
                    used = np.zeros(len(symbols), bool)
                    used[paths[low:high]] = True
                    numbers.append(number)
                    own.append(symbols.filter(pa.array(used)).cast(pa.binary()))
                    part = (np.cumsum(used) - 1)[paths[low:high]]
                    packed.append(CountTransducer.from_sorted(part, counts[low:high]).pack())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(o) for o in own])]), pa.int32())
            flat = pa.concat_arrays(own) if own else pa.array([], pa.binary())
            columns = [pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(offsets, flat), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["window_range", "symbols", "transducer"])

    return docs.mapInArrow(run, "window_range int, symbols array<binary>, transducer binary")


_COUNTS = "lang string, words int, phrase string, n bigint"


def _phrases(parts: list[tuple[pa.Array, bytes]], least: int) -> pa.RecordBatch:
    """The phrases of one range: whole counts from `least` on, and the partial counts at both ends."""
    symbols, number = _numbered(pa.concat_arrays([pa.array([b""], pa.large_binary()), *[s.cast(pa.large_binary()) for s, _ in parts]]))
    at, all_paths, all_weights = 1, [], []
    for own, packed in parts:
        paths, weights = CountTransducer.unpack(packed).paths()
        all_paths.append(number[at : at + len(own)][paths].astype(np.int32))
        all_weights.append(weights)
        at += len(own)
    paths, weights = np.concatenate(all_paths), np.concatenate(all_weights)
    del all_paths, all_weights, parts[:]
    paths, weights = unite(paths, weights)
    opens = _opens(paths)
    langs, sizes, phrases, counts = [], [], [], []
    for size in range(paths.shape[1]):
        starts = np.flatnonzero(opens[:, size])
        total = np.add.reduceat(weights, starts)
        kept = total >= least
        kept[[0, -1]] = True
        kept &= (paths[starts, size] != 0) | (size == 0)
        rows = symbols.take(pa.array(paths[starts[kept], : size + 1].reshape(-1))).to_pylist()
        for k in range(0, len(rows), size + 1):
            langs.append(rows[k].decode("utf-8", "replace"))
            phrases.append(b" ".join(rows[k + 1 : k + size + 1]).decode("utf-8", "replace"))
        sizes += [size] * int(kept.sum())
        counts.append(total[kept])
    columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(np.concatenate(counts), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "n"])


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words, phrase, n: all phrases of up to `longest` words that occur `least` times in a language; with no words, its words."""
    plain = _texts(docs)
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cuts = splitters(plain, longest, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column(0)[k].as_py()
                if parts and number != current:
                    yield _phrases(parts, least)
                current = number
                parts.append((batch.column(1).slice(k, 1).flatten(), batch.column(2)[k].as_py()))
        if parts:
            yield _phrases(parts, least)
        release()

    cut = shards(plain, longest, cuts).repartition(len(cuts) + 1, "window_range").sortWithinPartitions("window_range")
    counted = cut.mapInArrow(run, _COUNTS)
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def _as_paths(langs: pa.Array, phrases: pa.Array, symbols: dict[bytes, int], longest: int, grow: bool) -> np.ndarray:
    """Phrases as paths; unknown symbols are added, or else numbered -1."""
    out = np.zeros((len(langs), longest + 1), np.int64)
    for k, (lang, phrase) in enumerate(zip(langs.to_pylist(), phrases.to_pylist(), strict=True)):
        for at, symbol in enumerate([lang.encode(), *phrase.encode().split(b" ")]):
            out[k, at] = symbols.setdefault(symbol, len(symbols) + 1) if grow else symbols.get(symbol, -1)
    return out


def part_counts(candidates: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, cut (words of the first part), side (l or r), n: the counts of both parts at every cut of every candidate."""
    spark = candidates.sparkSession
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "words", words.alias("_w"), cut)
    left = F.struct(F.lit("l").alias("side"), F.array_join(F.slice("_w", F.lit(1), F.col("cut")), " ").alias("part"))
    right = F.struct(F.lit("r").alias("side"), F.array_join(F.slice("_w", F.col("cut") + 1, F.col("words")), " ").alias("part"))
    asked = cuts.select("lang", "phrase", "cut", F.inline(F.array(left, right)))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    requests = asked.select(F.lit(1).alias("kind"), "lang", "part", salt.alias("salt"), "phrase", "cut", "side", F.lit(0).cast("bigint").alias("n"))
    known = counts.where("words > 0").select(
        F.lit(0).alias("kind"), "lang", F.col("phrase").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        F.lit("").alias("phrase"), F.lit(0).alias("cut"), F.lit("").alias("side"), "n",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: dict[bytes, int] = {}
        paths, weights, transducer = [np.zeros((0, longest + 1), np.int64)], [np.zeros(0, np.int64)], None
        for batch in batches:
            kind = np.asarray(batch.column(0))
            split = int(np.searchsorted(kind, 1))
            if split:
                paths.append(_as_paths(batch.column(1).slice(0, split), batch.column(2).slice(0, split), symbols, longest, grow=True))
                weights.append(np.asarray(batch.column(7).slice(0, split), dtype=np.int64))
            if split == len(kind):
                continue
            if transducer is None:
                # Salted copies may have come to the same task.
                found, at = np.unique(np.concatenate(paths), axis=0, return_index=True)
                transducer = CountTransducer.from_sorted(found, np.concatenate(weights)[at])
                paths = weights = None
            rest = batch.slice(split)
            n = transducer.compose(_as_paths(rest.column(1), rest.column(2), symbols, longest, grow=False))
            columns = [rest.column(1), rest.column(4), rest.column(5), rest.column(6), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "cut", "side", "n"])

    dealt = known.unionByName(requests).repartition(partitions(spark), "lang", "part", "salt").sortWithinPartitions("kind", "lang", "part")
    return dealt.mapInArrow(run, "lang string, phrase string, cut int, side string, n bigint")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, nested_percent: int = 80, scale: int = 2_000_000, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    `a` counts the phrase, `l` and `r` the two parts of the cut that gives the lowest score floor(scale * a / (l + r)), `n` all words of the
    language. A phrase goes if a longer one around it has `nested_percent` of its count.
    """
    counts = stored(frequent_phrases(docs, longest, least), "collocations-counts")
    candidates = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    sides = part_counts(candidates, counts, longest).groupBy("lang", "phrase", "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r")
    )
    # In decimals: products may pass 64 bits.
    wide = "decimal(38,0)"
    score = F.expr(f"CAST((CAST(a AS {wide}) * {scale}) div (CAST(l AS {wide}) + r) AS bigint)")
    scored = sides.join(candidates, ["lang", "phrase"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # The parts of a candidate that lie inside it, each with the count of the most frequent phrase around it.
    words = F.split("phrase", " ")
    sizes = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    inner = candidates.where("words > 2").select("lang", "a", "words", words.alias("_w"), sizes.alias("_size"))
    inner = inner.select("lang", "a", "_w", "_size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1)).alias("_at"))
    inner = inner.select("lang", F.array_join(F.slice("_w", F.col("_at"), F.col("_size")), " ").alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    nested = F.coalesce(F.col("outer").cast(wide) * 100 >= F.col("a").cast(wide) * nested_percent, F.lit(False))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(~nested).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(counts.where("words = 0").select("lang", "n"), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
