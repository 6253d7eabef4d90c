"""Byte-pair encoding and decoding of whole texts, with the merges of a piece kept in a segment tree.

A text falls into pieces that no merge crosses. The leaves of a piece's tree are its neighbouring pairs of tokens, each with the rank of
its merge and its place; a node holds the smaller of its children, so the root is the leftmost pair of lowest rank. A merge changes three
leaves: the pair itself, which gets a new right neighbour, the pair before it, and the one that is gone; each is carried up to the root.
The piece is done when the root holds no pair. A piece of n tokens costs O(n log n), however long it is. Pieces of like length are worked
on side by side, one row of an array each; equal pieces of a slice of text are encoded once.

Defined cases. A null text is an empty one and has no tokens. Rows may repeat, ids too, and all other columns are kept out of the way.
An empty table gives no rows. Texts are never cut. Ids that the vocabulary does not know decode to nothing, null ids to an empty text,
bytes that are no UTF-8 to U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import gather, raw, release, ship, slices, texts

#: Text that is encoded at once; equal pieces in it are encoded once. A task holds some fifteen times as much.
SLICE_BYTES = 6 << 20
#: Ids that are decoded at once.
SLICE_IDS = 1 << 20
#: Cells of all trees that are worked on side by side.
TREE_CELLS = 1 << 20
NONE = np.int64((1 << 62) - 1)

# How byte-level vocabularies of this family part a text, white space being the Unicode property.
_WHITE = r"\t-\r \x85\xA0  -     　"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
#: First bytes of the white space outside ASCII.
_WHITE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + at): b for at, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary in the JSON form of public tokenizers: its bytes, merges and special tokens."""

    def __init__(self, path: str):
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        model, before = given["model"], given.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or given.get("normalizer") or odd:
            raise ValueError(f"not a plain byte-level vocabulary: {path} {odd}")
        self.special: dict[str, int] = {}
        for token in given.get("added_tokens", []):
            if token.get("lstrip") or token.get("rstrip") or token.get("single_word") or regex.search(rf"[{_WHITE}]", token["content"]):
                raise ValueError(f"a special token that takes its surroundings is not supported: {token['content']!r}")
            self.special[token["content"]] = token["id"]
        numbers = model["vocab"] | self.special
        letters = _byte_letters()
        self.size = max(numbers.values()) + 1
        spelt = [b""] * self.size
        for token, number in numbers.items():
            plain = token not in self.special and all(c in letters for c in token)
            spelt[number] = bytes(letters[c] for c in token) if plain else token.encode()
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in spelt])]).astype(np.int64)
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = model["vocab"][letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([model["vocab"][a] * self.size + model["vocab"][b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([model["vocab"][a + b] for a, b in merges], np.int64)
        self.pieces = regex.compile(_PIECES)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of two neighbours; NONE where there is none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), max(0, len(self.pairs) - 1))
        if not len(self.pairs):
            return np.full(wanted.shape, NONE)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NONE)

    def parts(self, text: str) -> list[str | int]:
        """The pieces of a text, special tokens as their ids."""
        if self.marks is None or not self.marks.search(text):
            return self.pieces.findall(text)
        found: list[str | int] = []
        low = 0
        for hit in self.marks.finditer(text):
            found += self.pieces.findall(text[low : hit.start()])
            found.append(self.special[hit.group()])
            low = hit.end()
        return found + self.pieces.findall(text[low:])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairTrees:
    """Segment trees over the pairs of many pieces, one row each; all pieces have at most `width` (a power of two) bytes."""

    def __init__(self, known: Vocabulary, tokens: np.ndarray, lengths: np.ndarray):
        rows, width = tokens.shape
        self.known, self.width, self.shift = known, width, width.bit_length() - 1
        self.tokens, self.alive = tokens, np.arange(width) < lengths[:, None]
        # One more column than tokens: the end, and what lies before the first token.
        places = np.arange(width + 1)
        self.after = np.minimum(np.broadcast_to(places + 1, (rows, width + 1)), lengths[:, None]).copy()
        self.before = np.broadcast_to(places - 1, (rows, width + 1)).copy()
        self.end = lengths
        self.tree = np.full((rows, 2 * width), NONE)
        if width > 1:
            rank = np.full((rows, width), NONE)
            rank[:, :-1] = known.rank(tokens[:, :-1], tokens[:, 1:])
            paired = self.alive & (np.arange(width) + 1 < lengths[:, None]) & (rank != NONE)
            self.tree[:, width:] = np.where(paired, (rank << self.shift) + np.arange(width), NONE)
        for low in (1 << k for k in range(self.shift - 1, -1, -1)):
            self.tree[:, low : 2 * low] = np.minimum(self.tree[:, 2 * low : 4 * low : 2], self.tree[:, 2 * low + 1 : 4 * low : 2])

    def _leaf(self, rows: np.ndarray, place: np.ndarray) -> None:
        """Set the pair that begins at `place` (-1: none) and carry it to the root."""
        inside = place >= 0
        rows, place = rows[inside], place[inside]
        right = self.after[rows, place]
        paired = self.alive[rows, place] & (right < self.end[rows])
        right = np.where(paired, right, 0)
        rank = np.where(paired, self.known.rank(self.tokens[rows, place], self.tokens[rows, right]), NONE)
        self.tree[rows, self.width + place] = np.where(rank == NONE, NONE, (rank << self.shift) + place)
        node = (self.width + place) >> 1
        for _ in range(self.shift):
            self.tree[rows, node] = np.minimum(self.tree[rows, 2 * node], self.tree[rows, 2 * node + 1])
            node >>= 1

    def merge(self) -> None:
        """Merge the pair at the root of every tree until no tree has one."""
        rows = np.arange(len(self.tokens))
        while len(rows := rows[self.tree[rows, 1] != NONE]):
            root = self.tree[rows, 1]
            left = root & (self.width - 1)
            right = self.after[rows, left]
            beyond = self.after[rows, right]
            self.tokens[rows, left] = self.known.made[root >> self.shift]
            self.alive[rows, right] = False
            self.after[rows, left] = beyond
            self.before[rows, beyond] = left
            for place in (right, left, self.before[rows, left]):
                self._leaf(rows, place)


def encode_pieces(pieces: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces (a binary column) one after another, and where each piece's begin."""
    data, offsets = raw(pieces)
    lengths = np.diff(offsets)
    tokens = known.of_byte[data]
    counts = np.zeros(len(pieces), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    classes = np.where(lengths > 1, np.ceil(np.log2(np.maximum(lengths, 1))), 0).astype(np.int64)
    for size in np.unique(classes):
        width, members = 1 << int(size), np.flatnonzero((classes == size) & (lengths > 0))
        step = max(1, TREE_CELLS // (4 * width))
        for low in range(0, len(members), step):
            own = members[low : low + step]
            places = offsets[own][:, None] + np.arange(width)
            grid = tokens[np.minimum(places, len(tokens) - 1)]
            trees = PairTrees(known, grid, lengths[own])
            trees.merge()
            counts[own] = trees.alive.sum(axis=1)
            kept.append((own, trees.tokens[trees.alive]))
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ids = np.empty(at[-1], np.int32)
    for own, found in kept:
        ids[np.repeat(at[own] - np.concatenate([[0], np.cumsum(counts[own])[:-1]]), counts[own]) + np.arange(len(found))] = found
    return ids, at


def _chunks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts, and at single blanks between characters that are no white space. No piece crosses such a place."""
    blank = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    plain = ~np.isin(np.arange(256), [*range(0x21), 0x7F, *_WHITE_LEADS])
    # What comes before is looked at from its possible first bytes on.
    led = np.isin(np.arange(256), _WHITE_LEADS)
    odd = (data[blank - 1] >= 0x80) & (led[data[np.maximum(blank - 2, 0)]] | led[data[np.maximum(blank - 3, 0)]])
    cuts = blank[plain[data[blank + 1]] & plain[data[blank - 1]] & ~odd]
    begins = np.zeros(len(data), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begins[cuts] = True
    return np.flatnonzero(begins)


def encode(column: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column one after another, and where each text's begin."""
    data, offsets = raw(column)
    starts = _chunks(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
    bounds = np.append(starts, len(data))
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    parts: list[bytes | None] = []
    fixed: list[tuple[int, int]] = []
    count = np.empty(len(coded.dictionary), np.int64)
    for k, chunk in enumerate(coded.dictionary.to_pylist()):
        found = known.parts(chunk.decode("utf-8", "replace"))
        count[k] = len(found)
        for part in found:
            if isinstance(part, int):
                fixed.append((len(parts), part))
                parts.append(None)
            else:
                parts.append(part.encode())
    pieces = pa.array(parts, pa.large_binary()).dictionary_encode()
    ids, at = encode_pieces(pieces.dictionary, known)
    # Special tokens follow the pieces' own ids.
    ids = np.concatenate([ids, np.array([number for _, number in fixed], np.int32)])
    low, high = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    own = np.asarray(pc.fill_null(pieces.indices, -1), dtype=np.int64)
    low[own >= 0], high[own >= 0] = at[:-1][own[own >= 0]], at[1:][own[own >= 0]]
    if fixed:
        special = np.array([place for place, _ in fixed])
        low[special] = at[-1] + np.arange(len(fixed))
        high[special] = low[special] + 1
    ids, part_at = gather(ids, low, high)
    chunk_at = part_at[np.concatenate([[0], np.cumsum(count)])]
    which = np.asarray(coded.indices, dtype=np.int64)
    ids, at = gather(ids, chunk_at[which], chunk_at[which + 1])
    return ids, at[np.searchsorted(starts, offsets)]


def decode(ids: np.ndarray, offsets: np.ndarray, known: Vocabulary) -> pa.Array:
    """The texts of lists of ids, special tokens included."""
    inside = (ids >= 0) & (ids < known.size)
    number = np.where(inside, ids, 0).astype(np.int64)
    data, at = gather(known.bytes, known.at[number], np.where(inside, known.at[number + 1], known.at[number]))
    bounds = at[offsets]
    out = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return out.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([value.decode("utf-8", "replace") for value in out.to_pylist()], pa.large_string())


def list_slices(batches: Iterator[pa.RecordBatch], items: int = SLICE_IDS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their lists hold about so many ids together; a longer list stands alone."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0), dtype=np.int64)
        at, low = np.concatenate([[0], np.cumsum(lengths + 1)]), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + items, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
    release()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """id and ids (array<int>) of every whole text, under the vocabulary at `path`, which every worker can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            ids, at = encode(batch.column(1), vocabulary(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["id", "ids"])

    return texts(docs).mapInArrow(run, "id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """id, ids and the text they stand for."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches):
            column = batch.column(1)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
            ids = np.asarray(pc.fill_null(column.flatten(), -1))
            text = decode(ids, np.concatenate([[0], np.cumsum(lengths)]), vocabulary(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, text.cast(pa.string())], ["id", "ids", "text"])

    return encoded.select(F.col("id").cast("bigint").alias("id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "id bigint, ids array<int>, text string"
    )
