"""Suffix sorting by external induction, in bulk.

Suffixes are of type S or L (smaller or larger than the next one). Sorting the leftmost S suffixes orders all: a pass in ascending order
induces the L suffixes, a pass in descending order the S suffixes. Each pass is driven by a priority queue of suffix tuples (first
character, position); a tuple that is taken out induces the one before it. Tuples with equal characters leave in the order in which they
came, so the queue is a row of first-in-first-out bins by ranges of characters. It keeps at most `MEMORY` bytes and writes what is beyond
to a temporary file of the task, whose parts it reads when their bin's turn comes.

Tuples are taken out in bulk: all of a bin up to the smallest character that one of them induces into the same bin. The leftmost S
suffixes are named by the order of their substrings (sorted by the same two passes) and sorted by recursion on the names. A row of names
has a large alphabet, so few tuples leave together; where it is short, the recursion ends and its suffixes are sorted by doubling.
"""

from __future__ import annotations

import tempfile

import numpy as np

from tallyhouse.llm.common import mix

BINS = 256
MEMORY = 64 << 20
SMALL = 2000
#: Names in a row that is sorted by doubling (some 50 bytes a name).
SMALL_NAMES = 1 << 18


class DiskQueue:
    """Bins of positions in the order in which they came; beyond a bound of memory they lie in a temporary file."""

    def __init__(self, bins: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(bins)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, number: int, items: np.ndarray) -> None:
        self.parts[number].append(items)
        self.held += items.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffixes-")
        self.file.seek(0, 2)
        for parts in self.parts:
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[k] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
        self.held = 0

    def pop(self, number: int) -> np.ndarray:
        parts, self.parts[number] = self.parts[number], []
        found = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), np.int64)
            else:
                self.held -= part.nbytes
            found.append(part)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _split(keys: np.ndarray, items: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Items by key (small numbers), in their order."""
    order = np.argsort(keys.astype(np.int16), kind="stable")
    sorted_keys = keys[order]
    heads = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return [(int(sorted_keys[a]), items[order[a:b]]) for a, b in zip(heads, [*heads[1:], len(order)], strict=True)]


def _induce(text: np.ndarray, size: int, seeds: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Positions in ascending order of their suffixes: `seeds` (given in that order) and all that they induce.

    A position induces the one before it where `may` says so; what it induces has no smaller character. Of one character the induced
    suffixes come before the seeds.
    """
    shift = max(0, int(size - 1).bit_length() - 8)
    bins = ((size - 1) >> shift) + 1
    queue = DiskQueue(bins)
    seed_bin = text[seeds] >> shift
    seed_at = np.searchsorted(seed_bin, np.arange(bins + 1))
    out = []
    for b in range(bins):
        induced = queue.pop(b)
        own_seeds = seeds[seed_at[b] : seed_at[b + 1]]
        if not len(induced) and not len(own_seeds):
            continue
        items = np.concatenate([induced, own_seeds])
        order_key = 2 * text[items] + np.concatenate([np.zeros(len(induced), np.int64), np.ones(len(own_seeds), np.int64)])
        if shift or len(own_seeds):
            order = np.argsort(order_key, kind="stable")
            items, order_key = items[order], order_key[order]
        while len(items):
            before = items - 1
            good = before >= 0
            good &= may[before]
            before = before[good]
            target = text[before]
            inside = (target >> shift) == b
            if inside.any():
                # Tuples below the least character induced into this bin are final; at it, the induced ones of this generation are.
                least = 2 * int(target[inside].min())
                cut = int(np.searchsorted(order_key, least))
                if not cut:
                    cut = int(np.searchsorted(order_key, order_key[0], "right"))
            else:
                cut = len(items)
            out.append(items[:cut])
            made = int(np.count_nonzero(good[:cut]))
            before, target, inside = before[:made], target[:made], inside[:made]
            away = ~inside
            if away.any():
                for number, part in _split(target[away] >> shift, before[away]):
                    queue.push(number, part)
            items, order_key = items[cut:], order_key[cut:]
            if inside.any():
                new = before[inside]
                items = np.concatenate([items, new])
                order_key = np.concatenate([order_key, 2 * text[new]])
                # New tuples go after those of their character that were induced before, and before its seeds.
                order = np.argsort(order_key, kind="stable")
                items, order_key = items[order], order_key[order]
    queue.close()
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _both_passes(text: np.ndarray, size: int, leftmost: np.ndarray, is_s: np.ndarray) -> np.ndarray:
    """All suffixes but those of character 0 in order, from leftmost S suffixes in order."""
    first = _induce(text, size, leftmost, ~is_s)
    larger = first[~is_s[first]]
    flipped = size - 1 - text
    second = _induce(flipped, size, larger[::-1], is_s & (text > 0))
    return second[::-1]


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last one counts as such."""
    step = np.sign(np.diff(text))
    step = np.append(step, 1)
    # An equal character has the type of the next position.
    at = np.where(step != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def _doubled(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a small text by doubling ranks."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    span = 1
    while True:
        later = np.zeros(len(text), np.int64)
        later[: len(text) - span] = rank[span:] + 1
        key = rank * (len(text) + 1) + later
        order = np.argsort(key, kind="stable")
        rank = np.zeros(len(text), np.int64)
        rank[order] = np.cumsum(np.append(0, key[order[1:]] != key[order[:-1]]))
        if rank.max() == len(text) - 1 or 2 * span > len(text):
            return order
        span *= 2


def sort_suffixes(text: np.ndarray, size: int, small: int | None = None) -> np.ndarray:
    """Positions in the order of their suffixes. `text`: whole numbers below `size`. Texts of up to `small` numbers are not induced.

    Every 0 ends a string: zeros differ from each other, a later one is smaller, and the last number is a 0.
    """
    text = text.astype(np.int64)
    zeros = np.flatnonzero(text == 0)[::-1]
    if len(text) <= (SMALL if small is None else small):
        plain = text + len(zeros) - 1
        plain[zeros] = np.arange(len(zeros))
        return _doubled(plain)
    is_s = _types(text)
    leftmost = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    inner = leftmost[text[leftmost] > 0]
    ends = zeros[(zeros > 0) & ~is_s[np.maximum(zeros - 1, 0)]]
    by_character = np.concatenate([ends, inner[np.argsort(text[inner], kind="stable")]])
    if not len(inner):
        return np.concatenate([zeros, _both_passes(text, size, by_character, is_s)])

    # Names of the substrings from one leftmost S suffix to the next.
    marked = np.zeros(len(text), bool)
    marked[inner] = True
    order = _both_passes(text, size, by_character, is_s)
    order = order[marked[order]]
    stop = np.full(len(text), len(text) - 1, np.int64)
    stop[leftmost[:-1]] = leftmost[1:]
    last = stop[order]
    codes = np.concatenate([[np.uint64(0)], np.cumsum(mix(text.astype(np.uint64) + np.uint64(77)) * _powers(len(text)), dtype=np.uint64)])
    marks = (codes[last + 1] - codes[order]) * _inverse_powers(len(text))[order]
    length = last - order
    same = (marks[1:] == marks[:-1]) & (length[1:] == length[:-1]) & (text[last[1:]] > 0)
    name = len(ends) + np.cumsum(np.append(0, ~same))
    names = np.zeros(len(text), np.int64)
    names[order] = name
    names[ends] = np.arange(len(ends))
    reduced = names[leftmost]
    if name[-1] + 1 == len(leftmost):
        sorted_leftmost = leftmost[np.argsort(reduced, kind="stable")]
    else:
        # In the reduced text only its last number is a 0.
        sorted_leftmost = leftmost[sort_suffixes(reduced, int(name[-1]) + 1, SMALL_NAMES)]
    return np.concatenate([zeros, _both_passes(text, size, sorted_leftmost, is_s)])


_BASE = 0x9E3779B97F4A7C15 | 1
_UP = _DOWN = np.ones(1, np.uint64)


def _powers(count: int) -> np.ndarray:
    global _UP
    if len(_UP) < count:
        full = np.full(count, _BASE, np.uint64)
        full[0] = 1
        _UP = np.cumprod(full, dtype=np.uint64)
    return _UP[:count]


def _inverse_powers(count: int) -> np.ndarray:
    global _DOWN
    if len(_DOWN) < count:
        full = np.full(count, pow(_BASE, -1, 1 << 64), np.uint64)
        full[0] = 1
        _DOWN = np.cumprod(full, dtype=np.uint64)
    return _DOWN[:count]
