"""Benchmark items inside documents: a BM25 index of the items, every passage of every document as a query, overlap verified.

The index holds the test items: postings of impacts (BM25 weights), each divided by the item's score against itself, so that 1 is the
whole item and one threshold serves all. Items lie in blocks; a term knows its largest impact in each block (block-max). A passage is
`2 * stride` words, a new one begins every `stride` words, and no item is longer than the stride, so an item in a text lies within some
passage whole.

Passages are pruned as WAND does, by upper bounds. Of each item the commonest terms, up to `UNREAD` of the threshold together, are not
read at first: an item can reach the threshold only with some of its other terms. Those terms' block maxima are summed for every passage
of a slice and block at once; a block is scored in full only where that sum and the most that its unread terms can add reach the
threshold, and within it terms are read in order of their maxima until no item can get there. Bounds never cut a score that counts.

An item found above the threshold is verified: of the question (all but the last line, or the last sentence) and of the answer (that
line or sentence) each, `overlap` of the five-word shingles must be in the passage.

Words are lower-cased and bare of punctuation at their ends. Defined cases. Null texts are empty; items without words match nothing; a
part shorter than five words counts as one shingle, an item of one sentence is question and answer at once. Rows and items may repeat:
each pair of a document's row and an item gives one row. Documents without a find give no row; empty tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, Rolling, raw, slices, strings, texts, word_hashes, word_ranges

SHINGLE_WORDS, OVERLAP, THRESHOLD, UNREAD = 5, 0.8, 0.6, 0.75
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKENS = Rolling("decontamination tokens")


def words_of(text: str | None) -> list[str]:
    return [w for x in _WORD.findall(text or "") if (w := x.lower().strip(_MARKS))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item; the same words twice if it cannot be cut."""
    lines = [x for x in text.split("\n") if words_of(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.!?])\s+", text) if words_of(x)]
    if len(lines) < 2:
        return words_of(text), words_of(text)
    return words_of("\n".join(lines[:-1])), words_of(lines[-1])


def shingles(words: list, size: int = SHINGLE_WORDS) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


@dataclass
class Index:
    """Test items of one index; `impacts` and `items` are the postings of all terms one after another, `at` where each term's begin."""

    ids: list[int | None]
    terms: list[str]
    at: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    unread: np.ndarray
    longest: int
    parts: list[tuple[list[str], list[str]]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], threshold: float) -> Index:
        kept = [(i, t) for i, t in rows if words_of(t)]
        own = [words_of(t) for _, t in kept]
        mean = sum(map(len, own)) / max(1, len(own))
        found: dict[str, dict[int, int]] = {}
        for k, words in enumerate(own):
            for w in words:
                place = found.setdefault(w, {})
                place[k] = place.get(k, 0) + 1
        terms = sorted(found, key=lambda w: (-len(found[w]), w))
        lists = []
        for w in terms:
            idf = np.log(1 + (len(own) - len(found[w]) + 0.5) / (len(found[w]) + 0.5))
            lists.append([(k, idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(own[k]) / mean))) for k, n in sorted(found[w].items())])
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        items = np.array([k for x in lists for k, _ in x], np.int64)
        impacts = np.array([s for x in lists for _, s in x])
        impacts = impacts / np.maximum(np.bincount(items, impacts, minlength=len(own))[items], 1e-12) if len(items) else impacts
        # Terms come commonest first, so within an item its postings do too.
        order = np.lexsort((np.arange(len(items)), items))
        sums = np.cumsum(impacts[order])
        starts = np.searchsorted(items[order], np.arange(len(own)))
        within = sums - np.concatenate([[0.0], sums])[starts][items[order]] if len(items) else sums
        unread = np.zeros(len(items), bool)
        unread[order] = within <= UNREAD * threshold
        return cls(
            [i for i, _ in kept], terms, at, items, impacts, unread, max(map(len, own), default=1), [question_and_answer(t) for _, t in kept]
        )

    def prepare(self) -> None:
        """Bounds and look-ups that follow from the postings; made once in each task."""
        blocks = -(-len(self.ids) // BLOCK_ITEMS)
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.at))
        self.block_top = np.zeros((len(self.terms), blocks))
        np.maximum.at(self.block_top, (owner, self.items // BLOCK_ITEMS), self.impacts)
        # Postings of blocks that are read first: (term, block) with the largest impact; and what the unread terms add at most.
        first = np.zeros_like(self.block_top)
        read = ~self.unread
        np.maximum.at(first, (owner[read], self.items[read] // BLOCK_ITEMS), self.impacts[read])
        term, self.read_block = np.nonzero(first)
        self.read_top = first[term, self.read_block]
        self.read_at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        rest = np.bincount(self.items[self.unread], self.impacts[self.unread], minlength=len(self.ids))
        self.rest = np.maximum.reduceat(rest, np.arange(0, len(rest), BLOCK_ITEMS)) if len(rest) else rest
        self.value_set = pa.array(self.terms, pa.large_string())
        self.shingles = [(shingles(q), shingles(a)) for q, a in self.parts]

    def candidates(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Passages and blocks (rows) that may reach the threshold, from distinct pairs of passage and term."""
        number = np.diff(self.read_at)[term]
        begin = np.repeat(self.read_at[term] - (np.cumsum(number) - number), number)
        posting = begin + np.arange(len(begin))
        key = np.repeat(passage, number) * len(self.rest) + self.read_block[posting]
        key, which = np.unique(key, return_inverse=True)
        bound = np.bincount(which, self.read_top[posting], minlength=len(key)) + self.rest[key % max(1, len(self.rest))]
        key = key[bound >= threshold - 1e-9]
        return np.stack([key // max(1, len(self.rest)), key % max(1, len(self.rest))], 1)

    def search(self, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items of these blocks that reach the threshold for a query of distinct terms."""
        bounds = self.block_top[np.ix_(terms, blocks)].sum(0)
        found = []
        for block, left in zip(blocks[bounds >= threshold - 1e-9], bounds[bounds >= threshold - 1e-9], strict=True):
            low, high = block * BLOCK_ITEMS, min((block + 1) * BLOCK_ITEMS, len(self.ids))
            scores = np.zeros(high - low)
            # Terms with the largest maxima first; what is left cannot lift an item above the threshold once the sum is too small.
            for t in terms[np.argsort(-self.block_top[terms, block], kind="stable")]:
                best = self.block_top[t, block]
                if best == 0 or scores.max() + left < threshold - 1e-9:
                    break
                a, b = self.at[t] + np.searchsorted(self.items[self.at[t] : self.at[t + 1]], [low, high])
                scores[self.items[a:b] - low] += self.impacts[a:b]
                left -= best
            found += [(low + int(k), float(scores[k])) for k in np.flatnonzero(scores >= threshold - 1e-12)]
        return found


def _slice_terms(index: Index, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of each word the term number (-1: none); words before each text; the distinct normal words and each word's number among them."""
    data, offsets = raw(column)
    starts, ends, bounds = word_ranges(data, offsets)
    coded = pa.array(word_hashes(data, starts, ends, _TOKENS)).dictionary_encode()
    number = np.asarray(coded.indices, dtype=np.int64)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    tokens = strings(data, starts[first], ends[first]).cast(pa.large_string())
    normal = pc.utf8_trim(pc.utf8_lower(tokens), characters=_MARKS)
    # Words of punctuation only are no words.
    empty = np.asarray(pc.equal(normal, ""), dtype=bool)[number] if len(number) else np.zeros(0, bool)
    term = np.asarray(pc.fill_null(pc.index_in(normal, value_set=index.value_set), -1), dtype=np.int64)
    keep = ~empty
    before = np.concatenate([[0], np.cumsum(keep)])
    return term[number[keep]], before[bounds], normal, number[keep]


def find(index: Index, column: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item, score, overlap of the question, of the answer, first word of the passage): the best passage of each text and item."""
    term, bounds, normal, number = _slice_terms(index, column)
    stride = index.longest
    count = np.diff(bounds)
    passages = np.maximum(1, -(-(count - stride) // stride)) * (count > 0)
    text = np.repeat(np.arange(len(count)), passages)
    place = np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)
    low = bounds[text] + place * stride
    high = np.minimum(low + 2 * stride, bounds[text + 1])
    best: dict[tuple[int, int], tuple[int, int, float, float, float, int]] = {}
    # Each word lies in the passage that begins at its stride and in the one before.
    known = np.flatnonzero(term >= 0)
    of_text = np.searchsorted(bounds, known, "right") - 1
    nth = (known - bounds[of_text]) // stride
    first_passage = np.cumsum(passages) - passages
    pairs = []
    for back in (0, 1):
        there = (nth - back >= 0) & (nth - back < passages[of_text])
        pairs.append((first_passage[of_text[there]] + nth[there] - back) * max(1, len(index.terms)) + term[known[there]])
    pair = np.unique(np.concatenate(pairs))
    may = index.candidates(pair // max(1, len(index.terms)), pair % max(1, len(index.terms)), threshold)
    heads = np.flatnonzero(np.diff(may[:, 0], prepend=-1))
    for a, b in zip(heads, np.append(heads, len(may))[1:], strict=True):
        p, blocks = int(may[a, 0]), may[a:b, 1]
        own = term[low[p] : high[p]]
        hits = index.search(np.unique(own[own >= 0]), blocks, threshold)
        if not hits:
            continue
        words = normal.take(pa.array(number[low[p] : high[p]])).to_pylist()
        grams: dict[int, set] = {}
        for item, score in hits:
            shares = []
            for part, words_of_part in zip(index.shingles[item], index.parts[item], strict=True):
                size = min(SHINGLE_WORDS, len(words_of_part))
                if size not in grams:
                    grams[size] = shingles(words, size)
                shares.append(len(part & grams[size]) / max(1, len(part)))
            if min(shares) >= overlap:
                key = (int(text[p]), item)
                new = (*key, score, *shares, int(low[p] - bounds[text[p]]))
                if key not in best or new[2:] > best[key][2:]:
                    best[key] = new
    return list(best.values())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, max_items: int = 20_000
) -> DataFrame:
    """id, hash (of the text), item_id, score, question_overlap, answer_overlap, start_word of every document's row and item found in it.

    An index holds at most `max_items` items; a larger benchmark makes several, each with its own statistics, and each is queried with all
    passages. An index is sent to the tasks, so its size is bounded by `max_items`.
    """
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].alias("text")).distinct()
    indexes = max(1, -(-items.count() // max_items))
    rows = texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    dealt = items.withColumn("_index", F.pmod(F.xxhash64("item_id", "text"), F.lit(indexes)))
    schema = "id bigint, hash bigint, item_id bigint, score double, question_overlap double, answer_overlap double, start_word int"
    found = None
    for k in range(indexes):
        own = dealt.where(F.col("_index") == k).select("item_id", "text").collect()
        index = Index.of(sorted(((r[0], r[1]) for r in own), key=lambda r: (NO_ID if r[0] is None else r[0], r[1] or "")), threshold)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            index.prepare()
            for batch in slices(batches):
                hits = find(index, batch.column(1), threshold, overlap)
                at = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(2).take(at),
                        pa.array([index.ids[h[1]] for h in hits], pa.int64()),
                        *[pa.array([h[n] for h in hits], pa.float64()) for n in (2, 3, 4)],
                        pa.array([h[5] for h in hits], pa.int32()),
                    ],
                    ["id", "hash", "item_id", "score", "question_overlap", "answer_overlap", "start_word"],
                )

        one = rows.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found
