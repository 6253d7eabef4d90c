"""Language of documents by a linear-chain conditional random field over their words.

A word's features are its bytes' bigrams and trigrams, its first and last one to three bytes, the word itself (lexicon) and whether it
has letters; languages follow each other by learned transitions. Forward-backward gives each word's share of every language; a document
is of the language with the largest sum. Words may be of several languages: `label_words` gives each word's own.

The field is fitted on at most `max_train_docs` labelled documents outside the held-out third. Their words carry the document's label;
training sequences are spliced from pieces of documents of random languages, so that transitions are learned from switches that are
known. All words of all texts are labelled, in numpy over blocks of words: the operators of all blocks of a slice are multiplied at once,
joined along each document, and the marginals follow block by block.

Defined cases. A null text and one without letters are `und` with score 0. Without any labelled document every text is `und`. Rows may
repeat and get equal results; ties go to the language that sorts first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, Rolling, gather, held_out, mix, raw, slices, strings, texts, word_hashes, word_ranges

UNKNOWN = "und"
BLOCK = 64

# Where the kinds of features lie in the weight table.
_BIGRAMS, _TRIGRAMS, _AFFIXES, _WORDS, _SHAPES = 0, 1 << 16, (1 << 16) + (1 << 17), (1 << 16) + (1 << 18), (1 << 16) + (1 << 18) + (1 << 18)
FEATURES = _SHAPES + 2

_TOKENS, _LOWERED = Rolling("language tokens"), Rolling("language words")


def token_features(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each token (lower-cased, none null or empty), one token after another, and where each token's begin."""
    lowered = pc.utf8_lower(tokens.cast(pa.large_string()))
    letters = np.asarray(pc.match_substring_regex(lowered, r"\p{L}"), dtype=bool)
    data, offsets = raw(lowered)
    starts, ends = offsets[:-1], offsets[1:]
    # With a blank at both ends, so that n-grams know the word's edges.
    size = ends - starts
    padded_at = np.concatenate([[0], np.cumsum(size + 2)])
    padded = np.full(padded_at[-1], 0x20, np.int64)
    inside = np.ones(len(padded), bool)
    inside[padded_at[:-1]] = False
    inside[padded_at[1:] - 1] = False
    padded[inside] = data
    pairs = padded[:-1] * 256 + padded[1:]
    triples = _TRIGRAMS + ((pairs[:-1] * 0x9E3779B1 + padded[2:] * 0x85EBCA6B) >> 9) % (1 << 17)
    kinds, owners = [], []

    def add(values: np.ndarray, rows: np.ndarray) -> None:
        kinds.append(values)
        owners.append(rows)

    row = np.arange(len(size))
    number = size + 1
    at, owner = _runs(padded_at[:-1], number)
    add(_BIGRAMS + pairs[at], owner)
    at, owner = _runs(padded_at[:-1], size)
    add(triples[at], owner)
    for n in (1, 2, 3):
        long = row[size >= n]
        for kind, first in ((0, starts[long]), (1, ends[long] - n)):
            code = np.zeros(len(long), np.int64)
            for k in range(n):
                code = code * 256 + data[first + k]
            add(_AFFIXES + (mix((code * 8 + 2 * n + kind).astype(np.uint64)) % np.uint64(1 << 17)).astype(np.int64), long)
    add(_WORDS + (word_hashes(data, starts, ends, _LOWERED) % np.uint64(1 << 18)).astype(np.int64), row)
    add(_SHAPES + letters.astype(np.int64), row)
    values, owner = np.concatenate(kinds), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return values[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def _runs(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first, first+1, ... for each row, and the row of each."""
    owner = np.repeat(np.arange(len(first)), number)
    begin = np.cumsum(number) - number
    return np.arange(len(owner)) - begin[owner] + first[owner], owner


@dataclass
class Field:
    """Languages, weights of the features, transitions and starts (all logarithmic)."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray

    def emissions(self, tokens: pa.Array) -> np.ndarray:
        values, at = token_features(tokens)
        sums = np.add.reduceat(self.weights[values], at[:-1], axis=0) if len(tokens) else np.zeros((0, len(self.languages)))
        return sums.astype(np.float32)

    def marginals(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Share of each language for every word; `bounds`: words before each document."""
        count = np.diff(bounds)
        k = len(self.languages)
        blocks = -(-count // BLOCK)
        block_at = np.concatenate([[0], np.cumsum(blocks)])
        total = int(block_at[-1])
        out = np.zeros((len(scores), k), np.float32)
        if not total:
            return out
        doc = np.repeat(np.arange(len(count)), blocks)
        part = np.arange(total) - block_at[doc]
        place = (block_at[np.repeat(np.arange(len(count)), count)] * BLOCK + np.arange(len(scores)) - np.repeat(bounds[:-1], count)).astype(np.int64)
        emit = np.ones((total * BLOCK, k), np.float32)
        emit[place] = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
        emit = emit.reshape(total, BLOCK, k)
        used = np.minimum(count[doc] - part * BLOCK, BLOCK)
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        begin = np.exp(self.starts - self.starts.max()).astype(np.float32)
        heads = part == 0

        # The operator of each block: row i is what comes out of state i before it.
        whole = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
        for t in range(BLOCK):
            go = used > t
            new = (whole[go] @ step) * emit[go, t][:, None, :]
            if t == 0:
                first = heads[go]
                new[first] = (begin * emit[go, 0][first])[:, None, :]
            whole[go] = new / new.sum((1, 2), keepdims=True)

        # Before and after each block, along the document.
        before = np.full((total, k), 1.0 / k, np.float32)
        after = np.ones((total, k), np.float32)
        longest = int(blocks.max())
        for j in range(1, longest):
            now = block_at[:-1][blocks > j] + j
            v = np.einsum("nk,nkl->nl", before[now - 1], whole[now - 1])
            before[now] = v / v.sum(1, keepdims=True)
        for j in range(longest - 2, -1, -1):
            now = block_at[:-1][blocks > j + 1] + j
            v = np.einsum("nkl,nl->nk", whole[now + 1], after[now + 1])
            after[now] = v / v.sum(1, keepdims=True)

        forward = np.zeros((total, BLOCK, k), np.float32)
        state = before
        for t in range(BLOCK):
            new = (state @ step) * emit[:, t]
            if t == 0:
                new[heads] = begin * emit[heads, 0]
            new /= new.sum(1, keepdims=True)
            state = np.where((used > t)[:, None], new, state)
            forward[:, t] = state
        back = after
        for t in range(BLOCK - 1, -1, -1):
            go = (used > t)[:, None]
            forward[:, t] *= np.where(go, back, 1.0)
            new = (emit[:, t] * back) @ step.T
            new /= new.sum(1, keepdims=True)
            back = np.where(go, new, back)
        shares = forward.reshape(total * BLOCK, k)[place]
        return shares / shares.sum(1, keepdims=True)


def _slice_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a slice, the number of each word in it, words before each text."""
    data, offsets = raw(column)
    starts, ends, bounds = word_ranges(data, offsets)
    coded = pa.array(word_hashes(data, starts, ends, _TOKENS)).dictionary_encode()
    index = np.asarray(coded.indices, dtype=np.int64)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[index[::-1]] = np.arange(len(index))[::-1]
    return strings(data, starts[first], ends[first]).cast(pa.large_string()), index, bounds


def _train(languages: list[str], rows: list[tuple[str, str]], sequences: int = 6000, length: int = 64, batch: int = 250) -> Field:
    """Weights from smoothed counts, then transitions and all weights by adaptive gradient steps on the likelihood of spliced sequences."""
    k = len(languages)
    draw = np.random.default_rng(7)
    tokens, index, bounds = _slice_words(pa.array([r[0] for r in rows], pa.large_string()))
    label_of = np.array([languages.index(r[1]) for r in rows])
    values, at = token_features(tokens)
    word_label = np.repeat(label_of, np.diff(bounds))
    seen = np.bincount(index * k + word_label, minlength=len(tokens) * k).reshape(-1, k).astype(float)
    seen = np.log1p(seen)  # a word of a repeated passage counts little more than once
    counts = np.zeros((FEATURES, k))
    owner = np.repeat(np.arange(len(tokens)), np.diff(at))
    for j in range(k):
        counts[:, j] = np.bincount(values, seen[owner, j], minlength=FEATURES)
    share = (counts + 0.5) / (counts.sum(0) + 0.5 * FEATURES)
    weights = np.log(share) - np.log(share).mean(1, keepdims=True)
    weights[counts.sum(1) == 0] = 0
    weights *= 0.15  # features of one word overlap
    model = Field(languages, weights.astype(np.float32), np.log(np.full((k, k), 0.02) + np.eye(k)), np.zeros(k))

    docs_of = [np.flatnonzero((label_of == j) & (np.diff(bounds) > 0)) for j in range(k)]
    present = [j for j in range(k) if len(docs_of[j])]
    square = [np.zeros_like(model.weights), np.zeros((k, k)), np.zeros(k)]
    for _ in range(0, sequences, batch):
        words, truth = np.zeros((batch, length), np.int64), np.zeros((batch, length), np.int64)
        for s in range(batch):
            filled = 0
            while filled < length:
                j = present[draw.integers(len(present))]
                d = docs_of[j][draw.integers(len(docs_of[j]))]
                n = min(int(draw.integers(4, 49)), length - filled, int(bounds[d + 1] - bounds[d]))
                low = bounds[d] + draw.integers(0, bounds[d + 1] - bounds[d] - n + 1)
                words[s, filled : filled + n] = index[low : low + n]
                truth[s, filled : filled + n] = j
                filled += n
        kinds, which = np.unique(words, return_inverse=True)
        number = np.diff(at)[kinds]
        places, owner = _runs(at[kinds], number)
        used = values[places]
        scores = np.zeros((len(kinds), k), np.float32)
        for j in range(k):
            scores[:, j] = np.bincount(owner, model.weights[used, j], minlength=len(kinds))
        e = np.exp(scores - scores.max(1, keepdims=True))[which.reshape(-1)].reshape(batch, length, k) + 1e-30
        step, begin = np.exp(model.transitions), np.exp(model.starts)
        ahead, back = np.zeros((batch, length, k)), np.ones((batch, length, k))
        v = begin * e[:, 0]
        ahead[:, 0] = v / v.sum(1, keepdims=True)
        for t in range(1, length):
            v = (ahead[:, t - 1] @ step) * e[:, t]
            ahead[:, t] = v / v.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            v = (e[:, t + 1] * back[:, t + 1]) @ step.T
            back[:, t] = v / v.sum(1, keepdims=True)
        gamma = ahead * back
        gamma /= gamma.sum(2, keepdims=True)
        pairs = ahead[:, :-1, :, None] * step * (e[:, 1:] * back[:, 1:])[:, :, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        true = np.eye(k)[truth]
        error = (gamma - true).reshape(-1, k)
        by_kind = np.stack([np.bincount(which.reshape(-1), error[:, j], minlength=len(kinds)) for j in range(k)], 1)
        gradient = np.stack([np.bincount(used, by_kind[owner, j], minlength=FEATURES) for j in range(k)], 1)
        moves = np.zeros((k, k))
        np.add.at(moves, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        for n, (name, g) in enumerate(
            (("weights", gradient), ("transitions", pairs.sum((0, 1)) - moves), ("starts", (gamma - true)[:, 0].sum(0)))
        ):
            value = getattr(model, name)
            g = g / batch + 1e-5 * value
            square[n] += g * g
            setattr(model, name, (value - 0.1 * g / (np.sqrt(square[n]) + 1e-8)).astype(value.dtype))
    return model


def fit(docs: DataFrame, max_train_docs: int = 3000, max_train_chars: int = 20_000) -> Field | None:
    """The field from at most `max_train_docs` labelled documents of at most `max_train_chars` characters outside the held-out third:
    those with the smallest hashes of their texts, an equal share of the bound for each language."""
    named = docs.select(
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("id"), docs["text"].alias("text"), docs["lang"].alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_train_chars))
    pool = named.where(~held_out()).select("text", "lang")
    languages = sorted(r[0] for r in pool.select("lang").distinct().collect())
    if not languages:
        return None
    rows: list[tuple[str, str]] = []
    for language in languages:
        own = pool.where(F.col("lang") == language).orderBy(F.xxhash64("text"), "text").limit(max_train_docs // len(languages))
        rows += [(r[0], language) for r in dict.fromkeys((r[0],) for r in own.select("text").collect())]
    return _train(languages, rows)


def _shares(model: Field, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    tokens, index, bounds = _slice_words(column)
    return model.marginals(model.emissions(tokens)[index], bounds), bounds


def predict_language(docs: DataFrame, max_train_docs: int = 3000) -> DataFrame:
    """id, text, held_out, lang_pred and score (the share of the words' marginals that the language has) of every row."""
    model = fit(docs, max_train_docs)
    rows = texts(docs)
    if model is None:
        judged = rows.select("id", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                column = batch.column(1)
                shares, bounds = _shares(model, column)
                sums = np.concatenate([np.zeros((1, shares.shape[1])), np.cumsum(shares, axis=0, dtype=float)])
                own = sums[bounds[1:]] - sums[bounds[:-1]]
                best = own.argmax(1)
                score = own[np.arange(len(own)), best] / np.maximum(np.diff(bounds), 1)
                known = np.asarray(pc.match_substring_regex(column, r"\p{L}"), dtype=bool)
                names = np.where(known, np.array(model.languages, dtype=object)[best], UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), column, pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))],
                    ["id", "text", "lang_pred", "score"],
                )

        judged = rows.mapInArrow(run, "id bigint, text string, lang_pred string, score double")
    return judged.select("id", "text", held_out().alias("held_out"), "lang_pred", "score")


def label_words(model: Field, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its language."""
    column = pa.array([text], pa.large_string())
    shares, _ = _shares(model, column)
    data, offsets = raw(column)
    starts, ends, _ = word_ranges(data, offsets)
    return [
        (bytes(gather(data, starts[i : i + 1], ends[i : i + 1])[0]).decode(), model.languages[j]) for i, j in enumerate(shares.argmax(1))
    ]
