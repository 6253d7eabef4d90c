"""Toxicity of documents, hidden words restored first.

A noisy channel: a written token is a word that went through leetspeak, spacing and repetition. Every token that may have gone through
it becomes a lattice of candidate characters; Viterbi picks the path with the best sum of the channel's and a character trigram model's
log probabilities. The trigrams are counted over all texts. Tokens whose lattice has one path only (plain letters) are their own result.
Symbols at the edge of a word stand for a letter or for nothing; letters written twice may be one. Neighbouring words of at most `SHORT`
characters share a lattice with a blank or nothing between them; what it joins is scored beside the words themselves.

The restored words and their beginnings are scored: features that labelled toxic documents hold significantly more often form a lexicon
with log odds, and a logistic model turns a document's hits into a score. The lexicon and the model are fitted on at most
`max_train_rows` labelled documents outside the held-out third, equal texts counted once.

Defined cases. A null text is an empty one and is scored from the constant of the model. Rows may repeat and get equal scores. Without
labels of both classes every score is the share of toxic labels (0.5 without labels). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Rolling, held_out, raw, slices, stored, strings, texts, word_hashes, word_ranges

# What a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~'/\\,:;"
LOG = {name: float(np.log(p)) for name, p in {"same": 0.90, "single": 0.10, "leet": 0.80, "kept": 0.02, "joined": 0.60, "apart": 0.40, "once": 0.45, "twice": 0.45, "all": 0.10}.items()}
#: Symbols of the trigram model: 0 is everything that is no letter of it.
SYMBOLS = 64
#: Words of so many characters may be pieces of one word.
SHORT = 3
#: How likely a symbol before (after) a word is punctuation; others are so with the probability of `kept`.
OPENS = {"(": 0.8, "¡": 0.8, "|": 0.5, "+": 0.3}
CLOSES = {"!": 0.8, "|": 0.5, "+": 0.3}

_TOKENS = Rolling("tokens")
_EDGES = re.compile(r"^\W+|[\W_]+$")
_MAY_HIDE = re.compile(r"[^\W\d_].*[\d@$!|+(€£¡]|[\d@$!|+(€£¡].*[^\W\d_]|([^\W\d_])\1|[^\W\d_][.\-_*~'/\\,:;][^\W\d_]|^[@$!|+(€£¡]{3,}$")
_SYMBOLS_AT_EDGES = re.compile(r"(?:^|(?<=\s))[@$!|+(€£¡]+|[@$!|+(€£¡]+(?=\s|$)")


#: What can be taken off an edge without a closer look: ASCII punctuation that stands for no letter.
_PLAIN_EDGES = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in LEET and c != "_")


def core(token: str) -> str:
    """The token in lower case; of what stands before and after its letters and digits only symbols that may be letters stay."""
    word = token.lower()
    if (plain := word.lstrip(_PLAIN_EDGES).rstrip(_PLAIN_EDGES + "_")).isalnum():
        return plain
    return _EDGES.sub(lambda m: "".join(c for c in m.group() if c in LEET), word)


def alphabet_of(counts: dict[int, int]) -> str:
    """The most frequent lower-case letters, by code point counts; ties go to the smaller code point."""
    letters = [(-n, c) for c, n in counts.items() if chr(c).isalpha()]
    return "".join(chr(c) for _, c in sorted(letters)[: SYMBOLS - 1])


def _code_points(batch: pa.RecordBatch, column: int) -> np.ndarray:
    joined = "\n".join(batch.column(column).to_pylist()).lower()
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def _summed(rows: DataFrame, key: str) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(key).agg(F.sum("n")).collect()}


def character_model(docs: DataFrame) -> tuple[str, np.ndarray]:
    """The letters of the model and log P(character | two before it), counted over all texts in one pass.

    Each task counts trigrams of code points below a fixed bound in an array; only sums leave it, at most SYMBOLS^3 cells in the end.
    """
    span = 0x180  # Latin letters with their extensions; what lies beyond is no letter of the model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(span, np.int64)
        for batch in slices(batches):
            points = _code_points(batch, 1)
            letters += np.bincount(points[points < span], minlength=span)
        at = np.flatnonzero(letters)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(letters[at])], ["cell", "n"])

    rows = texts(docs)
    alphabet = alphabet_of(_summed(rows.mapInArrow(count, "cell bigint, n bigint"), "cell"))
    symbol = np.zeros(span, np.int64)
    for k, c in enumerate(alphabet):
        symbol[ord(c)] = k + 1

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            points = _code_points(batch, 1)
            s = symbol[np.minimum(points, span - 1)]
            s[points >= span] = 0
            if len(s) > 2:
                cells += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    table = np.zeros(SYMBOLS**3)
    for cell, n in _summed(rows.mapInArrow(trigrams, "cell bigint, n bigint"), "cell").items():
        table[cell] = n
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = table.sum((0, 1)) + 1.0
    one /= one.sum()
    two = table.sum(0) + 20.0 * one
    two /= two.sum(1, keepdims=True)
    three = table + 5.0 * two[None]
    three /= three.sum(2, keepdims=True)
    return alphabet, np.log(three)


@dataclass
class Channel:
    """Restores tokens; what it has restored is remembered up to a bound."""

    alphabet: str
    logs: np.ndarray
    known: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.symbol = {c: k + 1 for k, c in enumerate(self.alphabet)}
        self.rows: dict[tuple[int, int], list[float]] = {}

    def __getstate__(self):
        return {"alphabet": self.alphabet, "logs": self.logs.astype(np.float32)}

    def __setstate__(self, state):
        self.__init__(state["alphabet"], state["logs"])

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Candidates of each place: what may have been written there, and the channel's log probability."""
        nothing: dict[int, float] = {}
        for m in _SYMBOLS_AT_EDGES.finditer(token):
            before = m.start() == 0 or token[m.start() - 1].isspace()
            after = m.end() == len(token) or token[m.end()].isspace()
            for at in range(*m.span()):
                odds = [side.get(token[at], 0.02) for side, on in ((OPENS, before), (CLOSES, after)) if on]
                nothing[at] = max(odds)
        places, k = [], 0
        while k < len(token):
            c, n = token[k], 1
            while k + n < len(token) and token[k + n] == c:
                n += 1
            if k in nothing:
                no, yes = float(np.log(nothing[k])), float(np.log(1 - nothing[k]))
                given = [(x, yes + LOG["leet"] - float(np.log(len(LEET[c])))) for x in LEET[c]]
                places.extend([*given, (c, yes + LOG["kept"]), ("", no)] for _ in range(min(n, 2)))
            elif c.isalpha() and n == 2:
                places.append([(c, LOG["single"]), (c * 2, LOG["same"])])
            elif c.isalpha() and n >= 3:
                places.append([(c, LOG["once"]), (c * 2, LOG["twice"]), (c * n, LOG["all"])])
            elif c in LEET:
                given = [(x, LOG["leet"] - float(np.log(len(LEET[c])))) for x in LEET[c]]
                places.extend([*given, (c, LOG["kept"])] for _ in range(min(n, 2)))
            elif c == " " or c in SEPARATORS:
                places.append([("", LOG["joined"]), (" ", LOG["apart"])])
            else:
                places.extend([(c, 0.0)] for _ in range(n))
            k += n
        return places

    def restore(self, token: str) -> str:
        """The best path through the token's lattice under the character model."""
        if (found := self.known.get(token)) is not None:
            return found
        symbol, rows = self.symbol, self.rows
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for place in [*self.lattice(token), [(" ", 0.0)]]:
            best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for text, cost in place:
                    x, y, s = a, b, score + cost
                    for c in text:
                        if (row := rows.get((x, y))) is None:
                            row = rows[x, y] = self.logs[x, y].tolist()
                        z = symbol.get(c, 0)
                        s += row[z]
                        x, y = y, z
                    old = best.get((x, y))
                    if old is None or s > old[0]:
                        best[x, y] = (s, (path, text))
            states = best
        path, parts = max(states.values(), key=lambda v: v[0])[1], []
        while path is not None:
            parts.append(path[1])
            path = path[0]
        out = "".join(reversed(parts)).strip()
        if len(token) <= 200:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[token] = out
        return out

    def words(self, token: str) -> list[str]:
        """The restored words of one written token: lower case, no punctuation around it."""
        return self.words_of(core(token))

    def words_of(self, word: str, may: bool = True) -> list[str]:
        """The same from the core of the token. If nothing that is asked for `may` be read into it, it is not decoded and gives none."""
        if _MAY_HIDE.search(word):
            if not may:
                return []
            word = self.restore(word)
        return [w for x in word.split() if (w := x if x.isalnum() else _EDGES.sub("", x))]

    def joined(self, pieces: tuple[str, ...], wanted) -> list[str]:
        """The words that the common lattice of neighbouring pieces makes of two pieces or more; none if no wanted feature can come of it."""
        if not any(c.isalpha() or c in LEET and not c.isdigit() for p in pieces for c in p):
            return []
        plain = len(pieces) <= 8 and not any(c in LEET or c in SEPARATORS for p in pieces for c in p)
        if plain and not any(_MAY_HIDE.search(p) for p in pieces):
            # Its paths are the pieces, joined or not.
            made = ("".join(pieces[i:j]) for i in range(len(pieces)) for j in range(i + 2, len(pieces) + 1))
            if not any(wanted(x) is not None for w in made for x in features_of(w)):
                return []
        alone = {w for p in pieces for w in self.words(p)}
        found = (_EDGES.sub("", x) for x in self.restore(" ".join(pieces)).split())
        return [w for w in found if len(w) > 1 and w not in alone]


def features_of(word: str) -> list[str]:
    """The word, and its first four and five characters if it is longer."""
    return [word, *(word[:n] + "~" for n in (4, 5) if len(word) > n)]


#: Lexicons of more different beginnings are not turned into a pattern; their tokens are all decoded.
MOST_PATTERNS = 400
#: Letters of a feature that a pattern looks at.
PATTERN_LETTERS = 5


def reading(features: list[str]) -> str | None:
    """A pattern that every token matches which one of the features can be read into: its first letters in order, each as itself or as a
    symbol for it, repeated or not, with symbols and separators between them. Others may match too. None where the patterns are too many.

    For an engine without backtracking: what may stand between letters may stand for letters as well.
    """

    def among(characters: str) -> str:
        return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(characters)))

    patterns, between = set(), " " + SEPARATORS + "".join(LEET)
    for feature in features:
        word = feature.removesuffix("~")
        parts = []
        for k, c in enumerate(word):
            if (not k or word[k - 1] != c) and len(parts) < PATTERN_LETTERS:
                own = c + "".join(s for s, given in LEET.items() if c in given)
                parts.append(f"[{among(own)}][{among(own + between)}]*")
        patterns.add("".join(parts))
    if len(patterns) > MOST_PATTERNS:
        return None
    return "|".join(sorted(patterns)) or "[^\\x{0}-\\x{10FFFF}]"


def _readable(tokens: list[str], pattern: str | None) -> list[bool]:
    if pattern is None or not tokens:
        return [True] * len(tokens)
    return pc.match_substring_regex(pa.array(tokens, pa.string()), pattern).to_pylist()


def _tokens(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of a slice, the token number of each word, and the words before each text."""
    data, offsets = raw(column)
    starts, ends, bounds = word_ranges(data, offsets)
    if not len(starts):
        return [], np.zeros(0, np.int64), bounds
    coded = pa.array(word_hashes(data, starts, ends, _TOKENS)).dictionary_encode()
    index = np.asarray(coded.indices, dtype=np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[index[::-1]] = np.arange(len(index))[::-1]
    tokens = [t.decode("utf-8", "replace") for t in strings(data, starts[first], ends[first]).to_pylist()]
    return tokens, index, bounds


def _neighbours(short: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last) of every run of two or more short words of a text."""
    inside = short[index]
    fresh = np.zeros(len(index) + 1, bool)
    fresh[bounds] = True  # a run may not go on from the text before
    heads = np.flatnonzero(inside & (fresh[:-1] | ~np.append(False, inside[:-1])))
    stops = np.flatnonzero(inside & (fresh[1:] | ~np.append(inside[1:], False))) + 1
    several = stops - heads >= 2
    heads, stops = heads[several], stops[several]
    return np.searchsorted(bounds, heads, "right") - 1, heads, stops


def _hits(channel: Channel, column: pa.Array, wanted, memo: dict, pattern: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of each wanted feature, repeated as often as it occurs, and the number of words of each text.

    `wanted(feature)` gives a number or None; `memo` keeps what a token gives, up to a bound; `pattern` is a `reading` of the wanted features.
    """
    tokens, index, bounds = _tokens(column)
    if len(memo) > 400_000:
        memo.clear()
    # The cores of short tokens, which may be pieces of a word.
    brief = memo.setdefault(None, {})
    new = [t for t in tokens if t not in memo]
    plain = [core(t) for t in new]
    for token, word, may in zip(new, plain, _readable(plain, pattern), strict=True):
        memo[token] = tuple(dict.fromkeys(f for w in channel.words_of(word, may) for x in features_of(w) if (f := wanted(x)) is not None))
        if len(word) <= SHORT:
            brief[token] = word
    given = [memo[t] for t in tokens]
    number = np.fromiter(map(len, given), np.int64, len(given))
    flat = np.fromiter((f for g in given for f in g), np.int64, int(number.sum()))
    at = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    per_word = number[index]
    rows = np.repeat(np.repeat(np.arange(len(column)), np.diff(bounds)), per_word)
    begin = np.repeat(at[index] - np.concatenate([[0], np.cumsum(per_word)[:-1]]) if len(index) else at[:0], per_word)
    found = flat[begin + np.arange(len(begin))]
    cores = [brief.get(t) for t in tokens]
    short = np.fromiter((c is not None for c in cores), bool, len(cores))
    runs = []
    for text, low, high in zip(*(x.tolist() for x in _neighbours(short, index, bounds)), strict=True):
        run = tuple(cores[k] for k in index[low:high].tolist() if cores[k])
        if len(run) >= 2:
            runs.append((text, run))
    fresh = [r for r in dict.fromkeys(r for _, r in runs) if r not in memo]
    for run, may in zip(fresh, _readable([" ".join(r) for r in fresh], pattern), strict=True):
        memo[run] = tuple(f for w in channel.joined(run, wanted) for x in features_of(w) if (f := wanted(x)) is not None) if may else ()
    more = [(text, f) for text, run in runs for f in memo[run]]
    if more:
        rows = np.concatenate([rows, [m[0] for m in more]])
        found = np.concatenate([found, [m[1] for m in more]])
    return rows, found, np.diff(bounds)


@dataclass
class Model:
    """A lexicon (feature to log odds) and the logistic model over a document's hits."""

    channel: Channel
    weights: dict[str, float]
    middle: np.ndarray
    scale: np.ndarray
    theta: np.ndarray

    def measures(self, column: pa.Array, memo: dict) -> np.ndarray:
        """Per text: sum and maximum of the log odds of its distinct lexicon features, their number, all hits, words."""
        if "" not in memo:
            memo[""] = ({f: k for k, f in enumerate(self.weights)}, reading(list(self.weights)))
        kept = memo[""]
        number, size, look = kept[0], max(1, len(kept[0])), np.array(list(self.weights.values()))
        rows, found, words = _hits(self.channel, column, number.get, memo, kept[1])
        memo[""] = kept
        out = np.zeros((len(column), 5))
        out[:, 3] = np.log1p(np.bincount(rows, minlength=len(column)))
        if len(rows):
            pairs = np.unique(rows * size + found)
            rows, odds = pairs // size, look[pairs % size]
            out[:, 0] = np.log1p(np.bincount(rows, odds, minlength=len(column)))
            np.maximum.at(out[:, 1], rows, odds)
            out[:, 2] = np.log1p(np.bincount(rows, minlength=len(column)))
        out[:, 4] = np.log1p(words)
        return out

    def score(self, measures: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(measures)), (measures - self.middle) / self.scale])
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.theta, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic model with a ridge penalty on all but the constant."""
    theta = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ theta)
        theta += step
        if np.abs(step).max() < 1e-6:
            break
    return theta


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, significance: float = 30.0) -> Model | float:
    """The model, or the share of toxic labels where one class is missing.

    `max_train_rows` labelled documents outside the held-out third are taken, those with the smallest hashes of their ids; of labels that
    contradict each other the larger counts. `significance` is the least log-likelihood ratio of a lexicon feature.
    """
    channel = Channel(*character_model(docs))
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = (
        named.groupBy(F.col("doc_id").cast("bigint").alias("id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(~held_out())
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train_rows)
    )
    own = texts(docs).join(F.broadcast(stored(chosen, "toxic-labels")), "id")
    sample = stored(own.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == total:
        return toxic / total if total else 0.5

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches):
            numbers: dict[str, int] = {}
            memo.clear()
            rows, found, _ = _hits(channel, batch.column(0), lambda x, known=numbers: known.setdefault(x, len(known)), memo)
            label, size = np.asarray(batch.column(1)).astype(np.int64), max(1, len(numbers))
            pairs = np.unique(rows * size + found)
            cells = np.bincount(2 * (pairs % size) + label[pairs // size], minlength=2 * len(numbers)).reshape(-1, 2)
            columns = [pa.array(list(numbers), pa.string()), pa.array(cells[:, 0]), pa.array(cells[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "clean", "toxic"])

    # By the features themselves: no two share a count.
    counts = sample.mapInArrow(count, "cell string, clean bigint, toxic bigint").groupBy("cell").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t")
    )
    base = toxic / total
    # More frequent among toxic documents than overall, beyond what chance gives; no more than the sample has features.
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (total - toxic + 1.0))
    share = F.col("t") / (F.col("t") + F.col("c"))
    ratio = 2 * (
        F.col("t") * F.log(F.greatest(share, F.lit(1e-9)) / base) + F.col("c") * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - base))
    )
    kept = counts.where((F.col("t") > 0) & (share >= 0.5) & (ratio >= significance)).select("cell", odds).collect()
    model = Model(channel, {r[0]: r[1] for r in kept}, np.zeros(5), np.ones(5), np.zeros(6))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches):
            found = model.measures(batch.column(0), memo)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    rows = sample.mapInArrow(measure, "x array<double>, toxic int").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    model.middle, model.scale = x.mean(0), x.std(0) + 1e-9
    model.theta = _logistic(np.column_stack([np.ones(len(x)), (x - model.middle) / model.scale]), y)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train_rows: int = 20_000) -> DataFrame:
    """id, text, held_out, score (0 to 1) and predicted (1 from `threshold` on) of every row."""
    rows = texts(docs)
    model = fit(docs, labels, max_train_rows)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for batch in slices(batches):
                found = model.score(model.measures(batch.column(1), memo))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["id", "text", "score"])

        scored = rows.mapInArrow(run, "id bigint, text string, score double")
    return scored.select("id", "text", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
