from __future__ import annotations

import random

import pytest

#: Columns that clash with names the operators use inside.
EXTRA = ["id", "hash", "end", "kind", "bucket", "first", "last", "family", "score", "label", "_id", "piece", "_hash", "_spans", "_row"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture
def docs(spark):
    """A documents table with extra columns from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", None, *["x"] * len(EXTRA)) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def twins():
    """Two texts that differ in every place, but whose sums by powers of any odd base are equal modulo 2^64."""
    one, other = "a", "b"
    for _ in range(11):
        one, other = one + other, other + one
    return one, other


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, a shared passage, a periodic text, odd white space, nulls, repeated rows."""
    draw = random.Random(5)
    syllables = "ka lo mi ne pu ra so ti ve zu ärm öl".split()
    words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, base = prose(70), prose(160)
    texts = [prose(draw.randint(1, 120)) for _ in range(12)]
    texts += [base, base, base.upper(), prose(5) + "\n" + base, base + " " + prose(3)]
    for _ in range(5):
        changed = base.split()
        changed[draw.randrange(len(changed))] = prose(1)
        texts.append(" ".join(changed))
    texts += [prose(20) + " " + passage + "\t" + prose(20) for _ in range(4)]
    texts += ["la " * 300, "aaaa" * 100, "one", "two words", " ", " \t\n ", "", None, prose(3000), "日本 語 " * 80]
    draw.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (rows[7][0], rows[7][1]), (None, base), (None, "two words")]
