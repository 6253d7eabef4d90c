"""Joins on shingles, fingerprints and components, against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from tallyhouse.llm import common, fingerprints, graph, ngram_join
from tallyhouse.llm.common import NO_ID

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def classes(rows, size, percent):
    rows = [(NO_ID if i is None else i, t or "") for i, t in rows]
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min(least.get(label[k], i), i)
    return sorted((i, len(sets[k]), least[label[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 16384), (5, 80, 16384), (2, 80, 3)])
def test_components_of_similar_documents(docs, corpus, size, percent, block):
    found = ngram_join.similar_components(docs(corpus), size, percent, block)
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect())
    assert got == classes(corpus, size, percent)


def test_linked_sets_share_a_key():
    draw = np.random.default_rng(2)
    sizes = ngram_join.Sizes(80)
    for _ in range(2000):
        n = int(draw.integers(1, 60))
        common = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        a = np.unique(np.concatenate([common, draw.integers(0, 1 << 63, int(draw.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, draw.integers(0, 1 << 63, int(draw.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        if len(np.setxor1d(a, b)) and ngram_join.linked(a, b, 80):
            (keys, needed), (others, also) = ngram_join.block_keys(a, sizes), ngram_join.block_keys(b, sizes)
            shared = np.intersect1d(keys, others)
            most = {k: max(x, y) for k in shared.tolist() for x in needed[keys == k] for y in also[others == k]}
            assert any(list(most.values()).count(n) >= n for n in most.values())


def test_the_mark_of_a_hot_key_stays_in_any_order():
    rows = np.array([(5, 1, 3), (5, 1, 0), (5, 2, 3), (6, 1, 2), (6, 3, 4)], ngram_join._KEY)
    for order in ([0, 1, 2, 3, 4], [1, 0, 2, 3, 4], [4, 2, 0, 3, 1]):
        got, heads, many = ngram_join._groups(rows[order])
        assert got.tolist() == [(5, 1, 0), (5, 2, 3), (6, 1, 2), (6, 3, 4)]
        assert heads.tolist() == [0, 2] and many.tolist() == [True, False]


def test_copies_of_a_hot_head_in_other_slices(docs, monkeypatch):
    cut = ngram_join.slices
    monkeypatch.setattr(ngram_join, "slices", lambda batches, column="text", size=0: cut(batches, column, 30_000))
    base = [f"w{k}" for k in range(120)]
    copies = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(10, 34)]
    for before in (True, False):
        lone = [(500 + k, t) for k, t in enumerate(copies[:3])]
        rows = [*enumerate(copies)]
        rows = [*lone, *rows] if before else [*rows, *lone]
        found = ngram_join.similar_components(docs(rows).coalesce(1), 3, 90)
        got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect())
        assert got == classes(rows, 3, 90)


def test_a_common_passage_makes_no_family(docs, monkeypatch):
    """Unlike texts share blocks that are hot; before, each such block put all its sets into one family, whose sets all travel."""
    passage = [f"c{k}" for k in range(100)]
    own = lambda n: [*passage, *[f"u{n}x{k}" for k in range(200)]]
    near = lambda n, k: [*own(n)[:k], f"edit{k}", *own(n)[k + 1 :]]
    rows = [(n, " ".join(own(n))) for n in range(200)]
    rows += [(300 + k, " ".join(near(7, 110 + k))) for k in range(30)] + [(400, " ".join(near(9, 250)))]
    travelled, links = [], ngram_join._links

    def recorded(reps, *args):
        travelled.append({r["id"] for r in reps.select("id").collect()})
        return links(reps, *args)

    monkeypatch.setattr(ngram_join, "_links", recorded)
    expected = classes(rows, 5, 80)
    for block in (16384, 7):  # then also with more sets than may be sent
        found = ngram_join.similar_components(docs(rows), 5, 80, block)
        assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == expected
        assert travelled[-1] >= {7, 9, 400, *range(300, 330)} and len(travelled[-1]) < 100
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)


def test_sets_of_a_large_family_go_to_tasks_by_size(spark):
    sizes = [int(10 * 1.06**k) for k in range(120)] + [50] * 40
    named = spark.createDataFrame([(1, k, 7 * k, n, k, k) for k, n in enumerate(sizes)] + [(2, 500, 1, 9, 500, 500)], "family bigint, a bigint, b bigint, n bigint, id bigint, hash bigint")
    dealt = {r["id"]: r for r in ngram_join._dealt(named, 80, 10).collect()}
    assert dealt[500]["tasks"] == [0] and len(dealt) == 161
    blocks = {k: dealt[k]["block"] for k in range(160)}
    assert max(list(blocks.values()).count(b) for b in set(blocks.values())) <= 20 and len(set(blocks.values())) > 10
    for x in range(160):
        for y in range(x):
            if 100 * min(sizes[x], sizes[y]) >= 80 * max(sizes[x], sizes[y]):
                low, high = sorted((blocks[x], blocks[y]))
                assert low << 32 | high in dealt[x]["tasks"] and low << 32 | high in dealt[y]["tasks"]
    assert sum(len(r["tasks"]) for r in dealt.values()) < 161 * 8  # all 16 before


def test_no_documents(docs):
    assert ngram_join.similar_components(docs([])).count() == 0
    assert fingerprints.edited_fingerprints(docs([])).count() == 0


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(90, 91), (92, 91), (95, 95)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {91: 90, 92: 90}


def test_edited_fingerprints(docs, corpus):
    rows = sorted({(i, t or "") for i, t in corpus if i is not None})
    got = {r["id"]: r for r in fingerprints.edited_fingerprints(docs(rows)).collect()}
    marks = {i: r["fingerprint"] for i, r in got.items()}
    for (i, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, marks[i]) == marks[i]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def test_all_rows_get_a_fingerprint(docs, corpus):
    found = fingerprints.edited_fingerprints(docs(corpus)).collect()
    assert sorted(r["id"] for r in found) == sorted(NO_ID if i is None else i for i, _ in corpus)
    one = fingerprints.edited_fingerprints(docs([(4, "a single text of some words")])).collect()
    assert one[0]["near_next"] == 1.0


def test_likeness_estimates_jaccard(docs, corpus):
    import pyarrow as pa

    rows = [t for _, t in corpus if t and len(t.split()) > 20][:14]
    signs = fingerprints.signatures(pa.array(rows))
    sets = [frozenset(tuple(WORD.findall(t)[k : k + 5]) for k in range(len(WORD.findall(t)) - 4)) for t in rows]
    for a in range(len(rows)):
        for b in range(a):
            true = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert abs((signs[a] == signs[b]).mean() - true) < 0.2


@pytest.mark.parametrize("block", [4096, 3])
def test_near_copies_beside_a_dissimilar_head_are_linked(docs, block):
    base = [f"w{k}" for k in range(100)]
    text = lambda *at: " ".join("x" + str(k) if k in at else w for k, w in enumerate(base))
    # All but the head differ from it in the same places and from each other in one word.
    rows = [(1, text()), *[(10 + k, text(5, 20, 35, *([50 + k] if k else []))) for k in range(8)], (90, " ".join(f"v{k}" for k in range(100)))]
    found = fingerprints.near_copies(docs(rows), 0.8, 1, 1, block=block).collect()  # one band, which all but the last share
    sets = {i: shingles(t, 5) for i, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert (10, 11) in alike and not any(a == 1 for a, _ in alike)
    pairs = {(r["head"], r["id"]) for r in found}

    def groups(edges):
        label = {i: i for i in sets}
        for a, b in edges:
            label = {i: label[a] if x == label[b] else x for i, x in label.items()}
        return {frozenset(i for i in sets if label[i] == x) for x in label.values()}

    assert pairs <= alike and len(found) == len(pairs) and groups(pairs) == groups(alike)


def test_near_copies_are_verified(docs):
    base = " ".join(f"w{k}" for k in range(200))
    near, other = base.replace("w100 ", "changed "), " ".join(f"v{k}" for k in range(200))
    found = fingerprints.near_copies(docs([(1, base), (2, near), (3, other), (4, base), (5, None)])).collect()
    assert [(r["head"], r["id"]) for r in found] == [(1, 2)] and 0.9 < found[0]["jaccard"] < 1


def test_words_made_to_collide_link_nothing(docs, twins):
    common = " ".join(f"w{k}" for k in range(12))
    rows = [(1, twins[0]), (2, twins[1]), (3, f"{common} {twins[0]}"), (4, f"{common} {twins[1]}"), (5, f"{common} {twins[1]}")]
    found = {r["id"]: r["component_id"] for r in ngram_join.similar_components(docs(rows), size=3, percent=90).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    prints = {r["id"]: r["fingerprint"] for r in fingerprints.edited_fingerprints(docs(rows[:2])).collect()}
    assert prints[1] != prints[2]
