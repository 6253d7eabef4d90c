from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry

from tests.llm.conftest import EXTRA

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_lose_rows_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == columns, name
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and docs.count() == len(left)
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids


def test_stages_take_odd_rows(spark, docs, corpus):
    rows = docs(corpus)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, rows, SMALL)
        assert left.columns == rows.columns, name
        # Also columns whose names the stages use inside.
        assert {r[c] for r in left.collect() for c in EXTRA} == {"x"}, name
    kept = corpus_pipeline.near_duplicates(spark, rows, SMALL).collect()
    texts = [r["text"] for r in kept if r["text"] and r["text"].split()]
    assert len(texts) == len(set(texts))
    wordless = [t for _, t in corpus if not (t or "").split()]
    assert sum(not (r["text"] or "").split() for r in kept) == len(wordless)


def test_one_row_of_near_copies_with_equal_ids_stays(spark, docs):
    base = " ".join(f"w{k}" for k in range(120))
    near = [base.replace(f"w{k} ", "changed ") for k in (30, 60, 90)]
    other = " ".join(f"v{k}" for k in range(120))
    rows = docs([(None, base), (None, near[0]), (None, other), (None, None), (7, near[1]), (7, near[2]), (8, other + " x"), (8, "unlike any of them")])
    kept = corpus_pipeline.near_duplicates(spark, rows, SMALL).collect()
    texts = [r["text"] for r in kept]
    assert len(kept) == 4 and sum(t in (base, *near) for t in texts) == 1
    assert {(r["doc_id"], r["text"]) for r in kept} >= {(None, other), (None, None), (8, "unlike any of them")}
    same = docs([(7, near[1]), (7, near[2]), (7, near[2])])
    assert corpus_pipeline.near_duplicates(spark, same, SMALL).count() == 1


def test_empty_table_passes_through(spark, docs):
    rows = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, SMALL).count() == 0


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
