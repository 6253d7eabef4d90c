"""From documents to packed training sequences: toxic documents go, one of each group of near copies stays, contaminated documents go,
personal data is replaced, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. A row is known by its id and its text.
Documents without words are clean, have no copies and stay. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, broadcast_if_small, known_id, stored
from tallyhouse.llm.decontaminate import contaminated
from tallyhouse.llm.ngram_join import similar_components
from tallyhouse.llm.packing import pack_documents
from tallyhouse.llm.pii import sanitise
from tallyhouse.llm.queries import VOCABULARY
from tallyhouse.llm.toxicity import score_toxicity

#: No SQL: the stages fit models, search and pack.
ORACLE_SQL = None

KEYS = ["_id", "_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Every row whole in one column, so that no name of the user's is taken, with its id and the hash of its text."""
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_hash"),
    )


def _rows(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.select(*[F.col("_row")[c].alias(c) for c in columns])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose (id, hash) is not among those of `gone`."""
    rows = stored(gone.toDF(*KEYS).distinct(), "pipeline-gone")
    return _rows(_keyed(docs).join(broadcast_if_small(rows), KEYS, "left_anti"), docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the restored words mark as toxic (score 0.7 or more) go."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1").select("id", F.xxhash64("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, one row stays: that with the smallest id, and of texts
    with that id the one with the smallest hash. Ids may be null or repeat."""
    found = stored(similar_components(docs, size=5, percent=80).where("n_shingles > 0"), "pipeline-components")
    first = found.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("first"), F.count("*").alias("members"))
    first = stored(first.where("members > 1").select("root", "first"), "pipeline-first")
    row = F.struct("id", "hash")
    grouped = found.join(broadcast_if_small(first), "root")
    left = _without(docs, grouped.where(row != F.col("first")).select("id", "hash"))
    # Rows of one id and text are copies too: of those that repeat, one stays.
    again = grouped.where(row == F.col("first")).groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "hash")
    again = broadcast_if_small(stored(again.toDF(*KEYS), "pipeline-repeated"))
    one = _rows(_keyed(left).join(again, KEYS, "left_semi").dropDuplicates(KEYS), docs.columns)
    return _rows(_keyed(left).join(again, KEYS, "left_anti"), docs.columns).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("id", "hash"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced; every document stays."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in as few sequences as can be found."""
    placed = pack_documents(docs, VOCABULARY)
    return placed.select(known_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
