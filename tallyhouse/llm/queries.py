"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.byte_pairs import decode_documents, encode_documents
from tallyhouse.llm.collocations import collocations
from tallyhouse.llm.common import known_id
from tallyhouse.llm.decontaminate import contaminated
from tallyhouse.llm.fingerprints import edited_fingerprints
from tallyhouse.llm.hard_negatives import hard_negatives
from tallyhouse.llm.language import predict_language
from tallyhouse.llm.ngram_join import similar_components
from tallyhouse.llm.packing import pack_documents
from tallyhouse.llm.pii import span_digest
from tallyhouse.llm.suffix_dedup import remove_strings
from tallyhouse.llm.superkmers import remove_repeats
from tallyhouse.llm.toxicity import score_toxicity
from tallyhouse.llm.url_filter import ALLOW, BLOCK, Rule, filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the tokenizer's vocabulary lies; the library takes any path.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_language(_table(spark, sf_dir, "documents"))
    return found.select(known_id(), "held_out", "lang_pred", "score")


def op2_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select(known_id(), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)
    return placed.select(known_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# Fixed by the contract, in its order.
URL_RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op5_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(_table(spark, sf_dir, "documents"))
    return found.select(
        known_id(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select(known_id(), "held_out", "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(known_id(), "item_id", "score", "question_overlap", "answer_overlap", "start_word")


def op8_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_digest(_table(spark, sf_dir, "documents"))
    return found.select(known_id(), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_strings(_table(spark, sf_dir, "documents"))
    return left.select(known_id(), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_components(_table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select(known_id(), "n_shingles", known_id("component_id").alias("component_id"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, number = _table(spark, sf_dir, "embeddings"), F.col("vec_id")
    moved = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), number % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decode_documents(encode_documents(_table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return read.select(
        known_id(),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_superkmer_dedup": op2_superkmer_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_minhash_fingerprints": op5_minhash_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii_sanitise": op8_pii_sanitise,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}

SQL: dict[str, str] = {
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
            FROM documents),
        split AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        grams AS (SELECT lang, w[i:i + size - 1] AS p FROM places, range(1, 5) s(size) WHERE i + size - 1 <= len(w)),
        counts AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 30),
        cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counts WHERE len(p) > 1),
        scored AS (
            SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
            FROM cuts c JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN counts r ON r.lang = c.lang AND r.p = c.p[c.k + 1:len(c.p)]),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        inside AS (
            SELECT DISTINCT s.lang, o.p[i:i + len(s.p) - 1] AS p
            FROM counts o, range(1, 4) t(i), counts s
            WHERE len(o.p) > 2 AND s.lang = o.lang AND len(s.p) > 1 AND len(s.p) < len(o.p) AND i + len(s.p) - 1 <= len(o.p)
                AND s.p = o.p[i:i + len(s.p) - 1] AND 100 * o.f >= 80 * s.f),
        kept AS (
            SELECT w.lang, array_to_string(w.p, ' ') AS phrase, w.a, w.l, w.r, w.score
            FROM lowest w LEFT JOIN inside i ON i.lang = w.lang AND i.p = w.p WHERE i.p IS NULL)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
            k.phrase, k.a, k.l, k.r, t.n, k.score
        FROM kept k JOIN totals t ON t.lang = k.lang
        QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) <= 2000""",
    "op11_hard_negatives": """
        WITH taking_part AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
            FROM taking_part a JOIN taking_part r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
        positives AS (
            SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
            CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3""",
}
