"""URL filter: fixed rules first, gradient-boosted trees on lexical features for what no rule decides.

The rules label the urls they fit; the trees learn from those labels and judge the rest. Features are computed by column functions:
lengths, depth, digit ratio, entropy of the characters, parameter counts, labels of the host, and for the last one, two and three
labels of the host the share of blocked urls among the labelled ones.

Defined cases. A null url counts as empty: host and path are empty, no rule fits, the trees judge it. Rows may repeat; each is judged
alone. Without any labelled url everything undecided is allowed; with labels of one class only, that class is the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import broadcast_if_small, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null or a text without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*+)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column, give) -> Column:
    """`give(rule)` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        found = F.when(rule.fits(host, path), F.lit(give(rule))).otherwise(found)
    return found


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))).cast("double")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    length = F.length(url).cast("double")
    digits = length - F.length(F.regexp_replace(url, "[0-9]", ""))
    shares = F.transform(
        F.array_distinct(F.split(url, "")), lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / F.greatest(length, F.lit(1.0))
    )
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return {
        "url_length": length,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"),
        "digit_ratio": digits / F.greatest(length, F.lit(1.0)),
        "entropy": entropy,
        "parameters": _count(url, "="),
        "ampersands": _count(url, "&"),
        "hyphens": _count(host, "-"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "has_fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"),
    }


def host_suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


SUFFIXES = (1, 2, 3)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], max_train_rows: int = 20_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """page_id, url, host, path, rule (text of the rule that decided, or null), verdict, block_score (null where a rule decided).

    The trees are fitted on at most `max_train_rows` different urls that a rule decides: of each verdict those with the smallest hashes, as
    many as its share of the different urls, but a tenth of the sample at least where there are so many. The suffix table counts all rows
    that a rule decides; it is broadcast only after a count finds it small.
    """
    rows = pages.select("page_id", F.col("url").alias("url"), F.coalesce("url", F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path})
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumns(
        {"rule": longest_rule(rules, host, path, lambda r: r.text), "_said": longest_rule(rules, host, path, lambda r: r.verdict)}
    )
    labelled = rows.where(F.col("_said").isNotNull()).select("_url", "host", "path", (F.col("_said") == BLOCK).cast("double").alias("label"))
    different = stored(labelled.distinct(), "url-labelled")
    classes = {r[0]: r[1] for r in different.groupBy("label").count().collect()}
    columns = ["page_id", "url", "host", "path", "rule"]
    if len(classes) < 2:
        only = BLOCK if list(classes) == [1.0] else ALLOW
        return rows.select(*columns, F.coalesce("_said", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))

    few, many = sorted(classes, key=lambda c: (classes[c], c))
    least = min(classes[few], max(1, max_train_rows // 10, max_train_rows * classes[few] // sum(classes.values())))
    chosen = [
        different.where(F.col("label") == c).orderBy(F.xxhash64("_url"), "_url").limit(n) for c, n in ((few, least), (many, max_train_rows - least))
    ]
    sample = stored(chosen[0].unionByName(chosen[1]), "url-sample")
    base = labelled.agg(F.avg("label")).first()[0]
    known = (
        labelled.select("label", F.explode(F.array_distinct(F.array(*[host_suffix(F.col("host"), n) for n in SUFFIXES]))).alias("suffix"))
        .groupBy("suffix")
        .agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    )
    table = stored(known.select("suffix", ((F.col("blocked") + 2 * base) / (F.col("n") + 2)).alias("share")), "url-suffixes")
    table = broadcast_if_small(table)

    def with_features(df: DataFrame) -> DataFrame:
        df = df.withColumns(lexical_features(F.col("_url"), F.col("host"), F.col("path")))
        for n in SUFFIXES:
            one = table.select(F.col("suffix").alias(f"_suffix{n}"), F.col("share").alias(f"_share{n}"))
            df = df.withColumn(f"_suffix{n}", host_suffix(F.col("host"), n)).join(one, f"_suffix{n}", "left")
            df = df.withColumn(f"suffix_share{n}", F.coalesce(f"_share{n}", F.lit(base)))
        names = [*lexical_features(F.col("_url"), F.col("host"), F.col("path")), *[f"suffix_share{n}" for n in SUFFIXES]]
        return VectorAssembler(inputCols=names, outputCol="features").transform(df)

    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=11, subsamplingRate=1.0, maxBins=64).fit(
        with_features(sample).select("features", "label")
    )
    undecided = fitted.transform(with_features(rows.where(F.col("_said").isNull())))
    judged = undecided.select(
        *columns,
        F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW).alias("verdict"),
        vector_to_array("probability")[1].alias("block_score"),
    )
    decided = rows.where(F.col("_said").isNotNull())
    return decided.select(*columns, F.col("_said").alias("verdict"), F.lit(None).cast("double").alias("block_score")).unionByName(judged)
