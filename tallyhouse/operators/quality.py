"""Identity checks: one name with several birth dates, and full names that look alike.

The reports these stand for are known by name, parameters and use only; what exactly they compute is our reading.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import clamp_limit, is_blank
from tallyhouse.operators.skew import spread_join
from tallyhouse.session import checkpointed

# Letters whose sound code is that of the letter below them.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOOUUUUY"


#: The ratios at which the most similar names are sought before the one that was asked for.
STEPS = (0.95, 0.85, 0.7, 0.5)


def name_key(c: Column) -> Column:
    """A name as it is compared: trimmed, lower case."""
    return F.lower(F.trim(c))


def sound_key(c: Column) -> Column:
    """Soundex (four characters) with accents folded, so that `Núñez` and `Nunez` sound alike."""
    return F.soundex(F.translate(F.upper(F.trim(c)), ACCENTED, UNACCENTED))


def multi_dob_people(person: DataFrame) -> DataFrame:
    """All persons whose full name is on record with more than one birth date, with the number of dates."""
    named = (
        person.filter(~is_blank(F.col("first_name")) & ~is_blank(F.col("last_name")))
        .withColumn("_first", name_key(F.col("first_name")))
        .withColumn("_last", name_key(F.col("last_name")))
    )
    # Spark counts distinct dates in two steps, (name, date) first, so a very common name is not one task's work.
    names = (
        named.groupBy("_first", "_last").agg(F.count_distinct("dob").alias("dob_count")).filter(F.col("dob_count") > 1)
    )
    return spread_join(named, names, ["_first", "_last"]).select(*person.columns, "dob_count")


def multi_dob_names(person: DataFrame, limit: object = None) -> DataFrame:
    """The first `limit` (200 if not given, at most 2000) of `multi_dob_people`, by name, date and id."""
    return (
        multi_dob_people(person)
        .orderBy(name_key(F.col("last_name")), name_key(F.col("first_name")), "dob", "person_id")
        .limit(clamp_limit(200 if limit is None else limit))
    )


def _with_piece(names: DataFrame, name: str, ratio: float, shorter: bool, key: str) -> DataFrame:
    """One row a `key` of the name; two names whose ratio reaches `ratio` share one, if one is keyed as the shorter.

    Names of one length take either role. If the longer of two names has g characters they may differ by k = floor((1 - ratio) * g)
    edits. Cut the shorter name into k + 1 pieces: k edits cannot touch them all, so one piece stands in the longer name as it is, and
    near its old place. A key is made of the two lengths, the number of the piece and its text. The shorter name writes one key a
    piece and possible partner length; the longer one a key for every place where the piece may stand. (Pass-Join, Li et al., VLDB
    2011, with its position bounds.) A name of no more than k characters would have empty pieces, which stand everywhere: there the two
    lengths alone are the key. Complete for every ratio above 0; at 0 all names are alike and share one key.
    """
    if ratio <= 0:
        return names.withColumn(key, F.lit(0).cast("bigint"))
    n = F.char_length(F.col(name))
    if shorter:
        low, high = n, F.greatest(n, F.floor(n / F.lit(ratio) + 1e-9).cast("int"))
        s, g = n, F.col("_other")
    else:
        low, high = F.greatest(F.lit(1), F.ceil(n * F.lit(ratio) - 1e-9).cast("int")), n
        s, g = F.col("_other"), n
    k, i, size, start = F.col("_k"), F.col("_i"), F.col("_size"), F.col("_start")
    # The last (s mod (k + 1)) pieces are one character longer than the others.
    plain = k + 1 - s % (k + 1)
    base = F.floor(s / (k + 1)).cast("int")
    by_length = F.array(F.lit(-1))
    pieces = (
        names.withColumn("_other", F.explode(F.sequence(low, high)))
        .withColumn("_k", F.greatest(F.lit(0), F.floor(F.lit(1 - ratio) * g + 1e-9).cast("int")))
        .withColumn("_i", F.explode(F.when(k + 1 > s, by_length).otherwise(F.sequence(F.lit(0), k))))
        .withColumn("_start", F.greatest(F.lit(0), i * base + F.greatest(F.lit(0), i - plain)))
        .withColumn("_size", F.when(i < 0, 0).otherwise(base + F.when(i >= plain, 1).otherwise(0)))
    )
    place = start
    if not shorter:
        shift = g - s
        left = F.greatest(F.lit(0), start - i, start + shift - (k - i))
        right = F.least(n - size, start + i, start + shift + (k - i))
        places = F.when(i < 0, F.array(F.lit(0))).when(left <= right, F.sequence(left, F.greatest(left, right)))
        pieces = pieces.withColumn("_place", F.explode(places))
        place = F.col("_place")
    text = F.substring(F.col(name), place + 1, size)
    # A hash will do as the key: names that meet by accident are told apart by the comparison that follows.
    return pieces.select(*names.columns, F.xxhash64(s, g, i, text).alias(key))


def _ratio(a: str, b: str) -> Column:
    return 1 - F.levenshtein(F.col(a), F.col(b)) / F.greatest(F.char_length(F.col(a)), F.char_length(F.col(b)))


def similar_name_pairs(
    person: DataFrame, min_first: float, min_last: float, same_dob: bool = True, use_soundex: bool = True
) -> DataFrame:
    """All pairs of full names that are alike, with the persons behind them.

    Ratio = 1 - edit distance / length of the longer name, on trimmed lower-case names; first and last name must reach their
    own minimum. `same_dob` asks for equal birth dates, `use_soundex` for equal sound of both names ("preference" in the
    existing screen may mean less than the filter we make of it).

    Persons are first put together by name (and date): a pair of names stands for `person_pairs` pairs of persons, and a name
    that several persons share makes one row with itself. So a name with many bearers adds no more work than a rare one. Names
    then meet only over a common piece of the first and of the last name (see `_piece_keys`), never all within a block.
    """
    names, met = name_candidates(person, min_first, min_last, same_dob, use_soundex)
    exact = ["dob"] if same_dob else []
    pairs = (
        met.withColumn("ratio_first", _ratio("first_a", "first_b"))
        .withColumn("ratio_last", _ratio("last_a", "last_b"))
        .filter((F.col("ratio_first") >= min_first) & (F.col("ratio_last") >= min_last))
    )
    across = pairs.select(
        *exact,
        F.col("first_a").alias("first_name_a"),
        F.col("last_a").alias("last_name_a"),
        F.col("first_b").alias("first_name_b"),
        F.col("last_b").alias("last_name_b"),
        F.col("low_id_a").alias("person_id_a"),
        F.col("low_id_b").alias("person_id_b"),
        (F.col("n_a") * F.col("n_b")).alias("person_pairs"),
        "ratio_first",
        "ratio_last",
    )
    same = names.filter(F.col("n") > 1).select(
        *exact,
        F.col("first").alias("first_name_a"),
        F.col("last").alias("last_name_a"),
        F.col("first").alias("first_name_b"),
        F.col("last").alias("last_name_b"),
        F.col("low_id").alias("person_id_a"),
        F.col("high_id").alias("person_id_b"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("person_pairs"),
        F.lit(1.0).alias("ratio_first"),
        F.lit(1.0).alias("ratio_last"),
    )
    if min_first > 1 or min_last > 1:
        return across.limit(0)
    return across.unionByName(same)


def name_candidates(
    person: DataFrame, min_first: float, min_last: float, same_dob: bool, use_soundex: bool
) -> tuple[DataFrame, DataFrame]:
    """The different names, and the pairs of them that must be compared: each once, its names in order."""
    if not (math.isfinite(min_first) and math.isfinite(min_last)):
        raise ValueError("minimum ratios must be finite numbers")
    if max(min_first, min_last) <= 0 and not (same_dob or use_soundex):
        raise ValueError("every name is alike: give a minimum ratio, or ask for equal dates or sound")
    exact = ["dob"] if same_dob else []
    named = person.filter(~is_blank(F.col("first_name")) & ~is_blank(F.col("last_name")))
    if same_dob:
        named = named.filter(F.col("dob").isNotNull())
    names = (
        named.select(
            name_key(F.col("first_name")).alias("first"), name_key(F.col("last_name")).alias("last"), *exact, "person_id"
        )
        .groupBy("first", "last", *exact)
        .agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("low_id"), F.max("person_id").alias("high_id"))
    )
    if use_soundex:
        names = names.withColumn("_sf", sound_key(F.col("first"))).withColumn("_sl", sound_key(F.col("last")))
    equal = [*exact, *(["_sf", "_sl"] if use_soundex else [])]

    # Keys on both names would multiply; the other name is held to the band of lengths that its minimum leaves.
    keyed, other, ratio, band = ("last", "first", min_last, min_first) if min_last >= min_first else ("first", "last", min_first, min_last)

    def side(suffix: str, shorter: bool) -> DataFrame:
        found = _with_piece(names, keyed, ratio, shorter, "_piece")
        named_apart = [F.col(c).alias(c + suffix) for c in ("first", "last", "n", "low_id")]
        # Size estimates know nothing of the exploded keys and would take a side for small enough to broadcast.
        return found.select(F.xxhash64(*equal, "_piece").alias("_key"), *equal, *named_apart).hint("merge")

    # Both sides are plain shuffles, so AQE can split a key that many different names share.
    lengths = [F.char_length(F.col(other + x)) for x in ("_a", "_b")]
    met = side("_a", True).join(side("_b", False), ["_key", *equal]).filter(
        ((F.col("first_a") != F.col("first_b")) | (F.col("last_a") != F.col("last_b")))
        & (F.least(*lengths) >= F.greatest(*lengths) * F.lit(float(band)) - 1e-9)
    )
    in_order = F.struct("last_a", "first_a") < F.struct("last_b", "first_b")

    def ordered(a: str, b: str, name: str) -> Column:
        return F.when(in_order, F.col(a)).otherwise(F.col(b)).alias(name)

    pairs = met.select(
        *exact,
        *[ordered(f"{c}_{x}", f"{c}_{y}", f"{c}_{x}") for c in ("first", "last", "n", "low_id") for x, y in ("ab", "ba")],
    )
    return names, pairs.dropDuplicates([*exact, "first_a", "last_a", "first_b", "last_b"])


def similar_full_names(
    person: DataFrame,
    min_first: float = 0.9,
    min_last: float = 0.9,
    same_dob: bool = True,
    use_soundex: bool = True,
    limit: object = 500,
) -> DataFrame:
    """The `limit` (at most 2000) most similar pairs of `similar_name_pairs`, by the sum of both ratios.

    Names that are nearly equal are cheap to find, so the ratio is lowered step by step. No ratio is above 1, so a pair whose ratios sum
    up to at least 1 + r has both at r or above: where a step with minimum r finds `limit` pairs of such a sum, no other pair can be
    among the first. Only where it does not are names compared at the next lower ratio. Each step runs when this is called; what
    it keeps is `limit` rows.
    """
    least, number = min(float(min_first), float(min_last)), clamp_limit(limit, 500)
    score = F.col("ratio_first") + F.col("ratio_last")
    order = [F.desc(score), "last_name_a", "first_name_a", "last_name_b", "first_name_b", *(["dob"] if same_dob else [])]
    for ratio in STEPS:
        if not least < ratio:
            break
        # A little below the bound, which floating point may miss.
        firsts = [max(float(m), ratio - 1e-9) for m in (min_first, min_last)]
        pairs = similar_name_pairs(person, *firsts, same_dob, use_soundex).filter(score >= 1 + ratio)
        best = checkpointed(pairs.orderBy(*order).limit(number))
        if best.count() == number:
            return best.orderBy(*order)
    pairs = similar_name_pairs(person, float(min_first), float(min_last), same_dob, use_soundex)
    return pairs.orderBy(*order).limit(number)
