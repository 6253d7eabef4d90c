"""Personal data by fixed patterns, and the terms that give it away; built-in column functions only.

Base spans are the matches of four patterns that pass their check. Information-theoretic sanitisation adds terms: for every base span
the words of the passage around it (`CONTEXT_WORDS` on either side, whatever lines they stand on) are counted with the entity it holds,
and over all texts. A term discloses an entity by log2(P(entity | term) / P(entity)) bits; a term that lies beside one entity in enough
different contexts, in most of its own occurrences in the corpus and by enough bits is a span wherever it occurs, also in texts without
the entity. A term that stands for its entity almost always is removed, else it is generalised to the kind of the entity.

Positions are code points. They come from the lengths of what lies between the matches, added up by a window over a document's
matches, so no step takes more than n log n for n matches.

Defined cases. A null text is an empty one: no spans. Rows may repeat and get equal results; spans of equal rows count once, occurrences in the corpus each time.
Overlapping spans of different kinds are all reported; in the sanitised text what they cover together is replaced once, under the kind
of the first. An empty table gives no rows. The patterns cannot overflow the stack or go quadratic, whatever the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, WORD_BREAK, broadcast_if_small, stored

# Fixed by the contract: kinds in order. The patterns are written so that they match the same without backtracking: a match starts where
# a run of its first class starts, or where the last match ended.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ \-]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}
CONTEXT_CHARS, CONTEXT_WORDS = 240, 15
_EDGES = r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$"


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as disclosing: different contexts beside one entity, share of its occurrences there, bits."""

    contexts: int = 3
    share: float = 0.5
    bits: float = 4.0
    removed_share: float = 0.9
    #: More candidate terms than this are joined by a shuffle instead of a broadcast.
    broadcast_terms: int = 50_000


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    number = F.length(digits)
    parts = F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", parts)
        .when(kind == "card", F.when(number.between(16, 19), F.call_function("luhn_check", digits)).otherwise(False))
        .otherwise(number.between(8, 15))
    )


def _may_hold(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.instr(text, "@") > 0
    if kind == "phone":
        return F.instr(text, "+") > 0
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][ \-]?[0-9]")


def rows_of(docs: DataFrame) -> DataFrame:
    """id, hash of the text, text: what a row is known by."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """id, hash, kind, start, end, hit, left, right: valid matches, with the text beside them."""
    nothing = F.array().cast("array<string>")
    pairs = rows
    for kind in KINDS:
        may = _may_hold(kind, F.col("text"))
        pairs = pairs.withColumn(f"_m_{kind}", F.when(may, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(nothing))
    for kind in KINDS:
        pairs = pairs.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("text", PATTERNS[kind], -1)).otherwise(nothing))
    some = F.size("_m_email") + F.size("_m_ip") + F.size("_m_card") + F.size("_m_phone") > 0
    every = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"_m_{k}").alias("m"), F.col(f"_g_{k}").alias("g")) for k in KINDS]
    )
    each = pairs.where(some).select("id", "hash", F.explode(every).alias("x")).where(F.size("x.m") > 0)
    each = each.select("id", "hash", F.col("x.kind").alias("kind"), F.col("x.m").alias("m"), F.col("x.g").alias("g"))
    each = each.select("id", "hash", "kind", F.posexplode(F.arrays_zip("m", "g", F.slice("g", 2, F.size("g")).alias("n"))))
    narrow = each.where(F.col("col.m").isNotNull()).select(
        "id",
        "hash",
        "kind",
        F.col("pos"),
        F.col("col.m").alias("hit"),
        F.length("col.g").alias("gap"),
        F.length("col.m").alias("size"),
        F.right("col.g", F.lit(CONTEXT_CHARS)).alias("left"),
        F.left("col.n", F.lit(CONTEXT_CHARS)).alias("right"),
        (F.length("col.n") > CONTEXT_CHARS).alias("more"),
    )
    narrow = narrow.dropDuplicates(["id", "hash", "kind", "pos"])
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("id", "hash", "kind").orderBy("pos"))
    placed = narrow.withColumn("end", end).where(_valid(F.col("kind"), F.col("hit")))
    return placed.select(
        "id",
        "hash",
        "kind",
        (F.col("end") - F.col("size")).alias("start"),
        "end",
        "hit",
        "left",
        "right",
        (F.length("left") < F.col("gap")).alias("_cut_left"),
        F.col("more").alias("_cut_right"),
    )


def _words(text: Column, keep_last: bool, cut: Column) -> Column:
    """(word, where it begins) of the words nearest to the span; a word cut off at the context's far end is left out."""
    parts = F.split(text, r"[\x20\x09-\x0D]")
    placed = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(
            F.element_at(parts, i).alias("word"),
            F.aggregate(F.slice(parts, 1, i - 1), F.lit(0), lambda acc, p: acc + F.length(p) + 1).alias("at"),
        ),
    )
    whole = F.filter(placed, lambda p: ~(cut & (p["at"] == 0))) if keep_last else F.filter(
        placed, lambda p: ~(cut & (p["at"] + F.length(p["word"]) == F.length(text)))
    )
    words = F.filter(whole, lambda p: p["word"] != "")
    if keep_last:
        return F.slice(words, F.greatest(F.size(words) - CONTEXT_WORDS + 1, F.lit(1)), CONTEXT_WORDS)
    return F.slice(words, 1, CONTEXT_WORDS)


def _term(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, _EDGES, ""))


def beside(spans: DataFrame) -> DataFrame:
    """One row a word beside a base span: id, hash, kind, entity, term, start, end, context (a hash of the text around)."""
    base = spans.select(
        "id",
        "hash",
        "kind",
        F.lower("hit").alias("entity"),
        F.xxhash64("left", "right").alias("context"),
        F.concat(
            F.transform(
                _words(F.col("left"), True, F.col("_cut_left")),
                lambda w: F.struct(w["word"].alias("word"), (F.col("start") - F.length("left") + w["at"]).alias("at")),
            ),
            F.transform(
                _words(F.col("right"), False, F.col("_cut_right")),
                lambda w: F.struct(w["word"].alias("word"), (F.col("end") + w["at"]).alias("at")),
            ),
        ).alias("words"),
    )
    each = base.select("id", "hash", "kind", "entity", "context", F.explode("words").alias("w"))
    lead = F.length("w.word") - F.length(F.regexp_replace("w.word", r"^[^\p{L}\p{N}]++", ""))
    each = each.select(
        "id", "hash", "kind", "entity", "context", _term(F.col("w.word")).alias("term"), (F.col("w.at") + lead).cast("bigint").alias("start")
    )
    each = each.where(F.col("term").rlike(r"\p{L}") & (F.length("term") >= 3) & (F.instr("term", "@") == 0))
    return each.withColumn("end", F.col("start") + F.length("term"))


def disclosing_terms(rows: DataFrame, near: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """term, kind, entity, bits, share: terms above the thresholds. Occurrences of a term are counted over all rows."""
    own = near.select("id", "hash", "kind", "entity", "context", "term", "start").distinct()
    pairs = own.groupBy("term", "kind", "entity").agg(F.count("*").alias("both"))
    likely = pairs.where(F.col("both") >= limits.contexts)
    exact = (
        own.select("term", "kind", "entity", "context").distinct().groupBy("term", "kind", "entity").agg(F.count("*").alias("contexts"))
    )
    candidates = stored(likely.join(exact, ["term", "kind", "entity"]).where(F.col("contexts") >= limits.contexts), "pii-candidates")
    terms = candidates.select("term").distinct()
    if terms.count() <= limits.broadcast_terms:
        terms = F.broadcast(terms)
    occurrences = (
        rows.select(F.explode(F.split("text", WORD_BREAK)).alias("word"))
        .select(_term(F.col("word")).alias("term"))
        .join(terms, "term")
        .groupBy("term")
        .agg(F.count("*").alias("all"))
    )
    entities = own.select("id", "hash", "kind", "entity", "context").groupBy("kind", "entity").agg(F.count("*").alias("of_entity"))
    of_all = entities.agg(F.sum("of_entity")).first()[0] or 1
    judged = (
        candidates.join(occurrences, "term")
        .join(entities, ["kind", "entity"])
        .withColumn("share", F.col("both") / F.greatest("all", "both"))
        .withColumn("bits", F.log2(F.col("share") / (F.col("of_entity") / F.lit(of_all))))
    )
    return judged.where((F.col("share") >= limits.share) & (F.col("bits") >= limits.bits)).select("term", "kind", "entity", "bits", "share")


def occurrences_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """id, hash, start, end and the columns of `terms` (one row a term) for every word of all texts that is such a term.

    Places are sums of lengths over the words of the texts that hold a term; only those texts' words travel.
    """
    word = rows.select("id", "hash", F.explode(F.array_distinct(F.split("text", WORD_BREAK))).alias("word"))
    keys = word.select("id", "hash", _term(F.col("word")).alias("term")).join(terms.select("term"), "term", "left_semi")
    keys = stored(keys.select("id", "hash").distinct(), "pii-disclosed")
    held = rows.join(broadcast_if_small(keys), ["id", "hash"])
    each = held.select("id", "hash", F.posexplode(F.split("text", r"[\x20\x09-\x0D]", -1)).alias("pos", "word"))
    each = each.repartition("id", "hash").dropDuplicates(["id", "hash", "pos"])  # rows may repeat
    before = Window.partitionBy("id", "hash").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("at", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)))
    lead = F.length("word") - F.length(F.regexp_replace("word", r"^[^\p{L}\p{N}]++", ""))
    placed = placed.select(
        "id", "hash", (F.col("at") + lead).alias("start"), F.length(F.regexp_replace("word", _EDGES, "")).alias("_size"), _term(F.col("word")).alias("term")
    )
    return placed.join(terms, "term").withColumn("end", F.col("start") + F.col("_size")).drop("_size")


def term_spans(rows: DataFrame, near: DataFrame, terms: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """id, hash, kind (`term`), start, end, mark: the disclosing words, all occurrences in all texts."""
    mark = F.when(F.col("share") >= limits.removed_share, F.lit("")).otherwise(F.concat(F.lit("[NEAR "), F.upper("kind"), F.lit("]")))
    marks = stored(terms.groupBy("term").agg(F.min(mark).alias("mark")), "pii-marks")
    everywhere = occurrences_of(rows, broadcast_if_small(marks, limits.broadcast_terms)).select("id", "hash", "start", "end", "mark")
    # Beside an entity a word may be cut by the entity itself; elsewhere words are whole.
    beside_own = near.join(terms, ["term", "kind", "entity"]).select("id", "hash", "start", "end", mark.alias("mark"))
    return everywhere.unionByName(beside_own).groupBy("id", "hash", "start", "end").agg(F.min("mark").alias("mark")).select(
        "id", "hash", F.lit(TERM).alias("kind"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), "mark"
    )


def find_spans(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """id, hash, kind, start, end, mark (what takes the span's place): base spans and disclosing terms."""
    rows = rows_of(docs)
    base = stored(base_spans(rows), "pii-spans")
    near = stored(beside(base), "pii-beside")
    terms = stored(disclosing_terms(rows, near, limits), "pii-disclosing")
    marked = base.select(
        "id",
        "hash",
        "kind",
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
        F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("mark"),
    )
    return marked.unionByName(term_spans(rows, near, terms, limits))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), kind)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    found = find_spans(docs, limits)
    entry = F.struct(_order(F.col("kind")).alias("order"), "start", "end", "kind")
    lists = found.groupBy("id", "hash").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    rows = rows_of(docs).drop("text").join(lists, ["id", "hash"], "left")
    every = F.coalesce("all", F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string>>"))
    rows = rows.select("id", every.alias("all"))

    def number(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return rows.select(
        "id",
        *[number(k) for k in KINDS],
        F.sha2(_joined(F.filter("all", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
    )


def sanitise(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """The rows of `docs`, all columns, with personal data and disclosing terms replaced in `text`; other rows stay as they are."""
    found = find_spans(docs, limits)
    # What spans cover together is replaced once.
    row = Window.partitionBy("id", "hash").orderBy("start", "end", _order(F.col("kind")))
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(row))
    merged = runs.groupBy("id", "hash", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("mark", F.struct("start", "end")).alias("mark")
    )
    lists = merged.groupBy("id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "mark"))).alias("_spans"))
    # The whole row travels in one column, so that no name of the user's is taken.
    columns = docs.columns
    keyed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"),
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_hash"),
    )
    text = F.col("_row")["text"]
    both = keyed.join(lists.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "_spans"), ["_id", "_hash"], "left")
    parts = F.transform(
        F.sequence(F.lit(1), F.size("_spans")),
        lambda i: F.concat(
            F.substring(
                text,
                F.when(i == 1, F.lit(1)).otherwise(F.try_element_at("_spans", F.greatest(i - 1, F.lit(1)))["end"].cast("int") + 1),
                F.element_at("_spans", i)["start"].cast("int")
                - F.when(i == 1, F.lit(0)).otherwise(F.try_element_at("_spans", F.greatest(i - 1, F.lit(1)))["end"].cast("int")),
            ),
            F.element_at("_spans", i)["mark"],
        ),
    )
    rest = F.substr(text, F.element_at("_spans", -1)["end"].cast("int") + 1)
    changed = F.when(F.col("_spans").isNull(), text).otherwise(F.concat(F.concat_ws("", parts), rest))
    return both.select(*[changed.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns])
