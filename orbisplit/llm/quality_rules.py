"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose bit i is set
when rule i failed; policies (named, versioned sets of rules) and ablations are then bit arithmetic on that
long, so changing a policy never reads a text again. Only built-in expressions are used and nothing is
shuffled but the histogram of bit patterns.

Defined cases: a null or blank text has no words (it fails ``few_words``); a null ``doc_id`` is carried
through; a text of any length is measured whole; repeated rows give repeated ledger rows; an empty table gives an empty ledger; further columns of the
input are ignored by ``ledger`` and kept by ``keep``. Two different 8-word windows of one text count as equal
only if their 64-bit hashes collide.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import BREAK, free_name, words

#: Words in a window of the repetition rule.
WINDOW = 8
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``failed(measurement columns)`` is true."""

    name: str
    failed: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept if none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]


#: The position of a rule is its bit, so new rules are only ever appended.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") >= 3) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
    Rule("adjacent_repeats", lambda m: 10 * m("n_adjacent_repeats") > 2 * m("n_words")),
    Rule("upper_case", lambda m: 2 * m("n_upper") > m("word_chars")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 16 * m("n_words"))),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
PRODUCTION = Policy("production", 1, tuple(r.name for r in RULES))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    """The bits of a policy's rules; an unknown rule is an error."""
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[name] for name in set(policy.rules))


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at sorted positions."""
    gaps = F.zip_with(positions, F.slice(positions, 2, F.size(positions)), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def measurements(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key and every measurement that a rule reads, as longs."""
    body = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, BREAK, "") != "")
    # Columns that a later step reads within a lambda are named first, so that they are computed once a row.
    found = (
        docs.select(F.col(key).alias(key), F.col(text).alias("_t"))
        .withColumn("_w", words(F.col("_t")))
        .withColumn("_l", lines)
        .withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w)))
        .select(
            key,
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.col("_wh"),
        )
        .withColumn(
            "_h",
            F.when(
                F.size("_wh") >= WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_wh") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_wh", i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn(
            "n_adjacent_repeats",
            F.aggregate(
                F.zip_with("_wh", F.slice("_wh", 2, F.greatest(F.size("_wh"), F.lit(1))), lambda a, b: F.when(a == b, 1).otherwise(0)),
                F.lit(0).cast("long"),
                lambda s, x: s + x,
            ),
        )
        # Sorting is left to the texts that do have a window twice.
        .withColumn(
            "_s",
            F.when(
                F.size(F.array_distinct("_h")) < F.size("_h"),
                F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
    )
    s = F.col("_s")
    twice = F.filter(
        s,
        lambda e, j: F.coalesce((j > 0) & (F.get(s, j - 1)["h"] == e["h"]), F.lit(False))
        | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)),
    )
    return (
        found.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda e: e["i"]))))
        .withColumn("n_repeat_words", F.when(F.col("_p").isNotNull(), _covered(F.col("_p"))).otherwise(F.lit(0).cast("long")))
        .drop("_wh", "_h", "_s", "_p")
    )


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements and ``failed_bits`` of every document: each rule is evaluated exactly once."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.failed(F.col), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measurements(docs, text, key).withColumn("failed_bits", bits)


def apply_policy(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, into: str = "kept") -> DataFrame:
    """Add a boolean: true where no rule of the policy failed."""
    return book.withColumn(into, F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, those it alone rejects, and those kept without it.

    The ledger is first folded to one row per bit pattern (at most 2 ** rules), so a hot pattern costs one
    counter, and each rule then reads the patterns alone.
    """
    patterns = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    all_bits = mask(policy, rules)
    bits = F.col("failed_bits").bitwiseAND(F.lit(all_bits).cast("long"))
    aggs = []
    for i, rule in enumerate(rules):
        if rule.name in policy.rules:
            own = F.lit(1 << i).cast("long")
            without = F.lit(all_bits & ~(1 << i)).cast("long")
            aggs.append(
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.coalesce(F.sum(F.when(bits.bitwiseAND(own) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
                    F.coalesce(F.sum(F.when(bits == own, F.col("n"))), F.lit(0)).alias("n_only"),
                    F.coalesce(F.sum(F.when(F.col("failed_bits").bitwiseAND(without) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
                )
            )
    return patterns.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def keep(docs: DataFrame, policy: Policy = PRODUCTION, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns as they were."""
    row = free_name(docs.columns, "_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{text}`").alias("_t"))
    # The document rides along as the key: no join, no shuffle.
    book = apply_policy(ledger(packed, text="_t", key=row), policy)
    # The filter reads a row number, which keeps it above the measurements: pushed below them, it would repeat them all.
    numbered = book.withColumn("_at", F.monotonically_increasing_id())
    return numbered.where(F.col("kept") & (F.col("_at") >= 0)).select(f"{row}.*")
