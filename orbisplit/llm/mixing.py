"""Mixing sources to target weights: budgets flow down a tree of domains, languages and sources.

A node shares its budget among its children by weight. A child whose subtree cannot take its share (its tokens times the
allowed epochs) is filled up, and what it leaves goes to its siblings by weight; only what a whole family cannot take goes
up to the next level's siblings. That is water-filling, level by level from the top, with subtree capacities.

A leaf's budget is a number of whole epochs and a rest; the rest is the prefix, by tokens, of the epoch's seeded order.
The prefix is cut without gathering a leaf: token sums of 1024 slices of the hash range find the slice in which the rest
ends, and a running sum within that slice finds the last document. Each leaf then has one cutoff, and documents are
compared with it where they lie: their texts are never shuffled.

All numbers are whole, so results don't depend on the order of sums. Defined cases: null domain, language or source are
``unknown``; a null or blank text has no tokens and is taken with the prefix it falls into; a text of any length is one row
that is taken or left whole; a null doc_id is ordered as the
text ``null``; repeated rows are each taken or left alike, unless the cutoff falls between them, where both are left; an
empty table gives an empty one; columns keep their values, and added ones avoid clashes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisplit.llm.common import free_name, materialise, words

#: Slices of the hash range of a leaf.
SLICE_BITS = 10
#: Leaves up to this number (about 10 MB) are broadcast; more are joined by key.
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """Whole weights by name and level, ``other`` for names not listed; budget in tokens (None: as many as there are)."""

    domain: Mapping[str, int] = field(default_factory=lambda: {"web": 4, "books": 3, "news": 2, "forum": 1})
    lang: Mapping[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source: Mapping[str, int] = field(default_factory=dict)
    other: int = 1
    budget: int | None = None
    max_epochs: int = 4
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The production rule: the number that ends a source's name, modulo four."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit(""))
    place = F.when(number == "", F.lit(0)).otherwise(F.pmod(F.expr("1") * number.try_cast("long"), F.lit(4)))
    return F.element_at(F.array(*[F.lit(x) for x in ("web", "books", "news", "forum")]), (place + 1).cast("int"))


def _weight(name: Column, known: Mapping[str, int], other: int) -> Column:
    if not known:
        return F.lit(other).cast("long")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(other)).cast("long")


def _fill(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Add ``alloc``: each child's part of ``budget`` (one value per family) by ``w``, none above ``cap``."""
    by = Window.partitionBy(*[F.col(c) for c in family] or [F.lit(0)])
    order = by.orderBy((F.col("cap") / F.col("w")), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.col("cap") * F.col("_after") <= F.col("w") * (F.col("budget") - F.col("_before"))
    nodes = nodes.withColumn("_before", before).withColumn("_after", after).withColumn("_full", full)
    spent = F.min(F.when(~F.col("_full"), F.col("_before"))).over(by)
    left = F.max(F.when(~F.col("_full"), F.col("_after"))).over(by)
    nodes = nodes.withColumn("_spent", spent).withColumn("_left", left)
    share = F.expr("(w * (budget - _spent)) div _left")
    return nodes.withColumn("alloc", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_before", "_after", "_full", "_spent", "_left")


def allocate(leaves: DataFrame, targets: Targets) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds ``alloc`` by the tree of weights."""
    leaves = leaves.withColumn("cap", F.col("tokens") * targets.max_epochs)
    budget = F.lit(targets.budget).cast("long") if targets.budget is not None else F.col("_all")
    plan = leaves.agg(F.sum("tokens").alias("_all")).select(F.coalesce(budget, F.lit(0)).alias("budget"), F.lit(0).alias("_one"))
    above: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*above, level).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("w", _weight(F.col(level), getattr(targets, level), targets.other))
        nodes = nodes.join(plan, above) if above else nodes.withColumn("_one", F.lit(0)).join(plan, "_one").drop("_one")
        filled = _fill(nodes, above, level)
        above = [*above, level]
        plan = filled.select(*above, F.col("alloc").alias("budget"))
    return filled.select(*LEVELS, "tokens", "alloc")


def _order(targets: Targets, doc_id: Column) -> Column:
    """A number of 32 bits: a document's place in the order of the epoch in which its leaf's rest is taken."""
    name = F.concat_ws(":", F.lit(str(targets.seed)), F.col("full").cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast where the number of rows allows it; otherwise the join is left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def mix(docs: DataFrame, targets: Targets = Targets(), key: str = "doc_id", text: str = "text", domain: Column | None = None) -> DataFrame:
    """The rows taken, with all their columns, and domain, n_tokens and epochs (how often a row is taken)."""
    names = docs.columns
    low = {c.lower() for c in names}
    added = {c: free_name(names, c) for c in ("domain", "n_tokens", "epochs")}
    get = lambda c: F.coalesce(F.col(f"`{c}`").cast("string") if c in low else F.lit(None).cast("string"), F.lit("unknown"))
    row = free_name(names, "_row")
    source = F.col("source").cast("string") if "source" in low else F.lit(None).cast("string")
    leaf_of = {"domain": F.coalesce(domain if domain is not None else domain_of(source), F.lit("unknown")), "lang": get("lang"), "source": get("source")}
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias(row),
        F.col(f"`{key}`").alias("_id"),
        F.size(words(F.col(f"`{text}`").cast("string"))).cast("long").alias("_n"),
        *[c.alias(f"_{k}") for k, c in leaf_of.items()],
    )
    keys = [f"_{k}" for k in LEVELS]
    narrow = materialise(packed.select("_id", "_n", *keys), "mix-tokens")
    leaves = narrow.groupBy(*[F.col(f"_{k}").alias(k) for k in LEVELS]).agg(F.sum("_n").alias("tokens"))
    plan = allocate(materialise(leaves, "mix-leaves"), targets)
    full = F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(0))
    plan = plan.withColumn("full", full).select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "full", (F.col("alloc") - F.col("full") * F.col("tokens")).alias("rest"))
    plan = materialise(plan, "mix-plan")

    placed = narrow.join(_small(plan), keys).where("rest > 0").withColumn("_u", _order(targets, F.col("_id")))
    slices = placed.groupBy(*keys, "rest", F.shiftright("_u", 32 - SLICE_BITS).alias("slice")).agg(F.sum("_n").alias("s"))
    upto = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = slices.withColumn("c", F.sum("s").over(upto)).where("c > rest").groupBy(*keys).agg(F.min("slice").alias("slice"), F.min(F.col("c") - F.col("s")).alias("before"))
    ends = materialise(ends, "mix-slices")
    # Equal documents share a place: the running sum goes by place, so that they are taken or left together.
    last = placed.join(_small(ends), keys).where(F.shiftright("_u", 32 - SLICE_BITS) == F.col("slice"))
    run = Window.partitionBy(*keys).orderBy("_u", "_id", "_n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("c", F.col("before") + F.sum("_n").over(run)).where("c <= rest")
    last = last.groupBy(*keys).agg(F.max(F.struct("_u", "_id", "_n")).alias("last"))
    cut = plan.join(ends.select(*keys, "slice"), keys, "left").join(last, keys, "left")
    cut = materialise(cut, "mix-cutoffs")

    whole = packed.join(_small(cut), keys).withColumn("_u", _order(targets, F.col("_id")))
    in_slice = F.shiftright("_u", 32 - SLICE_BITS)
    taken = (F.col("rest") > 0) & (
        F.col("slice").isNull() | (in_slice < F.col("slice")) | F.coalesce((in_slice == F.col("slice")) & (F.struct("_u", "_id", "_n") <= F.col("last")), F.lit(False))
    )
    epochs = (F.col("full") + F.when(taken, 1).otherwise(0)).cast("long")
    return whole.withColumn("_e", epochs).where("_e > 0").select(
        f"{row}.*", F.col("_domain").alias(added["domain"]), F.col("_n").alias(added["n_tokens"]), F.col("_e").alias(added["epochs"])
    )
