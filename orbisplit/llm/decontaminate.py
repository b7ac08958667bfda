r"""Benchmark decontamination by canonical templates.

Texts become tokens (runs of letters and digits, lower case). Numbers, the units that follow numbers, and names become
typed placeholders in the template and stay as slot values beside it, so a question with other numbers or names has
the same template. Windows of the template are joined by hash with the windows of the benchmark's items. Windows that a document meets
at one distance from the item's are an alignment, one reading of the item in that text; windows with slots count if these are
consistent over the whole alignment: a value of the item stands for one value of the document, wherever it recurs. An item is found in a
document if the windows that count are at least ``share`` hundredths of the item's windows.

What is a name depends on the characters before it, and windows with too few literal tokens are too general as templates. So all
windows are joined by the hash of their real tokens too (lower case, slot values included), and a verbatim passage is met
whatever stands around it or breaks its lines. An item is found if its consistent templates reach the share of its
windows that have enough literal tokens, where these are at least half of its windows, and ``n_windows`` counts those; or
if templates and real tokens together reach the share of all its windows, which ``n_windows`` counts then.

Texts are cut into pieces of PIECE windows before windows become rows, so that a row holds a piece's tokens and not the text's: time and
memory are linear in a text's words.

The items' windows are broadcast only if there are few enough of them (``BROADCAST_WINDOWS``, ``BROADCAST_CHARS``, counted first); a document's windows are
then made and probed in one pass, and only what meets an item is shuffled. Otherwise both sides are shuffled by hash, a
document's windows with their own slot values but without its other tokens.

Defined cases: a null or blank text has no tokens and meets nothing; an item below the window size is a single window of its own
length, and one below ``LEAST`` tokens is found only where it is all of a document; an item without tokens is never
found; a null doc_id or item_id is carried through; repeated rows of a document count as one document of that doc_id, of
an item as one item, and rows of one id with other texts add up; a text of any length is read whole, its windows one by one;
empty tables give an empty result; further columns, whatever their names, are ignored by ``leaks`` and kept by ``clean``.
Windows are compared by 64-bit hashes of their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import materialise

#: Tokens in a window, and the fewest of an item that is looked for within texts.
WINDOW, LEAST = 8, 4
#: Windows of a piece of a text.
PIECE = 128
#: Hundredths of an item's windows that must be met.
SHARE = 50
#: A window with fewer literal tokens than this is too general to count (shorter windows need half of theirs).
LITERALS = 4
#: Windows of items, and characters of their slots, up to which they are broadcast: about 60 MB.
BROADCAST_WINDOWS, BROADCAST_CHARS = 200_000, 32 << 20
#: Units that are placeholders after a number.
UNITS = (
    "percent", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs",
    "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "mph", "kmh", "meter", "meters", "metre", "metres",
)
# Marks before slot tokens, one control character each; texts lose theirs first.
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"


def tokens(text: Column) -> Column:
    """Array of tokens in order; slot tokens start with their mark. A null text has none."""
    t = F.translate(F.coalesce(text, F.lit("")), NUMBER + UNIT + NAME, "")
    # A capital inside a sentence: after a letter, digit or comma, and one space.
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},] )(\p{Lu}\p{Ll})", NAME + "$1")
    t = F.lower(t)
    t = F.regexp_replace(t, r"([0-9]++(?:[.,][0-9]++)*+)", f" {NUMBER}$1 ")
    t = F.regexp_replace(t, f"({NUMBER}[0-9.,]+ +)({'|'.join(sorted(UNITS, key=len, reverse=True))})" + r"(?![\p{L}\p{N}])", f"$1{UNIT}$2")
    # Within a number, points and commas belong to it.
    parts = F.split(t, rf"(?:[^\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}.,]|(?<![0-9])[.,]|[.,](?![0-9]))+")
    return F.filter(parts, lambda w: w != "")


def _template(token: Column) -> Column:
    """The hash of a token, or of its mark alone."""
    return F.xxhash64(F.when(token < "\x04", F.substring(token, 1, 1)).otherwise(token))


def _plain(token: Column) -> Column:
    """The hash of a token without its mark."""
    return F.xxhash64(F.when(token < "\x04", F.substring(token, 2, 1 << 30)).otherwise(token))


def _windows(size: Column, n: Column, total: Column) -> Column:
    """Hashes of n windows of the column ``_h``, of a text that has ``total``; null if there is none. Below LEAST tokens, only a whole text
    is a window."""
    there = (total == 1) | ((total > 1) & (size >= LEAST))
    return F.when(there, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("_h", i, size))))


def _once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """rows (keep) with columns that are computed once a row: an expression that a lambda uses would be computed for each element, but what
    a generator puts out is a value."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _slots(column: str) -> Column:
    """The tokens of a window where they are slots, null where they are literal."""
    return F.transform(column, lambda w: F.when(w < "\x04", w))


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, hash, size, i_pos, i_slots, template, exact, n_literal, n_windows): the hashes by which each window of an item can
    be met, of its template or of its real tokens; n_literal of its n_windows windows have enough literal tokens."""
    rows = items.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("_t")).distinct()
    made = _once(_once(rows, ["item_id"], _w=tokens(F.col("_t"))), ["item_id", "_w"], _h=F.transform("_w", _template)).where(F.size("_w") > 0)
    made = made.withColumn("size", F.least(F.size("_w"), F.lit(WINDOW)))
    n = F.size("_w") - F.col("size") + 1
    out = made.select("item_id", "_w", "size", F.posexplode(_windows(F.col("size"), n, n)).alias("i_pos", "hash"))
    out = out.withColumn("i_slots", _slots(F.slice("_w", F.col("i_pos") + 1, F.col("size"))))
    # What is too general here is so in documents too: equal templates have their slots at equal places.
    need = F.when(F.col("size") < WINDOW, F.ceil(F.col("size") / 2)).otherwise(F.lit(LITERALS))
    n_literals = F.size(F.filter("i_slots", lambda x: x.isNull()))
    plain = F.xxhash64(F.transform(F.slice("_w", F.col("i_pos") + 1, F.col("size")), _plain))
    out = out.select("item_id", "hash", plain.alias("_x"), "size", "i_pos", "i_slots", ((n_literals >= need) & (F.col("size") >= LEAST)).alias("_literal"))
    n_slots = F.size(F.filter("i_slots", lambda x: x.isNotNull()))
    templates = out.where("_literal").withColumn("template", F.lit(True)).withColumn("exact", n_slots == 0)
    real = out.where((n_slots > 0) | ~F.col("_literal")).withColumn("hash", F.col("_x")).withColumn("template", F.lit(False)).withColumn("exact", F.lit(True))
    n = out.groupBy("item_id").agg(F.countDistinct(F.when(F.col("_literal"), F.col("i_pos"))).alias("n_literal"), F.countDistinct("i_pos").alias("n_windows"))
    out = templates.unionByName(real).drop("_x", "_literal")
    return out.join(n, out["item_id"].eqNullSafe(n["item_id"])).drop(n["item_id"])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, item_id, n_met, n_windows): pairs whose consistent windows reach the share."""
    book = materialise(item_windows(items, item_key, item_text), "leaks-items")
    chars = F.sum(F.length(F.array_join("i_slots", "")))
    n_windows, n_chars, sizes = book.agg(F.count(F.lit(1)), chars, F.sort_array(F.collect_set("size"))).first()
    few = n_windows <= BROADCAST_WINDOWS and (n_chars or 0) <= BROADCAST_CHARS
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_t"))
    # A text is made tokens once; each size of window that items have is a row of it, and each piece a row of that.
    read = _once(rows.withColumn("_r", F.xxhash64("_t")), ["doc_id", "_r"], _w=tokens(F.col("_t")))
    sizes = sizes or [WINDOW]
    read = read.withColumn("_size", F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes))))
    size, total = F.col("_size"), F.size("_w") - (F.col("_size") - 1)
    piece = lambda k: F.struct((k * PIECE).alias("_o"), F.slice("_w", k * PIECE + 1, size + (PIECE - 1)).alias("_w"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((total - 1) / PIECE).cast("int")), piece)
    cut = read.where(total > 0).select("doc_id", "_r", "_size", total.alias("_n"), F.inline(parts))
    slots_at = F.filter(F.transform("_w", lambda w, i: F.when(w < "\x04", i)), lambda i: i.isNotNull())
    plain = F.when(F.exists("_w", lambda w: w < "\x04"), F.transform("_w", _plain)).otherwise(F.array().cast("array<bigint>"))
    made = _once(cut, ["doc_id", "_r", "_size", "_n", "_o", "_w"], _h=F.transform("_w", _template), _p=plain, _s=slots_at)
    n = F.least(F.col("_n") - F.col("_o"), F.lit(PIECE))
    # Windows without slots have one hash; those with slots follow once more, by their real tokens.
    at = F.array_distinct(F.flatten(F.transform("_s", lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.least(i, n - 1)))))
    both = F.concat(_windows(size, n, F.col("_n")), F.transform("_at", lambda i: F.xxhash64(F.slice("_p", i + 1, size))))
    place = F.when(F.col("_j") < n, F.col("_j")).otherwise(F.get("_at", F.col("_j") - n))
    probes = _once(made, ["doc_id", "_r", "_size", "_n", "_o", "_w", "_h", "_p"], _at=at)
    probes = probes.select("doc_id", "_r", "_w", "_at", "_size", "_n", "_o", F.posexplode(both).alias("_j", "_hash"))
    probes = probes.select("doc_id", "_r", "_hash", "_size", "_w", "_o", place.alias("_l"), (F.col("_j") < n).alias("_shape"))
    d_slots = _slots(F.slice("_w", F.col("_l") + 1, size)).alias("d_slots")
    d_pos = (F.col("_o") + F.col("_l")).alias("_d")
    if not few:
        probes = probes.select("doc_id", "_r", "_hash", "_size", "_shape", d_pos, d_slots)
    book = book.select("item_id", "hash", "size", "i_pos", "i_slots", "template", "exact", "n_literal", "n_windows")
    met = probes.join(F.broadcast(book) if few else book, (F.col("_hash") == F.col("hash")) & (size == F.col("size"))).where(F.col("exact") | F.col("_shape"))
    by = ["doc_id", "item_id", "n_literal", "n_windows"]
    met = met.select(*by, "_r", "i_pos", "i_slots", *([d_pos, d_slots] if few else ["_d", "d_slots"]), "exact", (F.col("template") & F.col("_shape")).alias("by_template"))
    pairs = F.filter(F.arrays_zip(F.col("i_slots").alias("i"), F.col("d_slots").alias("d")), lambda p: p["i"].isNotNull())
    # An alignment has a window of the item once at most, so what is gathered is no longer than the item.
    position = lambda c: F.collect_set(F.when(c, F.col("i_pos")))
    t = F.col("by_template")
    lined = met.groupBy(*by, "_r", (F.col("_d") - F.col("i_pos")).alias("_off")).agg(
        position(t).alias("_t"), position(t & F.col("exact")).alias("_same"), position(t | F.col("exact")).alias("_a"), position(F.col("exact")).alias("_x"),
        F.collect_set(F.when(t, pairs)).alias("_pairs"),
    )
    lined = lined.withColumn("_pairs", F.array_distinct(F.flatten("_pairs")))
    consistent = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["i"]))) == F.size("_pairs")
    either = lambda a, b: F.when(consistent, F.col(a)).otherwise(F.col(b))
    lined = lined.select(*by, either("_t", "_same").alias("_t"), either("_a", "_x").alias("_a"))
    # One row for each window of an item that a document meets, however often it does.
    places = lined.select(*by, "_t", F.explode("_a").alias("i_pos")).groupBy(*by, "i_pos").agg(F.max(F.array_contains("_t", F.col("i_pos"))).alias("t"))
    found = places.groupBy(*by).agg(F.count_if("t").alias("_t"), F.count(F.lit(1)).alias("_a"))
    alone = (F.col("_t") > 0) & (2 * F.col("n_literal") >= F.col("n_windows")) & (100 * F.col("_t") >= share * F.col("n_literal"))
    found = found.where(alone | ((F.col("_a") > 0) & (100 * F.col("_a") >= share * F.col("n_windows"))))
    either = lambda a, b: F.when(alone, F.col(a)).otherwise(F.col(b))
    return found.select("doc_id", "item_id", either("_t", "_a").alias("n_met"), either("n_literal", "n_windows").alias("n_windows"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **more: object) -> DataFrame:
    """The documents in which no item is found, with all their columns; those without a key are kept."""
    ids = materialise(leaks(docs, items, key=key, **more).select(F.col("doc_id").alias("_leaked")).distinct(), "leaks-ids")
    return docs.join(ids, docs[f"`{key}`"] == ids["_leaked"], "left_anti")
