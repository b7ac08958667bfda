"""URL filters: rules first, then a path-template tree per host that judges what no rule names.

Paths become templates: segments that look like numbers or hashes turn into typed wildcards, and a node with many
children of few urls each gets one wildcard child. The tree grows from branching to branching until a template has fewer than ``support`` urls
in all; what is below is one tail, ``**``. No depth is fixed.

Labels are what the rules say: urls they block are bad, urls they allow are good, all others are unlabelled and count as neither. The
purity of a template is bad / (bad + good) over its labelled urls, smoothed towards that of its parent template over all
hosts, and so on up to a fixed ``prior``: a template that no label tells anything of is presumed good. Within a host, sibling
branches are merged unless a two-sample test of their labelled shares tells them apart. A branch is rejected if its purity,
smoothed towards its templates' purity over all hosts, reaches a threshold. So what rules say of some hosts decides urls of
like paths on hosts and branches that no rule names.

Every step is a grouped sum over (host, template) rows that are combined before they are shuffled, so a host with
a third of all urls costs as many rows as it has templates; nothing is gathered per host.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged as the empty template of
the empty host; paths of any length are read whole; repeated rows are judged each and counted each; an empty table gives an
empty one; rules of one length are told apart by their host's length, then by their text; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    """wide: children beyond which a node may be a wildcard, if its urls are at most ``per_child`` times the children; support:
    urls below which a template has no branches, and labelled urls below which siblings are not told apart; z: standard
    errors within which siblings are alike; weight: pseudo-urls of what purity is smoothed to; prior, reject: purity."""

    wide: int = 50
    per_child: int = 3
    support: int = 5
    z: float = 2.0
    weight: float = 2.0
    prior: float = 0.2
    reject: float = 0.7


#: The rules of the production query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Rules up to this number are one expression; more are joined by host suffix.
INLINE_RULES = 200


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumn("host", F.translate(F.regexp_extract(whole, shape, 1), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(whole, shape, 2)
    )


def _by_length(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))


def with_rule(urls: DataFrame, rules: Sequence[Rule], key: str = "page_id") -> DataFrame:
    """Add ``rule`` and ``ruled`` (its verdict), null where no rule fits. Rows need ``host`` and ``path``."""
    host, path = F.col("host"), F.col("path")
    if len(rules) <= INLINE_RULES:
        rule = ruled = F.lit(None).cast("string")
        for r in reversed(_by_length(rules)):
            fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
            rule, ruled = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(ruled)
        return urls.withColumn("rule", rule).withColumn("ruled", ruled)
    spark = urls.sparkSession
    ordered = [(r.host, r.path, r.text, r.verdict, i) for i, r in enumerate(_by_length(rules))]
    book = spark.createDataFrame(ordered, "_h string, _p string, _r string, _v string, _i long")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # The best rule is found once for each distinct host and path.
    best = (
        urls.select("host", "path").distinct().withColumn("_h", F.explode(suffixes)).join(book, "_h")
        .where(path.startswith(F.col("_p")))
        .groupBy("host", "path").agg(F.min_by(F.struct("_r", "_v"), "_i").alias("_b"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        urls["*"], F.col("_b._r").alias("rule"), F.col("_b._v").alias("ruled")
    )


def segment_kind(segment: Column) -> Column:
    """A segment, or the typed wildcard of what it looks like; a file's suffix is kept."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("<num>"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("<num>."), F.substring_index(segment, ".", -1)))
        .when(segment.rlike(r"^[0-9A-Fa-f-]{12,}$"), F.lit("<hex>"))
        .when(segment.rlike(r"^[^0-9]*[0-9]+[^0-9]*$"), F.regexp_replace(segment, "[0-9]+", "<num>"))
        .otherwise(segment)
    )


def with_shape(urls: DataFrame) -> DataFrame:
    """Add ``shape``: the typed segments of the whole path."""
    return urls.withColumn("shape", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment_kind))


def templates(urls: DataFrame, settings: Settings) -> DataFrame:
    """(host, shape, n, bad, good, steps): the tree, a row per host and shape; steps are what a template is made of. urls: rows of host,
    shape, label. What all urls of a template have in common further on is one step, so levels are as many as there are branchings."""
    tree = urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "block").alias("bad"), F.count_if(F.col("label") == "allow").alias("good")
    )
    # at: segments that the steps have used up, -1 where there are no more steps.
    at = F.when(F.size("shape") == 0, F.lit(-1)).otherwise(F.lit(0))
    tree = materialise(tree.select("*", F.array().cast("array<string>").alias("steps"), at.alias("at")), "url-tree")
    while not tree.where("at >= 0").isEmpty():
        growing = tree.where("at >= 0").withColumn("_s", F.get("shape", F.col("at")))
        fan = growing.groupBy("host", "steps", "_s").agg(F.sum("n").alias("n")).groupBy("host", "steps").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
        wild = fan.where((F.col("c") > settings.wide) & (F.col("n") <= settings.per_child * F.col("c"))).select("host", "steps", F.lit(True).alias("_wild"))
        whole = growing.groupBy("steps").agg(F.sum("n").alias("a"), F.min("shape").alias("x"), F.max("shape").alias("y"))
        # The first and the last of some arrays have in common what all have.
        differ = F.array_position(F.zip_with("x", "y", lambda x, y: x.eqNullSafe(y)), False)
        common = F.when(differ == 0, F.size("x")).otherwise(differ - 1).cast("int")
        whole = whole.select("steps", (F.col("a") < settings.support).alias("_few"), common.alias("_common"))
        shared = F.col("_common") > F.col("at")
        end = F.when(F.col("_few"), F.size("shape")).when(shared, F.col("_common")).otherwise(F.col("at") + 1)
        run = F.array_join(F.slice("shape", F.col("at") + 1, F.greatest(F.col("_common") - F.col("at"), F.lit(1))), "/")
        step = F.when(F.col("_few"), F.lit("**")).when(shared, run).otherwise(F.when(F.col("_wild"), F.lit("*")).otherwise(F.col("_s")))
        grown = growing.join(wild, ["host", "steps"], "left").join(whole, "steps").select(
            "host", "shape", "n", "bad", "good", F.concat("steps", F.array(F.concat(F.lit("/"), step))).alias("steps"),
            F.when(end < F.size("shape"), end).otherwise(F.lit(-1)).alias("at"),
        )
        # Written at each level: the next one reads the tree more than once, and the plan must not double.
        tree = materialise(tree.where("at < 0").unionByName(grown), "url-tree")
    return tree.drop("at")


def purities(tree: DataFrame, settings: Settings) -> DataFrame:
    """(steps, purity) over all hosts: that of each step on the way from the root, smoothed to the step before."""
    own = tree.groupBy("steps").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ways = own.where(F.size("steps") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("k"))
    ways = ways.select("steps", "bad", "good", "k", F.slice("steps", 1, F.col("k")).alias("node"))
    sums = ways.groupBy("node").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    way = ways.select("steps", "k", "node").join(sums, "node").groupBy("steps").agg(F.array_sort(F.collect_list(F.struct("k", "b", "g"))).alias("way"))
    w = settings.weight
    smoothed = F.aggregate("way", F.lit(settings.prior), lambda p, x: (x["b"] + w * p) / (x["b"] + x["g"] + w))
    return own.select("steps").join(way, "steps", "left").select("steps", F.coalesce(smoothed, F.lit(settings.prior)).alias("purity"))


def branches(urls: DataFrame, settings: Settings) -> DataFrame:
    """(host, shape, template, branch, bad_share, rejected): the judged tree, a row per host and shape."""
    tree = templates(urls, settings)
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    node = materialise(tree.groupBy("host", "steps").agg(*sums).join(purities(tree, settings), "steps"), "url-nodes")
    parent = F.array_join(F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))), "")
    node = node.select("*", F.array_join("steps", "").alias("template"), parent.alias("parent"), (F.col("bad") + F.col("good")).alias("known"))
    pool = node.groupBy("host", "parent").agg(F.sum("bad").alias("p_bad"), F.sum("known").alias("p_known"))
    others, others_bad = F.col("p_known") - F.col("known"), F.col("p_bad") - F.col("bad")
    p, own, theirs = F.try_divide(F.col("p_bad"), F.col("p_known")), F.try_divide(F.col("bad"), F.col("known")), F.try_divide(others_bad, others)
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), F.col("known")) + F.try_divide(F.lit(1), others)))
    apart = (F.col("known") >= settings.support) & (others >= settings.support) & (F.abs(own - theirs) > settings.z * error)
    node = node.join(pool, ["host", "parent"]).withColumn("branch", F.when(apart, F.col("template")).otherwise(F.concat("parent", F.lit("/~"))))
    merged = node.groupBy("host", "branch").agg(
        F.sum("bad").alias("b"), F.sum("known").alias("k"), (F.sum(F.col("n") * F.col("purity")) / F.sum("n")).alias("prior")
    )
    share = (F.col("b") + settings.weight * F.col("prior")) / (F.col("k") + settings.weight)
    judged = merged.select("host", "branch", F.round(share, 6).alias("bad_share"))
    return (
        tree.select("host", "shape", "steps")
        .join(node.select("host", "steps", "template", "branch"), ["host", "steps"])
        .join(judged, ["host", "branch"])
        .select("host", "shape", "template", "branch", "bad_share", (F.col("bad_share") >= settings.reject).alias("rejected"))
    )


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, settings: Settings = Settings(), key: str = "page_id", url: str = "url", learn: Column | None = None
) -> DataFrame:
    """key, host, path, rule, verdict, template, branch, bad_share, rejected (by the tree) of every url. learn: a condition on host and
    path that says whose labels the tree is given; of all urls, if there is none."""
    urls = with_rule(with_parts(pages.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{url}`").cast("string").alias("_u")), "_u"), rules, "_k")
    urls = with_shape(urls)
    label = F.col("ruled") if learn is None else F.when(learn, F.col("ruled"))
    tree = branches(urls.select("host", "shape", label.alias("label")), settings)
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return urls.join(tree, ["host", "shape"]).select(
        F.col("_k").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "branch", "bad_share", "rejected"
    )
