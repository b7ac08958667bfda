"""Reports over a state folder: its dataset in figures, and the data that pictures of it are drawn from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.operators import density, report, sampling, spheres
from orbisplit.sources.state import State
from orbisplit.sources.tables import materialise


def rows_with_vectors(state: State) -> DataFrame:
    """(version, run_id, id, split, label, anchor_id, distance, v): the trajectory and the assignments, rebuilt from what is stored."""
    a = state.assignments().select("version", "run_id", "id", F.col("dataset_split").alias("split"), "anchor_id", F.col("distance_to_anchor").alias("distance"))
    return a.join(state.points().select("version", "id", "label", "v"), ["version", "id"])


def rebuilt(state: State, metric: str = "cosine") -> DataFrame:
    """rows_with_vectors, and for training rows without an anchor the closest one (``closest_anchor``, ``closest_distance``)."""
    rows = rows_with_vectors(state).withColumn("key", F.xxhash64("version", "id"))
    free = rows.where("anchor_id is null and split = 'train'")
    if state.anchors().isEmpty():
        near = free.select("key", F.lit(None).cast("long").alias("closest_anchor"), F.lit(None).cast("double").alias("closest_distance"))
    else:
        near = spheres.nearest_anchor(free.select(F.col("key").alias("id"), "v"), state.anchors(), metric)
        near = near.select(F.col("id").alias("key"), F.col("anchor_id").alias("closest_anchor"), F.col("distance").alias("closest_distance"))
    return rows.join(near, "key", "left").drop("key")


def projected(state: State, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows and anchor centres on the n main axes of the rows: (version, id, run_id, split, anchor_id, p) and (anchor_id, base_radius, p)."""
    rows = rows_with_vectors(state)
    axes = density.principal_axes(rows.select("id", "v"), n)
    p = density.project(F.col("v"), axes).alias("p")
    # A centre of another width than the rows has no projection: it is shown where the row nearest to it is, by the axes they share.
    width = len(axes[0])
    centers = state.anchors().select("anchor_id", "base_radius", F.col("center").alias("v")).withColumn("p", F.when(F.size("v") == width, p))
    if not centers.where("p is null").isEmpty():
        same = F.slice(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width))), F.lit(1), F.lit(width)).alias("v")
        found = report.placed_centers(centers.select("anchor_id", same, "p"), rows.select(F.xxhash64("version", "id").alias("id"), "v", p))
        centers = centers.drop("p").join(found, "anchor_id", "left")
    return rows.select("version", "id", "run_id", "split", "anchor_id", p), centers.select("anchor_id", "base_radius", "p")


def heat(state: State, size: int = 300) -> DataFrame:
    """(gx, gy, heat): how near each place of a grid over the projected rows is to an anchor, by the spread of the anchor's rows; anchors of few
    rows are filled up with points of their surface."""
    rows, centers = projected(state)
    x, y = (F.col("p")[i] for i in (0, 1))
    plane = materialise(rows.select("anchor_id", x.alias("x"), y.alias("y")), "plane")
    box = plane.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    ranges = [box[1] - box[0], box[3] - box[2]]
    pad = [0.15 * r or 0.5 for r in ranges]
    on = density.project(F.col("v"), density.principal_axes(rows_with_vectors(state).select("id", "v"), 2))
    surface = report.surface_points(state.anchors(), report.FULL).select("anchor_id", "i", on[0].alias("x"), on[1].alias("y"))
    spread = report.spread(plane.where("anchor_id is not null"), centers.select("anchor_id", x.alias("cx"), y.alias("cy")), surface, max(ranges) + 2 * max(pad))
    return report.heatmap(spread, size, (box[0] - pad[0], box[2] - pad[1]), (box[1] + pad[0], box[3] + pad[1]))


def figures(state: State) -> DataFrame:
    """(section, name, value): the dataset's counts and shares, its splits, runs, anchors and classes."""
    a = state.assignments()

    def named(section: str, df: DataFrame, name: Callable | None = None) -> DataFrame:
        """A row a column of a one-row table, or a row a row of (name, value)."""
        if name is not None:
            return df.select(F.lit(section).alias("section"), name("name").cast("string").alias("name"), F.col("value").cast("double").alias("value"))
        pairs_ = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("x")
        return df.select(pairs_).select(F.lit(section).alias("section"), "x.name", "x.value")

    counted = lambda c: a.groupBy(F.coalesce(F.col(c), F.lit("none")).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    labels = rows_with_vectors(state).where("label is not null").groupBy(F.lower("label").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    out = named("dataset", report.statistics(a, "dataset_split"))
    for section, df in (("split", counted("dataset_split")), ("run", counted("run_id")), ("class", labels)):
        out = out.unionByName(named(section, df, F.col))
    out = out.unionByName(named("anchors", spheres.radius_stats(state.anchors())))
    return out.unionByName(named("points of anchors", report.points_per_anchor(a)))


def stats_text(state: State) -> DataFrame:
    """(value): the figures as lines of text, in order."""
    f = figures(state).orderBy("section", "name")
    return f.select(F.format_string("%-20s %-24s %14.4f", "section", "name", "value").alias("value"))


def radius_histogram(state: State, bins: int = 20) -> DataFrame:
    low, high = state.anchors().agg(F.min("base_radius"), F.max("base_radius")).first()
    if low is None:
        return state.anchors().select(F.lit(0).alias("bin"), F.lit(0).alias("n"), F.lit(0.0).alias("density"))
    return report.histogram(state.anchors(), "base_radius", bins, low, high if high > low else low + 1.0)


def representatives(state: State, each: int = 1, anchors: int = 7) -> DataFrame:
    """The rows nearest to the centres of anchors that lie far from each other."""
    chosen = sampling.farthest_points(state.anchors().select(F.col("anchor_id").alias("id"), F.col("center").alias("v")), anchors)
    a = state.assignments().join(chosen.select(F.col("id").alias("anchor_id")), "anchor_id", "left_semi").withColumn("distance", F.col("distance_to_anchor"))
    return report.representatives(a, each)


#: What a report may be, and the table that it writes.
REPORTS: dict[str, Callable[..., DataFrame]] = {
    "stats": figures,
    "runs": lambda s: s.runs(),
    "run_histogram": lambda s: report.run_histogram(s.assignments(), "run_id", "dataset_split"),
    "rebuilt": rebuilt,
    "projection": lambda s, **more: projected(s, **more)[0],
    "centers": lambda s, **more: projected(s, **more)[1],
    "heat": heat,
    "radius_histogram": radius_histogram,
    "representatives": representatives,
}
#: Names of pictures in batch files, and the report whose data they are drawn from. Drawing itself is left to other tools.
PICTURES = {"standalone": "projection", "detailed": "projection", "summary": "projection", "3d": "projection"}


def write(state: State, given: Mapping[str, Any]) -> str:
    """Write a report below the state folder: Parquet, and for ``stats`` one text file too. Other names in the mapping go to the report."""
    kind = given.get("type", "stats")
    more = {k: v for k, v in given.items() if k not in ("type", "save")}
    if kind in PICTURES:
        given, more, kind = {}, {"n": 3 if kind == "3d" else 2}, PICTURES[kind]
    if kind not in REPORTS:
        raise ValueError(f"no report {kind!r}: one of {', '.join(sorted(REPORTS))}")
    path = f"{state.root}/reports/{given.get('save', kind)}"
    REPORTS[kind](state, **more).write.mode("overwrite").parquet(path)
    if kind == "stats":
        stats_text(state).coalesce(1).write.mode("overwrite").text(path + ".txt")
    return path
