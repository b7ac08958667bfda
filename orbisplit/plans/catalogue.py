"""One query per operator over the whole test tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbisplit.config import Config, Placement, Spheres
from orbisplit.functions import encoders
from orbisplit.functions import vectors as vec
from orbisplit.operators import cells, dedup, density, pairs, placement, report, sampling, spheres
from orbisplit.sources.tables import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
N_ANCHORS, RADIUS, BUFFER = 10, 0.8, 0.05
CONFIG = Config(spheres=Spheres(max_radius=0.8, percentile=20.0, strategy="inner_val"), placement=Placement(min_distance=0.3))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = CTE + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.points(table(spark, sf_dir, "embeddings"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), vec.doubles(F.col("embedding")).alias("v"), F.concat(F.lit("C"), F.col("label").cast("string")).alias("label"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten anchors at the rows that a hash puts first, numbered in that order."""
    chosen = points(spark, sf_dir).withColumn("u", vec.uniform(42, F.col("id"))).orderBy("u", "id").limit(N_ANCHORS)
    placed = chosen.select("id", "v", "u", F.lit(RADIUS).alias("radius"))
    numbered = placed.withColumn("id", F.expr("row_number() over (partition by 0 order by u, id)").cast("long")).select("id", "v", "radius")
    return placement.to_anchors(numbered, CONFIG, BUFFER)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spheres.assign(points(spark, sf_dir), anchors(spark, sf_dir))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


#: What the checks share: unit vectors, distances, neighbours, anchors, and assignments.
CTE = """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, 'C' || label AS label FROM embeddings),
unit AS (SELECT id, label, v, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS n FROM e),
pair AS (SELECT a.id AS l, b.id AS r, greatest(1 - list_dot_product(a.n, b.n), 0) AS d FROM unit a JOIN unit b ON a.id < b.id),
both_ways AS (SELECT l, r, d FROM pair UNION ALL SELECT r, l, d FROM pair),
near AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) AS rank FROM both_ways),
dens AS (SELECT l AS id, 1 / (avg(d) + 1e-8) AS density FROM near WHERE rank <= 10 GROUP BY l),
last AS (SELECT l, greatest(d, 1e-10) AS last FROM near WHERE rank = 20),
lids AS (SELECT l AS id, least(greatest(1 / (avg(ln(last / greatest(d, 1e-10))) + 1e-8), 0.1), 100) AS lid
         FROM near JOIN last USING (l) WHERE rank < 20 GROUP BY l),
chosen AS (SELECT row_number() OVER (ORDER BY u, id) - 1 AS anchor_id, id, v, n FROM (
             SELECT *, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT / 4294967296.0 AS u FROM unit) ORDER BY u, id LIMIT 10),
far AS (SELECT p.id, c.anchor_id, greatest(1 - list_dot_product(p.n, c.n), 0) AS d FROM unit p CROSS JOIN chosen c),
inside AS (SELECT * FROM far WHERE d <= 0.8 + 0.05),
first_met AS (SELECT id, min(anchor_id) AS anchor_id, arg_min(d, anchor_id) AS d, count(*)::INTEGER AS n_containing FROM inside GROUP BY id),
assigned AS (
  SELECT unit.id, unit.label, f.anchor_id, f.d AS distance, coalesce(n_containing, 0) AS n_containing,
         CASE WHEN f.anchor_id IS NULL THEN 'train' WHEN d > 0.8 THEN 'unassigned' WHEN d < 0.8 * (power(0.5, 1 / 64.0) * 0.7) THEN 'validation'
              WHEN d < 0.8 THEN 'test' ELSE 'train' END AS split
  FROM unit LEFT JOIN first_met f USING (id))
"""


@query("SELECT id, round(list_dot_product(n, n), 6) AS sq, round(list_sum(n), 6) + 0 AS total FROM unit")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("v", vec.l2_normalize(F.col("v")))
    return rounded(p.select("id", vec.dot(F.col("v"), F.col("v")).alias("sq"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")), "sq", "total")


def _close(spark: SparkSession, sf_dir: str, metric: str, within: float) -> DataFrame:
    return rounded(pairs.self_pairs(points(spark, sf_dir), metric, within), "d")


@query("SELECT l, r, round(d, 6) AS d FROM pair WHERE d <= 0.8")
def cosine_pairs_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _close(spark, sf_dir, "cosine", 0.8)


@query("SELECT a.id AS l, b.id AS r, round(list_distance(a.v, b.v), 6) AS d FROM e a JOIN e b ON a.id < b.id WHERE list_distance(a.v, b.v) <= 1.25")
def l2_pairs_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _close(spark, sf_dir, "euclidean", 1.25)


@query(
    "SELECT a.id AS l, b.id AS r, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))), 6) AS d FROM e a JOIN e b ON a.id < b.id "
    "WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) <= 8"
)
def l1_pairs_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _close(spark, sf_dir, "manhattan", 8.0)


@query("SELECT round(least(greatest(quantile_cont(d, 0.2), 0.01), 0.8), 6) AS radius FROM pair")
def base_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.createDataFrame([(placement.base_radius(points(spark, sf_dir), CONFIG),)], "radius double"), "radius")


@query("SELECT l, r, rank, round(d, 6) AS d FROM near WHERE rank <= 20")
def knn_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.knn(points(spark, sf_dir), 20), "d").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT * FROM (SELECT anchor_id AS l, id AS r, round(d, 6) AS d, row_number() OVER (PARTITION BY anchor_id ORDER BY d, id) AS rank FROM far) WHERE rank <= 20")
def knn_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spheres.centers(anchors(spark, sf_dir))
    return rounded(pairs.knn_cross(a, points(spark, sf_dir), 20), "d").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT id, round(density, 6) AS density FROM dens")
def local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.local_density(points(spark, sf_dir)), "density")


@query("SELECT id, round(lid, 6) AS lid FROM lids")
def lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.lid(points(spark, sf_dir)), "lid")


_STATS = [f"{c}_{s}" for c in ("density", "lid") for s in ("mean", "std", "min", "max", "p25", "p50", "p75", "p95")]


@query(
    "SELECT count(*) AS num_points, "
    + ", ".join(
        f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, "
        + ", ".join(f"round(quantile_cont({c}, {q / 100}), 6) AS {c}_p{q}" for q in (25, 50, 75, 95))
        for c in ("density", "lid")
    )
    + " FROM dens JOIN lids USING (id)"
)
def density_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.density_stats(points(spark, sf_dir)), *_STATS)


@query(
    "SELECT min(id) AS run_start, max(id) AS run_end FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM dens, (SELECT avg(density) AS m FROM dens) "
    "WHERE density > 1.02 * m) GROUP BY g"
)
def density_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dense_runs(density.local_density(points(spark, sf_dir)), 1.02)


@query(
    "SELECT id, round(1 + 2 * (1 - greatest(least((lid - a) / (b - a + 1e-8), 1), 0)), 6) AS factor, "
    "round(sqrt(list_dot_product(v, v)) * (1 + 2 * (1 - greatest(least((lid - a) / (b - a + 1e-8), 1), 0))), 6) AS size "
    "FROM lids JOIN e USING (id), (SELECT quantile_cont(lid, 0.05) AS a, quantile_cont(lid, 0.95) AS b FROM lids)"
)
def lid_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = density.lid_warp(points(spark, sf_dir)).withColumn("size", vec.norm(F.col("v")))
    return rounded(w.select("id", "factor", "size"), "factor", "size")


@query("SELECT dim, min(x) AS low, max(x) AS high FROM (SELECT unnest(range(64))::INTEGER AS dim, unnest(v) AS x FROM e) GROUP BY dim")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bounding_box(points(spark, sf_dir))


@query("SELECT dim, round(avg(x), 6) + 0 AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT unnest(range(64))::INTEGER AS dim, unnest(v) AS x FROM e) GROUP BY dim")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select(F.posexplode("v").alias("dim", "x"))
    return rounded(p.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")), "mean", "std")


@query(
    "SELECT greatest(least(floor(greatest(1, floor(n * 0.2)) / greatest(5, least(15, floor(n / 10)))), greatest(3, floor(n / 3))), greatest(1, floor(sqrt(n) / 5)))::BIGINT AS anchors "
    "FROM (SELECT count(*) AS n FROM e)"
)
def num_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return n.select(placement.num_anchors(F.col("n"), 0.2).alias("anchors"))


@query(
    "SELECT CASE WHEN t - v <= 0 AND v = 0 AND floor(n * 0.05) >= 1 THEN floor(n * 0.05) ELSE t - v END::BIGINT AS deficit FROM "
    "(SELECT floor(count(*) * 0.2) AS t, count(*) FILTER (split IN ('validation', 'test')) AS v, count(*) AS n FROM assigned)"
)
def eval_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report.statistics(assigned(spark, sf_dir)).first()
    d = placement.eval_deficit(0, 0, r.total_points, r.validation_count + r.test_count, CONFIG)
    return spark.createDataFrame([(d,)], "deficit long")


@query(
    "SELECT anchor_id, s AS strategy, round(0.8 * power(CASE s WHEN 'inner_val' THEN 0.3 ELSE 0.7 END, 1 / 64.0) * 0.7, 6) AS \"inner\", "
    "CASE s WHEN 'inner_val' THEN 'validation' ELSE 'test' END AS first FROM chosen, (VALUES ('inner_val'), ('inner_test')) t(s)"
)
def nested_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for s in ("inner_val", "inner_test"):
        one = anchors(spark, sf_dir).withColumn("shells", spheres.shells(F.col("base_radius"), 64, s, 0.3))
        one = one.select("anchor_id", F.lit(s).alias("strategy"), F.col("shells")[0]["outer"].alias("inner"), F.col("shells")[0]["split"].alias("first"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "inner")


@query("SELECT id, anchor_id, round(d, 6) AS d FROM inside")
def contain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spheres.containing(points(spark, sf_dir), anchors(spark, sf_dir)), "d")


@query("SELECT id, split, coalesce(anchor_id, -1) AS anchor_id, round(distance, 6) AS distance, n_containing FROM assigned")
def first_match_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assigned(spark, sf_dir), "distance").withColumn("anchor_id", F.coalesce("anchor_id", F.lit(-1)))


@query(
    "SELECT id, anchor_id, CASE WHEN d > 0.85 THEN 'train' WHEN d > 0.8 THEN 'unassigned' WHEN d < 0.8 * (power(0.5, 1 / 64.0) * 0.7) THEN 'validation' "
    "WHEN d < 0.8 THEN 'test' ELSE 'train' END AS split FROM far"
)
def point_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anchors(spark, sf_dir)
    d = pairs.distances(points(spark, sf_dir), spheres.centers(a)).withColumnRenamed("r", "anchor_id").join(a, "anchor_id")
    return d.select(F.col("l").alias("id"), "anchor_id", spheres.split_at(F.col("d"), F.col("base_radius"), F.col("buffer_radius"), F.col("shells")).alias("split"))


@query("SELECT id, arg_min(anchor_id, (d, anchor_id)) AS anchor_id, round(min(d), 6) AS distance FROM far GROUP BY id")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spheres.nearest_anchor(points(spark, sf_dir), anchors(spark, sf_dir)), "distance")


@query("SELECT unit.id, coalesce(string_agg(anchor_id, ',' ORDER BY anchor_id), '') AS anchor_ids FROM unit LEFT JOIN inside USING (id) GROUP BY unit.id")
def containing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spheres.containing_lists(points(spark, sf_dir), anchors(spark, sf_dir))
    return found.select("id", F.array_join(F.transform("anchor_ids", lambda x: x.cast("string")), ",").alias("anchor_ids"))


@query("SELECT id FROM far GROUP BY id HAVING min(d) > 0.8")
def uncovered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.uncovered(points(spark, sf_dir), spheres.centers(anchors(spark, sf_dir)), RADIUS).select("id")


@query(
    "SELECT 10::BIGINT AS num_anchors, 0.8::DOUBLE AS mean_radius, 0.0::DOUBLE AS std_radius, 0.8::DOUBLE AS min_radius, 0.8::DOUBLE AS max_radius, "
    "(SELECT round(min(greatest(1 - list_dot_product(a.n, b.n), 0)), 6) FROM chosen a JOIN chosen b ON a.anchor_id < b.anchor_id) AS min_separation, "
    "(SELECT round(count(DISTINCT id) / (SELECT count(*) FROM e), 6) FROM far WHERE d <= 0.8) AS coverage_ratio"
)
def placement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spheres.placement_stats(points(spark, sf_dir), anchors(spark, sf_dir))
    return rounded(s, "mean_radius", "std_radius", "min_radius", "max_radius", "min_separation", "coverage_ratio")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table as a stored part and a new one: by class, so that both are whole classes."""
    p = labelled(spark, sf_dir)
    return p.where("label < 'C5'"), p.where("label >= 'C5'")


@query("SELECT b.id FROM unit b WHERE label >= 'C5' AND NOT EXISTS (SELECT 1 FROM unit a WHERE a.label < 'C5' AND 1 - greatest(1 - list_dot_product(a.n, b.n), 0) > 0.35)")
def cross_batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _halves(spark, sf_dir)
    return dedup.drop_known(new, stored, 0.35).select("id")


@query(
    "SELECT b.id FROM unit b WHERE label >= 'C5' AND NOT EXISTS (SELECT 1 FROM unit a WHERE a.label < 'C5' AND 1 - greatest(1 - list_dot_product(a.n, b.n), 0) > 0.3 "
    "AND (nullif(a.label, 'C1') IS NULL OR nullif(b.label, 'C7') IS NULL OR a.label = b.label))"
)
def cross_batch_dedup_class_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = (h.withColumn("label", F.when(~F.col("label").isin("C1", "C7"), F.col("label"))) for h in _halves(spark, sf_dir))
    return dedup.drop_known(new, stored, 0.3, class_aware=True).select("id")


def _leader_sql(edge: str) -> str:
    """A scan in order of ids, as a recursion that carries the rows kept."""
    return CTE.replace("WITH e AS", "WITH RECURSIVE e AS").rstrip() + f""",
ed AS (SELECT l AS a, r AS b FROM pair WHERE {edge}), top AS (SELECT max(id) AS m FROM e),
r(i, kept) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT i + 1, CASE WHEN EXISTS (SELECT 1 FROM ed WHERE ed.b = r.i + 1 AND list_contains(r.kept, ed.a)) THEN kept
  ELSE list_append(kept, i + 1) END FROM r, top WHERE i < m)
SELECT unnest(kept) AS id FROM r, top WHERE i = m"""


@query()
def leader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.leader_dedup(labelled(spark, sf_dir), 0.35).select("id")


@query()
def spacing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.spacing_filter(points(spark, sf_dir), 0.6).select("id")


SQL["leader_dedup"] = _leader_sql("1 - d > 0.35")
SQL["spacing_filter"] = _leader_sql("d < 0.6")


@query()
def document_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate texts by their hashed n-gram vectors, scanned in order."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    v = encoders.encode(docs, "text", {"text": encoders.hashed_text(64)}).drop("model").withColumn("label", F.lit(None).cast("string"))
    return dedup.leader_dedup(v, 0.9999).select(F.col("id").alias("doc_id"))


SQL["document_leaders"] = """
WITH RECURSIVE raw AS (SELECT doc_id, hex(encode(' ' || lower(coalesce(text, '')) || ' ')) AS h FROM documents),
tri AS (SELECT doc_id, t, count(*) AS times FROM (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 2), lambda i: substr(h, 2 * i + 1, 6))) AS t FROM raw) GROUP BY ALL),
gram AS (SELECT t, (('0x' || substr(t, 1, 2))::INTEGER + 31 * ('0x' || substr(t, 3, 2))::INTEGER + 961 * ('0x' || substr(t, 5, 2))::INTEGER)::UHUGEINT AS g FROM (SELECT DISTINCT t FROM tri)),
place AS (SELECT t, ((xor(g, g >> 7) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) >> 32 AS p FROM gram),
cell AS (SELECT doc_id, ((p >> 1) % 64)::INTEGER AS c, sum(CASE WHEN p % 2 = 1 THEN times ELSE -times END)::DOUBLE AS x FROM tri JOIN place USING (t) GROUP BY ALL),
vec AS (SELECT d.doc_id AS id, list(coalesce(x, 0) ORDER BY k.k) AS v FROM documents d CROSS JOIN range(64) k(k) LEFT JOIN cell ON cell.doc_id = d.doc_id AND cell.c = k.k GROUP BY d.doc_id),
n AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS v FROM vec),
ed AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id < b.id WHERE 1 - greatest(1 - list_dot_product(a.v, b.v), 0) > 0.9999),
late AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS k FROM ed GROUP BY b),
r(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT late.k, CASE WHEN len(list_filter(before, lambda a: NOT list_contains(r.gone, a))) > 0 THEN list_append(gone, b) ELSE gone END FROM r JOIN late ON late.k = r.k + 1)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM r ORDER BY k DESC LIMIT 1))
"""


@query(
    "SELECT i, d, round(low + x * (high - low), 6) + 0 AS x FROM (SELECT i.i AS i, p.d AS d, (list_sum(list_transform(range(0, 20), lambda k: ((i.i + 1) // power(p.b, k)::HUGEINT % p.b) * power(p.b, -(k + 1)))) + "
    "('0x' || substr(md5('42:halton:' || p.d), 1, 8))::BIGINT / 4294967296.0) % 1.0 AS x FROM range((SELECT count(*) FROM e)) i(i), (VALUES (0, 2), (1, 3), (2, 5), (3, 7)) p(d, b)) "
    "JOIN (SELECT dim AS d, min(x) AS low, max(x) AS high FROM (SELECT unnest(range(4))::INTEGER AS dim, unnest(v[1:4]) AS x FROM e) GROUP BY dim) USING (d)"
)
def halton_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many points as there are rows, over the box of their first four axes."""
    p = points(spark, sf_dir).select("id", F.slice("v", 1, 4).alias("v"))
    made = sampling.points_in_box(spark, "halton", p.count(), *sampling.box_arrays(p))
    return rounded(made.select(F.col("id").alias("i"), F.posexplode("v").alias("d", "x")), "x")


@query()
def sobol_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many points as there are rows, over the box of their first eight axes."""
    p = points(spark, sf_dir).select("id", F.slice("v", 1, 8).alias("v"))
    made = sampling.points_in_box(spark, "sobol", p.count(), *sampling.box_arrays(p))
    return rounded(made.select(F.col("id").alias("i"), F.posexplode("v").alias("d", "x")), "x")


def _sobol_sql(dim: int, bits: int = 30) -> str:
    """The sequence by its definition: a point is the shift and the directions that its Gray code names, added without carry."""
    v, shift = sampling.directions(dim, 42, bits)
    rows = ", ".join(f"({d}, {shift[d]}::BIGINT, {v[d].tolist()}::BIGINT[])" for d in range(dim))
    return f"""
SELECT i, d::INTEGER AS d, round(low + state / {float(1 << bits)}::DOUBLE * (high - low), 6) + 0 AS x FROM (
  SELECT i.i AS i, d, list_reduce([shift] || list_transform(range(0, {bits}), lambda b: CASE WHEN (xor(i.i, i.i >> 1) >> b) & 1 = 1 THEN v[b + 1] ELSE 0 END), lambda p, q: xor(p, q)) AS state
  FROM range((SELECT count(*) FROM e)) i(i), (VALUES {rows}) g(d, shift, v))
JOIN (SELECT dim AS d, min(x) AS low, max(x) AS high FROM (SELECT unnest(range({dim}))::INTEGER AS dim, unnest(v[1:{dim}]) AS x FROM e) GROUP BY dim) USING (d)"""


SQL["sobol_points"] = CTE.rstrip() + _sobol_sql(8)


@query(
    "SELECT i.i AS i, dim, round(low + ('0x' || substr(md5('42:' || i.i || ':' || dim), 1, 8))::BIGINT / 4294967296.0 * (high - low), 6) + 0 AS x FROM range(20) i(i), "
    "(SELECT dim, min(x) AS low, max(x) AS high FROM (SELECT unnest(range(64))::INTEGER AS dim, unnest(v) AS x FROM e) GROUP BY dim)"
)
def uniform_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = sampling.box_arrays(points(spark, sf_dir))
    box = sampling.points_in_box(spark, "random", 20, low, high)
    return rounded(box.select(F.col("id").alias("i"), F.posexplode("v").alias("dim", "x")), "x")


_OFF = "off_center AS (SELECT anchor_id, list_transform(n, lambda x, i: x + 0.01 * (i % 3)) AS c FROM chosen), off AS (SELECT anchor_id, c, list_dot_product(c, c) AS q FROM off_center)"


def _off_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points beside the anchors."""
    a = spheres.centers(anchors(spark, sf_dir)).withColumn("v", vec.l2_normalize(F.col("v")))
    return a.withColumn("v", F.transform("v", lambda x, i: x + 0.01 * ((i + 1) % 3)))


@query()
def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.knn_cross(_off_center(spark, sf_dir), points(spark, sf_dir), 1)
    return near.select(F.col("l").alias("anchor_id"), F.col("r").alias("id"))


@query()
def snap_lid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    s = placement.snap(_off_center(spark, sf_dir), p, CONFIG)
    return pairs.distances(s, p, "euclidean", k=1).select(F.col("l").alias("anchor_id"), F.col("r").alias("id"))


_CTE_OFF = CTE.rstrip() + ", " + _OFF + ", odist AS (SELECT anchor_id, id, greatest(1 - list_dot_product(c, n) / sqrt(q), 0) AS d FROM off, unit) "
SQL["snap_nearest"] = _CTE_OFF + "SELECT anchor_id, arg_min(id, (d, id)) AS id FROM odist GROUP BY anchor_id"
SQL["snap_lid_weighted"] = (
    _CTE_OFF + ", five AS (SELECT * FROM odist QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY d, id) <= 5) "
    "SELECT anchor_id, arg_min(id, (-ln(greatest(('0x' || substr(md5('42:snap:' || anchor_id || ':' || id), 1, 8))::BIGINT / 4294967296.0, 1e-12)) * lid, id)) AS id "
    "FROM five JOIN lids USING (id) GROUP BY anchor_id"
)


def _adaptive(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    r = density.adaptive_radius(spheres.centers(anchors(spark, sf_dir)), points(spark, sf_dir), 0.3, method, high=2.0)
    return rounded(r.select(F.col("id").alias("anchor_id"), "radius"), "radius")


_AROUND = "around AS (SELECT anchor_id, id, d, row_number() OVER (PARTITION BY anchor_id ORDER BY d, id) - 1 AS rank FROM far)"


@query()
def adaptive_radius_lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(spark, sf_dir, "LID")


@query()
def adaptive_radius_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(spark, sf_dir, "density")


@query()
def adaptive_radius_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(spark, sf_dir, "kNN")


_CTE_AROUND = CTE.rstrip() + ", " + _AROUND + " "
SQL["adaptive_radius_knn"] = _CTE_AROUND + "SELECT anchor_id, round(least(greatest(avg(d), 0.01), 2), 6) AS radius FROM around WHERE rank BETWEEN 1 AND 10 GROUP BY anchor_id"
SQL["adaptive_radius_density"] = (
    _CTE_AROUND + "SELECT anchor_id, round(least(greatest(0.3 / (sqrt((1 / (avg(d) + 1e-8)) / ((SELECT avg(density) FROM dens) + 1e-8)) + 1e-8), 0.01), 2), 6) AS radius "
    "FROM around WHERE rank BETWEEN 1 AND 10 GROUP BY anchor_id"
)
SQL["adaptive_radius_lid"] = (
    _CTE_AROUND + """, ball AS (SELECT anchor_id, id FROM around WHERE rank BETWEEN 1 AND 20),
local_near AS (SELECT a.anchor_id, a.id AS l, d, row_number() OVER (PARTITION BY a.anchor_id, a.id ORDER BY d) AS rank
  FROM ball a JOIN ball b ON a.anchor_id = b.anchor_id AND a.id <> b.id JOIN both_ways w ON w.l = a.id AND w.r = b.id),
local_last AS (SELECT anchor_id, l, greatest(d, 1e-10) AS last FROM local_near WHERE rank = 19),
local_lid AS (SELECT anchor_id, l, least(greatest(1 / (avg(ln(last / greatest(d, 1e-10))) + 1e-8), 0.1), 100) AS lid
  FROM local_near JOIN local_last USING (anchor_id, l) WHERE rank < 19 GROUP BY anchor_id, l)
SELECT anchor_id, round(least(greatest(0.3 * greatest(0.5, least(10, avg(lid))) / 4, 0.01), 2), 6) AS radius FROM local_lid GROUP BY anchor_id"""
)


@query(
    "SELECT anchor_id, (CASE WHEN m > 0.8 THEN 0.8 WHEN m > 0.4 THEN 0.4 WHEN m > 0.2 THEN 0.2 WHEN m > 0.1 THEN 0.1 WHEN m > 0.05 THEN 0.05 END)::DOUBLE AS radius "
    "FROM (SELECT anchor_id, min(d) AS m FROM far JOIN e USING (id) WHERE label = 'C3' GROUP BY anchor_id) WHERE m > 0.05"
)
def validate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spheres.centers(anchors(spark, sf_dir)).withColumn("radius", F.lit(RADIUS))
    train = labelled(spark, sf_dir).where("label = 'C3'").select("id", "v")
    return rounded(placement.validate(c, train, 0.01).select(F.col("id").alias("anchor_id"), "radius"), "radius")


def _capped_sql(rows: str, low: float, radius: float) -> str:
    """Add the radius ``r`` to rows that have ``free`` (structs with a distance d) and ``allowed``: five bisections, written out."""
    n = lambda x: f"len(list_filter(free, lambda x: x.d < {x}))"
    sql = f"SELECT *, {low}::DOUBLE AS a0, {radius}::DOUBLE AS b0 FROM ({rows})"
    for i in range(5):
        m = f"(a{i} + b{i}) / 2"
        sql = f"SELECT *, CASE WHEN {n(m)} > allowed THEN a{i} ELSE {m} END AS a{i + 1}, CASE WHEN {n(m)} > allowed THEN {m} ELSE b{i} END AS b{i + 1} FROM ({sql})"
    return f"SELECT *, CASE WHEN {n(radius)} > allowed THEN a5 ELSE {radius} END AS r FROM ({sql})"


@query(
    "SELECT anchor_id, round(r, 6) AS radius, len(list_filter(free, lambda x: x.d < r)) AS captured FROM ("
    + _capped_sql("SELECT anchor_id, 5 AS allowed, list({'d': d}) AS free FROM far WHERE d <= 0.8 GROUP BY anchor_id", 0.01, 0.8) + ")"
)
def eval_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius at which each anchor captures at most five rows."""
    d = pairs.distances(points(spark, sf_dir), spheres.centers(anchors(spark, sf_dir)), within=RADIUS)

    def one(g):
        x = g["d"].to_numpy()
        r = placement.capped_radius(x, RADIUS, 5, 0.01)
        return g.head(1)[["r"]].assign(radius=r, captured=int((x < r).sum()))

    return rounded(d.groupBy("r").applyInPandas(one, "r long, radius double, captured long").withColumnRenamed("r", "anchor_id"), "radius")


def _taken(p: DataFrame, accepted: DataFrame) -> DataFrame:
    """(id, split, place): rows that accepted candidates took, with the candidate's place among those."""
    a = placement.to_anchors(accepted, CONFIG)
    return spheres.assign(p.select("id", "v"), a, placed=True).where("anchor_id is not null").select("id", "split", F.col("anchor_id").alias("place"))


def _candidates(p: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows (of each group) that a hash puts first, as candidates of one radius."""
    order = Window.partitionBy(*by or [F.lit(0)]).orderBy("u", "id")
    return p.withColumn("u", vec.uniform(42, F.col("id"))).withColumn("k", F.row_number().over(order).cast("long") - 1).where(F.col("k") < n).withColumn("radius", F.lit(RADIUS))


def _walk_sql(candidates: str, goes_on: str, is_open: str) -> str:
    """Candidates (k, n, cls, goal, fill) in order, as a recursion that carries the rows taken."""
    row = "STRUCT(d DOUBLE, id BIGINT, label VARCHAR)[]"
    offered = (
        "SELECT w.k + 1 AS k, w.taken, w.place, len(w.taken) AS n_eval, o.cls, o.goal, o.fill, t.target, t.target - len(w.taken) + t.overshoot AS allowed, "
        "list_filter(o.near, lambda x: NOT list_contains(list_transform(w.taken, lambda y: y.id), x.id)) AS free "
        f"FROM walk w JOIN offer o ON o.k = w.k + 1 CROSS JOIN total t WHERE {goes_on}"
    )
    capped = _capped_sql(offered, CONFIG.spheres.min_radius, RADIUS)
    return CTE.replace("WITH e AS", "WITH RECURSIVE e AS").rstrip() + f""",
hashed AS (SELECT *, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT / 4294967296.0 AS u FROM unit),
total AS (SELECT floor(count(*) * 0.2)::BIGINT AS target, greatest(1, floor(count(*) * 0.03))::BIGINT AS overshoot FROM e),
cand AS ({candidates}),
offer AS (
  SELECT k, any_value(cls) AS cls, any_value(goal) AS goal, any_value(fill) AS fill, list({{'d': d, 'id': id, 'label': label}} ORDER BY d, id) AS near
  FROM (SELECT c.k, c.cls, c.goal, c.fill, p.id, p.label, greatest(1 - list_dot_product(p.n, c.n), 0) AS d FROM cand c CROSS JOIN unit p) WHERE d <= {RADIUS} GROUP BY k),
walk(k, taken, place, got) AS (
  SELECT -1::BIGINT, []::{row}, -1::BIGINT, []::{row}
  UNION ALL
  SELECT k, CASE WHEN ok THEN list_concat(taken, inside) ELSE taken END, CASE WHEN ok THEN place + 1 ELSE place END,
         CASE WHEN ok THEN list_transform(inside, lambda x: {{'d': x.d / r, 'id': x.id, 'label': x.label}}) ELSE []::{row} END
  FROM (SELECT *, len(inside) > 1 AND {is_open} AS ok FROM (SELECT *, list_filter(free, lambda x: x.d < r) AS inside FROM ({capped}))))
SELECT g.id AS id, CASE WHEN g.d < power(0.5, 1 / 64.0) * 0.7 THEN 'validation' ELSE 'test' END AS split, place FROM (SELECT unnest(got) AS g, place FROM walk)"""


@query()
def closed_loop_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the closed loop over 40 given candidates of one radius: rows taken, and the place of the anchor that took each."""
    p = labelled(spark, sf_dir)
    c = materialise(_candidates(p, 40).select(F.col("k").alias("id"), "v", "radius"), "offered")
    n = p.count()
    ledger = placement.Ledger(int(n * 0.2), 0, max(1, int(n * 0.03)), CONFIG.spheres.min_radius)
    return _taken(p, placement.settle(c, p, ledger, CONFIG))


SQL["closed_loop_accept"] = _walk_sql(
    "SELECT row_number() OVER (ORDER BY u, id) - 1 AS k, n, NULL::VARCHAR AS cls, 0 AS goal, 0 AS fill FROM hashed ORDER BY u, id LIMIT 40", "len(w.taken) < t.target", "true"
)


@query()
def class_aware_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan by classes, rare ones first, over six given candidates of each."""
    p = labelled(spark, sf_dir)
    everything = p.withColumn("split", F.lit("unassigned"))
    counts = placement.class_counts(everything, everything.select("label", "split").limit(0), CONFIG).collect()
    goals = {i: placement.Goal(r.label, r.target) for i, r in enumerate(counts)}
    rank = F.create_map(*[F.lit(x) for i, g in goals.items() for x in (g.label, i)])[F.lower("label")].cast("long")
    c = _candidates(p, 6, "label").withColumn("id", F.shiftleft(rank, placement.RANK) + F.col("k"))
    c = materialise(c.select("id", "v", "radius"), "offered")
    n = p.count()
    ledger = placement.Ledger(int(n * 0.2), 0, max(1, int(n * 0.03)), CONFIG.spheres.min_radius)
    return _taken(p, placement.settle(c, p, ledger, CONFIG, goals))


SQL["class_aware_accept"] = _walk_sql(
    "SELECT row_number() OVER (ORDER BY c, label, u, id) - 1 AS k, n, label AS cls, greatest(1, floor(c * 0.2)) AS goal, floor(greatest(1, floor(c * 0.2)) * 0.8) AS fill "
    "FROM (SELECT *, count(*) OVER (PARTITION BY label) AS c, row_number() OVER (PARTITION BY label ORDER BY u, id) AS nth FROM hashed) WHERE nth <= 6",
    "true",
    "len(list_filter(taken, lambda y: y.label = cls)) < fill AND (n_eval < target OR len(list_filter(taken, lambda y: y.label = cls)) < 0.5 * goal)",
)


def _loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    none = p.limit(0)
    n = p.count()
    placed = placement.closed_loop(p, p, none, none, int(n * 0.2), n, CONFIG)
    return spheres.assign(p, placement.to_anchors(placed, CONFIG), placed=True)


@query()
def closed_loop_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loop(spark, sf_dir)


@query()
def class_aware_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir)
    everything = p.withColumn("split", F.lit("unassigned"))
    none = p.select("id", "v").limit(0)
    n = p.count()
    placed = placement.class_aware_loop(p, everything, none, none, everything.select("label", "split").limit(0), int(n * 0.2), 0, n, CONFIG)
    return spheres.assign(p.select("id", "v"), placement.to_anchors(placed, CONFIG), placed=True)


@query()
def incremental_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches through the engine, the second against the state that the first one left."""
    import dataclasses
    import uuid

    from orbisplit.plans.engine import Engine
    from orbisplit.sources.tables import shared_root

    engine = Engine(spark, f"{shared_root(spark)}/orbisplit/state-{uuid.uuid4().hex}", dataclasses.replace(CONFIG, class_aware=False))
    for name, half in zip(("one", "two"), _halves(spark, sf_dir), strict=True):
        engine.ingest(half, name)
    a = engine.state.assignments()
    return a.select("run_id", "id", "dataset_split", "train_split", "anchor_id", F.round("distance_to_anchor", 6).alias("distance_to_anchor"), "num_containing_anchors")


@query("SELECT split, count(*) AS n FROM assigned GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.split_counts(assigned(spark, sf_dir))


@query(
    "SELECT count(*) AS total_points, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS validation_count, "
    "count(*) FILTER (split = 'test') AS test_count, count(*) FILTER (split = 'unassigned') AS unassigned_count, round(avg((split = 'train')::INT), 6) AS train_ratio, "
    "round(avg((split = 'validation')::INT), 6) AS validation_ratio, round(avg((split = 'test')::INT), 6) AS test_ratio, round(avg((split IN ('validation', 'test'))::INT), 6) AS eval_ratio, "
    "round(avg((split <> 'train')::INT), 6) AS coverage_ratio, count(DISTINCT anchor_id) AS num_anchors_used FROM assigned"
)
def split_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.statistics(assigned(spark, sf_dir)), *[f"{x}_ratio" for x in ("train", "validation", "test", "eval", "coverage")])


def _with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).join(labelled(spark, sf_dir).select("id", "label"), "id")


@query("SELECT label AS run_id, sum(c)::BIGINT AS n, string_agg(split || '=' || c, ',' ORDER BY split) AS splits FROM (SELECT label, split, count(*) AS c FROM assigned GROUP BY ALL) GROUP BY label")
def run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = report.run_histogram(_with_label(spark, sf_dir).withColumnRenamed("label", "run_id"))
    return h.withColumn("splits", F.array_join(F.transform(F.map_entries("splits"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ","))


@query(
    "SELECT count(*) AS anchors, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std, min(c) AS low, quantile_cont(c, 0.25) AS p25, quantile_cont(c, 0.5) AS p50, "
    "quantile_cont(c, 0.75) AS p75, max(c) AS high FROM (SELECT count(*) AS c FROM assigned WHERE anchor_id IS NOT NULL GROUP BY anchor_id)"
)
def points_per_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.points_per_anchor(assigned(spark, sf_dir)), "mean", "std")


@query("SELECT round(avg(coalesce(c, 0)), 6) AS mean_points FROM chosen LEFT JOIN (SELECT anchor_id, count(*) AS c FROM assigned GROUP BY 1) USING (anchor_id)")
def mean_points_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.mean_points_of_all(assigned(spark, sf_dir), anchors(spark, sf_dir)), "mean_points")


@query("SELECT lower(label) AS label, count(*) AS total, count(*) FILTER (split IN ('validation', 'test')) AS n_eval FROM assigned GROUP BY 1")
def class_eval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.class_counts(_with_label(spark, sf_dir))


@query(
    "SELECT a.id, coalesce(string_agg(b.id, ',' ORDER BY b.id), '') AS similar FROM assigned a LEFT JOIN assigned b ON a.anchor_id = b.anchor_id AND a.id <> b.id GROUP BY a.id"
)
def similar_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.similar_members(assigned(spark, sf_dir))


@query("SELECT count(*) FILTER (n_containing > 0 OR anchor_id IS NOT NULL) AS covered, count(*) AS n FROM assigned")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage(assigned(spark, sf_dir))


@query("SELECT id, split IN ('train', 'unassigned') AS trains FROM assigned")
def train_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("id", report.train_mask(F.col("split"), "split").alias("trains"))


@query("SELECT id, CASE split WHEN 'validation' THEN 'val' WHEN 'unassigned' THEN 'train' ELSE split END AS train_split FROM assigned")
def split_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("id", vec.split_name(F.col("split")).alias("train_split"))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector by three models: as it is, a little turned, and with its places reversed."""
    p = points(spark, sf_dir)
    turned = F.transform("v", lambda x, i: x + 0.1 * ((i + 1) % 2))
    other = {"a": F.col("v"), "b": turned, "c": F.reverse("v")}
    return p.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("v")) for m, c in other.items()])).alias("m")).select("id", "m.model", "m.v")


_MODELS = """, ms AS (SELECT id, v AS p, list_transform(v, lambda x, i: x + 0.1 * (i % 2)) AS b, list_reverse(v) AS c FROM e),
sims AS (SELECT *, list_dot_product(p, b) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(b, b)) + 1e-8) AS ab,
  list_dot_product(p, c) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(c, c)) + 1e-8) AS ac,
  list_dot_product(b, c) / (sqrt(list_dot_product(b, b)) * sqrt(list_dot_product(c, c)) + 1e-8) AS bc FROM ms) """


@query()
def consensus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = encoders.consensus_union(_models(spark, sf_dir), "a", 0.5)
    return rounded(u.select("id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


@query()
def consensus_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.consensus_agree(_models(spark, sf_dir), 0.1)


SQL["consensus_union"] = (
    CTE.rstrip() + _MODELS + "SELECT id, round((list_sum(p) + CASE WHEN ab >= 0.5 THEN list_sum(b) ELSE 0 END + CASE WHEN ac >= 0.5 THEN list_sum(c) ELSE 0 END) "
    "/ (1 + (ab >= 0.5)::INT + (ac >= 0.5)::INT), 6) + 0 AS total FROM sims"
)
SQL["consensus_agree"] = CTE.rstrip() + _MODELS + "SELECT id, ab >= 0.1 AND ac >= 0.1 AND bc >= 0.1 AS agree FROM sims"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


@query("SELECT event_id, round((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1), 6) AS position FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def temporal_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.ordered(_events(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "position"), "position")


@query(
    "SELECT event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS arc FROM "
    "(SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS s FROM events)"
)
def trajectory_arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = report.arc_length(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ["value"])
    return a.select("event_id", F.round("arc", 4).alias("arc"))


@query(
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) x "
    "WHERE EXISTS (SELECT 1 FROM range(11) k(k) WHERE floor(k.k * 0.1::DOUBLE * (x.n - 1) + 1e-9) = x.i)"
)
def fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.at_fractions(_events(spark, sf_dir), "user_id", ["ts", "event_id"], 0.1).select("event_id")


@query("SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id")
def first_seen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_seen(_events(spark, sf_dir), "user_id", "event_id")


@query("SELECT anchor_id, id, rank FROM (SELECT anchor_id, id, row_number() OVER (PARTITION BY anchor_id ORDER BY distance, id) AS rank FROM assigned WHERE anchor_id IS NOT NULL) WHERE rank <= 3")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.representatives(assigned(spark, sf_dir), 3).select("anchor_id", "id", F.col("rank").cast("long").alias("rank"))


_FAR = ", s1 AS (SELECT 0 AS place, arg_max(anchor_id, (list_distance(v, m), -anchor_id)) AS anchor_id FROM chosen, (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS a FROM chosen, range(1, 65) r(i) GROUP BY i)))"
for _i in range(1, 5):
    _FAR += (
        f", s{_i + 1} AS (SELECT * FROM s{_i} UNION ALL SELECT {_i}, arg_max(anchor_id, (d, -anchor_id)) FROM ("
        f"SELECT c.anchor_id, min(list_distance(c.v, t.v)) AS d FROM chosen c CROSS JOIN chosen t WHERE t.anchor_id IN (SELECT anchor_id FROM s{_i}) GROUP BY c.anchor_id))"
    )


@query()
def farthest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spread order of the anchors."""
    a = anchors(spark, sf_dir)
    return sampling.farthest_points(a.select(F.col("anchor_id").alias("id"), F.col("center").alias("v")), 5).withColumnRenamed("id", "anchor_id")


SQL["farthest_point"] = CTE.rstrip() + _FAR + " SELECT place::BIGINT AS place, anchor_id FROM s5"


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.pca(points(spark, sf_dir), 2).select("id", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_plane(spark, sf_dir), "x", "y")


def _axis_sql(name: str, matrix: str, squarings: int = 13) -> str:
    """CTEs that end with ``name`` (w): the main axis of a matrix (m), from its power, whose rows are multiples of the axis. In the row of the
    largest weight that weight is positive."""
    out = f", {name}0 AS MATERIALIZED ({matrix})"
    for i in range(squarings):
        out += (
            f", {name}{i + 1} AS MATERIALIZED (SELECT list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / s)) AS m "
            f"FROM (SELECT m, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS s FROM {name}{i}))"
        )
    row = "list_transform(m, lambda r: list_dot_product(r, r))"
    return out + f", {name} AS MATERIALIZED (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS w FROM (SELECT m[list_position({row}, list_max({row}))] AS r FROM {name}{squarings}))"


SQL["pca_2d"] = CTE.rstrip() + ", mid AS MATERIALIZED (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(v[i]) AS a FROM e, range(1, 65) r(i) GROUP BY i))" + _axis_sql(
    "one", "SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM (SELECT i, j, covar_samp(v[i], v[j]) AS c FROM e, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j) GROUP BY i)"
) + _axis_sql(
    "two",
    "SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * w[i] * w[j])) AS m FROM (SELECT m, w, list_dot_product(w, list_transform(m, lambda r: list_dot_product(r, w))) AS l FROM one0, one)",
) + (
    " SELECT id, round(list_dot_product(c, one.w), 6) + 0 AS x, round(list_dot_product(c, two.w), 6) + 0 AS y "
    "FROM (SELECT id, list_transform(v, lambda x, i: x - mu[i]) AS c FROM e, mid), one, two"
)


@query("SELECT a.i AS a, b.i AS b, (a.i = b.i)::INT::DOUBLE AS covariance FROM range(64) a(i), range(64) b(i) WHERE a.i <= b.i")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariances of whitened vectors, which are those of independent axes of variance one."""
    w = density.whiten(points(spark, sf_dir)).select("id", F.posexplode("v").alias("a", "x"))
    both = w.join(w.select("id", F.col("a").alias("b"), F.col("x").alias("y")), "id").where("a <= b")
    return rounded(both.groupBy(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.covar_samp("x", "y").alias("covariance")), "covariance")


@query(
    "SELECT gx::INTEGER AS gx, gy::INTEGER AS gy, round(CASE WHEN max(h) >= 0.05 THEN max(h) END, 6) AS heat FROM (SELECT gx, gy, "
    "exp(-(power(-1 + gx * (2.0::DOUBLE / 29) - v[1] * 4, 2) + power(-1 + gy * (2.0::DOUBLE / 29) - v[2] * 4, 2)) / (2 * 0.2 * 0.2)) AS h "
    "FROM range(30) x(gx), range(30) y(gy), chosen) GROUP BY gx, gy"
)
def heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = anchors(spark, sf_dir).select((F.col("center")[0] * 4).alias("cx"), (F.col("center")[1] * 4).alias("cy"), F.lit(0.2).alias("sigma"))
    return rounded(report.heatmap(c, 30, (-1.0, -1.0), (1.0, 1.0)), "heat")


def _surface(n: int, center: str = "n", share: str = "1") -> str:
    """A CTE: points around the anchors, in lists of components."""
    draw = lambda d: f"('0x' || substr(md5('42:' || anchor_id || ':' || i || ':' || {d}), 1, 8))::BIGINT / 4294967296.0"
    return f"""surface AS (
  SELECT anchor_id, i, m, list_transform(list_zip(o, c), lambda z: (cos(a) * z[2] + sin(a) * z[1]) * sqrt(list_dot_product(m, m))) AS v FROM (
    SELECT anchor_id, i, m, c, a, list_transform(o, lambda x: x / greatest(sqrt(list_dot_product(o, o)), 1e-8)) AS o FROM (
      SELECT anchor_id, i, m, c, a, list_transform(list_zip(o, c), lambda z: z[1] - z[2] * along) AS o FROM (
        SELECT *, list_dot_product(o, c) AS along FROM (
          SELECT anchor_id, i, {center} AS m, n AS c, acos(greatest(least(1 - {RADIUS}::DOUBLE * {share.format(u=draw("'share'"))}, 1), -1)) AS a,
                 list_transform(range(0, 64), lambda d: sqrt(-2 * ln(greatest({draw("(2 * d)")}, 1e-12))) * cos(2 * pi() * {draw("(2 * d + 1)")})) AS o
          FROM chosen, range(0, {n}) r(i))))))"""


_SURFACE = _surface(50)


def _unit_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(anchors(spark, sf_dir).select("anchor_id", vec.l2_normalize(F.col("center")).alias("center"), "base_radius"), "unit-anchors")


@query()
def surface_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at each anchor's radius: all axes, and how far they are from the centre."""
    a = _unit_anchors(spark, sf_dir)
    p = report.surface_points(a, 50).join(a, "anchor_id").withColumn("distance", 1 - vec.dot(F.col("v"), F.col("center")))
    p = materialise(p, "surface").select("anchor_id", "i", "distance", F.posexplode("v").alias("d", "x"))
    return rounded(p.select("anchor_id", F.col("i").cast("long").alias("i"), F.col("d").cast("long").alias("d"), "x", "distance"), "x", "distance")


SQL["surface_points"] = CTE.rstrip() + ", " + _SURFACE + f" SELECT anchor_id, i, d, round(v[d + 1], 6) + 0 AS x, round({RADIUS}::DOUBLE, 6) AS distance FROM surface, range(64) r(d)"


@query()
def heatmap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat by the spread of each anchor's rows on two axes; rows of an anchor are few here, so surface points fill them up."""
    a = _unit_anchors(spark, sf_dir)
    on = lambda c: [F.col(c)[0].alias("x"), F.col(c)[1].alias("y")]
    rows = assigned(spark, sf_dir).where("anchor_id is not null").join(points(spark, sf_dir), "id").select("anchor_id", vec.l2_normalize(F.col("v")).alias("v"))
    rows = materialise(rows, "unit-rows").select("anchor_id", *on("v"))
    centers = a.select("anchor_id", F.col("center")[0].alias("cx"), F.col("center")[1].alias("cy"))
    spread = report.spread(rows, centers, report.surface_points(a, 50).select("anchor_id", "i", *on("v")), 2.0)
    return rounded(report.heatmap(spread, 40, (-1.0, -1.0), (1.0, 1.0)), "heat")


SQL["heatmap_filled"] = CTE.rstrip() + ", " + _SURFACE + """,
many AS (SELECT anchor_id, count(*) AS n FROM assigned WHERE anchor_id IS NOT NULL GROUP BY anchor_id),
plane AS (
  SELECT anchor_id, n[1] AS x, n[2] AS y FROM assigned JOIN unit USING (id) WHERE anchor_id IS NOT NULL
  UNION ALL SELECT anchor_id, v[1], v[2] FROM surface LEFT JOIN many USING (anchor_id) WHERE i < 50 - coalesce(n, 0)),
sigma AS (SELECT anchor_id, any_value(c.n[1]) AS cx, any_value(c.n[2]) AS cy, avg(sqrt(power(x - c.n[1], 2) + power(y - c.n[2], 2))) AS s FROM plane JOIN chosen c USING (anchor_id) GROUP BY anchor_id),
g AS (
  SELECT gx, gy, max(exp(-(power(-1 + gx * (2.0::DOUBLE / 39) - cx, 2) + power(-1 + gy * (2.0::DOUBLE / 39) - cy, 2)) / (2 * s * s))) AS h FROM range(40) a(gx), range(40) b(gy), sigma GROUP BY gx, gy)
SELECT gx::INTEGER AS gx, gy::INTEGER AS gy, round(CASE WHEN h >= 0.05 THEN h END, 6) AS heat FROM g"""


@query()
def center_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where centres are shown: every second one has no projection of its own."""
    rows = points(spark, sf_dir).withColumn("p", F.slice("v", 1, 2))
    beside = F.transform("center", lambda x, i: x + 0.01 * ((i + 1) % 3))
    c = anchors(spark, sf_dir).select("anchor_id", beside.alias("v")).withColumn("p", F.when(F.col("anchor_id") % 2 == 0, F.slice("v", 1, 2)))
    placed = report.placed_centers(c, rows)
    return rounded(placed.select("anchor_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")), "x", "y")


SQL["center_positions"] = CTE.rstrip() + """, moved AS (SELECT anchor_id, list_transform(v, lambda x, i: x + 0.01 * (i % 3)) AS c FROM chosen)
SELECT anchor_id, round(p[1], 6) + 0 AS x, round(p[2], 6) + 0 AS y FROM (
  SELECT anchor_id, c AS p FROM moved WHERE anchor_id % 2 = 0
  UNION ALL SELECT anchor_id, arg_min(v, (list_distance(v, c), id)) FROM moved CROSS JOIN e WHERE anchor_id % 2 = 1 GROUP BY anchor_id)"""


@query(
    "SELECT event_id, round(coalesce(x, 0), 6) + 0 AS x FROM ("
    "SELECT event_id, user_id % 7 AS folder, dense_rank() OVER (PARTITION BY user_id % 7 ORDER BY f, user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k "
    "FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)) LEFT JOIN ("
    "SELECT vec_id % 7 AS folder, dense_rank() OVER (PARTITION BY vec_id % 7 ORDER BY label) AS n, row_number() OVER (PARTITION BY vec_id % 7, label ORDER BY vec_id) AS k, embedding[1]::DOUBLE AS x "
    "FROM embeddings) USING (folder, n, k)"
)
def aligned_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as rows of runs, in seven folders; vectors of labels as stored batches."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("folder"), F.col("user_id").alias("run"), F.col("event_id").alias("place"), "event_id")
    e = table(spark, sf_dir, "embeddings")
    stored = e.select((F.col("vec_id") % 7).alias("folder"), F.col("label").alias("batch"), F.col("vec_id").alias("place"), vec.doubles(F.col("embedding")).alias("v"))
    return rounded(report.align(rows, stored, 64).select("event_id", F.col("v")[0].alias("x")), "x")


@query(
    "SELECT split, bin, n, round(n / (sum(n) OVER (PARTITION BY split) * 0.1), 6) AS density FROM (SELECT split, least(floor((v[1] + 1) / 0.1::DOUBLE), 19)::INTEGER AS bin, count(*) AS n "
    "FROM assigned JOIN e USING (id) WHERE v[1] BETWEEN -1 AND 1 GROUP BY ALL)"
)
def component_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assigned(spark, sf_dir).join(points(spark, sf_dir), "id").withColumn("x", F.col("v")[0])
    return rounded(report.histogram(a, "x", 20, -1.0, 1.0, "split"), "density")


@query()
def density_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select(F.col("v")[0].alias("cx"), F.col("v")[1].alias("cy"))
    return rounded(report.kde(p, 20, (-0.5, -0.5), (0.5, 0.5), 0.1), "density")


SQL["density_surface"] = (
    CTE + "SELECT gx::INTEGER AS gx, gy::INTEGER AS gy, round(avg(exp(-(power(-0.5 + gx / 19.0 - v[1], 2) + power(-0.5 + gy / 19.0 - v[2], 2)) / (2 * 0.01))) / (2 * pi() * 0.01), 6) AS density "
    "FROM range(20) x(gx), range(20) y(gy), e GROUP BY gx, gy"
)


@query()
def split_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assigned(spark, sf_dir).join(points(spark, sf_dir), "id")
    return rounded(report.hulls(a.select("split", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), ["split"]), "x", "y")


SQL["split_hulls"] = CTE.replace("WITH e AS", "WITH RECURSIVE e AS").rstrip() + """,
flat AS (SELECT split, v[1] AS x, v[2] AS y FROM assigned JOIN e USING (id)),
side AS (SELECT p.split, p.x, p.y, q.x AS to_x, q.y AS to_y FROM flat p JOIN flat q ON p.split = q.split AND (p.x, p.y) <> (q.x, q.y)
  WHERE NOT EXISTS (SELECT 1 FROM flat r WHERE r.split = p.split AND (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0)),
way(split, place, x, y) AS (SELECT split, 0, arg_min(x, (x, y)), arg_min(y, (x, y)) FROM side GROUP BY split
  UNION ALL SELECT s.split, w.place + 1, s.to_x, s.to_y FROM way w JOIN side s ON s.split = w.split AND s.x = w.x AND s.y = w.y
  WHERE (s.to_x, s.to_y) <> (SELECT min((f.x, f.y)) FROM side f WHERE f.split = s.split))
SELECT split, place, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM way"""


@query()
def sphere_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a sphere's boundary, moved to have its centre as their mean: all components."""
    s = report.sphere_samples(anchors(spark, sf_dir), 20)
    return rounded(s.select("anchor_id", "i", F.posexplode("v").alias("dim", "x")), "x")


SQL["sphere_boundary"] = CTE.rstrip() + ", " + _surface(20, "v") + """,
mean AS (SELECT anchor_id, d, avg(v[d + 1]) AS x FROM surface, range(64) r(d) GROUP BY ALL)
SELECT anchor_id, i::INTEGER AS i, d::INTEGER AS dim, round(v[d + 1] + m[d + 1] - x, 6) + 0 AS x FROM surface JOIN mean USING (anchor_id)"""


@query()
def sphere_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within a sphere: all components, and how far each is from the centre."""
    a = anchors(spark, sf_dir)
    s = report.sphere_samples(a, 20, volume=True).join(a.select("anchor_id", "center"), "anchor_id")
    far = 1 - vec.dot(F.col("v"), F.col("center")) / (vec.norm(F.col("v")) * vec.norm(F.col("center")))
    s = materialise(s.select("anchor_id", "i", "v", far.alias("distance")), "volume")
    return rounded(s.select("anchor_id", "i", "distance", F.posexplode("v").alias("dim", "x")), "x", "distance")


SQL["sphere_volume"] = CTE.rstrip() + ", " + _surface(20, "v", "{u}") + """
SELECT anchor_id, i::INTEGER AS i, d::INTEGER AS dim, round(v[d + 1], 6) + 0 AS x,
       round(1 - list_cosine_similarity(v, m), 6) + 0 AS distance FROM surface, range(64) r(d)"""


@query("SELECT anchor_id, count(*) AS n, round(avg(sqrt(power(e.v[1] - c.v[1], 2) + power(e.v[2] - c.v[2], 2))), 6) AS radius FROM assigned JOIN e USING (id) JOIN chosen c USING (anchor_id) GROUP BY anchor_id HAVING count(*) >= 2")
def projected_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assigned(spark, sf_dir).join(points(spark, sf_dir), "id")
    c = anchors(spark, sf_dir).select("anchor_id", F.col("center")[0].alias("cx"), F.col("center")[1].alias("cy"))
    a = a.join(c, "anchor_id").withColumn("x", F.col("v")[0]).withColumn("y", F.col("v")[1])
    n = a.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(report.projected_radius(a).join(n, "anchor_id").select("anchor_id", "n", "radius"), "radius")


@query("SELECT anchor_id, 'data_point' AS kind FROM chosen")
def anchor_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spheres.anchor_kinds(anchors(spark, sf_dir), points(spark, sf_dir))


@query("SELECT l, r, rank, round(d, 6) AS d FROM near WHERE rank <= 20")
def knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of knn_self, by cells of the metric space and in two passes, as for large tables."""
    p = points(spark, sf_dir)
    c = cells.build(p, p.count(), "cosine", cell=64)
    near = pairs.nearest(cells.nearest_by_cells(p, c, 20, other=True)[0], 20)
    return rounded(near, "d").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT l, r, round(d, 6) AS d FROM pair WHERE d <= 0.8")
def close_pairs_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of cosine_pairs_close, by cells."""
    p = points(spark, sf_dir)
    return rounded(cells.close_self_pairs(cells.build(p, p.count(), "cosine", cell=64), 0.8), "d")


@query()
def kmeans_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.kmeans_centers(points(spark, sf_dir), 6)


@query(
    "SELECT anchor_id, id FROM assigned WHERE distance < 1e-4 UNION ALL SELECT a.anchor_id, e.id FROM chosen a JOIN e ON list_distance(a.v, e.v) < 1e-4 "
    "WHERE a.anchor_id NOT IN (SELECT anchor_id FROM assigned WHERE distance < 1e-4)"
)
def center_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spheres.center_rows(assigned(spark, sf_dir), points(spark, sf_dir), anchors(spark, sf_dir))


@query("SELECT DISTINCT a.anchor_id, e.id FROM chosen a JOIN e ON list_distance(a.v, e.v) < 1e-4")
def center_rows_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres that no row was assigned to yet: all rows in their place."""
    nothing_yet = spheres.assign(points(spark, sf_dir), anchors(spark, sf_dir).where("anchor_id < 0"))
    return spheres.center_rows(nothing_yet, points(spark, sf_dir), anchors(spark, sf_dir))


@query(
    "SELECT id, arg_min(anchor_id, (d, anchor_id)) AS anchor_id, round(min(d), 6) AS distance FROM far WHERE id IN (SELECT id FROM assigned WHERE split = 'train' AND anchor_id IS NULL) GROUP BY id"
)
def closest_anchor_of_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = assigned(spark, sf_dir).where("split = 'train' and anchor_id is null").select("id")
    near = spheres.nearest_anchor(points(spark, sf_dir).join(free, "id", "left_semi"), anchors(spark, sf_dir))
    return rounded(near.select("id", "anchor_id", "distance"), "distance")


@query("SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source)::INTEGER AS ordinal FROM (SELECT DISTINCT lang, source FROM documents)")
def nth_of_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nth_of_folder(table(spark, sf_dir, "documents").select("lang", "source").distinct(), "lang", "source")


@query("SELECT DISTINCT source || '_1' AS run_id, source AS label FROM documents")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("_1")).alias("run_id"), F.concat(F.lit("/data/"), "source", F.lit("/images")).alias("folder_path"))
    return report.run_labels(runs.distinct())


@query("SELECT DISTINCT 'run_' || lang AS run_id, lang AS label FROM documents")
def run_labels_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select(F.concat(F.lit("run_"), "lang").alias("run_id"), F.concat(F.lit("/data/"), "lang", F.lit("/images")).alias("folder_path"))
    return report.run_labels(runs.distinct())


@query()
def radius_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radii that neighbours give the anchors, in ten bins."""
    return rounded(report.histogram(_adaptive(spark, sf_dir, "kNN"), "radius", 10, 0.0, 2.0), "density")


SQL["radius_histogram"] = (
    "SELECT bin, n, round(n / (sum(n) OVER () * 0.2), 6) AS density FROM (SELECT least(floor(radius / 0.2::DOUBLE), 9)::INTEGER AS bin, count(*) AS n FROM ("
    + SQL["adaptive_radius_knn"] + ") GROUP BY 1)"
)


@query(
    "SELECT gx::INTEGER AS gx, gy::INTEGER AS gy, round(CASE WHEN max(h) >= 0.05 THEN max(h) END, 6) AS heat FROM (SELECT gx, gy, "
    "exp(-(power(-0.5 + gx * (1.0::DOUBLE / 29) - v[1], 2) + power(-0.5 + gy * (1.0::DOUBLE / 29) - v[2], 2)) / (2 * s * s)) AS h FROM range(30) x(gx), range(30) y(gy), "
    "(SELECT any_value(c.v) AS v, avg(sqrt(power(e.v[1] - c.v[1], 2) + power(e.v[2] - c.v[2], 2))) AS s FROM assigned JOIN e USING (id) JOIN chosen c USING (anchor_id) "
    "GROUP BY anchor_id HAVING count(*) >= 2)) GROUP BY gx, gy"
)
def heatmap_by_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor's Gaussian as wide as its rows lie from its centre in the plane."""
    c = anchors(spark, sf_dir).select("anchor_id", F.col("center")[0].alias("cx"), F.col("center")[1].alias("cy"))
    rows = assigned(spark, sf_dir).join(points(spark, sf_dir), "id").join(c, "anchor_id").withColumn("x", F.col("v")[0]).withColumn("y", F.col("v")[1])
    c = c.join(report.projected_radius(rows).withColumnRenamed("radius", "sigma"), "anchor_id")
    return rounded(report.heatmap(c, 30, (-0.5, -0.5), (0.5, 0.5)), "heat")


@query("SELECT source AS run_id, lang AS label, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'pages', NULL, count(*) FROM pages")
def annotation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("lang").alias("label"))
    b = table(spark, sf_dir, "pages").select(F.lit("pages").alias("run_id"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"SELECT page_id, lower(regexp_extract(url, '(\.[^./\\]+)$', 1)) AS suffix, string_split(replace(url, '\', '/'), '/')[-1] AS base, "
    r"coalesce(string_split(replace(url, '\', '/'), '/')[-2], '') AS parent, regexp_replace(url, '_[^_]*$', '') AS folder FROM pages"
)
def path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", vec.suffix(u).alias("suffix"), vec.base_name(u).alias("base"), vec.parent_name(u).alias("parent"), vec.folder_of_run(u).alias("folder"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of all points by the first region they lie in."""
    return report.split_counts(assigned(spark, sf_dir))

