"""Column expressions over ``array<double>`` vectors. Readable forms for small sets; big pair sets use the block kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest norm that a vector is divided by.
EPS = 1e-8
METRICS = ("cosine", "euclidean", "manhattan")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector over its norm, the norm at least EPS."""
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x / n)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine: 1 - cos, never below 0, without an upper bound; an unknown metric is an error."""
    if metric == "cosine":
        return F.greatest(1.0 - dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS))), F.lit(0.0))
    if metric == "euclidean":
        return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "manhattan":
        return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown metric {metric!r}")


def similarity(d: Column, metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return 1.0 - d if metric == "cosine" else 1.0 / (1.0 + d)


def uniform(seed: int | str, *parts: Column) -> Column:
    """A number in [0, 1) from a seed and a key, the same in any engine that has MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_name(split: Column) -> Column:
    """Short names of splits: validation is val, what is unassigned trains."""
    return F.when(split == "validation", "val").when(split == "unassigned", "train").otherwise(split)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), F.lit(-2)), F.lit(""))


def folder_of_run(run_id: Column) -> Column:
    """A run's name without its time stamp."""
    return F.regexp_replace(run_id, "_[^_]*$", "")
