"""Settings, read from YAML or mappings and validated. Reading leaves the given mapping as it is."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Splits:
    train: float = 0.8
    eval: float = 0.2
    validation_share: float = 0.5
    tolerance: float = 0.03
    min_eval_per_batch: float = 0.05


@dataclass(frozen=True)
class Spheres:
    radius: str = "percentile"
    percentile: float = 50.0
    radius_scale: float = 1.0
    scale_factor: float = 1.0
    min_radius: float = 0.01
    max_radius: float = 0.5
    fixed_radius: float = 0.05
    buffer: float = 0.0
    adaptive: str = "LID"
    nested: bool = True
    strategy: str = "random"


@dataclass(frozen=True)
class Placement:
    method: str = "qmc"
    engine: str = "sobol"
    min_distance: float = 0.1
    min_points_per_anchor: int = 3
    overpropose: int = 3
    snap_k: int = 5
    snap: str = "lid"


@dataclass(frozen=True)
class Dedup:
    enabled: bool = True
    threshold: float = 0.98


@dataclass(frozen=True)
class Pixels:
    """What happens to images before they are encoded: size of the shorter edge, side of the middle square, range, mean and deviation
    (those of the encoder's family where they are not given)."""

    resize: int | None = 224
    crop: int | None = 224
    rescale: bool = True
    normalise: bool = True
    mean: tuple[float, ...] | None = None
    deviation: tuple[float, ...] | None = None


@dataclass(frozen=True)
class Encoding:
    """The encoder of images by name, others whose vectors are combined with its own, and how."""

    primary: str = "grid-8"
    others: tuple[str, ...] = ()
    consensus: str = "intersection"
    threshold: float = 0.8
    normalise: bool = True


@dataclass(frozen=True)
class Config:
    splits: Splits = field(default_factory=Splits)
    spheres: Spheres = field(default_factory=Spheres)
    placement: Placement = field(default_factory=Placement)
    dedup: Dedup = field(default_factory=Dedup)
    metric: str = "cosine"
    density_transform: str = "none"
    class_aware: bool = True
    streaming: bool = True
    encoding: Encoding = field(default_factory=Encoding)
    pixels: Pixels = field(default_factory=Pixels)
    log_level: str = "INFO"
    log_file: str = "orbisplit.log"
    seed: int = 42

    def validate(self) -> Config:
        s, h = self.splits, self.spheres
        problems = [
            (not 0 < s.train < 1 or not 0 < s.eval < 1, "train and eval shares lie between 0 and 1"),
            (abs(s.train + s.eval - 1) > 1e-6, "train and eval shares add up to 1"),
            (h.nested and not 0 < s.validation_share < 1, "the validation share lies between 0 and 1"),
            (h.adaptive != "none" and not h.min_radius < h.max_radius, "the least radius is below the largest"),
            (bool(self.encoding.others) and not 0 < self.encoding.threshold <= 1, "the consensus threshold lies above 0, up to 1"),
        ]
        wrong = [text for bad, text in problems if bad]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def digest(self) -> str:
        return hashlib.md5(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()


#: Settings as other tools' files name them, by section, with their place here; None: read, and without effect.
SECTIONS: dict[str, dict[str, str | None]] = {
    "foundation_models": {
        "primary_model": "encoding.primary", "multi_encoder_enabled": None, "additional_models": "encoding.others", "consensus_method": "encoding.consensus",
        "consensus_threshold": "encoding.threshold",
    },
    "preprocessing": {
        "use_fast": None, "do_resize": None, "resize_size": "pixels.resize", "do_center_crop": None, "crop_size": "pixels.crop", "do_rescale": "pixels.rescale",
        "do_normalize": "pixels.normalise", "image_mean": "pixels.mean", "image_std": "pixels.deviation", "do_convert_rgb": None,
    },
    "embedding": {"device": None, "batch_size": None, "normalize_embeddings": "encoding.normalise", "io_workers": None},
    "deduplication": {"enabled": "dedup.enabled", "similarity_threshold": "dedup.threshold", "method": None},
    "density_transformation": {"enabled": None, "method": "density_transform", "stretch_high_density_regions": None, "density_threshold": None},
    "anchor_placement": {
        "method": "placement.method", "qmc_sequence": "placement.engine", "min_anchor_distance": "placement.min_distance", "snap_strategy": "placement.snap",
        "lid_snap_k": "placement.snap_k",
    },
    "hypersphere": {
        "radius_computation": None, "adaptive_method": "spheres.adaptive", "base_radius_mode": "spheres.radius", "base_radius_fixed": "spheres.fixed_radius",
        "base_radius_percentile": "spheres.percentile", "base_radius_scale": "spheres.radius_scale", "radius_scale_factor": "spheres.scale_factor",
        "min_radius": "spheres.min_radius", "max_radius": "spheres.max_radius", "fixed_radius": None, "buffer_zones": None,
    },
    "nested_shells": {"enabled": "spheres.nested", "validation_ratio": "splits.validation_share", "shell_configuration": "spheres.strategy"},
    "dataset_splits": {
        "train_ratio": "splits.train", "eval_ratio": "splits.eval", "min_eval_per_batch": "splits.min_eval_per_batch", "eval_tolerance": "splits.tolerance", "ratio_monitoring": None,
    },
    "streaming": {"enabled": "streaming", "persistent_anchors": None, "anchor_persistence_path": None},
    "ann_index": {"index_type": None, "hnsw": None, "memory_mapping": None, "index_persistence_path": None},
    "distance": {"metric": "metric", "precision": None},
    "logging": {"level": "log_level", "log_file": "log_file"},
    "output": {"output_path": None},
    "experimental": {"dynamic_anchor_adjustment": None, "adaptive_buffer_zones": None, "hierarchical_anchors": None},
    "random_seed": {"random_seed": "seed", "set_global_seeds": None},
}
#: What those files call some values.
VALUES = {
    "placement.method": {"QMC": "qmc"},
    "placement.snap": {"lid_weighted": "lid"},
    "spheres.radius": {"auto": "percentile"},
    "spheres.adaptive": {"local_density": "density", "knn_distance": "kNN"},
    "density_transform": {"LID": "lid", "PCA": "whiten"},
}


def from_sections(given: Mapping[str, Any]) -> dict[str, Any]:
    """Settings in sections, by the names here. Switches that turn a setting off come after it; unknown names are errors."""
    made: dict[str, Any] = {}

    def put(place: str, value: Any) -> None:
        *above, last = place.split(".")
        at = made
        for name in above:
            at = at.setdefault(name, {})
        at[last] = value

    for section, values in given.items():
        if section == "class_aware":
            put(section, bool(values))
            continue
        names = SECTIONS.get(section)
        values = values or {}
        if extra := ([section] if names is None else sorted(set(values) - set(names))):
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        for name, value in values.items():
            place = names[name]
            if place and value is not None:
                known = VALUES.get(place, {})
                put(place, tuple(value) if isinstance(value, list) else known.get(value, value) if isinstance(value, str) else value)
    of = lambda section, name, default: (given.get(section) or {}).get(name, default)
    if not of("foundation_models", "multi_encoder_enabled", False):
        put("encoding.others", ())
    if not of("density_transformation", "enabled", False):
        put("density_transform", "none")
    if of("hypersphere", "radius_computation", "adaptive") != "adaptive":
        put("spheres.adaptive", "none")
    zones = of("hypersphere", "buffer_zones", None) or {}
    put("spheres.buffer", zones.get("buffer_radius", 0.02) if zones.get("enabled") else 0.0)
    if isinstance(of("preprocessing", "resize_size", None), Mapping):
        put("pixels.resize", min(of("preprocessing", "resize_size", None).values()))
    for switch, place in (("do_resize", "pixels.resize"), ("do_center_crop", "pixels.crop")):
        if of("preprocessing", switch, True) is False:
            put(place, None)
    if not of("streaming", "persistent_anchors", True):
        put("streaming", False)
    return made


def from_dict(given: Mapping[str, Any]) -> Config:
    """Settings by the names here, or in sections as other tools' files have them. Unknown names are errors."""
    if any(name in SECTIONS and isinstance(value, Mapping) for name, value in given.items()):
        given = from_sections(given)

    def read(kind: type, values: Mapping[str, Any]) -> Any:
        known = {f.name: f for f in dataclasses.fields(kind)}
        if extra := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        made = {}
        for name, value in values.items():
            factory = known[name].default_factory
            made[name] = read(factory, value) if isinstance(factory, type) else value
        return kind(**made)

    return read(Config, given).validate()


def from_yaml(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f) or {})


@dataclass(frozen=True)
class Batch:
    folders: tuple[str, ...]
    output_dir: str
    config: str | None = None
    reports: tuple[Mapping[str, Any], ...] = ()

    def settings(self) -> Config:
        return from_yaml(self.config) if self.config else Config()


def batch_from_yaml(path: str) -> Batch:
    """Folders, their output and settings, and reports: a type each, or a mapping with ``type`` and ``save``."""
    import yaml

    with open(path) as f:
        given = yaml.safe_load(f) or {}
    reports = given.get("reports") or given.get("visualizations") or ()
    return Batch(
        tuple(given["folders"]), given["output_dir"], given.get("config") or given.get("bf_config"), tuple({"type": r} if isinstance(r, str) else r for r in reports)
    )
