"""Region-aware splitting of datasets on Spark.

Names are imported when they are used: a Python worker that runs one operator's function loads that operator's modules alone."""

from importlib import import_module

#: The module of each name.
_HOMES = {
    "config": ("Batch", "Config", "batch_from_yaml", "from_dict", "from_yaml"),
    "functions.encoders": ("IMAGE_ENCODERS", "encode", "encode_images"),
    "operators.pairs": ("distances", "knn", "knn_cross", "points", "self_pairs"),
    "operators.spheres": ("assign",),
    "plans.engine": ("Engine", "log_to", "run_batch", "run_folder"),
    "sources.folders": ("annotations",),
    "sources.state": ("State",),
    "sources.tables": ("drop_work",),
    "streaming.ingest": ("ingest_stream",),
}
__all__ = sorted(name for names in _HOMES.values() for name in names)


def __getattr__(name: str) -> object:
    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(f"orbisplit.{home}"), name)
    raise AttributeError(name)
