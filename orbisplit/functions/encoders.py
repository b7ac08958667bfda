"""Encoders turn items into vectors. One for text and one for images are built in; others are functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisplit.config import Encoding, Pixels
from orbisplit.sources.tables import materialise

#: An encoder gets a batch of items and gives one vector a row.
Encoder = Callable[[pd.Series], np.ndarray]

#: Mean and deviation of pixels by family of model.
PIXELS = {"siglip": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)), "other": ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711))}


def pixel_constants(model: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    return PIXELS["siglip" if "siglip" in model.lower() else "other"]


def normalise_pixels(x: np.ndarray, model: str, mean: Sequence[float] | None = None, deviation: Sequence[float] | None = None) -> np.ndarray:
    """(x - mean) / deviation of images (rows, channels, height, width), with those of the model's family unless they are given."""
    own = pixel_constants(model)
    mean, std = (np.asarray(c)[None, :, None, None] for c in (mean or own[0], deviation or own[1]))
    return (x - mean) / std


#: Image encoders by name: each takes images (rows, 3, height, width) and gives a vector a row. A model is registered under its name.
IMAGE_ENCODERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}
#: Height and width of the black image that stands for one that is missing or cannot be read.
PLACEHOLDER = 224


#: Pixels of an encoder's call, in bytes, and images that are looked at in turn.
CALL_BYTES, CALL_ROWS = 64 << 20, 256
#: By file ending, what turns a file's bytes into pixels (height, width, 3), for formats that Spark's image source doesn't read.
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {}


def decoder(ending: str) -> Callable[[bytes], np.ndarray] | None:
    """The registered one, or Pillow's where it is installed."""
    if ending in DECODERS:
        return DECODERS[ending]
    try:
        from PIL import Image
    except ModuleNotFoundError:
        return None
    import io

    return lambda raw: np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))


def image_encoder(name: str) -> Callable[[np.ndarray], np.ndarray]:
    """A registered encoder, or ``grid-N``: the mean colours of N by N fields."""
    if name in IMAGE_ENCODERS:
        return IMAGE_ENCODERS[name]
    if name.startswith("grid-") and name[5:].isdigit() and int(name[5:]) > 0:
        return partial(_grid, n=int(name[5:]))
    raise ValueError(f"no image encoder {name!r}: register it in IMAGE_ENCODERS")


def _grid(x: np.ndarray, n: int) -> np.ndarray:
    edges = lambda size: np.minimum(np.arange(n) * size // n, size - 1)
    sums = np.add.reduceat(np.add.reduceat(x, edges(x.shape[2]), axis=2), edges(x.shape[3]), axis=3)
    counts = [np.diff([*edges(size), size]).clip(1) for size in x.shape[2:]]
    return (sums / np.outer(*counts)).reshape(len(x), -1)


def pixels_of(height: int | None, width: int | None, channels: int | None, data: bytes | None, content: bytes | None = None, decode: Callable[[bytes], np.ndarray] | None = None) -> np.ndarray | None:
    """Red, green and blue (height, width, 3) of a row of Spark's image source, whose order is blue, green, red, or of a file's content;
    none where neither can be read."""
    if content is not None and decode is not None:
        try:
            x = np.asarray(decode(content), np.uint8)
        except Exception:  # whatever a broken file makes a decoder raise
            return None
        return x if x.ndim == 3 and x.shape[2] == 3 and x.size else None
    if not data or not height or height < 1 or channels not in (1, 3, 4):
        return None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def _resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by the centres of pixels."""

    def ways(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = at.astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    (a, b, f), (c, d, g) = ways(x.shape[0], height), ways(x.shape[1], width)
    f, g = f[:, None, None], g[None, :, None]
    rows = x[a] * (1 - f) + x[b] * f
    return rows[:, c] * (1 - g) + rows[:, d] * g


def prepared(x: np.ndarray, pixels: Pixels) -> np.ndarray:
    """(3, height, width): the shorter edge resized, the middle square cut out (padded with black), 0 to 255 made 0 to 1."""
    x = x.astype(float)
    if pixels.resize:
        scale = pixels.resize / min(x.shape[:2])
        x = _resized(x, max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale)))
    if pixels.crop:
        pad = [max(0, pixels.crop - n) for n in x.shape[:2]]
        x = np.pad(x, [(n // 2, n - n // 2) for n in pad] + [(0, 0)])
        top, left = ((n - pixels.crop) // 2 for n in x.shape[:2])
        x = x[top : top + pixels.crop, left : left + pixels.crop]
    return np.moveaxis(x / 255.0 if pixels.rescale else x, 2, 0)


def encode_images(images: DataFrame, encoding: Encoding, pixels: Pixels, key: str = "filename") -> DataFrame:
    """(key, v, decoded) of images (key, height, width, nChannels, data[, ending, content]): made ready once for all encoders, normalised for
    each, and their vectors combined by consensus if there are several. An image that is missing or cannot be read is encoded as a
    black one, and ``decoded`` is false: such images are alike without being copies.

    Encoders are called with batches: images of one size together, up to CALL_ROWS of them or CALL_BYTES of pixels."""
    encoders = {name: image_encoder(name) for name in (encoding.primary, *encoding.others)}
    decoders = {"webp": decoder("webp"), **DECODERS}
    kind = images.schema[key].dataType.simpleString()
    more = [c for c in ("ending", "content") if c in images.columns]

    def call(rows: list[tuple[object, np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
        x = np.stack([r[1] for r in rows])
        for name, f in encoders.items():
            mean, deviation = pixel_constants(name)
            v = np.asarray(f(normalise_pixels(x, name, pixels.mean or mean, pixels.deviation or deviation) if pixels.normalise else x), np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if encoding.normalise else v
            columns = [pa.array([r[0] for r in rows]), pa.array([name] * len(rows)), pa.array(list(v), pa.list_(pa.float64())), pa.array([r[2] for r in rows])]
            yield pa.RecordBatch.from_arrays(columns, [key, "model", "v", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, ...], list[tuple[object, np.ndarray, bool]]] = {}
        size = 0
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(c)[i].as_py() for c in ("height", "width", "nChannels", "data", *more)]
                raw = row[5] if more else None
                x = pixels_of(*row[:4], raw, decoders.get(row[4]) if more else None)
                ready = prepared(np.zeros((PLACEHOLDER, PLACEHOLDER, 3), np.uint8) if x is None else x, pixels)
                group = held.setdefault(ready.shape, [])
                group.append((b.column(key)[i].as_py(), ready, x is not None))
                size += ready.nbytes
                if len(group) >= CALL_ROWS:
                    size -= sum(r[1].nbytes for r in group)
                    yield from call(held.pop(ready.shape))
                elif size >= CALL_BYTES:
                    for rows in held.values():
                        yield from call(rows)
                    held, size = {}, 0
        for rows in held.values():
            yield from call(rows)

    found = images.select(key, "height", "width", "nChannels", "data", *more).mapInArrow(run, f"{key} {kind}, model string, v array<double>, decoded boolean")
    if not encoding.others:
        return found.select(key, "v", "decoded")
    found = materialise(found, "encoded")
    read = found.where(F.col("model") == encoding.primary).select(key, "decoded")
    return consensus(found.drop("decoded"), encoding.primary, encoding.threshold, encoding.consensus, key).join(read, key)


def hashed_text(dim: int = 64, n: int = 3) -> Encoder:
    """Counts of n-grams of UTF-8 bytes of the lower-cased text, signed and hashed into dim places."""
    weights = np.array([31**j for j in range(n)], np.uint64)

    def encode(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            raw = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8).astype(np.uint64)
            if len(raw) >= n:
                h = np.lib.stride_tricks.sliding_window_view(raw, n) @ weights
                h = (h ^ h >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                out[i] = np.bincount(((h >> np.uint64(1)) % np.uint64(dim)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0), dim)
        return out

    return encode


def encode(df: DataFrame, column: str, encoders: dict[str, Encoder], key: str = "id", normalise: bool = True) -> DataFrame:
    """(key, model, v), a row per item and encoder; each item is read once for all encoders. An encoder that fails on an item
    as a whole batch is not caught: a lost row would be silent."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, f in encoders.items():
                v = f(b["item"])
                if normalise:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: b[key], "model": name, "v": list(v)})

    return df.select(key, F.col(column).alias("item")).mapInPandas(run, f"{key} {kind}, model string, v array<double>")


def _cos(a: Column, b: Column) -> Column:
    from orbisplit.functions.vectors import dot, norm

    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def consensus_union(vectors: DataFrame, primary: str, threshold: float, key: str = "id") -> DataFrame:
    """(key, v): the mean of the models' vectors that are like the primary one."""
    first = vectors.where(F.col("model") == primary).select(key, F.col("v").alias("p"))
    like = vectors.join(first, key).where(_cos(F.col("v"), F.col("p")) >= threshold)
    axes = like.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    mean = axes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    # A vector unlike itself (of norm 0) leaves nothing: then zeros.
    zeros = F.transform("p", lambda x: F.lit(0.0))
    return first.join(mean, key, "left").select(key, F.coalesce("v", zeros).alias("v"))


def consensus_agree(vectors: DataFrame, threshold: float, key: str = "id") -> DataFrame:
    """(key, agree): whether all pairs of models are alike."""
    a, b = (vectors.select(key, F.col("model").alias(f"m{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    pairs = a.join(b, key).where("ma < mb").groupBy(key).agg(F.bool_and(_cos(F.col("va"), F.col("vb")) >= threshold).alias("agree"))
    return vectors.select(key).distinct().join(pairs, key, "left").withColumn("agree", F.coalesce("agree", F.lit(True)))


def consensus(vectors: DataFrame, primary: str, threshold: float, method: str = "union", key: str = "id") -> DataFrame:
    """union and majority average; intersection and unknown methods give the primary vectors (see consensus_agree for its mask)."""
    if method in ("union", "majority"):
        return consensus_union(vectors, primary, threshold, key)
    return vectors.where(F.col("model") == primary).select(key, "v")
