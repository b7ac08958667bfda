"""Incremental rounds, replay, streams and folders."""

import copy
import dataclasses
import logging
import struct
import uuid
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisplit.config import Batch, Config, Dedup, Encoding, Pixels, Placement, Spheres, batch_from_yaml, from_dict
from orbisplit.functions.encoders import DECODERS, IMAGE_ENCODERS, encode, encode_images, hashed_text
from orbisplit.operators import report
from orbisplit.plans import summary
from orbisplit.plans.engine import Engine, embed_folder, log_to, run_batch, run_folder, run_id_of
from orbisplit.sources import folders
from orbisplit.sources.state import State
from orbisplit.sources.tables import shared_root
from orbisplit.streaming.ingest import ingest_stream

CONFIG = Config(spheres=Spheres(max_radius=0.8, percentile=20.0), placement=Placement(min_distance=0.3), dedup=Dedup(threshold=0.95), class_aware=False)


def engine(spark, config=CONFIG):
    return Engine(spark, f"{shared_root(spark)}/state-{uuid.uuid4().hex}", config)


def rows(spark, sf_dir, low, high):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id").between(low, high - 1))
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))


def test_two_rounds_and_replay(spark, sf_dir):
    e = engine(spark)
    one = e.ingest(rows(spark, sf_dir, 0, 250), "one").collect()
    assert {r.dataset_split for r in one} <= {"train", "validation", "test"} and len(one) == 250
    two = e.ingest(rows(spark, sf_dir, 200, 400), "two")
    assert two.count() == 150  # those seen before are duplicates
    again = {r.id: r.dataset_split for r in e.state.assignments().where("run_id = 'one'").collect()}
    assert again == {r.id: r.dataset_split for r in one}
    n = e.state.anchors().count()
    assert n and e.state.anchors().select("anchor_id").distinct().count() == n
    assert e.ingest(rows(spark, sf_dir, 200, 400), "two").count() == 150 and e.state.points().count() == 400
    assert e.ingest(rows(spark, sf_dir, 0, 100), "three").count() == 0 and e.state.commits().count() == 2
    s = e.statistics().first()
    assert s.total_points == 400 and 0 < s.eval_ratio <= 0.25
    assert e.pipeline_stats().first().stored_points == 400
    assert e.state.aligned(64).count() == 400
    e.reset()
    assert e.state.points().isEmpty()


def test_new_rows_meet_the_stored_ones_once(spark, sf_dir, monkeypatch):
    from orbisplit.plans import engine as module

    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    drop_known = module.drop_known
    monkeypatch.setattr(module, "drop_known", lambda *a: (kept := drop_known(*a)).mapInArrow(counted, kept.schema))
    e = engine(spark)
    assert e.ingest(rows(spark, sf_dir, 0, 60), "one").count() == 60 and met.value == 60
    assert e.ingest(rows(spark, sf_dir, 40, 100), "two").count() == 40 and met.value == 100


def test_assignments_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    state = State(spark, f"file://{tmp_path}/state")
    schema = "run_id string, id long, original_index long, dataset_split string, train_split string, anchor_id long, distance_to_anchor double, num_containing_anchors int"
    some = spark.createDataFrame([("a", i, i, "test", "test", i % 2 or None, 0.1, 1) for i in range(10)], schema)
    points = spark.createDataFrame([], "id long, original_index long, file_path string, label string, v array<double>")
    state.commit(0, "a", "", points, state.anchors(), some.mapInArrow(counted, some.schema))
    assert made.value == 10 and state.assignments().count() == 10
    assert sorted(r.id for r in state.similar().collect()) == [1, 3, 5, 7, 9]


def test_an_unfinished_version_does_not_count(spark, sf_dir):
    e = engine(spark)
    e.ingest(rows(spark, sf_dir, 0, 60), "one")
    e.state.points().limit(3).drop("version").write.parquet(f"{e.root}/points/version=7")
    assert e.state.points().count() == 60 and e.state.next_version() == 1


def test_stateless_mode(spark, sf_dir):
    e = engine(spark, dataclasses.replace(CONFIG, streaming=False))
    assert e.ingest(rows(spark, sf_dir, 0, 60), "one").count() == 60 and e.state.commits().isEmpty()


def test_stream_of_files(spark, sf_dir, tmp_path):
    e = engine(spark)
    for i in range(2):
        rows(spark, sf_dir, i * 60, i * 60 + 60).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v array<float>, label string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_stream(stream, e, str(tmp_path / "check")).awaitTermination()
    assert e.state.commits().count() == 2 and e.state.points().count() == 120


def by_name(contents):
    return encode(contents, "filename", {"m": hashed_text(16)}, key="filename").drop("model")


def test_folders(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = folders.annotations(spark, str(tmp_path)).orderBy("original_index").collect()
    assert [(r.filename, r.original_index) for r in found] == [("a.jpg", 0), ("b.PNG", 1)]
    e = engine(spark)
    out = run_folder(e, str(tmp_path), by_name, datetime(2024, 1, 2, 3, 4, 5))
    assert {r.filename for r in out.collect()} == {"a.jpg", "b.PNG"} and e.state.commits().first().batch_id == f"{tmp_path.name}_240102030405"
    assert run_id_of("/x/y/", datetime(2024, 1, 2)) == "y_240102000000"
    (tmp_path / "annotations.csv").write_text("filename,label,more\nb.PNG,x,1\na.jpg,y,2\n")
    assert folders.annotations(spark, str(tmp_path)).columns == ["filename", "label", "more", "original_index"]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        folders.annotations(spark, str(empty))
    root = f"{shared_root(spark)}/batch-{uuid.uuid4().hex}"
    assert run_batch(spark, Batch((str(empty), str(tmp_path)), root), by_name) == [str(empty)]


def test_annotations_keep_the_order_of_their_file(spark, tmp_path):
    names = [f"f{(i * 37) % 101:03d}.png" for i in range(101)]
    (tmp_path / "annotations.csv").write_text("filename,label\n" + "".join(f"{n},{i}\n" for i, n in enumerate(names)))
    found = folders.annotations(spark, str(tmp_path)).orderBy("original_index").collect()
    assert [(r.filename, r.original_index, r.label) for r in found] == [(n, i, i) for i, n in enumerate(names)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        assert [r.filename for r in folders.annotations(spark, str(tmp_path)).orderBy("original_index").collect()] == names
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def png(path, rgb):
    """An 8-bit image of rows of (red, green, blue)."""
    raw = b"".join(b"\0" + bytes(c for p in row for c in p) for row in rgb)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(rgb[0]), len(rgb), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_encoders_are_called_with_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(x):
        calls.add(1)
        return x.mean((2, 3))

    IMAGE_ENCODERS["counted"] = model
    try:
        sizes = [(2, 3), (4, 4)]
        rows = [(f"i{i}", h, w, 3, bytes([i % 250] * (h * w * 3))) for i in range(600) for h, w in [sizes[i % 2]]]
        images = spark.createDataFrame(rows, "filename string, height int, width int, nChannels int, data binary").coalesce(1)
        got = encode_images(images, Encoding("counted", normalise=False), Pixels(resize=0, crop=0, normalise=False)).collect()
    finally:
        del IMAGE_ENCODERS["counted"]
    assert calls.value == 4  # 300 images of each size, 256 at once
    assert len(got) == 600 and all(r.decoded and abs(r.v[0] - int(r.filename[1:]) % 250 / 255) < 1e-9 for r in got)


def test_images_that_cannot_be_read_are_no_duplicates(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.webp").write_bytes(b"RIFF" + bytes([i] * 20))
    for name in ("red.png", "same.png"):
        png(tmp_path / name, [[(255, 0, 0)] * 8] * 8)
    config = dataclasses.replace(CONFIG, pixels=Pixels(resize=8, crop=8, normalise=False), encoding=Encoding(primary="grid-2", normalise=False))
    out = run_folder(engine(spark, config), str(tmp_path))
    assert sorted(r.filename for r in out.collect()) == ["0.webp", "1.webp", "red.png"]
    # A decoder that is registered for the ending is used.
    DECODERS["webp"] = lambda raw: np.full((8, 8, 3), raw[4] * 200, np.uint8)
    try:
        found = embed_folder(engine(spark, config), str(tmp_path), spark.createDataFrame([("0.webp",), ("1.webp",)], "filename string"))
        got = {r.filename: (r.decoded, round(r.v[0], 3)) for r in found.collect()}
    finally:
        del DECODERS["webp"]
    assert got == {"0.webp": (True, 0.0), "1.webp": (True, round(200 / 255, 3))}


def test_types_of_annotations(spark, tmp_path):
    (tmp_path / "annotations.csv").write_text("filename,label,speed,n,ok\n001,x,1.5,7,true\n002,y,2,8,false\n")
    found = folders.annotations(spark, str(tmp_path))
    assert dict(found.dtypes) == {"filename": "string", "label": "string", "speed": "double", "n": "int", "ok": "boolean", "original_index": "bigint"}
    assert [(r.filename, r.n) for r in found.orderBy("original_index").collect()] == [("001", 7), ("002", 8)]


def test_images_are_decoded_prepared_and_encoded(spark, tmp_path):
    png(tmp_path / "red.png", [[(255, 0, 0)] * 40] * 20)
    png(tmp_path / "half.png", [[(0, 255, 0)] * 10 + [(0, 0, 255)] * 10] * 20)
    (tmp_path / "broken.png").write_bytes(b"no image")
    e = engine(spark, dataclasses.replace(CONFIG, pixels=Pixels(resize=20, crop=20, normalise=False), encoding=Encoding(primary="grid-2", normalise=False)))
    rows = spark.createDataFrame([("red.png",), ("half.png",), ("broken.png",), ("missing.png",)], "filename string")
    v = {r.filename: np.round(np.reshape(r.v, (3, 2, 2)), 2).tolist() for r in embed_folder(e, str(tmp_path), rows).collect()}
    one, none = [[1.0, 1.0]] * 2, [[0.0, 0.0]] * 2
    assert v["red.png"] == [one, none, none] and v["half.png"] == [none, [[1.0, 0.0]] * 2, [[0.0, 1.0]] * 2]
    assert v["broken.png"] == v["missing.png"] == [none] * 3
    two = dataclasses.replace(e.config, encoding=Encoding("grid-2", ("grid-2-siglip",), "union", 0.01), pixels=Pixels(resize=20, crop=20))
    monkey = IMAGE_ENCODERS.setdefault("grid-2-siglip", lambda x: x[:, :, ::10, ::10].reshape(len(x), -1))
    try:
        both = embed_folder(Engine(spark, e.root, two), str(tmp_path), rows)
        assert {len(r.v) for r in both.collect()} == {12} and monkey
    finally:
        IMAGE_ENCODERS.clear()
    with pytest.raises(ValueError):
        embed_folder(Engine(spark, e.root, dataclasses.replace(e.config, encoding=Encoding("unknown/model"))), str(tmp_path), rows)


def test_rows_without_a_file_stay_in_the_dataset(spark, tmp_path):
    rng = np.random.default_rng(2)
    for f in ("one", "two", "three"):
        (tmp_path / f).mkdir()
        names = [f"{f}{i:02d}.png" for i in range(24)]
        for name in names[1:]:
            png(tmp_path / f / name, [[tuple(map(int, rng.integers(0, 256, 3))) for _ in range(4)] for _ in range(4)])
        extra = ",more" if f == "two" else ""
        (tmp_path / f / "annotations.csv").write_text(f"filename,label{extra}\n" + "".join(f"{n},{'ab'[i % 2]}{extra and ',x'}\n" for i, n in enumerate(names)))
    root = f"{shared_root(spark)}/batch-{uuid.uuid4().hex}"
    settings = tmp_path / "settings.yaml"
    settings.write_text("pixels: {resize: 4, crop: 4}\nencoding: {primary: grid-4}\nspheres: {max_radius: 0.8}\n")
    batch = tmp_path / "batch.yaml"
    batch.write_text(f"folders: [{tmp_path}/one, {tmp_path}/two, {tmp_path}/three]\noutput_dir: {root}\nconfig: {settings}\nreports: [stats, rebuilt, {{type: standalone, save: flat}}]\n")
    assert run_batch(spark, batch_from_yaml(str(batch))) == []
    state = State(spark, root)
    data = state.dataset()
    n = {r.folder_path: r["count"] for r in data.groupBy("folder_path").count().collect()}
    # The black image is in each folder; it is a duplicate in the second and third.
    assert n == {f"{tmp_path}/one": 24, f"{tmp_path}/two": 23, f"{tmp_path}/three": 23}
    assert {"filename", "label", "more", "run_id", "dataset_split", "train_split", "original_index", "anchor_id"} <= set(data.columns)
    assert data.where("more = 'x'").count() == 23
    runs = [r.run_id for r in state.runs().collect()]
    assert len(runs) == 3 and state.dataset(runs[:1]).count() == 24
    s = report.statistics(state.assignments(), "dataset_split").first()
    assert s.total_points == 70 and 0 < s.eval_ratio <= 0.25
    members = state.similar().groupBy("anchor_id").count().collect()
    want = {r.anchor_id: r["count"] for r in state.assignments().where("anchor_id is not null").groupBy("anchor_id").count().collect()}
    assert {r.anchor_id: r["count"] for r in members} == want
    assert state.anchors_of([0]).count() == 1
    stats = spark.read.parquet(f"{root}/reports/stats")
    assert stats.where("section = 'dataset' and name = 'total_points'").first().value == 70
    assert spark.read.text(f"{root}/reports/stats.txt").count() == stats.count()
    closest = spark.read.parquet(f"{root}/reports/rebuilt")
    assert closest.count() == 70 and closest.where("split = 'train' and anchor_id is null and closest_anchor is null").isEmpty()
    flat, centers = summary.projected(state)
    assert {len(r.p) for r in flat.collect()} == {2} and centers.count() == state.anchors().count()
    assert summary.radius_histogram(state).agg(F.sum("n")).first()[0] == centers.count()
    assert summary.representatives(state).select("anchor_id").distinct().count() == min(7, len(want))
    plan = state.dataset(runs[:1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "run_id" in plan[plan.index("PartitionFilters") :]


def test_log_file(tmp_path):
    handler = log_to(str(tmp_path / "x.log"), Config(log_level="WARNING"))
    logging.getLogger("orbisplit.plans.engine").warning("told")
    logging.getLogger("orbisplit").removeHandler(handler)
    handler.close()
    assert "WARNING told" in (tmp_path / "x.log").read_text()


def test_settings_in_sections(tmp_path):
    given = {
        "class_aware": False,
        "foundation_models": {"primary_model": "m", "multi_encoder_enabled": True, "additional_models": ["n"], "consensus_method": "union"},
        "preprocessing": {"resize_size": {"height": 64, "width": 96}, "do_center_crop": False},
        "deduplication": {"similarity_threshold": 0.9999},
        "density_transformation": {"enabled": True, "method": "PCA"},
        "anchor_placement": {"method": "random", "snap_strategy": "nearest"},
        "hypersphere": {"adaptive_method": "local_density", "base_radius_mode": "fixed", "base_radius_fixed": 0.2, "buffer_zones": {"enabled": True, "buffer_radius": 0.1}},
        "nested_shells": {"shell_configuration": "inner_test"},
        "dataset_splits": {"train_ratio": 0.7, "eval_ratio": 0.3, "ratio_monitoring": {"enabled": True}},
        "streaming": {"enabled": True, "persistent_anchors": False},
        "distance": {"metric": "euclidean", "precision": "float32"},
        "random_seed": {"random_seed": 7},
    }
    before = copy.deepcopy(given)
    c = from_dict(given)
    assert given == before and not c.class_aware and not c.streaming and c.seed == 7 and c.metric == "euclidean"
    assert c.encoding == Encoding("m", ("n",), "union", 0.8) and c.pixels == Pixels(resize=64, crop=None)
    assert c.spheres == Spheres(radius="fixed", fixed_radius=0.2, buffer=0.1, adaptive="density", strategy="inner_test") and c.dedup.threshold == 0.9999
    assert c.density_transform == "whiten" and c.placement == Placement(method="random", snap="nearest") and c.splits.eval == 0.3
    assert from_dict({"hypersphere": {"radius_computation": "fixed"}}).spheres == Spheres(adaptive="none")
    assert from_dict({"foundation_models": {"primary_model": "m", "additional_models": ["n"]}}).encoding.others == ()
    for bad in ({"hypersphere": {"radius": 1}}, {"hypersphere": {}, "else": {}}, {"dataset_splits": {"train_ratio": 0.9}}):
        with pytest.raises(ValueError):
            from_dict(bad)
    (tmp_path / "b.yaml").write_text("folders: [a]\noutput_dir: o\nbf_config: null\nvisualizations: [{type: stats}, {type: 3d, save: x.html}]\n")
    assert batch_from_yaml(str(tmp_path / "b.yaml")).reports == ({"type": "stats"}, {"type": "3d", "save": "x.html"})
