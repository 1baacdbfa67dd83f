from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelproof.functions import images as im
from labelproof.operators import rules
from labelproof.plans import gallery as gallery_plan
from labelproof.schemas import Tables, schema
from labelproof.session import gathered
from labelproof.sources import files, sinks


def picture(kind="text"):
    image = np.full((32, 64), 255, np.uint8)
    if kind == "text":
        image[10:20, 8:50:6] = 20
    return image


@pytest.fixture(scope="module")
def gallery(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pictures")
    for name, kind in (("one.png", "text"), ("copy.png", "text"), ("blank.png", "blank")):
        (base / name).write_bytes(im.png_bytes(picture(kind)))
    rgb = np.zeros((40, 30, 3), np.uint8)
    rgb[..., 0], rgb[..., 1], rgb[..., 2] = 200, 100, 50
    (base / "colour.png").write_bytes(im.png_bytes(rgb))
    (base / "broken.png").write_bytes(b"no picture")
    return base


def by_name(df, column="path"):
    return {r[column].rsplit("/", 1)[1]: r for r in df.collect()}


def test_image_scan_and_statistics(spark, gallery):
    rows = by_name(files.read_images(spark, str(gallery)).withColumn("s", im.pixel_stats()))
    assert not rows["broken.png"]["decoded"] and rows["broken.png"]["width"] is None
    assert (rows["one.png"]["width"], rows["one.png"]["height"]) == (64, 32)
    want = picture().astype(float)
    assert rows["one.png"]["s"]["mean"] == pytest.approx(want.mean())
    assert rows["one.png"]["s"]["std"] == pytest.approx(want.std())
    assert rows["blank.png"]["s"]["intensity_range"] == 0
    # 19595*200 + 38470*100 + 7471*50 + 32768 >> 16
    assert rows["colour.png"]["s"]["mean"] == 124.0


def filtered_png(image, kind):
    """A picture whose rows are stored by one filter: 0 as they are, 1 from the left, 2 from above, 3 by an average."""
    height, width, channels = image.shape
    padded = np.zeros((height + 1, width + 1, channels), np.int64)
    padded[1:, 1:] = image
    left, above = padded[1:, :-1], padded[:-1, 1:]
    near = {0: 0, 1: left, 2: above, 3: (left + above) // 2}[kind]
    rows = ((image.astype(np.int64) - near) % 256).astype(np.uint8).reshape(height, -1)
    raw = b"".join(bytes([kind]) + r.tobytes() for r in rows)

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_plain_pictures_have_the_pixels_of_the_picture_source(spark, tmp_path):
    draw = np.random.default_rng(1)
    plain = {}
    for channels in (1, 3):
        for kind in range(4):
            data = filtered_png(draw.integers(0, 256, (7, 5, channels), np.uint8), kind)
            plain[f"c{channels}f{kind}.png"] = im.plain_png(data)
            (tmp_path / f"c{channels}f{kind}.png").write_bytes(data)
            for broken in (data[:-1], data[:-20], data[:50] + b"?" + data[51:], data[:20]):
                assert im.plain_png(broken) is None
    # what is no plain picture is left to the picture source
    assert {n for n, p in plain.items() if p is None} == {"c1f3.png", "c3f3.png"}
    for name, row in by_name(files.raw_images(spark, str(tmp_path))).items():
        if plain[name] is not None:
            assert plain[name].shape == (row["height"], row["width"], row["channels"])
            assert plain[name].tobytes() == bytes(row["pixels"])
    columns = ("decoded", "width", "height", "channels", "pixels")
    got, want = (by_name(read(spark, str(tmp_path))) for read in (files.read_images, files.raw_images))
    assert {n: [r[c] for c in columns] for n, r in got.items()} == {n: [r[c] for c in columns] for n, r in want.items()}


def test_the_picture_source_gets_only_what_is_not_plain(spark, gallery, monkeypatch):
    opened, source = [], files.raw_images
    monkeypatch.setattr(files, "raw_images", lambda s, path: opened.append(path) or source(s, path))
    assert files.read_images(spark, str(gallery)).count() == 5
    assert [files.list_files(spark, p).count() for p in opened] == [1]


def test_files_are_opened_once(spark, tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"p{i}.png").write_bytes(im.png_bytes(np.full((8, 8 + i), 40 * i, np.uint8), 6))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    rows = files.read_images(spark, str(tmp_path), ("length", "sha256"))
    want = {n: (r["sha256"], r["length"]) for n, r in by_name(files.read_binary(spark, str(tmp_path))).items()}
    monkeypatch.setattr(files, "SMALL_PICTURE", 80)
    again = by_name(files.read_images(spark, str(tmp_path)))
    for f in tmp_path.iterdir():
        f.unlink()
    got = by_name(rows)
    assert {n: (r["sha256"], r["length"]) for n, r in got.items()} == want
    # larger pictures are decoded again, to the same pixels; all are turned
    columns = ("decoded", "width", "height", "channels", "pixels")
    assert {n: [r[c] for c in columns] for n, r in got.items()} == {n: [r[c] for c in columns] for n, r in again.items()}
    assert (got["p3.png"]["width"], got["p3.png"]["height"], got["broken.png"]["decoded"]) == (8, 11, False)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.bin").write_bytes(b"x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1)
    try:
        scan = spark.read.format("binaryFile").load(str(tmp_path))
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() == 40
        few = gathered(scan)
        assert few.rdd.getNumPartitions() == min(40, 4 * cores) and few.count() == 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_listings_and_tasks_do_not_grow_with_every_few_files(spark, tmp_path):
    for i in range(1100):
        (tmp_path / f"{i}.bin").write_bytes(b"x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1)
    try:
        most = 4 * spark.sparkContext.defaultParallelism
        listing = files.list_files(spark, str(tmp_path))
        assert listing.rdd.getNumPartitions() == max(most, 5) and listing.count() == 1100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pictures_of_one_row_group_are_drawn_by_all_cores(spark, folder, tmp_path):
    # splits without the start of a row group are empty
    spark.read.parquet(f"{folder}/embeddings.parquet").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        t = Tables(spark, str(tmp_path))
        assert t.embeddings.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        busy = gallery_plan.levels(t).groupBy(F.spark_partition_id()).count()
        assert busy.count() > spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pictures_lie_in_many_folders_and_decoded_ones_are_not_broadcast(spark, folder):
    t = Tables(spark, folder)
    paths = [r["path"] for r in files.list_files(spark, gallery_plan.folder(t)).collect()]
    assert len(paths) == t.embeddings.filter("vec_id % 25 <> 3").count()
    # Spark lists more than 32 folders by tasks
    assert len({p.rsplit("/", 1)[0] for p in paths}) > 32
    plan = files.read_images(spark, gallery_plan.folder(t))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_digests_and_types(spark, gallery):
    rows = by_name(files.read_binary(spark, str(gallery)).withColumn("t", files.content_type(F.col("head"))))
    assert rows["one.png"]["sha256"] == rows["copy.png"]["sha256"] == hashlib.sha256((gallery / "one.png").read_bytes()).hexdigest()
    assert rows["one.png"]["t"] == "image/png" and rows["broken.png"]["t"] == "application/octet-stream"


def test_missing_file_keeps_null_metrics(spark, gallery):
    listed = spark.createDataFrame([(f"file:{gallery}/one.png",), (f"file:{gallery}/absent.png",)], "path string")
    images = files.read_images(spark, str(gallery)).withColumn("s", im.pixel_stats()).select("path", "decoded", "width", "height", "s.*")
    sizes = files.list_files(spark, str(gallery))
    joined = listed.join(images, "path", "left").join(sizes, "path", "left").withColumns(
        {
            "exists": F.col("length").isNotNull(),
            "opens_successfully": F.coalesce("decoded", F.lit(False)),
            "contrast_std": F.col("std"),
        }
    )
    rows = by_name(rules.quality_flags(joined, 64, 32))
    assert rows["absent.png"]["missing"] and rows["absent.png"]["mean"] is None and rows["absent.png"]["blank"] is None
    assert not rows["one.png"]["missing"] and not rows["one.png"]["wrong_size"] and not rows["one.png"]["blank"]


def test_hash_and_similarity(spark, gallery):
    rows = by_name(files.read_images(spark, str(gallery)).filter("decoded").withColumn("h", im.image_hash()))
    assert rows["one.png"]["h"] == rows["copy.png"]["h"] != rows["blank.png"]["h"]
    assert rows["blank.png"]["h"] == [-1, -1, -1, -1]
    a = picture()
    assert im.structural_similarity(a, a) == pytest.approx(1.0)
    assert im.structural_similarity(a, picture("blank")) < 0.9


def test_features(spark, gallery):
    images = files.read_images(spark, str(gallery)).filter("width = 64")
    rows = by_name(im.gradient_features(images, ["path"], 224, 96))
    # 12x28 cells give 11x27 blocks of 2x2 cells with 9 bins
    assert len(rows["one.png"]["features"]) == 11 * 27 * 36
    assert rows["one.png"]["features"] == rows["copy.png"]["features"]
    assert max(rows["blank.png"]["features"]) == 0.0
    tensor = by_name(im.normalised(images, "path", 112, 48))
    assert len(tensor["one.png"]["tensor"]) == 112 * 48 and set(tensor["blank.png"]["tensor"]) == {1.0}


def test_resize_keeps_the_mean():
    image = np.arange(96 * 224, dtype=np.float64).reshape(96, 224)
    assert im.fit(image, 112, 48).mean() == pytest.approx(image.mean(), rel=1e-3)
    assert np.allclose(im.fit(image, 224, 96), image)


def test_csv_null_modes(spark, tmp_path):
    shape = schema("id:long a:str b:str")
    df = spark.createDataFrame([(1, "", "x"), (2, None, 'q "y",\nz'), (3, "NA", None)], shape)
    path = str(tmp_path / "c")
    sinks.write_csv(df, path)
    keep = {tuple(r) for r in files.read_csv(spark, path, shape, keep_empty=True).collect()}
    null = {tuple(r) for r in files.read_csv(spark, path, shape).collect()}
    assert keep == {(1, "", "x"), (2, "", 'q "y",\nz'), (3, "NA", "")}
    assert null == {(1, None, "x"), (2, None, 'q "y",\nz'), (3, "NA", None)}


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "once")
    sinks.write_once(spark.range(3), path)
    with pytest.raises(FileExistsError):
        sinks.write_once(spark.range(3), path)


@pytest.mark.parametrize(
    "body, message",
    [
        ('{"a": ["x", " "]}', "blank"),
        ('{"a": ["x"], "b": ["X "]}', "repeated"),
        ('{"c": ["x"]}', "unknown"),
        ('{"a": "x"}', "list of names"),
        ('["x"]', "list of names"),
    ],
)
def test_bad_catalogues(spark, tmp_path, body, message):
    (tmp_path / "c.json").write_text(body)
    with pytest.raises(ValueError, match=message):
        files.read_catalogue(spark, str(tmp_path / "c.json"), ["a", "b"])


def test_catalogue_rows(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": [" X ", "y"], "b": ["z"]}')
    rows = {tuple(r) for r in files.read_catalogue(spark, str(tmp_path / "c.json"), ["a", "b"]).collect()}
    assert rows == {("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")}


def test_partitioned_layout_prunes_folders(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 3).cast("string").alias("t"))
    path = str(tmp_path / "p")
    sinks.write_partitioned(df, path, ["split", "t"])
    assert (tmp_path / "p" / "split=test" / "t=0").is_dir()
    kept = spark.read.parquet(path).filter("split = 'test'")
    assert "PartitionFilters: [isnotnull(split" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 25


def test_own_size_needs_no_filter(monkeypatch):
    draw = np.random.default_rng(3)
    pictures = [draw.integers(0, draw.integers(1, 257), draw.integers(1, 40, 2)).astype(np.uint8) for _ in range(300)]
    monkeypatch.setattr(im, "_weights", None)
    assert all((im.stretch(x, x.shape[1], x.shape[0]) == x).all() for x in pictures)


def test_scaled_pictures_leave_as_arrow_lists(spark, gallery, monkeypatch):
    images = files.read_images(spark, str(gallery))
    scaled = im.normalised(images, "path", 64, 32, keep=("width",))
    assert "MapInArrow" in scaled._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(im, "VALUES", 1)  # each picture a batch of its own
    pieces = im.normalised(images, "path", 64, 32, keep=("width",))
    assert sorted(map(str, scaled.collect())) == sorted(map(str, pieces.collect()))
    assert pieces.count() == 4


def test_percentiles_are_those_of_numpy():
    draw = np.random.default_rng(3)
    for _ in range(300):
        x = draw.integers(0, draw.integers(1, 257), draw.integers(1, 40, 2)).astype(np.uint8)
        assert im.percentiles(x, [0, 1, 50, 99, 100]) == np.percentile(x.astype(np.float64), [0, 1, 50, 99, 100]).tolist()


def test_statistics_call_no_general_percentile(spark, gallery, monkeypatch):
    monkeypatch.setattr(np, "percentile", None)
    picture = pd.Series([bytes(range(12))])
    found = im.pixel_stats.__globals__["_stats"].func(picture, *(pd.Series([n]) for n in (3, 4, 1)))
    assert found.loc[0, ["minimum", "maximum", "p01", "p99"]].tolist() == pytest.approx([0, 11, 0.11, 10.89])


class Captured:
    """A frame that hands out the function that is to run over its batches."""

    schema = schema("path:str pixels:bin height:int width:int channels:int")

    def filter(self, *_):
        return self

    select = filter

    def mapInArrow(self, work, _):
        return work


def test_features_leave_in_pieces_of_bounded_size():
    draw = np.random.default_rng(3)
    images = [draw.integers(0, 256, (16, 16)).astype(np.uint8) for _ in range(1000)]
    rows = [{"path": str(i), "pixels": x.tobytes(), "height": 16, "width": 16, "channels": 1} for i, x in enumerate(images)]
    pieces = list(im.gradient_features(Captured(), ["path"], 224, 96)(iter([pa.RecordBatch.from_pylist(rows)])))
    vector = 11 * 27 * 36
    assert max(len(p.column("features").flatten()) for p in pieces) < im.VALUES + vector < 1000 * vector
    assert [x for p in pieces for x in p.column("path").to_pylist()] == [r["path"] for r in rows]
    last = pieces[-1].column("features")[-1].as_py()
    assert last == im.orientation_histogram(im.fit(images[-1], 224, 96), (8, 8)).tolist()
    # cells of the pictures' own size too
    counts = list(im.cell_histograms(Captured(), ["path"], (2, 2))(iter([pa.RecordBatch.from_pylist(rows * 10)])))
    assert len(counts) > 1 and sum(p.num_rows for p in counts) == 10_000
    assert counts[0].column("counts")[0].as_py() == im.cell_counts(images[0], (2, 2)).ravel().tolist()
