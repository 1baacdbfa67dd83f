"""Headers, orientation, admission without decoding, and the two outputs of the stream."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from labelproof.functions import headers as hd
from labelproof.functions import images as im
from labelproof.operators import admission
from labelproof.sources import files
from labelproof.streaming import flows


def jpeg(width, height, orientation=None, order=">", filler=0):
    parts = [b"\xff\xd8"]
    if filler:
        parts.append(b"\xff\xe2" + struct.pack(">H", filler + 2) + b"\0" * filler)
    if orientation is not None:
        mark = b"MM" if order == ">" else b"II"
        entry = struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0)
        block = b"Exif\0\0" + mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 1) + entry + b"\0" * 4
        parts.append(b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block)
    parts.append(b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0")
    return b"".join(parts)


@pytest.mark.parametrize(
    "data, want",
    [
        (im.png_bytes(np.zeros((3, 5), np.uint8)), ("image/png", 5, 3, 1)),
        (im.png_bytes(np.zeros((3, 5, 3), np.uint8), 6), ("image/png", 5, 3, 6)),
        (im.png_bytes(np.zeros((3, 5), np.uint8), 9), ("image/png", 5, 3, 1)),
        (im.png_bytes(np.zeros((3, 5), np.uint8))[:20], ("image/png", None, None, 1)),
        (hd.PNG_SIGNATURE, ("image/png", None, None, 1)),
        (jpeg(70, 50), ("image/jpeg", 70, 50, 1)),
        (jpeg(70, 50, 8), ("image/jpeg", 70, 50, 8)),
        (jpeg(70, 50, 3, "<", filler=60000), ("image/jpeg", 70, 50, 3)),
        (jpeg(70, 50, 8)[:30], ("image/jpeg", None, None, 1)),
        (jpeg(0, 50), ("image/jpeg", None, None, 1)),
        (b"\xff\xd8\xff\xda\0\0", ("image/jpeg", None, None, 1)),
        (b"GIF89a", ("application/octet-stream", None, None, 1)),
        (b"", ("application/octet-stream", None, None, 1)),
        (None, ("application/octet-stream", None, None, 1)),
    ],
)
def test_picture_facts(data, want):
    assert hd.picture_facts(data) == want


def test_no_prefix_of_a_header_fails():
    for data in (jpeg(70, 50, 8, filler=20), im.png_bytes(np.zeros((3, 5), np.uint8), 6)):
        for size in range(len(data)):
            assert hd.picture_facts(data[:size])[0] in ("image/png", "image/jpeg", "application/octet-stream")


def test_upright_is_the_stated_turn():
    a = np.arange(24).reshape(2, 4, 3)
    want = {1: a, 2: a[:, ::-1], 3: np.rot90(a, 2), 4: a[::-1], 5: a.swapaxes(0, 1), 6: np.rot90(a, -1), 8: np.rot90(a)}
    want[7] = np.rot90(a, 2).swapaxes(0, 1)
    for orientation, image in want.items():
        assert np.array_equal(im.upright(a, orientation), image)


def scene():
    image = np.full((24, 40, 3), 250, np.uint8)
    image[:6, :10] = (10, 60, 200)
    image[12:, 30:] = (90, 20, 5)
    return image


def stored_as(image, orientation):
    return im.png_bytes(im.upright(image, {6: 8, 8: 6}.get(orientation, orientation)), orientation)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("arriving")
    for orientation in range(1, 9):
        (base / f"turn{orientation}.png").write_bytes(stored_as(scene(), orientation))
    whole = im.png_bytes(scene())
    (base / "damaged.png").write_bytes(whole[:-30])
    (base / "bomb.png").write_bytes(whole[:16] + struct.pack(">II", 6000, 5001) + whole[24:])
    (base / "heavy.png").write_bytes(whole + b"\0" * (5 << 20))
    (base / "wrong.png").write_bytes(b"no picture at all")
    (base / "cut.jpg").write_bytes(jpeg(100, 100)[:-8])
    (base / "small.png").write_bytes(im.png_bytes(scene()[:12]))
    (base / "blank.png").write_bytes(im.png_bytes(np.full((30, 30), 255, np.uint8)))
    return str(base)


REASONS = {
    **{f"turn{o}.png": "" for o in range(1, 9)},
    "damaged.png": "unreadable",
    "bomb.png": "too many pixels",
    "heavy.png": "too many bytes",
    "wrong.png": "unsupported type",
    "cut.jpg": "unreadable",
    "small.png": "too small",
    "blank.png": "blank or nearly blank",
}


def reasons(rows):
    return {r.path.rsplit("/", 1)[1]: r.reason for r in rows.collect()}


def test_turned_pictures_measure_alike(spark, folder):
    rows = files.read_images(spark, folder).filter("path LIKE '%turn%'").withColumn("s", im.pixel_stats()).withColumn("h", im.image_hash())
    seen = {(r.width, r.height, bytes(r.pixels), tuple(r.s), tuple(r.h)) for r in rows.collect()}
    assert len(seen) == 1 and next(iter(seen))[:2] == (40, 24)


def test_admission_reasons(spark, folder):
    judged = admission.admit_folder(spark, folder)
    assert reasons(judged) == REASONS
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in judged.collect()}
    assert all(sizes[f"turn{o}.png"] == (40, 24) for o in range(1, 9)) and sizes["bomb.png"] == (6000, 5001)


def test_ruled_out_files_are_not_opened(spark, folder, monkeypatch):
    opened = []
    real = admission.raw_images
    monkeypatch.setattr(admission, "raw_images", lambda s, path: opened.append(path) or real(s, path))
    admission.admit_folder(spark, folder).collect()
    assert real(spark, opened[0]).count() == sum(n not in ("bomb.png", "heavy.png", "wrong.png", "cut.jpg") for n in REASONS)
    # the scan itself leaves out what is over the limit
    plan = admission.headers(spark.read.format("binaryFile").load(folder))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4194304)" in plan and "GreaterThan(length,4194304)" in plan


def test_plain_pictures_are_decoded_where_they_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for o in range(1, 9):
        (tmp_path / "in" / f"{o}.png").write_bytes(im.png_bytes(im.upright(np.arange(40 * 24, dtype=np.uint8).reshape(24, 40), o), o))
    opened, source = [], files.raw_images
    monkeypatch.setattr(files, "raw_images", lambda s, path: opened.append(path) or source(s, path))
    rows = admission.admit_folder(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 8 and all(r.admitted for r in rows)
    assert [files.list_files(spark, p).count() for p in opened] == [0]


def test_a_jpeg_is_opened_and_turned(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(40, 24, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(40):
        for y in range(24):
            image.setRGB(x, y, 0xFFFFFF if x < 20 else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    # an orientation block goes in after the start mark
    block = jpeg(1, 1, 6)
    end = 4 + struct.unpack_from(">H", block, 4)[0]
    (tmp_path / "a.jpg").write_bytes(data[:2] + block[2:end] + data[2:])
    row = admission.admit_folder(spark, str(tmp_path)).first()
    assert (row.content_type, row.width, row.height, row.reason) == ("image/jpeg", 24, 40, "")
    pixels = files.read_images(spark, str(tmp_path)).first()
    turned = np.frombuffer(pixels.pixels, np.uint8).reshape(40, 24, 3)
    assert turned[:18].mean() > 240 and turned[22:].mean() < 15


def test_an_empty_folder(spark, tmp_path):
    assert admission.admit_folder(spark, str(tmp_path)).count() == 0


def test_stream_gives_the_reasons_of_the_batch(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    flows.admission(flows.arriving_files(spark, folder, 4), out, checkpoint).awaitTermination()
    judged = flows.judged_files(spark, out)
    assert reasons(judged) == REASONS and judged.count() == len(REASONS)
    assert judged.filter("admitted").count() == 8 and judged.filter("admitted <> (reason = '')").count() == 0
    assert judged.select("batch").distinct().count() > 1
    # a stream that starts again finds nothing new
    flows.admission(flows.arriving_files(spark, folder, 4), out, checkpoint).awaitTermination()
    assert flows.judged_files(spark, out).count() == len(REASONS)


def test_a_batch_that_fails_between_the_writes_is_written_once(spark, folder, tmp_path, monkeypatch):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    real, calls = flows._replace, []

    def second_fails(rows, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk gone")
        real(rows, path)

    monkeypatch.setattr(flows, "_replace", second_fails)
    with pytest.raises(Exception, match="disk gone"):
        flows.admission(flows.arriving_files(spark, folder, 100), out, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{out}/admitted").count() == 8
    flows.admission(flows.arriving_files(spark, folder, 100), out, checkpoint).awaitTermination()
    assert calls[0] == calls[2] and reasons(flows.judged_files(spark, out)) == REASONS
    assert flows.judged_files(spark, out).count() == len(REASONS)


def test_a_batch_is_not_listed_in_a_task_per_file(spark, folder, tmp_path, monkeypatch):
    setting, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    before, write = spark.conf.get(setting), flows.write_outputs
    monkeypatch.setattr(
        flows, "write_outputs", lambda rows, *rest: seen.append(int(rows.sparkSession.conf.get(setting))) or write(rows, *rest)
    )
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    flows.admission(flows.arriving_files(spark, folder), out, checkpoint).awaitTermination()
    assert seen == [4 * spark.sparkContext.defaultParallelism]
    assert spark.conf.get(setting) == before


def test_a_batch_of_small_files_is_listed_and_read_in_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(200):
        (tmp_path / "in" / f"{i}.png").write_bytes(im.png_bytes(np.full((24, 32), i, np.uint8)))
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1m")  # a split for each file
    try:
        files_ = flows.arriving_files(spark, str(tmp_path / "in"))
        query = flows.admission(files_, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    assert flows.judged_files(spark, str(tmp_path / "out")).count() == 200
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s is not None]
    # two scans: within the limit of bytes, and over it
    assert tasks and max(tasks) <= 2 * 4 * spark.sparkContext.defaultParallelism


def test_a_small_batch_is_read_in_fewer_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(200):
        (tmp_path / "in" / f"{i}.bin").write_bytes(b"x")
    setting, cores = "spark.sql.files.maxPartitionBytes", spark.sparkContext.defaultParallelism
    before, seen = spark.conf.get(setting), []
    spark.conf.set(setting, "1m")  # a split for each file
    try:
        for batch in (100, 300 * cores, 10_000 * cores):
            stream = flows.arriving_files(spark, str(tmp_path / "in"), batch)
            note = stream.writeStream.foreachBatch(lambda rows, _: seen.append(rows.rdd.getNumPartitions()))
            note.option("checkpointLocation", str(tmp_path / str(batch))).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    # 200 files in two batches, in one, and in one
    assert seen == [cores, cores, 300 * cores // flows.FILES_PER_TASK, 4 * cores]
