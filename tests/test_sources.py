"""Image bytes, sketches and streams. Pictures are written by the JVM's own encoder."""

import struct

import numpy as np
import pytest

from keepset.operators import sketches
from keepset.sources import files, images, jpeg, tiff


def picture(spark, path, quality=0.9, width=256, height=160, seed=0):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    base = 128 + 60 * np.sin(x / 17.0 + seed) + 40 * np.cos(y / 11.0) + rng.normal(0, 14, (height, width))
    value = np.clip(base, 0, 255).astype(np.int64)
    rgb = (value << 16) + (value << 8) + value
    pixels = spark.sparkContext._gateway.new_array(jvm.int, width * height)
    for k, v in enumerate(rgb.reshape(-1).tolist()):
        pixels[k] = v
    image.setRGB(0, 0, width, height, pixels, 0, width)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setCompressionMode(2)
    settings.setCompressionQuality(quality)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
    stream.close()
    return value


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("pictures")
    picture(spark, where / "fine.jpg", 0.9)
    picture(spark, where / "coarse.jpg", 0.3)
    (where / "broken.jpg").write_bytes(b"\xff\xd8nothing")
    return where


def test_coefficients_give_the_picture_back(spark, tmp_path):
    """Undoing the transform by hand comes close to what was encoded."""
    value = picture(spark, tmp_path / "p.jpg", 0.95, 64, 48)
    data = (tmp_path / "p.jpg").read_bytes()
    head = jpeg.header(data)
    assert (head.width, head.height) == (64, 48)
    steps = np.zeros(64, dtype=np.int64)
    steps[jpeg.ZIGZAG] = head.quantizers[head.components[0].quantizer]
    blocks = jpeg.luma_coefficients(data) * steps.reshape(8, 8)
    assert len(blocks) == 48
    basis = sketches._cosines(8)
    pixels = np.einsum("ji,njk,kl->nil", basis, blocks, basis) + 128
    whole = pixels.reshape(3, 4, 2, 2, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(48, 64)  # units of two by two blocks
    assert np.abs(whole - value).mean() < 4


def test_blocks_are_bounded(folder):
    data = (folder / "fine.jpg").read_bytes()
    assert len(jpeg.luma_coefficients(data, 100)) == 100
    with pytest.raises(jpeg.Unsupported):
        jpeg.luma_coefficients(b"\x89PNG")


def test_probe(spark, folder):
    found = images.with_scalars(images.probe(files.scan(spark, str(folder), content=True)))
    rows = {r["path"].split("/")[-1]: r for r in found.collect()}
    assert rows["broken.jpg"]["error"] and rows["fine.jpg"]["error"] is None
    assert (rows["fine.jpg"]["w"], rows["fine.jpg"]["h"], rows["fine.jpg"]["pixels"]) == (256, 160, 256 * 160)
    assert rows["coarse.jpg"]["tier"] > rows["fine.jpg"]["tier"] >= 0
    assert not rows["fine.jpg"]["raw"] and rows["fine.jpg"]["meta"] == 0 and rows["fine.jpg"]["t"] > 0


def test_comb():
    x = np.arange(41)
    smooth = 1000 * np.exp(-((x - 20) ** 2) / 60)
    assert images.comb(smooth) < 0.2 and images.comb(smooth * (x % 2 == 0)) > 0.9 and images.comb(np.ones(8)) is None


def _tiff(order, entries, exif=()):
    """A TIFF block with short text and number tags."""
    out, after = bytearray(), bytearray()
    first = 8 + 2 + 12 * (len(entries) + bool(exif)) + 4
    rows = [*entries, *([(tiff.EXIF, 4, None)] if exif else [])]

    def row(tag, kind, value, base):
        if kind == 2:
            raw = value.encode() + b"\0"
            if len(raw) > 4:
                at = base + len(after)
                after.extend(raw)
                return struct.pack(order + "HHII", tag, 2, len(raw), at)
            return struct.pack(order + "HHI", tag, 2, len(raw)) + raw.ljust(4, b"\0")
        return struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))

    inner = bytearray()
    if exif:
        base = first
        inner += struct.pack(order + "H", len(exif))
        strings_at = first + 2 + 12 * len(exif) + 4
        for tag, kind, value in exif:
            inner += row(tag, kind, value, strings_at)
        inner += b"\0" * 4 + bytes(after)
        after.clear()
    out += struct.pack(order + "H", len(rows))
    end = first + len(inner)
    for tag, kind, value in rows:
        out += row(tag, kind, first if value is None else value, end)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + bytes(out) + b"\0" * 4 + bytes(inner) + bytes(after)


@pytest.mark.parametrize("order", "<>")
def test_tags(order):
    data = _tiff(order, [(256, 4, 640), (257, 3, 480), (274, 3, 6), (305, 2, "Adobe Photoshop 1.0"), (306, 2, "2020:01:02 03:04:09")], [(36867, 2, "2020:01:02 03:04:05"), (41985, 3, 3)])
    found = tiff.tags(data)
    assert tiff.dimensions(data) == (640, 480)
    assert tiff.taken_at(found) == 1577934245.0
    assert tiff.flags(found) == {"software": "Adobe Photoshop 1.0", "maker": False, "moved": True, "upright": True, "rendered": 3, "meta": 1}
    assert tiff.tags(b"xx") == {} and tiff.dimensions(data[:20]) == (0, 0)


def test_preview(folder):
    small, large = (folder / "coarse.jpg").read_bytes(), (folder / "fine.jpg").read_bytes()
    assert tiff.largest_preview(b"RAW" + small + b"gap" + large + b"tail") in (small, large)
    assert tiff.largest_preview(b"none") is None


def test_sketches(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0 : sketches.HEIGHT, 0 : sketches.WIDTH]
    a = (128 + 50 * np.sin(x / 9) + 40 * np.sin(y / 13) + rng.normal(0, 3, x.shape)).clip(0, 255).astype(np.uint8)
    brighter, other = (a.astype(int) + 20).clip(0, 255).astype(np.uint8), rng.integers(0, 255, a.shape).astype(np.uint8)
    apart = lambda p, q: (sketches.signature(p) ^ sketches.signature(q)).bit_count()
    assert apart(a, brighter) <= 4 and apart(a, other) > 15
    assert sketches.residual(a, a) == (0.0, 0.0)
    shaken = np.roll(a, (3, -5), (0, 1))
    assert sketches._shift(shaken.astype(float), a.astype(float)) == (3, -5)
    assert sketches.residual(a, shaken)[0] < 0.02 < sketches.residual(a, other)[0]
    rows = spark.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(other.tobytes()))], "id long, sketch binary")
    assert dict(map(tuple, sketches.signatures(rows).collect())) == {1: sketches.signature(a), 2: sketches.signature(other)}
    pair = rows.alias("p").crossJoin(rows.alias("q")).selectExpr("p.id a", "q.id b", "p.sketch sketch_a", "q.sketch sketch_b").where("a < b")
    assert sketches.residuals(pair).first()["block"] == pytest.approx(sketches.residual(a, other)[0])


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from keepset.streaming import sessions

    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 01:30:00"), ("u", "2024-01-01 03:00:01"), ("u", "2024-02-01 00:00:00")], "user string, ts string").select("user", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    query = sessions.shoots(stream, "user").writeStream.format("memory").queryName("shoots").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["members"] for r in spark.table("shoots").collect()) == [1, 2]
    (tmp_path / "queue").mkdir()
    (tmp_path / "queue/1.path").write_text("/a\n")
    (tmp_path / "queue/2.paths").write_text("/b\n/c\n\n")
    seen = []
    assert sessions.drain(spark, str(tmp_path / "queue"), str(tmp_path / "state"), seen.append) == 3
    assert seen == ["/a", "/b", "/c"] and sessions.drain(spark, str(tmp_path / "queue"), str(tmp_path / "state"), seen.append) == 0
