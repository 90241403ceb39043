import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import media, queries
from meterloom.llm.media import Decoder, bytes_to_jpeg


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 7, 24, 25, 150, 1000])
def test_payload_round_trip(blocks):
    payload = np.random.default_rng(blocks).integers(0, 256, 64 * blocks).astype(np.uint8).tobytes()
    for p in (payload, b"\xff" * len(payload), b"\0" * len(payload)):
        assert Decoder(bytes_to_jpeg(p)).payload() == p


def java_image(spark, data):
    jvm = spark.sparkContext._jvm
    stream = jvm.java.io.ByteArrayInputStream(bytearray(data))
    return jvm.javax.imageio.ImageIO.read(stream)


def pixels_of(spark, image):
    h, w = image.getHeight(), image.getWidth()
    values = np.array(list(image.getRaster().getPixels(0, 0, w, h, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.int, w * h * image.getRaster().getNumBands()))))
    return values.reshape(h, w, -1)


def test_other_decoders_read_the_files(spark):
    payload = ("Some text that is stored. " * 40).encode()
    data = bytes_to_jpeg(payload[: len(payload) // 64 * 64])
    image = java_image(spark, data)
    assert image is not None and (image.getWidth(), image.getHeight()) == Decoder(data).rgb().shape[1::-1]


def written_by_java(spark, picture):
    """A progressive JPEG of another writer, with its own scans and Huffman tables."""
    jvm = spark.sparkContext._jvm
    h, w, _ = picture.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in picture[y, x])
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    modes = jvm.java.lang.Class.forName("javax.imageio.ImageWriteParam")
    param.setProgressiveMode(modes.getField("MODE_DEFAULT").get(None))
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    return bytes(out.toByteArray()), image


def test_reads_files_of_other_writers(spark):
    y, x = np.mgrid[0:45, 0:70]
    picture = np.stack([(x * 3) % 256, (y * 5) % 256, (x + y) % 256], axis=2).astype(np.uint8)
    data, _ = written_by_java(spark, picture)
    assert b"\xff\xc2" in data
    got = Decoder(data).rgb()
    want = pixels_of(spark, java_image(spark, data))[:, :, :3]
    assert got.shape == want.shape == picture.shape
    # Decoders differ in how they smooth chroma; luma must agree.
    luma = lambda p: p.astype(float) @ [0.299, 0.587, 0.114]
    assert np.abs(luma(got) - luma(want)).mean() < 2


def test_op3_digests(spark, sf):
    got = {r.doc_id: r for r in queries.op3_media(spark, sf).collect()}
    features = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert features.setdefault(r.text, (g.media_sha256, g.media_bytes, g.feature)) == (g.media_sha256, g.media_bytes, g.feature)


def test_features_and_files_by_another_decoder(spark, sf):
    """Java's decoder reads each stored file: same size, mean colours alike; the file is what its text gives."""
    found = queries.op3_media(spark, sf).orderBy("doc_id").limit(25).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in found:
        data = bytes_to_jpeg(media.payload_of(texts[r.doc_id])[0])
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.media_bytes, r.media_sha256)
        pixels = pixels_of(spark, java_image(spark, data))[:, :, :3]
        size, means, _ = r.feature.split(":")
        assert size == f"{pixels.shape[1]}x{pixels.shape[0]}"
        assert np.abs(np.array(list(map(int, means.split(",")))) / 1000 - pixels.mean(axis=(0, 1))).max() < 6, r.doc_id


def test_media_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "x" * 64, 3), (2, "é" * 40000, 4)], "doc_id bigint, text string, media int")
    stored = media.encode_texts(docs)
    rows = media.media_digests(stored).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in rows) == [(0, 64), (0, 64), (64, 64), (80000, 80000)]
    none = stored.limit(1).select("doc_id", "n_bytes", F.lit(None).cast("binary").alias("media"))
    assert [r.media_sha256 for r in media.media_digests(none).collect()] == [None]
    tensors = media.decode_media(stored).collect()
    assert all(len(r._rgb) == r._height * r._width * 3 for r in tensors)
    assert media.media_digests(media.encode_texts(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        Decoder(b"no picture")
    whole = stored.first().media
    odd = spark.createDataFrame([(None, 7), (bytearray(b"no picture"), 8), (bytearray(whole[:60]), 9), (bytearray(whole), 10)], "media binary, _rgb int")
    got = media.decode_media(odd).collect()
    assert odd.columns == got[0].__fields__[:2] and [r._rgb for r in got] == [7, 8, 9, 10]
    assert [r['__rgb'] is None for r in got] == [True, True, True, False] and [r._problem is None for r in got] == [True, False, False, True]
    assert media.decode_media(odd.limit(0)).count() == 0
