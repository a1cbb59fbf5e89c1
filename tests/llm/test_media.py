import hashlib
import os
import zipfile
import zlib

import pytest

from skarn.llm import media

ROWS = [(1, "hello", "a"), (2, None, "b"), (3, "", "c"), (4, "x" * 64, "d"), (4, "x" * 64, "d"), (None, "é" * 1000, "e"), (6, "long " * 60000, "f")]


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def rows_of(df):
    return sorted((r.key or "", r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.with_features(df).collect())


def expected():
    return sorted((str(i) if i is not None else "", len((t or "").encode()), len(payload(t)), hashlib.sha256(payload(t)).hexdigest(), zlib.crc32(payload(t)[-64:])) for i, t, _ in ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, payload string")


def test_round_trip_over_many_small_archives_and_ranges(spark, docs):
    path = media.store(docs.repartition(3), archive_bytes=300)
    assert len(os.listdir(path.removeprefix("file://"))) > 4
    for most in (500, 4000, 1 << 20):
        assert rows_of(media.load(spark, path, most)) == expected()


def test_png_is_a_png_and_lossless():
    for text in (b"", b"abc", bytes(range(256)) * 5):
        samples, n = media.decode(media.encode(text))
        assert n == len(text) and samples == media.payload_of(text) and len(samples) % 64 == 0


def test_equal_texts_equal_values_and_empty_table(spark, docs):
    got = media.with_features(media.load(spark, media.store(docs))).where("key = '4'").collect()
    assert len(got) == 2 and got[0].asDict() == got[1].asDict()
    assert media.load(spark, media.store(docs.limit(0))).count() == 0


def test_a_member_is_read_again_by_its_offset(tmp_path):
    from pyarrow.fs import LocalFileSystem

    path = f"{tmp_path}/a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("000000000-1.png", media.encode(b"first"))
        z.writestr("000000001-2.png", media.encode(b"second"))
    member = zipfile.ZipFile(path).infolist()[1]
    broken = bytes(200)  # the block came back damaged; the file is sound
    assert media.MediaReader._member(LocalFileSystem(), path, member, broken, 0)[0].startswith(b"second")
    raw = bytearray(open(path, "rb").read())
    raw[member.header_offset + 60] ^= 255
    open(path, "wb").write(bytes(raw))
    with pytest.raises(OSError):
        media.MediaReader._member(LocalFileSystem(), path, member, bytes(raw), member.header_offset)


def test_uncommitted_archives_are_not_read(spark, docs):
    path = media.store(docs)
    local = path.removeprefix("file://")
    with zipfile.ZipFile(f"{local}/left-behind.zip", "w") as z:
        z.writestr("000000000-9.png", media.encode(b"stray"))
    assert rows_of(media.load(spark, path)) == expected()


def plain_feature(raw):
    """From the definition: mean, deviation, and which of the 64 columns are brighter than the mean."""
    n, total = len(raw), sum(raw)
    deviation = max(0.0, sum(b * b for b in raw) / n - (total / n) ** 2) ** 0.5
    bits = "".join("1" if sum(raw[k::64]) * 64 > total else "0" for k in range(64))
    return f"{total / n:.4f}:{deviation:.4f}:{int(bits, 2):016x}"


def plain_png(raw, n):
    """The stored form read chunk by chunk: signature, size and kind of the image, length, samples and checksums."""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        body = raw[at + 4 : at + 8 + size]
        assert zlib.crc32(body) == int.from_bytes(raw[at + 8 + size : at + 12 + size], "big")
        chunks.append((body[:4], body[4:]))
        at += 12 + size
    head = chunks[0][1]
    assert chunks[0][0] == b"IHDR" and int.from_bytes(head[:4], "big") == 64 and head[8:10] == b"\x08\x00" and chunks[-1][0] == b"IEND"
    rows = zlib.decompress(b"".join(c for k, c in chunks if k == b"IDAT"))
    samples = b"".join(rows[i + 1 : i + 65] for i in range(0, len(rows), 65))
    assert set(rows[::65]) == {0} and int.from_bytes(head[4:8], "big") * 64 == len(samples)
    return samples


def test_query_equals_plain_definitions(spark, sf):
    rows = {r.doc_id: r for r in media.op4_archive_source(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert set(rows) == {d.doc_id for d in docs}
    for d in docs:
        r, raw = rows[d.doc_id], payload(d.text)
        stored = media.encode((d.text or "").encode())
        assert plain_png(stored, r.n_bytes) == raw
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(raw))


def test_ranges_grow_beyond_so_many(monkeypatch, spark, docs):
    path = media.store(docs.repartition(3), archive_bytes=300)
    monkeypatch.setattr(media, "MOST_RANGES", 2)
    assert len(media.MediaReader({"path": path, "range_bytes": "1"}).partitions()) < 20
