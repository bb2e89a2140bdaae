import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from keelson.llm import media, warc
from keelson.llm.common import open_fs, shared_dir


def check(docs, **kw):
    got = media.media_columns(docs, **kw).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        p = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert all(r.error is None for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add(tuple(r)[5:])
    assert all(len(s) == 1 for s in by_text.values())


def test_round_trip(spark, sf, edge, empty):
    check(spark.read.parquet(f"{sf}/documents.parquet"), range_bytes=20_000)
    check(edge)
    check(spark.createDataFrame([(1, "x" * 576), (2, "y" * 1152), (3, "é" * 288)], "doc_id bigint, text string"))
    assert media.media_columns(empty).count() == 0


def test_a_damaged_member_is_told_and_the_rest_read(spark, edge):
    path = shared_dir(spark, "damaged")
    media.write_archives(media.encoded(edge).coalesce(1), path)
    whole = media.read_archives(spark, path, range_bytes=1000).orderBy("offset").collect()
    assert len(whole) == edge.count()
    fs, base = open_fs(path)
    hurt = whole[3]
    with open(f"{base}/{hurt.archive}", "r+b") as f:
        f.seek(hurt.offset + 40)
        f.write(b"\x00\x01\x02")
    again = media.read_archives(spark, path).orderBy("offset").collect()
    assert [r.error is not None for r in again] == [i == 3 for i in range(len(again))]
    with pytest.raises(ValueError):
        media.decode_png(b"\x89PNG\r\n\x1a\n" + b"\0" * 40)


def test_members_fail_and_are_tried_again():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("lost")
        return 7

    assert media._again(flaky, 3) == 7
    with pytest.raises(OSError):
        media._again(lambda: (_ for _ in ()).throw(OSError("gone")), 2)


def test_a_failing_handle_gives_way_to_another(tmp_path):
    (tmp_path / "x").write_bytes(b"abcdef")
    opened = []
    with media.Archive(f"file://{tmp_path}/x") as f:

        def read():
            opened.append(f.handle)
            if len(opened) == 1:
                f.handle.close()
            return f.handle.read(3)

        assert media._again(read, 3, f.reopen) == b"abc"
        assert len(opened) == 2 and opened[0] is not opened[1]


def test_writes_add_up_and_ranges_grow_with_the_total(spark, edge, monkeypatch):
    path = shared_dir(spark, "twice")
    media.write_archives(media.encoded(edge.limit(3)), path)
    media.write_archives(media.encoded(edge.limit(2)), path)
    assert media.read_archives(spark, path).count() == 5
    reader = media.ArchiveReader([path], 1, 2)
    many = len(reader.partitions())
    monkeypatch.setattr(media, "PLANNED", 10)
    assert many > 300 and len(reader.partitions()) <= 20  # 366 bytes of members, in a few archives
    ids = spark.createDataFrame([("a1", "x"), ("7", "y")], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in media.media_columns(ids).collect()) == ["7", "None"]
    docs = media.encoded(edge.limit(4)).write.format("keelson_archive").option("path", path)
    docs.mode("overwrite").save()
    assert media.read_archives(spark, path).count() == 4


@pytest.fixture(scope="module")
def pages(spark, sf):
    odd = spark.createDataFrame([(None, "http://a b", None), (900, None, ""), (900, None, "x" * 200_000), (901, "u", "WARC/1.1\r\n\r\n"), (901, "u", "é😀".encode("utf-16", "surrogatepass").decode("utf-16"))], "page_id bigint, url string, html string")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(odd)


def test_audit_finds_exactly_the_decay(spark, pages):
    for n_files in (1, 3):
        for rotten in (F.lit(False), F.col("page_id") % 7 == 3, F.lit(True)):
            rotten = F.coalesce(rotten, F.lit(False))
            got = warc.fixity_drill(pages.repartition(n_files), rotten, file_bytes=30_000).collect()
            want = pages.select("page_id", F.coalesce("html", F.lit("")).alias("h"), rotten.alias("d")).collect()
            row = lambda i, n, h, d: str((i, n, h, True, d))
            assert sorted(str(tuple(r)) for r in got) == sorted(row(r.page_id, len(r.h.encode()), hashlib.sha256(r.h.encode()).hexdigest(), r.d) for r in want)
    assert warc.fixity_drill(pages.limit(0), F.lit(True)).count() == 0


def test_a_lost_file_differs_throughout(spark, pages):
    a, b = shared_dir(spark, "a"), shared_dir(spark, "b")
    index = warc.write_warc(pages.repartition(2), a)
    warc.replicate(index, a, b)
    fs, base = open_fs(b)
    gone = index.select("file").first().file
    fs.delete_file(f"{base}/{gone}")
    bad = warc.audit(index, a, b).where("differs")
    assert bad.where(F.col("file") != gone).isEmpty() and bad.count() == index.where(F.col("file") == gone).count()


def test_missing_and_extra_records_differ(spark, pages):
    a, b = shared_dir(spark, "a"), shared_dir(spark, "b")
    index = warc.write_warc(pages.repartition(2), a, 20_000)
    warc.replicate(index, a, b)
    files = sorted(r.file for r in index.select("file").distinct().collect())
    # of the other replica one file is missing in its index, one record of another, and the first lacks a file itself
    last = index.where(F.col("file") == files[1]).agg(F.max("seq")).first()[0]
    theirs = index.where((F.col("file") != files[0]) & ~((F.col("file") == files[1]) & (F.col("seq") == last)))
    ours = index.where(F.col("file") != files[2])
    got = warc.audit(ours, a, b, theirs)
    key = lambda df: sorted((r.file, r.seq) for r in df.select("file", "seq").collect())
    want = index.where(F.col("file").isin(files[0], files[2]) | ((F.col("file") == files[1]) & (F.col("seq") == last)))
    assert key(got.where("differs")) == key(want)
    assert key(got.where("intact is null")) == key(index.where(F.col("file") == files[2]))
    assert got.count() == index.count()


def test_urls_stay_whole():
    fields, _ = warc.parse(warc.record(1, "http://a b\t?q=\u00e9", "x"))
    assert fields["warc-target-uri"] == "http://a%20b%09?q=\u00e9"
