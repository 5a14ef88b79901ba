import base64
import hashlib
import struct

import pytest
import zstandard

from assetweave.llm import warc as d

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "http://c/", "é" * 300_000), (6, "u", "<p>own</p>"),
        (7, "u", "a\r\n\r\nb\r\n\r\n"), (8, "z", "<p>same</p>")]


def expected(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            top[digest(h)] = max(i, top.get(digest(h), i))
    out = []
    for i, _, h in rows:
        first = top.get(digest(h), i)
        out.append((i, len((h or "").encode()), digest(h), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out)


def run(spark, rows, least=0):
    got = d.round_trip(spark.createDataFrame(rows, SCHEMA), least).collect()
    by_id = {i: h or "" for i, _, h in rows}
    assert all(r.html == (by_id[r.page_id] if r.record_type == "response" else None) for r in got)
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)


def test_round_trip(spark):
    assert run(spark, ROWS) == expected(ROWS)
    assert run(spark, ROWS, 5) == expected(ROWS, 5)


def test_many_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body><p>page {i} " + "of text " * (i % 50)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = d.write_archives(df, str(tmp_path / "out"), limit=20_000)
    assert manifest.count() > 5 and manifest.selectExpr("sum(records)").first()[0] == 600
    got = d.read_archives(spark, str(tmp_path / "out"), manifest).collect()
    assert {(r.page_id, r.html) for r in got} == {(i, h) for i, _, h in rows}


def test_files_that_the_manifest_does_not_list_are_not_read(spark, tmp_path):
    manifest = d.write_archives(spark.createDataFrame(ROWS[:2], SCHEMA), str(tmp_path / "out"))
    (tmp_path / "out" / "stray.warc.zst").write_bytes(b"left by a lost attempt")
    assert d.read_archives(spark, str(tmp_path / "out"), manifest).count() == 2


def test_one_frame_per_record_behind_the_dictionary():
    records = [d._record(i, "u", b"x" * i, None) for i in range(50)]
    data = d.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and data[8 + size:12 + size] == struct.pack("<I", 0xFD2FB528)
    assert [b for _, b in d.records_of(data)] == [r.partition(b"\r\n\r\n")[2][:-4] for r in records]
    plain = zstandard.ZstdDecompressor().decompressobj().decompress(data[8:8 + size])
    bare = struct.pack("<II", magic, len(plain)) + plain + data[8 + size:]
    assert len(list(d.records_of(bare))) == 50  # a dictionary that isn't compressed


@pytest.mark.parametrize("change, said", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9"), "header"), (lambda r: r.replace(b"WARC-Date: ", b"X: "), "warc-date"),
    (lambda r: r[:-1] + b"x", "two line ends"), (lambda r: r[:-4], "bytes"), (lambda r: r.replace(b"body", b"b0dy"), "payload"),
    (lambda r: r.replace(b"WARC-Type", b"WARC-Type\r\nbroken"), "without a field")])
def test_faults_are_found(change, said):
    data = d.archive([change(d._record(1, "u", b"body", None))])
    with pytest.raises(d.ArchiveError, match=said):
        for fields, block in d.records_of(data):
            d.payload_of(fields, block, "here")


def test_cut_archives_are_found():
    data = d.archive([d._record(i, "u", b"some text of a page " * 9, None) for i in range(20)])
    for bad in (b"", data[:6], data[:100], data[:-3], b"\0" * 20 + data, data[:-40] + b"\xff" * 40):
        with pytest.raises(d.ArchiveError):
            list(d.records_of(bad))


def test_repeated_rows_null_ids_and_empty_table(spark):
    got = d.round_trip(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "b")], SCHEMA)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [
        ("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert d.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
