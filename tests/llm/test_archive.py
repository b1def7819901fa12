import base64
import hashlib
import io

import pyarrow.fs
import pytest
import zstandard

from pyspark.sql import functions as F

from spendframe.llm import archive, queries


def expected(pages, least=0):
    """(page_id, bytes, digest, type, refers_to) by definition."""
    first = {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        if page_id is not None and len(data) >= least:
            first[data] = min(page_id, first.get(data, page_id))
    rows = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        head = first.get(data) if len(data) >= least else None
        revisit = head is not None and head != page_id
        rows.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(rows, key=str)


PAGES = [
    (5, "http://a/1", "<p>one</p>"),
    (3, "http://a/2\r\nWARC-Type: evil", "<p>one</p>"),
    (9, None, None),
    (8, "http://ü/é", ""),
    (7, "x", "é" * 400_000),
    (2, "x", "two\r\n\r\nWARC/1.1\r\n"),
    (2, "x", "two\r\n\r\nWARC/1.1\r\n"),
    (None, "x", "<p>one</p>"),
    (None, "x", "alone"),
]
FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*row, "clash") for row in PAGES], "page_id long, url string, html string, payload string")
    index = archive.write(pages, least_bytes=least)
    assert index.count() == len(PAGES)
    records = archive.read(index).collect()
    assert sorted((tuple(row[name] for name in FIELDS) for row in records), key=str) == expected(PAGES, least)
    payloads = {row.page_id: (row.payload or b"").decode() for row in records if row.record_type == "response"}
    assert payloads[7] == "é" * 400_000 and payloads[3] == "<p>one</p>" and payloads[2] == PAGES[5][2]
    assert {row.url for row in records if row.page_id in (3, 9)} == {"http://a/2%0D%0AWARC-Type:%20evil", None}


def test_frames_are_independent_and_any_tool_reads_them(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(500)]
    index = archive.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    monkeypatch.setattr(archive, "FRAME_BYTES", 2000)
    bundle = archive.Bundle("file:///tmp")
    for page_id, url, html in rows[:40]:
        bundle.add(page_id, archive.build_record(page_id, url, html.encode(), None, False))
    entries = bundle.close()
    files, path = pyarrow.fs.FileSystem.from_uri(bundle.path)
    with files.open_input_file(path) as file:
        table = archive.read_seek_table(file)
        file.seek(0)
        whole = file.read()
    files.delete_file(path)
    assert len(table) > 10 and sum(size for size, _ in table) + 8 + 8 * len(table) + 9 == len(whole)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
    assert len(plain) == sum(size for _, size in table)
    for entry in entries:
        frame = zstandard.ZstdDecompressor().decompress(whole[entry["frame_start"] :][: entry["frame_size"]])
        record, stop = archive.parse_record(frame, entry["offset"])
        assert record["page_id"] == entry["page_id"] and stop - entry["offset"] == entry["length"]
    wanted = spark.createDataFrame([(3,), (77,), (499,), (5000,), (None,)], "page_id long")
    assert sorted(row.payload.decode() for row in archive.fetch(index, wanted).collect()) == sorted(rows[i][2] for i in (3, 77, 499))


def test_damage_is_noticed():
    record = archive.build_record(1, "u", b"payload", None, False)
    assert archive.parse_record(record)[0]["payload"] == b"payload"
    with pytest.raises(ValueError):
        archive.parse_record(record.replace(b"payload\r\n", b"paylOad\r\n"))
    with pytest.raises(ValueError):
        archive.parse_record(record[5:])


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.read(archive.write(pages)).count() == 0


def test_query_against_definition(spark, sf_dir):
    pages = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = queries.QUERIES["op7_archive"](spark, sf_dir).select(*FIELDS).collect()
    assert sorted((tuple(row) for row in rows), key=str) == expected(pages)


def test_reading_takes_tasks_in_proportion_to_the_bundles(spark, tmp_path, monkeypatch):
    """Tiny rows that name the bundles are not merged into one task; a path without a scheme is resolved by Spark."""
    index = archive.write(spark.range(40).selectExpr("id page_id", "'u' url", "repeat(string(id), 50) html").repartition(40), str(tmp_path / "w"))
    assert index.select("bundle").distinct().count() > 20
    assert all(row.bundle.startswith("file:///") for row in index.collect())
    used = archive.read(index, 4).select(F.spark_partition_id()).distinct().count()
    assert used > 4
    assert archive.read(index, 4).count() == 40
    assert archive.fetch(index, spark.range(3).selectExpr("id page_id")).count() == 3
