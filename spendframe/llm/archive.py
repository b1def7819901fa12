"""WARC archives as seekable Zstandard bundles.

Each task writes its records to bundle files in a shared folder: whole records are grouped into independent
frames, and a skippable frame at the end holds the seek table (compressed and decompressed size of each
frame), so that any frame can be read alone and any Zstandard tool can still read the file. The index, a
stored table, maps record identifiers to bundle, frame and offset within the frame. A task that runs again
writes new files under new names; only files that the index names count.
"""

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.session import durable, new_path

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Bundles that one reading task takes, about 64 MB.
BUNDLES_AT_ONCE = 4
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Numbers of the seekable format, and the WARC profile of revisits.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc:page")

INDEX = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
)
INDEX_DDL = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_size long, offset long, length long"
RECORD = pa.schema(
    [("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)
RECORD_DDL = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP head only, but the digest and size of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    safe = None if url is None else "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record that starts at `start` and where it ends. Damage raises ValueError."""
    cut = data.find(b"\r\n\r\n", start)
    lines = data[start:cut].decode("utf-8").split("\r\n") if cut >= 0 else [""]
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    stop = cut + 4 + int(fields["content-length"])
    block = data[cut + 4 : stop]
    if f"sha1:{digest(block)}" != fields["warc-block-digest"] or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
    known, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != known):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    record = {
        "page_id": number("x-page-id"),
        "record_id": fields["warc-record-id"],
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": size,
        "payload_digest": known,
        "payload": None if revisit else payload,
    }
    return record, stop + 4


class Bundle:
    """Collects records into frames and writes one file."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.files, path = pyarrow.fs.FileSystem.from_uri(self.path)
        self.file = self.files.open_output_stream(path, compression=None)  # else the name decides
        self.frames: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.waiting, self.size, self.written, self.first = [], 0, 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.waiting and self.size + len(record) > FRAME_BYTES:
            self.flush()
        entry = {"record_id": record_id(page_id), "page_id": page_id, "bundle": self.path, "frame": len(self.frames)}
        self.index.append(entry | {"offset": self.size, "length": len(record)})
        self.waiting.append(record)
        self.size += len(record)

    def flush(self) -> None:
        packed = self.packer.compress(b"".join(self.waiting))
        self.file.write(packed)
        for entry in self.index[self.first :]:
            entry |= {"frame_start": self.written, "frame_size": len(packed)}
        self.first = len(self.index)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.waiting, self.size = [], 0

    def close(self) -> list[dict]:
        if self.waiting:
            self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return self.index


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *frame) for frame in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(file) -> list[tuple[int, int]]:
    """(compressed, decompressed) sizes of the frames of an open file."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table of this kind at the end of the file")
    file.seek(size - 9 - 8 * count)
    return list(struct.iter_unpack("<II", file.read(8 * count)))


def _open(path: str):
    files, own = pyarrow.fs.FileSystem.from_uri(path)
    return files.open_input_file(own)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        bundle, size = None, 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(k) for k in range(4))):
                page_id, payload, first = page_id.as_py(), payload.as_py() or b"", first.as_py()
                record = build_record(page_id, url.as_py(), payload, first, first is not None and first != page_id)
                bundle = bundle or Bundle(folder)
                bundle.add(page_id, record)
                size += len(record)
                if size >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pylist(bundle.close(), INDEX)
                    bundle, size = None, 0
        if bundle:
            yield pa.RecordBatch.from_pylist(bundle.close(), INDEX)

    return run


def resolved(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host that Spark resolves it to, so that executors open the same place."""
    if "://" not in folder:
        probe = f"{folder}/place-{uuid.uuid4().hex}"
        spark.range(1).coalesce(1).write.parquet(probe)
        folder = unquote(spark.read.parquet(probe).select("_metadata.file_path").first()[0]).rsplit("/place-", 1)[0]
    return re.sub("^file:/+", "file:///", folder)


def write(pages: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes one record per row and returns the stored index.

    Among rows whose payloads are equal and have at least `least_bytes` bytes, those with the smallest id are responses
    and the others revisits of it; shorter payloads are all responses. A null payload counts as empty. Rows with a null
    id revisit the smallest id of their payload, or are responses if it has none. Repeated rows are written
    repeatedly, under one identifier. The folder is one that Spark and pyarrow can open; by default a new one in
    the shared folder of the session. A path without a scheme is where Spark finds it.
    """
    spark = pages.sparkSession
    folder = resolved(spark, folder or new_path(spark, "warc"))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("hash", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    groups = rows.where("hash is not null").groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = durable(groups.where("n > 1").select("hash", "first"), "warc-copies")
    joined = rows.join(groups, "hash", "left").select("page_id", "url", "payload", "first")
    return durable(joined.mapInArrow(_writer(folder), INDEX_DDL), "warc-index")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as file:
                start = 0
                for packed, size in read_seek_table(file):
                    file.seek(start)
                    data = unpacker.decompress(file.read(packed), max_output_size=size)
                    start += packed
                    records, at = [], 0
                    while at < len(data):
                        record, at = parse_record(data, at)
                        records.append(record)
                    yield pa.RecordBatch.from_pylist(records, RECORD)


def read(index: DataFrame, bundles_at_once: int = BUNDLES_AT_ONCE) -> DataFrame:
    """All records of the bundles that an index names, one task for about `bundles_at_once` bundles, frame by frame.

    The rows that name the bundles are tiny, so the number of tasks is given, by the number of bundles; left to
    adaptive execution they would all be merged into one.
    """
    bundles = durable(index.select("bundle").distinct(), "warc-bundles")
    return bundles.repartition(_tasks(bundles, bundles_at_once), "bundle").mapInArrow(_frames, RECORD_DDL)


def _tasks(bundles: DataFrame, bundles_at_once: int) -> int:
    return max(1, -(-bundles.count() // bundles_at_once))


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    last, data = None, b""
    for batch in batches:
        for row in batch.to_pylist():
            if last != (row["bundle"], row["frame_start"]):
                last = row["bundle"], row["frame_start"]
                with _open(row["bundle"]) as file:
                    file.seek(row["frame_start"])
                    data = unpacker.decompress(file.read(row["frame_size"]))
            yield pa.RecordBatch.from_pylist([parse_record(data, row["offset"])[0]], RECORD)


def fetch(index: DataFrame, wanted: DataFrame, id: str = "page_id", bundles_at_once: int = BUNDLES_AT_ONCE) -> DataFrame:
    """The records of wanted ids, reading only the frames that hold them. Unknown ids give no row."""
    places = index.join(wanted.select(F.col(id).alias("page_id")).distinct(), "page_id", "left_semi")
    places = durable(places.select("bundle", "frame_start", "frame_size", "offset"), "warc-places")
    tasks = _tasks(places.select("bundle").distinct(), bundles_at_once)
    return places.repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame_start", "offset").mapInArrow(_pick, RECORD_DDL)
