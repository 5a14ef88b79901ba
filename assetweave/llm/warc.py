"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: records with equal payloads become one response and revisits that refer to it. Each task cuts its records
into archives of bounded size and trains each archive's dictionary on the first of its records. Archives go to the shared folder
under a name of their own for every attempt; the manifest, a table written by Spark, lists the archives that count.

Reading: Spark reads the files; a task takes the dictionary from the leading frame, decodes frame by frame and checks
version, needed fields, lengths, record ends and payload digests. A fault ends the job with its place.

A null payload is empty. Of equal payloads the row with the largest page_id is the response (null ids count as
smallest); rows that repeat that id are responses too.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.llm.common import schema
from assetweave.session import cut_lineage, shared_folder

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528  # fixed values of the Zstandard and WARC formats
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
ARCHIVE_BYTES = 16 << 20  # of records before compression
SAMPLE, DICTIONARY_BYTES = 400, 32 << 10
LEVEL = 3


class ArchiveError(ValueError):
    """What is wrong with an archive, and where."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
              ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Records to the bytes of an archive. Too few records to learn from give a dictionary of plain content."""
    sample = records[:SAMPLE]
    try:
        known = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL)
    except zstandard.ZstdError:
        known = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1",
                                              dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *map(press.compress, records)])


def records_of(data: bytes, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive."""
    if len(data) < 8:
        raise ArchiveError(f"{name}: no leading frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or len(data) < 8 + size:
        raise ArchiveError(f"{name}: no dictionary in the leading skippable frame")
    held = data[8:8 + size]
    if len(held) >= 4 and struct.unpack_from("<I", held)[0] == FRAME:
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    decode, at, view = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), 8 + size, memoryview(data)
    while at < len(data):
        frame, parts, begun = decode.decompressobj(), [], at
        while not frame.eof:
            if at >= len(data):
                raise ArchiveError(f"{name}: the frame at {begun} is cut off")
            step = view[at:at + 16384]
            try:
                parts.append(frame.decompress(step))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"{name}: the frame at {begun} can't be decoded: {e}") from e
            at += len(step) - len(frame.unused_data)
        yield _parse(b"".join(parts), f"{name}, frame at {begun}")


def _parse(record: bytes, place: str) -> tuple[dict[str, str], bytes]:
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ArchiveError(f"{place}: no {VERSION.decode()} header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8").partition(":")
        if not colon or not key.strip():
            raise ArchiveError(f"{place}: a header line without a field")
        fields[key.strip().lower()] = value.strip()
    if missing := [k for k in NEEDED if k not in fields]:
        raise ArchiveError(f"{place}: no {', '.join(missing)}")
    if not fields["content-length"].isdigit() or (n := int(fields["content-length"])) != len(rest) - 4:
        raise ArchiveError(f"{place}: the block has {len(rest) - 4} bytes, {fields['content-length']} are declared")
    if rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"{place}: the record doesn't end with two line ends")
    return fields, rest[:n]


def payload_of(fields: dict[str, str], block: bytes, place: str) -> tuple[bytes | None, int]:
    """The payload (None for revisits) and the length of the full payload, checked against length and digest."""
    http, found, payload = block.partition(b"\r\n\r\n")
    told = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not found or len(told) != 1 or not told[0].isdigit():
        raise ArchiveError(f"{place}: the payload's length is not declared")
    if fields["warc-type"] == "revisit":
        if payload or not fields.get("warc-refers-to"):
            raise ArchiveError(f"{place}: a revisit with a payload, or without what it refers to")
        return None, int(told[0])
    if len(payload) != int(told[0]) or fields.get("warc-payload-digest") != f"sha1:{digest32(payload)}":
        raise ArchiveError(f"{place}: the payload is not the declared one")
    return payload, len(payload)


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root)
        waiting, size = [], 0

        def flush():
            name = f"{uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(archive(waiting))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(waiting)], pa.int64())], ["archive", "records"])
        for batch in batches:
            for page, url, html, refers in zip(*batch.columns, strict=True):
                waiting.append(_record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py()))
                size += len(waiting[-1])
                if size >= limit:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()
    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of (page_id, url, html) below `folder`; returns the manifest (archive, records), a written table.

    Of equal payloads of at least `least` bytes all but one become revisits.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"))
    shared = pages.filter(F.octet_length("html") >= least).groupBy("_digest").agg(
        F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(
        F.col("_digest").alias("_shared"), "_first")
    shared = cut_lineage(shared, "shared_payloads")  # its size is then known: small, it goes to the pages
    marked = pages.join(shared, pages["_digest"] == shared["_shared"], "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))
    return cut_lineage(marked.mapInArrow(_write(folder, limit), schema("archive string, records long")), "manifest")


def _read(id_type: pa.DataType):
    def number(urn: str, place: str):
        if not (urn.startswith("<urn:page:") and urn.endswith(">")):
            raise ArchiveError(f"{place}: unknown record id {urn}")
        told = urn[10:-1]
        return None if told == "None" else pa.scalar(told).cast(id_type).as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [id_type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), id_type]
        names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held, data = [], 0, content.as_buffer().to_pybytes()
                for fields, block in records_of(data, path.as_py()):
                    place = f"{path}, {fields['warc-record-id']}"
                    payload, size = payload_of(fields, block, place)
                    refers = fields.get("warc-refers-to")
                    rows.append((number(fields["warc-record-id"], place), fields.get("warc-target-uri"),
                                 None if payload is None else payload.decode(), size, fields["warc-payload-digest"][5:],
                                 fields["warc-type"], refers and number(refers, place)))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, kinds, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)
    return run


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, id_type: str = "long") -> DataFrame:
    """A row per record: page_id, url, html (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if manifest is not None:
        files = files.join(manifest.select("archive").distinct(), F.element_at(F.split("path", "/"), -1) == F.col("archive"), "left_semi")
    kind = schema(f"x {id_type}")[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    return files.mapInArrow(_read(to_arrow_type(kind)), schema(
        f"page_id {id_type}, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, least)
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], schema(
            f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, html string, payload_bytes long, payload_digest string, "
            f"record_type string, refers_to {pages.schema['page_id'].dataType.simpleString()}"))
    return read_archives(spark, folder, manifest, pages.schema["page_id"].dataType.simpleString())
