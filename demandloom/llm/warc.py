"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then a frame per record.

``write_archives`` streams the records of a task to archives of bounded size, under names of that attempt alone; those of the
attempts that count are listed in the table it returns, so that a repeated or speculative task leaves nothing that is
read. ``read_archives`` finds the frames from their block headers, decodes each with the archive's dictionary and validates the record: version line, required
fields, the lengths of block and payload, the record's end, and the payload's SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.session import stored

SKIPPABLE = 0x184D2A5D  # magic number of the dictionary frame
DICTIONARY_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 27  # after which a new archive is begun: one is read as a whole
SAMPLE_BYTES = 1 << 21  # payloads of an archive that its dictionary is trained on
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def dictionary_for(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid4() if page_id is None else uuid5(NAMESPACE_URL, f'page:{page_id}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """Response of a page, or a revisit of the page ``first`` that has the same payload."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or f"urn:page:{page_id}")
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()), ("X-Payload-Length", str(len(payload)))]
    fields += [] if page_id is None else [("X-Page-ID", str(page_id))]
    if first is None:
        return record([*fields, ("Content-Type", "application/http; msgtype=response")], HTTP + payload)
    return record([*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(first)), ("X-Refers-To-Page-ID", str(first)), ("Content-Type", "application/http; msgtype=response")], HTTP)


def archive(records: Iterator[bytes], sample_bytes: int = SAMPLE_BYTES) -> Iterator[bytes]:
    """The archive's bytes: dictionary frame, a warcinfo frame, a frame per record."""
    import zstandard

    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size > sample_bytes:
            break
    dictionary = dictionary_for(sample)
    yield dictionary_frame(dictionary)
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    for r in chain([info], sample, records):
        yield coder.compress(r)


def _frame_end(data: memoryview, at: int) -> int:
    import zstandard

    try:
        head = zstandard.get_frame_parameters(data[at : at + 18])
        at += zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as error:
        raise WarcError(f"no frame at {at}: {error}") from None
    last = False
    while not last:
        if at + 3 > len(data):
            raise WarcError("truncated frame")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * head.has_checksum
    if at > len(data):
        raise WarcError("truncated frame")
    return at


def frames(data: bytes) -> Iterator[bytes]:
    """Decoded frames of an archive; a dictionary frame may come first and may itself be compressed."""
    import zstandard

    view, at, options = memoryview(data), 0, {}
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        at = 8 + int.from_bytes(data[4:8], "little")
        if at > len(data):
            raise WarcError("truncated dictionary")
        dictionary = data[8:at]
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
    decoder = zstandard.ZstdDecompressor(**options)
    while at < len(data):
        if 0x184D2A50 <= int.from_bytes(view[at : at + 4], "little") <= 0x184D2A5F:  # other skippable frames
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            continue
        end = _frame_end(view, at)
        try:
            yield decoder.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as error:
            raise WarcError(f"frame at {at}: {error}") from None
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields with lower-case names, block) of one record, validated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"malformed field {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = [x for x in REQUIRED if x not in fields]
    if missing:
        raise WarcError(f"missing {', '.join(missing)}")
    length = fields["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("block length differs from Content-Length")
    return fields, rest[:-4]


def page_of(raw: bytes) -> dict | None:
    """Row of a response or revisit record; None for other types."""
    fields, block = parse_record(raw)
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    row = {"page_id": None, "target_uri": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None, "error": None}
    if "x-page-id" in fields:
        row["page_id"] = int(fields["x-page-id"])
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    if row["record_type"] == "revisit":
        row["refers_to"] = int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None
        row["payload_bytes"] = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
        row["payload_digest"] = digest or None
        return row
    own = hashlib.sha256(payload).hexdigest()
    if kind == "sha256" and digest != own:
        raise WarcError("payload digest differs")
    if fields.get("x-payload-length", str(len(payload))) != str(len(payload)):
        raise WarcError("payload length differs")
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": own}


_ROW = {"page_id": pa.int64(), "target_uri": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "error": pa.string()}


def _rows(archives: Iterator[tuple[str, bytes]], payloads: bool) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size = 0
    for path, data in archives:
        try:
            for raw in frames(data):
                try:
                    row = page_of(raw)
                except (WarcError, ValueError) as error:
                    row = dict.fromkeys(_ROW) | {"error": f"{path}: {error}"}
                if row is not None:
                    size += len(row["payload"] or b"")
                    rows.append(row if payloads else row | {"payload": None})
                if size > 1 << 24 or len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_ROW))
                    rows, size = [], 0
        except WarcError as error:
            rows.append(dict.fromkeys(_ROW) | {"error": f"{path}: {error}"})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema(_ROW))


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, first: the smallest page_id with an equal payload of ``least`` bytes or more, if another row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    copied = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # pages below the least have no copies: keys of their own keep them apart
    rows = rows.withColumn("digest", F.coalesce("digest", F.concat(F.lit("small:"), F.xxhash64("page_id", "url", "payload").cast("string"))))
    return rows.join(copied, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to ``folder``; the archives' paths and record numbers.

    ``folder`` is a URI that all executors reach. A null html is an empty payload; repeated page_ids are written each; rows
    of a null page_id have no page field and are never referred to. An archive ends with the record that takes it to
    ``archive_bytes``. No pages make no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        records = (page_record(*row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        attempt, made = uuid4().hex, 0
        for begin in records:
            count, size = [0], 0

            def some(begin: bytes = begin, count: list[int] = count) -> Iterator[bytes]:
                for r in chain([begin], records):
                    count[0] += 1
                    yield r
                    if size >= archive_bytes:
                        return

            system.create_dir(base, recursive=True)
            name = f"{base}/pages-{TaskContext.get().partitionId():06d}-{attempt}-{made:04d}.warc.zst"
            with system.open_output_stream(name, compression=None) as out:
                for data in archive(some(), min(SAMPLE_BYTES, archive_bytes)):
                    out.write(data)
                    size += len(data)
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(count, pa.int64())], ["path", "records"])

    return stored(with_revisits(pages, least).mapInArrow(run, "path string, records long"), "archives")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, written: DataFrame | None = None) -> DataFrame:
    """A row per response or revisit record of the ``*.warc.zst`` archives in ``folder``, or of those that ``written`` lists (path).

    A record or archive that breaks the format gives a row with ``error`` and nulls, and the records after a broken frame are
    not read. ``payloads`` False leaves the payload column null. Revisits carry length and digest of the full payload.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if written is not None:
        name = F.element_at(F.split("path", "/"), -1)
        files = files.withColumn("name", name).join(written.select(name.alias("name")), "name", "left_semi").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(((p, c) for batch in batches for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), payloads)

    return files.mapInArrow(run, "page_id long, target_uri string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string")
