"""WARC archives compressed with Zstandard, one frame a record, dictionary in front.

An archive may begin with a skippable frame (magic 0x184D2A5D) that holds the
dictionary of all later frames, raw or itself compressed. Each further frame is
one record: version line, headers, an empty line, ``Content-Length`` bytes and
two line ends. The reader decodes frame by frame and checks all of that.

Frames are delimited by their block headers before anything is decoded, and decoded
in steps of ``STEP`` bytes, so that a small frame that swells costs no more than the
record limit: one of over ``MOST_BYTES`` is an error (a binary cell ends at 2 GiB).

Defined results: a record that breaks a rule comes back with ``error`` set and
whatever could be read; after a frame that can't be decoded, reading goes on at
the next frame if its end is known, otherwise the rest of that archive is one
row with an error; an archive without dictionary is read without one; an empty
or null archive has no records; skippable frames elsewhere are passed over, but one
that is cut off is an error. The writer skips pages with a null html or url, writes
control characters and outer blanks of a url as %XX, as header lines can't hold them, and
repeated pages are repeated records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import shared

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: Sample from which the writer trains its dictionary: pages and bytes of each.
DICTIONARY_PAGES, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 2000, 16_384, 32_768
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: A record that decodes to more is refused rather than held in memory; bytes decoded at a time; largest dictionary.
MOST_BYTES, STEP, MOST_DICTIONARY = 1 << 30, 1 << 20, 64 << 20
RECORD = "archive string, number int, frame_offset long, frame_length long, version string, warc_type string, record_id string, target_uri string, warc_date string, content_length long, payload binary, digest_ok boolean, error string"


_BLANK = re.compile(r"[\x00-\x1f\x7f\x85  ]|^ +| +\Z")


def frame(record: bytes, compressor: zstandard.ZstdCompressor) -> bytes:
    return compressor.compress(record)


def dictionary_frame(dictionary: bytes, compress: bool = True) -> bytes:
    body = zstandard.ZstdCompressor().compress(dictionary) if compress else dictionary
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def record(kind: str, uri: str, date: str, record_id: str, payload: bytes) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{record_id}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def leading_dictionary(data: memoryview) -> tuple[bytes | None, int]:
    """The dictionary, if a skippable frame leads, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut off")
    body = bytes(data[8 : 8 + size])
    if len(body) >= 4 and struct.unpack_from("<I", body)[0] == ZSTD_MAGIC:
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=MOST_DICTIONARY)
    return body, 8 + size


def parse(whole: bytes) -> dict:
    """Fields of one decoded record; ``error`` says which rule it breaks first."""
    out: dict = {"error": None}
    end = whole.find(b"\r\n\r\n")
    if end < 0:
        return {"error": "headers do not end"}
    lines = whole[:end].decode("utf-8", "replace").split("\r\n")
    out["version"] = lines[0]
    headers: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:  # a folded line goes on with the last header
            last = next(reversed(headers))
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            out["error"] = out["error"] or f"not a header: {line[:80]}"
        headers.setdefault(name.strip().lower(), value.strip())
    out |= {"warc_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "warc_date": headers.get("warc-date")}
    missing = [h for h in REQUIRED if not headers.get(h)]
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        out["error"] = out["error"] or "not a WARC version line"
    if missing:
        out["error"] = out["error"] or "missing: " + ", ".join(missing)
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        out["error"] = out["error"] or "Content-Length is not a number"
        return out
    length = out["content_length"] = int(size)
    payload = out["payload"] = whole[end + 4 : end + 4 + length]
    rest = whole[end + 4 + length :]
    if len(payload) < length:
        out["error"] = out["error"] or f"the block has {len(payload)} of {length} bytes"
    elif rest != b"\r\n\r\n":
        out["error"] = out["error"] or ("more than one record in a frame" if rest.startswith(b"\r\n\r\nWARC/") else "the block does not end with two line ends")
    algorithm, _, want = headers.get("warc-block-digest", "").partition(":")
    if want and algorithm.lower() == "sha1":
        h = hashlib.sha1(payload)
        out["digest_ok"] = want.lower() in (h.hexdigest(), base64.b32encode(h.digest()).decode().lower())
        if not out["digest_ok"]:
            out["error"] = out["error"] or "the block digest differs"
    return out


def frame_end(view: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its header and block headers; ValueError if it doesn't within the archive."""
    if at + 5 > len(view) or struct.unpack_from("<I", view, at)[0] != ZSTD_MAGIC:
        raise ValueError("not a frame" if at + 5 <= len(view) else "the frame is cut off")
    kind = view[at + 4]
    one_segment, size_flag = kind >> 5 & 1, kind >> 6
    end = at + 5 + (not one_segment) + (0, 1, 2, 4)[kind & 3] + ((1 if one_segment else 0), 2, 4, 8)[size_flag]
    last = False
    while not last:
        if end + 3 > len(view):
            raise ValueError("the frame is cut off")
        head = view[end] | view[end + 1] << 8 | view[end + 2] << 16
        last, form, size = bool(head & 1), head >> 1 & 3, head >> 3
        if form == 3:
            raise ValueError("a block of reserved type")
        end += 3 + (1 if form == 1 else size)
    end += 4 * (kind >> 2 & 1)  # the checksum
    if end > len(view):
        raise ValueError("the frame is cut off")
    return end


def records(data: bytes, most: int = MOST_BYTES) -> Iterator[dict]:
    """Every record of one archive in order, with its frame's place."""
    view = memoryview(data)
    try:
        dictionary, at = leading_dictionary(view)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        decoder = zstandard.ZstdDecompressor(**options)
    except (ValueError, zstandard.ZstdError) as e:
        yield {"number": 0, "frame_offset": 0, "frame_length": len(data), "error": f"dictionary: {e}"}
        return
    number = 0
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0] if at + 8 <= len(view) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", view, at + 4)[0]
            if end > len(view):
                yield {"number": number, "frame_offset": at, "frame_length": len(view) - at, "error": "frame: the skippable frame is cut off"}
            at = end
            continue
        found: dict = {"number": number, "frame_offset": at}
        end = None
        try:
            end = frame_end(view, at)
            parts, size = [], 0
            with decoder.stream_reader(view[at:end], read_across_frames=False) as reader:
                while part := reader.read(STEP):
                    parts.append(part)
                    size += len(part)
                    if size > most:
                        raise ValueError(f"a record of over {most} bytes")
            found |= parse(b"".join(parts))
        except (ValueError, zstandard.ZstdError) as e:
            found["error"] = f"frame: {e}"
            end = end or next_frame(data, at)
        found["frame_length"] = end - at
        yield found
        number += 1
        at = end


def next_frame(data: bytes, at: int) -> int:
    """Where the frame after a broken one seems to begin: at the next magic number."""
    k = data.find(struct.pack("<I", ZSTD_MAGIC), at + 4)
    return len(data) if k < 0 else k


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives in columns ``path, content``, such as the binaryFile source gives.

    An archive is the unit of work; archives of the usual gigabyte at most fit a task.
    """

    def run(batches):
        schema = pa.schema([("archive", pa.string()), ("number", pa.int32()), ("frame_offset", pa.int64()), ("frame_length", pa.int64()), ("version", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_length", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for found in records(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    held.append(found | {"archive": path.as_py()})
                    size += len(found.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("path", "content").mapInArrow(run, RECORD)


def train_dictionary(pages: DataFrame) -> bytes:
    """From a bounded sample of distinct pages (the constants above), the first by hash; empty if there are too few. It only makes archives smaller."""
    hashed = pages.where(F.col("html").isNotNull()).select(F.substring("html", 1, DICTIONARY_PAGE_BYTES).alias("start"), F.xxhash64("html").alias("h"))
    edge = hashed.select("h").distinct().orderBy("h").limit(DICTIONARY_PAGES).agg(F.max("h")).head()[0]
    rows = hashed.where(F.col("h") <= edge).groupBy("h").agg(F.first("start").alias("start")).orderBy("h").select("start").collect() if edge is not None else []
    sample = [r[0].encode() for r in rows if r[0]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, dictionary: bytes, most: int = 64 << 20) -> DataFrame:
    """``path, content``: archives of about ``most`` bytes of html each, made within each partition."""
    import uuid

    run_id = uuid.uuid4().hex[:8]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compressor = zstandard.ZstdCompressor(level=3, **options)
        head = dictionary_frame(dictionary) if dictionary else b""
        out, size, number = [head], 0, 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([f"{run_id}-{part:05d}-{number:05d}.warc.zst"]), pa.array([b"".join(out)], pa.binary())], ["path", "content"])

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = html.encode()
                name = hashlib.md5(f"{page_id}\x1f{url}".encode()).hexdigest()
                out.append(frame(record("resource", _BLANK.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url), "2024-01-01T00:00:00Z", f"{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}", payload), compressor))
                size += len(payload)
                if size >= most:
                    yield archive()
                    out, size, number = [head], 0, number + 1
        if len(out) > 1:
            yield archive()

    return pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("page_id", "url", "html").mapInArrow(run, "path string, content binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the shared folder, then read every record back."""
    return read_archives(shared.table(write_archives(pages, train_dictionary(pages)), "archives"))
