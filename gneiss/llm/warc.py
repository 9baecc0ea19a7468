"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: in each task records are gathered up to ``archive_bytes``; a dictionary is trained on them and
stored first, then each record is compressed as a frame of its own. Executors share no folders, so the
archives are rows (name, data) of a Parquet table in the shared folder; the reader takes that table, or
files through Spark's binaryFile source (columns path, content).

Reading: the skippable frame's dictionary is loaded, frames are decoded one by one, and every record's
version line, mandatory headers, Content-Length and (for responses and resources) payload digest are
validated; an archive that breaks a rule raises ``WarcError``. ``read_records`` and ``read_files`` give whole
records of any type and any id; ``read`` gives the digest columns of pages.

Equal payloads of at least ``min_bytes``: the record with the largest id is the response, the others are
revisits that name it. Defined results: null html is an empty payload; a null id can't be referred to, so
such a record is always a response; rows that repeat the largest id are all responses; a null url is
written without a target URI; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import write_shared

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528  # fixed values: magic numbers of the two kinds of frame
ARCHIVE_BYTES, DICTIONARY_BYTES, LEAST_SAMPLES = 8 << 20, 32 << 10, 32
SALTS = 16
#: Bytes of an archive that one task decodes, about, and tasks over which parts are dealt, at most.
PART_BYTES, MOST_TASKS = 32 << 20, 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "record_type string, record_id string, target_uri string, date string, headers map<string,string>, http_head string, payload binary, payload_bytes long, payload_digest string, refers_to string"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A whole WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of whole records. Too few records to train on give an archive without a dictionary."""
    trained = None
    if len(records) >= LEAST_SAMPLES:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, steps=1)
        except zstandard.ZstdError:
            trained = None  # samples too small or too alike
    coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    lead = b""
    if trained:
        raw = trained.as_bytes()
        lead = struct.pack("<II", SKIPPABLE, len(raw)) + raw
    return lead + b"".join(coder.compress(r) for r in records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at a byte ends: its header, its blocks' headers and its checksum tell, without decoding."""
    try:
        head = zstandard.get_frame_parameters(data[at : at + 18])
        end = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise WarcError(f"bad frame header at byte {at}: {e}") from e
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError(f"the frame at byte {at} is cut short")
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        if kind == 3:
            raise WarcError(f"bad block at byte {end}")
        end += 3 + (1 if kind == 1 else size)  # a run holds one byte however long it is
    end += 4 * head.has_checksum
    if end > len(data):
        raise WarcError(f"the frame at byte {at} is cut short")
    return end


def leading(view: memoryview) -> tuple[bytes, int]:
    """The dictionary in the leading skippable frame, b"" for none, and where the records begin."""
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != SKIPPABLE:
        return b"", 0
    size = struct.unpack_from("<I", view, 4)[0]
    if 8 + size > len(view):
        raise WarcError("the dictionary frame is cut short")
    raw = bytes(view[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
        raw = zstandard.ZstdDecompressor().decompress(raw)
    return raw, 8 + size


def spans(view: memoryview, at: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each frame from a byte on."""
    while at < len(view):
        if len(view) - at < 4 or struct.unpack_from("<I", view, at)[0] != FRAME:
            raise WarcError(f"no frame at byte {at}")
        end = frame_end(view, at)
        yield at, end
        at = end


def frames(data: bytes, trained: bytes | None = None) -> Iterator[bytes]:
    """The decompressed frames of an archive, one record each, each decoded from its own bytes only.

    trained: the dictionary of the archive that ``data`` is a part of; None: it may lead the data.
    """
    view = memoryview(data)
    raw, at = leading(view) if trained is None else (trained, 0)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    for begin, end in spans(view, at):
        one = decoder.decompressobj()
        try:
            out = one.decompress(view[begin:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame at byte {begin}: {e}") from e
        if not one.eof or one.unused_data:
            raise WarcError(f"the frame at byte {begin} doesn't end where its blocks do")
        yield out


def parse(one: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, validated."""
    head, gap, rest = one.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:  # a folded line goes on with the last value
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise WarcError(f"bad header line {line[:80]!r}")
        name = name.strip().lower()
        headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name} header")
    if not headers["content-length"].isdigit():
        raise WarcError("bad Content-Length")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    return headers, rest[:length]


def page_of(urn: str | None) -> int | None:
    """The number in an id of this module's form; null for any other id."""
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.isascii() and inner.isdigit() else None


def unchunked(body: bytes) -> bytes:
    """The content of a body in HTTP's chunked coding."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : max(end, at)].partition(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise WarcError("bad chunk size")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        at = end + 2 + n + 2
        if body[at - 2 : at] != b"\r\n":
            raise WarcError("a chunk is cut short")
        out.append(body[end + 2 : at - 2])


def holds(said: str, payload: bytes) -> bool:
    """Whether a labelled digest fits, in base 32 or 16; one of an algorithm not known here is not judged."""
    name, _, value = said.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    raw = hashlib.new(name, payload).digest()
    return value.rstrip("=").upper() == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex()


def whole(headers: dict[str, str], block: bytes) -> tuple:
    """The fields of RECORD for a record of any type, validated."""
    kind, http, payload, size = headers["warc-type"], None, block, len(block)
    if headers.get("content-type", "").lower().startswith("application/http"):
        http, gap, body = block.partition(b"\r\n\r\n")
        if not gap or kind != "request" and not http.startswith(b"HTTP/"):
            raise WarcError("no whole HTTP head")
        fields = [line.partition(b":") for line in http.split(b"\r\n")[1:]]
        of = lambda name: [v.strip() for k, _, v in fields if k.strip().lower() == name]
        sizes, chunked = of(b"content-length"), any(v.lower().endswith(b"chunked") for v in of(b"transfer-encoding"))
        cut, payload, http = "warc-truncated" in headers, body, http.decode("latin-1")
        if chunked and kind != "revisit" and not cut:
            try:
                payload = unchunked(body)
            except WarcError:
                # some crawlers store the content but leave the header; then the digest must fit the stored bytes
                if "warc-payload-digest" not in headers or not holds(headers["warc-payload-digest"], body):
                    raise
        elif not chunked and sizes and not cut:
            if not sizes[0].isdigit() or len(set(sizes)) > 1:
                raise WarcError("bad HTTP Content-Length")
            if kind == "response" and len(body) != int(sizes[0]):
                raise WarcError("the payload doesn't match its length")
        size = len(payload) if kind != "revisit" else int(sizes[0]) if sizes and sizes[0].isdigit() else None
        payload = None if kind == "revisit" else payload
        # digests are taken of the body with or without its chunk sizes
        stored = (payload, body)
    else:
        stored = (block,)
        if kind == "revisit":
            payload, size = None, None
    said = headers.get("warc-payload-digest")
    if said and kind in ("response", "resource") and "warc-truncated" not in headers and not any(holds(said, x) for x in stored):
        raise WarcError("the payload doesn't match its digest")
    if not said and payload is not None:
        said = "sha1:" + digest(payload)
    return kind, headers["warc-record-id"], headers.get("warc-target-uri"), headers["warc-date"], headers, http, payload, size, said, headers.get("warc-refers-to")


def interpret(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record."""
    kind, name, _, _, _, _, _, size, said, refers_to = whole(headers, block)
    return page_of(name), size, said and said.removeprefix("sha1:"), kind, page_of(refers_to) if kind == "revisit" else None


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write page_id, url, html as archives; gives the table (name, data), stored in the shared folder."""
    import pyarrow as pa

    slim = pages.select("page_id", "url", "html", F.sha1(payload_of(F.col("html"))).alias("_sha"), F.octet_length(payload_of(F.col("html"))).alias("_size"))
    # only digests that occur again are joined; the maximum is formed before the shuffle
    first = slim.filter(F.col("_size") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # one payload may be a third of all pages: its pages are dealt over several tasks
    first = first.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    joined = slim.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(first, ["_sha", "_salt"], "left")
    again = F.col("_first").isNotNull() & (F.col("page_id") < F.col("_first")) & (F.col("_size") >= min_bytes)
    rows = joined.select("page_id", "url", F.when(again, F.col("_first")).alias("refers_to"), "html")

    def run(batches):
        from pyspark import TaskContext

        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for page_id, url, refers_to, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append(record(page_id, url, (html or "").encode(), refers_to))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{count:05d}.warc.zst"]), pa.array([pack(held)], pa.binary())], names=["name", "data"])
                        count, held, size = count + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{count:05d}.warc.zst"]), pa.array([pack(held)], pa.binary())], names=["name", "data"])

    return write_shared(rows.mapInArrow(run, "name string, data binary"), "warc")


def parts(archives: DataFrame, data: str, part_bytes: int) -> DataFrame:
    """(trained, part): archives cut at frames into parts of about ``part_bytes``, each with the archive's dictionary.

    Only headers are read to cut; a long archive is then decoded by many tasks.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for archive in batch.column(0):
                view = memoryview(archive.as_buffer())
                raw, begin = leading(view)
                done = begin
                for _, end in spans(view, begin):
                    if end - begin >= part_bytes or end == len(view):
                        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([view[begin:end]], pa.binary())], names=["trained", "part"])
                        begin = end
                    done = end
                if done != len(view):
                    raise WarcError(f"bytes after the frame that ends at {done}")

    return archives.select(F.col(data)).mapInArrow(run, "trained binary, part binary")


def decoded(archives: DataFrame, data: str, make, schema: str, trained: str | None = None) -> DataFrame:
    """Rows of ``schema`` that make(headers, block) gives for records, but for those where it gives None.

    trained: the column of the dictionaries, where ``data`` holds parts of archives.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), kinds, strict=True)], names=kinds.names)

        for batch in batches:
            for archive, dictionary in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for one in frames(archive.as_py(), dictionary.as_py()):
                    row = make(*parse(one))
                    if row is not None:
                        rows.append(row)
                        held += len(one)
                    if held >= ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select(F.col(data), F.col(trained) if trained else F.lit(None).cast("binary")).mapInArrow(run, schema)


def read_records(archives: DataFrame, data: str = "data", trained: str | None = None) -> DataFrame:
    """All records of archives (a table with a binary column), of any type: the columns of RECORD.

    ``headers`` has lower-case names, repeated ones joined by commas; ``payload`` is an HTTP body without
    chunk sizes, or else the whole block, and null for a revisit.
    """
    return decoded(archives, data, lambda headers, block: (*(r := whole(headers, block))[:4], list(r[4].items()), *r[5:]), RECORD, trained)


def read(archives: DataFrame, data: str = "data") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the responses and revisits of archives."""
    return decoded(archives, data, lambda headers, block: interpret(headers, block) if headers["warc-type"] in ("response", "revisit") else None, RESULT)


def read_files(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """All records, as read_records gives them, of .warc.zst files of up to 2 GB that any Hadoop store holds.

    Files are cut at frames into parts, and parts are dealt over tasks before they are decoded.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    n = max(1, (files.agg(F.sum("length")).first()[0] or 0) // part_bytes)
    cut = parts(files, "content", part_bytes)
    # dealt by content, so a repeated task deals them alike
    return read_records(cut.repartition(min(n, MOST_TASKS), F.xxhash64("part")), "part", "trained")
