"""Legacy archives to WARC: converting, writing and reading back.

An ARC archive is a version block and records, each with one header line and as many bytes as
that line declares.  Version 1 lines have five fields, version 2 lines ten.  ``parse_arc`` reads
either by its own field list; ``convert`` turns the records into WARC ones, with an identifier,
timestamp, type and digests made from what the line and the block say: HTTP blocks become
responses, all others resources.  A record that names its page is identified by it, any other by
its archive, place, URL, date and digest.  Of records with equal payloads, the one with the
largest page id is the response and the others revisit it.  Blocks are bytes of any kind.

The archives are gzipped files in the shared folder, written by Spark's text writer: a row is a
bundle of records and the two line ends that close a record are the line separator, so any Hadoop
file system will do.  All cuts are by bytes: an ARC archive and a bundle end where they would
outgrow ``BUNDLE_BYTES``, a file has ``FILE_BUNDLES`` bundles at most, and what is read back
comes in batches of about ``BUNDLE_BYTES``; only a record that is larger by itself exceeds them.
The writer makes one gzip member of a file.  Reading takes whole files as binary rows, unpacks
them in a stream and parses by the declared lengths alone.

A null URL is written as ``-``, a null payload as an empty one; a null id has no number to
refer to and is always a response; repeated rows get a record each; an empty table gives none.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import slices
from tessel.plans.staging import scratch_path, staged

#: Fields of a record's header line, by version of the archive.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
#: Bytes of a small archive or a bundle of records, and bundles of one file, at most.
BUNDLE_BYTES, FILE_BUNDLES = 4 << 20, 32
#: The date of records whose source has none.
NO_DATE = "20000101000000"
_NO_ID = 1 << 64


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page id, so that a reference can be read back."""
    n = _NO_ID if page_id is None else page_id & (1 << 64) - 1
    high, low = n >> 62, n & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | 8 << 76 | 2 << 62 | low)}>"


def page_id_of(name: str) -> int | None:
    """The page id in a record's identifier; None where it holds none."""
    found = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:"))
    value = found.int
    if found.version != 8:
        return None
    n = (value >> 64 & 0xFFF) << 62 | value & (1 << 62) - 1
    return None if n == _NO_ID else n - (1 << 64) if n >> 63 else n


def synthetic_id(fields: dict, payload: str) -> str:
    """The identifier of a record that names no page, from where it stands and what it says."""
    about = "\n".join([fields["archive"], str(fields["at"]), fields["URL"], fields["Archive-date"], payload])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, about)}>"


def timestamp(date: str) -> str:
    """A WARC date of an archive's 14 digits, or of the 4 to 12 of them that are given."""
    d = date + "00000101000000"[len(date) :] if date.isdecimal() and 4 <= len(date) <= 14 else NO_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _http(page_id: int | None, payload: bytes) -> bytes:
    number = f"X-Page-Id: {'-' if page_id is None else page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{number}\r\n".encode()


def _line(version: int, url: str, date: str, kind: str, length: int, checksum: str, name: str) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": checksum, "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(length)}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n"


def _one_word(url: str | None) -> str:
    """The URL as one field of a header line."""
    return "".join(f"%{ord(c):02X}" if c.isspace() or ord(c) < 33 else c for c in url or "") or "-"


def write_arc(records: list[tuple], version: int, name: str) -> bytes:
    """An ARC archive of ``(page_id, url, payload)`` records."""
    about = f"{version} 0 tessel\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = [_line(version, f"filedesc://{name}", NO_DATE, "text/plain", len(about), "-", name), about]
    for page_id, url, payload in records:
        block = _http(page_id, payload) + payload
        out += [_line(version, _one_word(url), NO_DATE, "text/html", len(block), hashlib.md5(payload).hexdigest(), name), block, b"\n"]
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """``(fields, block)`` of each record, by the version's field list and the declared lengths.

    ``fields`` also holds the archive's own name and the record's place in it, ``archive`` and
    ``at``.  Spaces beyond the number of fields belong to the URL.
    """
    at, version, archive = 0, None, ""
    while at < len(content):
        end = content.index(b"\n", at)
        if end == at:  # the line end that closes a record
            at += 1
            continue
        line = content[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        length = int(line.rpartition(" ")[2])
        block = content[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError("the archive ends within a record")
        if version is None:
            version, archive = int(block.split(b" ", 1)[0]), line.partition(" ")[0]
        else:
            names = ARC_FIELDS[version]
            words = line.rsplit(" ", len(names) - 1)
            if len(words) != len(names):
                raise ValueError(f"a version {version} header line has {len(names)} fields, not {len(words)}")
            yield dict(zip(names, words, strict=True)) | {"archive": archive, "at": at}, block
        at = end + 1 + length


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and payload of an HTTP response block; any other is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    at, end = block.find(_END), _END
    bare = block.find(b"\n\n", 0, at if at >= 0 else len(block))  # not beyond the first end
    if bare >= 0:
        at, end = bare, b"\n\n"
    elif at < 0:
        at, end = len(block), b""
    head, payload = block[: at + len(end)], block[at + len(end) :]
    lines = head.decode("utf-8", "surrogateescape").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, head, payload


def to_warc(fields: dict, block: bytes, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the line ends that close it."""
    http, head, payload = http_parts(block)
    sha, page = digest(payload), http.get("x-page-id", "")
    own = record_id(int(page)) if page.lstrip("-").isdecimal() else record_id(None) if page == "-" else synthetic_id(fields, sha)
    body = block if refers_to is None else head
    kind = "application/http; msgtype=response" if head else fields["Content-type"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {timestamp(fields['Archive-date'])}",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + _END + body


def unpacked(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    unzip = zlib.decompressobj(31)
    for at in range(0, len(content), step):
        data = content[at : at + step]
        while data:
            yield unzip.decompress(data)
            data = unzip.unused_data
            if data:
                unzip = zlib.decompressobj(31)
    yield unzip.flush()


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """``(headers, block)`` of each record of a stream, by the declared lengths."""
    held = bytearray()
    need, headers = None, {}
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if need is None:
                end = held.find(_END, at)
                if end < 0:
                    break
                lines = held[at:end].decode("utf-8", "surrogateescape").split("\r\n")
                if lines[0] not in ("WARC/1.0", "WARC/1.1"):
                    raise ValueError("not at the start of a record")
                headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need, at = int(headers["content-length"]), end + 4
            if len(held) < at + need + 4:
                break
            yield headers, bytes(held[at : at + need])
            at, need = at + need + 4, None
        del held[:at]
    if held or need is not None:
        raise ValueError("the archive ends within a record")


def bundles(sizes: list[int], most: int = BUNDLE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of at most ``most`` bytes, or of one larger member."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield start, at
            start, held = at, 0
        held += size
    if sizes:
        yield start, len(sizes)


def arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", refers_col: str | None = None) -> DataFrame:
    """``(content binary, refers array<long>)``: small ARC archives of the pages, of either version in turn."""

    def run(batches):
        for k, part in enumerate(p for batch in batches for p in slices(batch)):
            rows = [(i, u, h or b"") for i, u, h in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)]
            refers = part.column(3).to_pylist()
            for a, b in bundles([len(h) for _, _, h in rows]):
                content = pa.array([write_arc(rows[a:b], 1 + k % 2, f"part-{k}-{a}.arc")], pa.binary())
                yield pa.RecordBatch.from_arrays([content, pa.array([refers[a:b]], pa.list_(pa.int64()))], ["content", "refers"])

    refers = F.col(refers_col) if refers_col else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col).cast("binary"), refers.cast("long").alias("refers"))
    return rows.mapInArrow(run, "content binary, refers array<long>")


def convert(archives: DataFrame, most: int = BUNDLE_BYTES) -> DataFrame:
    """``(records binary)``: the WARC records of ARC archives, in bundles of ``most`` bytes.

    ``refers`` says what each record revisits, if given.  A bundle has the line ends that close a
    record after each but its last.
    """

    def run(batches):
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for content, refers in zip(batch.column(0), batch.column(1), strict=True):
                named = refers.as_py()
                for k, (fields, block) in enumerate(parse_arc(content.as_py())):
                    record = to_warc(fields, block, named[k] if named else None)
                    if held and size + len(record) > most:
                        yield _bundle(held)
                        held, size = [], 0
                    held.append(record)
                    size += len(record) + len(_END)
        if held:
            yield _bundle(held)

    return archives.select("content", "refers").mapInArrow(run, "records binary")


def _bundle(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_END.join(records)], pa.binary())], ["records"])


def write(records: DataFrame, path: str, most: int = FILE_BUNDLES) -> str:
    """Write bundles of WARC records as gzipped archives under a path that all executors share."""
    rows = records.select(F.col("records").cast("string"))  # the cast and the writer leave all bytes as they are
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    return path


def read(spark, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload)`` of archives.

    A revisit has no payload of its own; its length is what its HTTP header declares.  A response's
    digest is computed anew and must be the one in its header.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_warc(unpacked(content.as_py())):
                    http, _, payload = http_parts(block)
                    revisit = headers["warc-type"] == "revisit"
                    told = headers["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != told:
                        raise ValueError(f"wrong digest in {headers['warc-record-id']}")
                    size = int(http.get("content-length", 0)) if revisit else len(payload)
                    refers = page_id_of(headers["warc-refers-to"]) if revisit else None
                    rows.append((page_id_of(headers["warc-record-id"]), size, told, headers["warc-type"], refers, headers["warc-target-uri"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), None if revisit else payload))
                    held += len(block)
                    if len(rows) == 512 or held > BUNDLE_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a WARC record for every page, revisits included, and read the archives back."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = rows.groupBy("sha").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "target")
    shared = staged(shared, "shared-payloads")  # a table: its join can split a payload that many pages have
    rows = rows.join(shared, "sha", "left")
    rows = rows.withColumn("refers", F.when(F.col("id") != F.col("target"), F.col("target"))).drop("sha", "target")
    path = write(convert(arcs(rows, "id", "url", "html", "refers")), path or scratch_path(spark, "warc"))
    return read(spark, path)
