"""Web archives in ZIP packages: written by executors, read back by range without extraction.

A package is a ZIP file whose members are all stored, not compressed: ``archive/data.warc.gz`` with
one gzip member per record, and ``indexes/index.cdxj`` with a line per record: its offset in the
archive member and its length.  Packages of other makers may have any number of archives (archive/*.warc.gz, or plain
*.warc) and indexes (*.cdxj, *.cdx.gz and so on, lines of JSON or of the usual eleven fields), which may be compressed.  The reader parses the end-of-directory record, the ZIP64 locator and
directory and the central directory, finds where the stored members' bytes lie, and reads single
records by range, neither unpacking the ZIP file nor scanning the archive.

Of pages with equal payloads (of ``least`` bytes or more) that with the largest id is a response
record, the others are revisits that refer to it; payloads are told apart by SHA-256 and length, and the pages
with the payload itself move once, to meet their group's figures.  Defined cases: null html is an
empty payload; of rows that repeat an id and a payload one is the response and the others
revisit it; rows with a null id are responses only where the group has no other; an empty table gives no
packages; ids are whole numbers (text ids are cast, one that is no number is an error); further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, remember, shared_path
from quillon.llm.files import reading, writing

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
LEAST = 0
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
#: Signatures of the parts of a ZIP file (fixed values of the format).
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"


# --- ZIP packages ------------------------------------------------------------------------------


class ZipWriter:
    """Stored members written to a stream that can't seek: sizes follow each member's data, in ZIP64 form."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes):
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts) -> None:
        start, crc, size = self.at, 0, 0
        # Flag 8: CRC and sizes follow the data. The ZIP64 field makes them eight bytes long.
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(name), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, 0, 0))
        for part in parts:
            self._put(part)
            crc, size = zlib.crc32(part, crc), size + len(part)
        self._put(b"PK\7\x08" + struct.pack("<IQQ", crc, size, size))
        self.members.append((name, crc, size, start))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name.encode() + extra)
        end, n = self.at, len(self.members)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, end - begin, begin))
        self._put(LOCATOR + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 0))


def directory(source) -> dict[str, dict]:
    """name -> method, size and data offset of each member, from a ZIP file's central directory."""
    size = source.size()
    tail = source.read_at(min(size, 22 + FULL16), max(0, size - 22 - FULL16))
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: it has no end of directory")
    _, _, _, n, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if n == FULL16 or FULL32 in (length, begin):
        place = max(0, size - len(tail)) + at - 20
        locator = source.read_at(20, place)
        if locator[:4] != LOCATOR:
            raise ValueError("ZIP64 fields without a locator")
        end64 = source.read_at(56, struct.unpack_from("<IQI", locator, 4)[1])
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of directory where the locator points")
        n, length, begin = struct.unpack_from("<QQQ", end64, 32)
    data, members, at = source.read_at(length, begin), {}, 0
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        _, _, _, method, _, _, crc, packed, plain, name, extra, comment, _, _, _, start = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
        title = data[at + 46 : at + 46 + name].decode()
        fields, wide = data[at + 46 + name : at + 46 + name + extra], b""
        while len(fields) >= 4:
            kind, long = struct.unpack_from("<HH", fields)
            wide, fields = (fields[4 : 4 + long] if kind == 1 else wide), fields[4 + long :]
        # The ZIP64 field holds, in this order, only those values that did not fit.
        numbers = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
        plain, packed, start = (next(numbers) if x == FULL32 else x for x in (plain, packed, start))
        members[title] = {"method": method, "size": packed, "plain": plain, "crc": crc, "start": start}
        at += 46 + name + extra + comment
    for m in members.values():
        head = source.read_at(30, m["start"])
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        m["data"] = m["start"] + 30 + sum(struct.unpack_from("<HH", head, 26))
    return members


class Package:
    """Range reads of a package's records, from any number of archive members and indexes."""

    def __init__(self, source):
        self.source, self.members = source, directory(source)
        self.archives = {name.rsplit("/", 1)[-1]: m for name, m in self.members.items() if name.startswith("archive/") and name.endswith((".warc", ".warc.gz"))}
        self.indexes = sorted(name for name in self.members if name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", name))
        for name, m in self.archives.items():
            if m["method"] != 0:
                raise ValueError(f"{name} is compressed as a member: its records can't be read by range")
        if not self.indexes:
            raise ValueError("the package has no index")

    def _blocks(self, name: str, block: int):
        """A member's bytes, unpacked if they are packed as a member or as gzip, in bounded blocks."""
        m, at = self.members[name], 0
        layers = [-15] * (m["method"] == 8) + [31] * name.endswith(".gz")
        if m["method"] not in (0, 8):
            raise ValueError(f"{name} is packed by method {m['method']}")
        open_layers = [zlib.decompressobj(x) for x in layers]
        while at < m["size"]:
            data = self.source.read_at(min(block, m["size"] - at), m["data"] + at)
            at += block
            for i, bits in enumerate(layers):
                out = []
                while data:
                    out.append(open_layers[i].decompress(data))
                    data = open_layers[i].unused_data
                    if not open_layers[i].eof:
                        break
                    if data:  # one gzip member after the other
                        open_layers[i] = zlib.decompressobj(bits)
                data = b"".join(out)
            yield data

    def index(self, block: int = 1 << 20):
        """filename, offset and length of each index line, in order; header lines and those without a place are passed over."""
        for name in self.indexes:
            rest = b""
            for data in self._blocks(name, block):
                *lines, rest = (rest + data).split(b"\n")
                yield from filter(None, map(_place, lines))
            if rest:
                yield from filter(None, [_place(rest)])

    def record(self, offset: int, length: int, filename: str = "data.warc.gz") -> bytes:
        """One record, unpacked."""
        m = self.archives[filename]
        if offset + length > m["size"]:
            raise ValueError("record beyond its archive")
        data = self.source.read_at(length, m["data"] + offset)
        return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def _place(line: bytes) -> dict | None:
    """Where an index line says that its record lies."""
    text = line.decode().strip()
    if text.startswith(("!", "CDX ")) or not text:
        return None
    brace = text.find("{")
    if brace >= 0:
        fields = json.loads(text[brace:])
    else:  # the eleven fields of plain CDX end in length, offset and file name
        own = text.split()
        fields = dict(zip(("length", "offset", "filename"), own[-3:])) if len(own) == 11 else {}
    if not {"filename", "offset", "length"} <= fields.keys():
        return None
    return fields | {"filename": fields["filename"].rsplit("/", 1)[-1], "offset": int(fields["offset"]), "length": int(fields["length"])}


# --- WARC records ------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    """Bare upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A response record, or a revisit record that keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = "".join(c for c in url or "" if c.isprintable())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields: header (by lower-case name), http (likewise) and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return {"header": fields, "http": http_fields, "payload": payload}


# --- DataFrames --------------------------------------------------------------------------------


def planned(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html and whether the row is a revisit, of which page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html")
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    equal = rows.where(size >= least).select("sha", "page_id")
    each = equal.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("same"))
    groups = each.groupBy("sha").agg(F.max("page_id").alias("keep"), F.sum("same").alias("n"), F.max("same").alias("most")).where("n > 1")
    groups = durable(groups, "payloads")
    if groups.where("most > 1").isEmpty():
        nth = rows.withColumn("nth", F.lit(1))
    else:  # of rows that repeat an id and a payload the first by its stored place is the response
        rows = durable(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
        first = rows.join(groups.where("most > 1").select("sha", F.col("keep").alias("page_id")), ["sha", "page_id"], "left_semi").groupBy("sha").agg(F.min("at").alias("first"))
        nth = rows.join(durable(first, "first"), "sha", "left").withColumn("nth", F.when(F.col("first").isNull() | (F.col("at") == F.col("first")), 1).otherwise(2))
    met = nth.join(groups.select("sha", "keep", F.lit(True).alias("shared")), "sha", "left")
    revisit = F.coalesce("shared", F.lit(False)) & (size >= least) & ~(F.col("page_id").eqNullSafe(F.col("keep")) & (F.col("nth") == 1))
    return met.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("keep")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = LEAST, **columns) -> DataFrame:
    """Write the pages into packages below ``folder``, one per partition; one row (path) per package."""

    def run(batches):
        path, lines, spot = f"{folder}/part-{uuid.uuid4().hex}.wacz", [], 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def records():
            nonlocal spot
            for batch in _again(first, batches):
                for page_id, url, html, revisit, keep in zip(*batch.columns):
                    page_id, url = page_id.as_py(), url.as_py()
                    packer = zlib.compressobj(1, wbits=31)
                    data = packer.compress(record(page_id, url, html.as_py().encode(), keep.as_py(), revisit.as_py())) + packer.flush()
                    line = {"id": name_of(page_id), "filename": "data.warc.gz", "offset": spot, "length": len(data)}
                    lines.append(f"{name_of(page_id)} {DATE} {json.dumps(line)}\n".encode())
                    spot += len(data)
                    yield data

        with writing(path) as out:
            package = ZipWriter(out)
            package.member(ARCHIVE, records())
            package.member(INDEX, lines)
            package.close()
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return durable(planned(pages, least, **columns).mapInArrow(run, "path string"), "packages")


def _again(first, rest):
    yield first
    yield from rest


ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(packages: DataFrame) -> DataFrame:
    """Every record of the packages, read by range: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def row(fields):
        head, revisit = fields["header"], fields["header"]["warc-type"] == "revisit"
        stated, payload = head["warc-payload-digest"].removeprefix("sha1:"), fields["payload"]
        if not revisit and (digest(payload) != stated or len(payload) != int(fields["http"]["content-length"])):
            raise ValueError(f"{head['warc-record-id']}: the payload is not what its record says")
        return {
            "page_id": id_of(head["warc-record-id"]),
            "payload_bytes": int(fields["http"]["content-length"]),
            "payload_digest": stated,
            "record_type": head["warc-type"],
            "refers_to": id_of(head["warc-refers-to"]) if revisit else None,
        }

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reading(path) as source:
                    package, found = Package(source), []
                    for line in package.index():
                        found.append(row(parse(package.record(line["offset"], line["length"], line["filename"]))))
                        if len(found) == 1024:
                            yield pa.RecordBatch.from_pylist(found, ROWS)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_pylist(found, ROWS)

    # Packages are many records each: every task takes few of them.
    return packages.repartition(max(1, packages.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = LEAST, **columns) -> DataFrame:
    """Write the pages into a fresh shared folder and read all records back."""
    folder = remember(pages.sparkSession, shared_path(pages.sparkSession, "warc"))
    return read(write(pages, folder, least, **columns))
