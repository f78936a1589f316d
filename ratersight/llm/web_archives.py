"""WARC records in ZIP packages: written as stored members with an index, and range-read without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratersight.llm import scratch
from ratersight.llm.files import Ranges, writing

#: Signatures of a ZIP file's parts, and of extra fields that hold 64-bit sizes.
LOCAL, CENTRAL, END, END64, LOCATOR64, EXTRA64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x0001
#: The profile of revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER_BYTES = 16 << 20
INDEX, DESCRIPTION = "indexes/index.cdxj", "datapackage.json"
#: Rows of one batch of records read, and bytes that are looked through at a time for the ends of records.
BATCH, STEP = 1000, 1 << 16


class ZipWriter:
    """Appends stored members to a stream. force64 uses the 64-bit forms whatever the sizes."""

    def __init__(self, out, force64: bool = False):
        self.out, self.force64, self.at, self.members = out, force64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        n, crc, at = name.encode(), zlib.crc32(data), self.at
        big = self.force64 or len(data) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", EXTRA64, 16, len(data), len(data)) if big else b""
        size = 0xFFFFFFFF if big else len(data)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(n), len(extra)) + n + extra)
        self._put(data)
        self.members.append((n, crc, len(data), at))

    def finish(self) -> None:
        start = self.at
        for n, crc, size, at in self.members:
            big = self.force64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, at) if big else b""
            small = 0xFFFFFFFF if big else size
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, small, small, len(n), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + n + extra)
        size, count, end = self.at - start, len(self.members), self.at
        if big := self.force64 or count >= 0xFFFF or start >= 0xFFFFFFFF or size >= 0xFFFFFFFF:
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
        few = (0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if big else (count, count, size, start)
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, *few, 0))


class ZipReader:
    """The members of a ZIP file by its central directory, read by range (an object with size and read(start, length)).

    Stored and deflated members are known; only stored ones have a start(), from which parts of them can be read."""

    def __init__(self, ranges):
        self.ranges = ranges
        tail_at = max(0, ranges.size - 22 - 0xFFFF)
        tail = ranges.read(tail_at, ranges.size - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        if at < 0:
            raise ValueError("no end of a central directory")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF in (count,) or 0xFFFFFFFF in (size, start):
            sign, _, where, _ = struct.unpack("<IIQI", ranges.read(tail_at + at - 20, 20))
            if sign != LOCATOR64:
                raise ValueError("no locator of a 64-bit directory")
            head = struct.unpack("<IQHHIIQQQQ", ranges.read(where, 56))
            if head[0] != END64:
                raise ValueError("no 64-bit end of a central directory")
            count, size, start = head[7], head[8], head[9]
        self.members: dict[str, tuple[int, int, int, int]] = {}  # name -> bytes held, offset of the local header, checksum, method
        held, at = ranges.read(start, size), 0
        for _ in range(count):
            sign, _, _, _, method, _, _, crc, packed, full, n, extra, note, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", held, at)
            if sign != CENTRAL:
                raise ValueError("the central directory is damaged")
            name = held[at + 46 : at + 46 + n].decode()
            more, end = at + 46 + n, at + 46 + n + extra
            while more + 4 <= end:
                kind, length = struct.unpack_from("<HH", held, more)
                if kind == EXTRA64:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", held, more + 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    where = wide.pop(0) if where == 0xFFFFFFFF else where
                more += 4 + length
            self.members[name] = (packed, where, crc, method)
            at = end + note

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        if self.members[name][3] != 0:
            raise ValueError(f"{name} is not stored, so parts of it can't be read")
        return self._start(name)

    def _start(self, name: str) -> int:
        where = self.members[name][1]
        sign, *_, n, extra = struct.unpack("<IHHHHHIIIHH", self.ranges.read(where, 30))
        if sign != LOCAL:
            raise ValueError(f"{name} has no local header")
        return where + 30 + n + extra

    def read(self, name: str) -> bytes:
        size, _, crc, method = self.members[name]
        if method not in (0, 8):
            raise ValueError(f"{name} is compressed by an unknown method")
        data = self.ranges.read(self._start(name), size)
        data = zlib.decompress(data, -15) if method == 8 else data
        if zlib.crc32(data) != crc:
            raise ValueError(f"{name} does not match its checksum")
        return data


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    """The page of a record's name; records that others wrote have none."""
    own = name.removeprefix("<urn:page:").removesuffix(">")
    return int(own) if name.startswith("<urn:page:") and own != "none" else None


def url_key(url: str | None) -> str:
    """The sort key of a URL: the host's labels from the last to the first, then path and query, in lower case."""
    url = "".join((url or "").split())
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return url.lower() or "-"
    return (",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def index_entries(text: str) -> Iterator[dict]:
    """The entries of an index of lines that hold a key, a time and an object, or the object alone."""
    for line in text.splitlines():
        if "{" in line and not line.startswith("!"):
            yield json.loads(line[line.index("{") :])


def walk(ranges, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzipped record of an archive that begins at start."""
    at = 0
    while at < size:
        unpack, seen = zlib.decompressobj(31), at
        while not unpack.eof:
            if seen >= size:
                raise ValueError("the last record is cut off")
            part = ranges.read(start + seen, min(STEP, size - seen))
            unpack.decompress(part)
            seen += len(part)
        end = seen - len(unpack.unused_data)
        yield at, end - at
        at = end


def records(package: ZipReader) -> Iterator[tuple[str, int, int]]:
    """(member, offset, length) of the records of a package: by its indexes, or, of archives that none mentions, by walking
    through their gzipped records. Archives must be stored."""
    indexed: set[tuple[str, int]] = set()
    for name in package.members:
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx")):
            for entry in index_entries(package.read(name).decode()):
                file, at = str(entry["filename"]), int(entry["offset"])
                file = file if file in package.members else f"archive/{file}"
                if (file, at) not in indexed:
                    indexed.add((file, at))
                    yield file, at, int(entry["length"])
    known = {file for file, _ in indexed}
    for name, (size, *_) in package.members.items():
        if name.endswith((".warc.gz", ".warc")) and name not in known:
            if name.endswith(".warc"):
                raise ValueError(f"{name} is not gzipped by record and has no index")
            yield from ((name, at, length) for at, length in walk(package.ranges, package.start(name), size))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, gzipped on its own. A revisit holds the HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _name(page_id), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(url.split())
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header lines by their names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(packed: bytes) -> tuple[dict[str, str], int | None, bytes]:
    """(header fields by names in lower case, the full payload's length, the payload that is there) of one record, gzipped
    or not. The length is null for a revisit whose HTTP header tells none. A response's digest by SHA-1 is checked, and
    computed where it has no such one."""
    raw = gzip.decompress(packed) if packed.startswith(b"\x1f\x8b") else packed
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(lines)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        own, told = f"sha1:{digest(payload)}", fields.get("warc-payload-digest", "")
        if told.lower().startswith("sha1:") and told[5:].upper() != own[5:]:
            raise ValueError("the payload does not match its digest")
        return fields | {"warc-payload-digest": own}, len(payload), payload
    size = _fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length", "")
    return fields, int(size) if size.isdecimal() else None, payload


def _write(folder: str, force64: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06d}.wacz"
        index: list[str] = []
        with writing(folder, name) as out:
            package, held, size, no = ZipWriter(out, force64), [], 0, 0
            resources: list[dict] = []

            def add(path: str, data: bytes) -> None:
                package.add(path, data)
                resources.append({"name": path.rsplit("/", 1)[-1], "path": path, "hash": f"sha256:{hashlib.sha256(data).hexdigest()}", "bytes": len(data)})

            def full() -> None:
                nonlocal held, size, no
                add(f"archive/data-{no:05d}.warc.gz", b"".join(held))
                held, size, no = [], 0, no + 1

            for batch in batches:
                for page, url, html, keeper in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3).to_pylist()):
                    own = record(page, url, html.as_py() or b"", keeper, keeper is not None)
                    entry = {"url": "".join((url or "").split()), "filename": f"data-{no:05d}.warc.gz", "offset": str(size), "length": str(len(own))}
                    index.append(f"{url_key(url)} 19700101000000 {json.dumps(entry)}")
                    held.append(own)
                    size += len(own)
                    if size >= MEMBER_BYTES:
                        full()
            if held:
                full()
            add(INDEX, "".join(f"{line}\n" for line in sorted(index)).encode())
            package.add(DESCRIPTION, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}).encode())
            package.finish()
        if index:
            yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(index)], pa.int64())})

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, force64: bool = False) -> DataFrame:
    """Write pages (page_id, url, html) as packages into folder; returns their names and numbers of records.

    Of pages with equal payloads of least_bytes or more, that with the largest page_id is a response, others revisit it;
    smaller ones are all responses. Null html is an empty payload. Repeated rows of the largest page_id are all responses.
    A page with a null id revisits the largest id of its payload, if any has one. An empty table writes nothing."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    pages = pages.withColumn("sha", F.sha1("html"))
    ids = scratch.table(pages.select("page_id", "sha", F.octet_length("html").alias("size")), "pages")
    keepers = ids.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null")
    again = ids.join(keepers, "sha").filter("page_id is null or page_id < keeper").select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "keeper").distinct()
    marked = pages.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    return scratch.table(marked.select("page_id", "url", "html", "keeper").mapInArrow(_write(folder, force64), "name string, records long"), "packages")


def _read(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def rows(ranges: Ranges) -> Iterator[tuple]:
        package = ZipReader(ranges)
        starts: dict[str, int] = {}
        for member, at, length in records(package):
            if member not in starts:
                starts[member] = package.start(member)
            fields, size, _ = parse(ranges.read(starts[member] + at, length))
            if fields["warc-type"] in ("response", "revisit"):
                refers = fields.get("warc-refers-to")
                yield _number(fields["warc-record-id"]), size, fields.get("warc-payload-digest", "").rpartition(":")[2] or None, fields["warc-type"], refers and _number(refers)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ranges = Ranges(folder, name)
                found = rows(ranges)
                while own := list(itertools.islice(found, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), kinds)], names=names)
                ranges.close()

    return read


def read_archives(spark: SparkSession, packages: DataFrame, folder: str) -> DataFrame:
    """A row for each response and revisit of the packages (name): page_id, payload_bytes, payload_digest, record_type,
    refers_to. Packages may be others': page_id and refers_to are null for records that write_archives() did not name.

    Directories and indexes are parsed, then each record is read by its range and checked against its digest. Archives that
    no index mentions are walked through; archives that aren't stored are an error. An empty table gives an empty result."""
    names = packages.select("name").repartition(scratch.parts(spark), "name")
    return names.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def oracle_sql() -> str:
    """What the pages' records tell, in DuckDB's SQL: 20 bits of the SHA-1 are four letters of the digest."""
    value = " + ".join(f"(instr('0123456789abcdef', h[5 * i + {k}]) - 1) * {16 ** (5 - k)}" for k in range(1, 6))
    letters = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v // {32 ** (3 - k)}) % 32 + 1]" for k in range(4))
    return f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, html, array_to_string(list_transform(list_transform(range(8), lambda i: {value}), lambda v: {letters}), '') as payload_digest, max(page_id) over (partition by html) as last from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from d"""
