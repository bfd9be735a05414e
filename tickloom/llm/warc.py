"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged archives.

The reader checks every record (member checksum, version line, header lines, length, block and payload digests). After a
failed check it looks for the next place where a gzip member or a version line starts that passes all checks, goes on
from there, and reports the bytes in between as a quarantined gap. A member is inflated as a stream and its records come out
as they are complete: a damaged one among several costs itself only (the next version line is looked for in the member's
content), and of a member that breaks off or cannot be inflated any further the records before that are kept. A member of
one record has to pass its checksum; of several, that have been handed out by then, each has passed its own digests. One
record at a time is in memory.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections import deque
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ship, stored
from tickloom.operators.tables import small_side
from tickloom.session import scratch_path

ship(__name__)

LEAST_SHARED = 1000  # bytes; smaller payloads are never written as revisits
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
MEMBER_BYTES = 1 << 13  # a member is inflated in small steps, so that little is consumed beyond a record
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = (
    "archive string, kind string, first long, end long, reason string, record_type string, record_id string, uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, member long, content_first long, content_end long"
)


class Damaged(Exception):
    """A check failed; the text says which."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(text: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def record_bytes(record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record: a response, or a revisit with the HTTP header of a payload that is written elsewhere."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_line(uri)}", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member of its own."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def planned(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``pages`` (page_id, url, html) with ``keeper``: the page that holds the payload, where that is another one.

    Payloads are equal if their SHA-1 and length are. The page with the largest id keeps the payload. Null ids come
    after all others, and a group of them alone keeps every payload; rows that repeat the keeper keep theirs too. Only
    payloads that occur more than once are joined, so a copied one costs one row, however many pages have it.
    """
    plain = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sized = plain.withColumn("__sha", F.when(F.octet_length("html") >= least, F.sha1("html")))
    shared = sized.filter(F.col("__sha").isNotNull()).groupBy("__sha", F.octet_length("html").alias("__size")).agg(
        F.max("page_id").alias("__largest"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select(F.col("__sha").alias("__key"), "__size", "__largest")
    side = small_side(stored(shared, "shared-payloads"))
    joined = sized.join(side, (sized["__sha"] == side["__key"]) & (F.octet_length(sized["html"]) == side["__size"]), "left")
    keeper = F.when(~F.col("page_id").eqNullSafe(F.col("__largest")), F.col("__largest"))
    return joined.select("page_id", "url", "html", keeper.alias("keeper"))


def page_urn(page_id: int | None) -> str:
    return "urn:x-page:" + ("none" if page_id is None else str(page_id))


def write_archives(pages: DataFrame, folder: str, compressed: bool = True, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write archives below ``folder`` and return (archive, records, bytes), the list of those that count.

    A task writes each archive under a name of its own and moves it into place when it is complete. Archives of tasks
    that failed or ran twice are not on the list, so lost executors do no harm. ``folder`` has to be a path that pyarrow
    can write, such as a mounted one, HDFS or an object store.
    """
    ending = ".warc.gz" if compressed else ".warc"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            files.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for k in range(batch.num_rows):
                page_id, url, html, keeper = (c[k].as_py() for c in columns)
                if out is None:
                    name, records, size = uuid.uuid4().hex + ending, 0, 0
                    out = files.open_output_stream(f"{root}/.{name}", compression=None)
                data = record_bytes(page_urn(page_id), url or "", html.encode("utf-8"), None if keeper is None else page_urn(keeper))
                data = member(data, level) if compressed else data
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = planned(pages).select("page_id", "url", "html", "keeper")
    return stored(rows.mapInArrow(write, "archive string, records long, bytes long"), "archives")


class Window:
    """A byte stream with a little of its past: ``at(offset, n)`` for offsets from the last ``forget`` on."""

    def __init__(self, stream: io.RawIOBase, step: int = READ_BYTES, size: int | None = None) -> None:
        self.stream, self.step, self.size, self.start, self.data, self.ended = stream, step, size, 0, bytearray(), False

    def at(self, offset: int, size: int) -> bytes:
        while not self.ended and self.start + len(self.data) < offset + size:
            more = self.stream.read(max(self.step, offset + size - self.start - len(self.data)))
            self.data += more
            self.ended = not more
        return bytes(self.data[offset - self.start:offset - self.start + size])

    def forget(self, offset: int) -> None:
        del self.data[:offset - self.start]
        self.start = max(self.start, offset)


class Inflated:
    """The content of the member at ``place`` of a window, as a stream that ends where it cannot go on.

    ``place`` moves behind what has been consumed; ``fault`` tells why a member did not come to its proper end.
    ``surely`` tells up to where the bytes belong to the member, if its content is known to be right up to an offset: a member
    that breaks off may be inflated on into the next one.
    """

    def __init__(self, window: Window, place: int) -> None:
        self.window, self.place, self.fault, self.done = window, place, None, False
        self.unpack, self.made, self.steps = zlib.decompressobj(31), 0, deque()

    def surely(self, offset: int) -> int:
        while len(self.steps) > 1 and self.steps[1][0] < offset:
            self.steps.popleft()
        return self.steps[0][1]

    def read(self, size: int) -> bytes:
        out = self._step(size)
        self.made += len(out)
        return out

    def _step(self, size: int) -> bytes:
        while not self.done:
            self.steps.append((self.made, self.place))
            data = self.window.at(self.place, MEMBER_BYTES)
            if not data:
                self.fault, self.done = "truncated member", True
                break
            before = self.unpack.copy()
            try:
                out = self.unpack.decompress(data, size)
            except zlib.error as error:
                self.fault, self.done = "member checksum" if "incorrect" in str(error) else "member", True
                return self._until_error(before, data)
            self.done = self.unpack.eof
            # At the end the tail may repeat what is unused.
            self.place += len(data) - len(self.unpack.unused_data if self.done else self.unpack.unconsumed_tail)
            if out:
                return out
        return b""

    def _until_error(self, unpack: object, data: bytes) -> bytes:
        """What the bytes before the faulty one still give."""
        out = bytearray()
        for k in range(len(data)):
            try:
                out += unpack.decompress(data[k:k + 1])
            except zlib.error:
                break
            self.place += 1
        return bytes(out)


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line")
        found[name.strip().lower()] = value.strip()
    return found


def _plain(window: Window, offset: int) -> tuple[int, dict[str, str], bytes]:
    """An uncompressed record: its end, headers and block."""
    if not re.match(rb"WARC/\d+\.\d+\r\n", window.at(offset, 16)):
        raise Damaged("version line")
    # A header may have any length: a url has none that it cannot exceed.
    size, looked = 1024, 0
    while (stop := (head := window.at(offset, size)).find(b"\r\n\r\n", looked)) < 0:
        if len(head) < size:
            raise Damaged("header end")
        if any(b":" not in line for line in head.split(b"\r\n")[1:-1]):
            raise Damaged("header line")
        size, looked = size * 4, size - 3
    headers = _headers(head[:stop])
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise Damaged("content length")
    length = int(headers["content-length"])
    first = offset + stop + 4
    if window.size is not None and first + length + 4 > window.size:
        raise Damaged("truncated record")  # found without reading what there is
    block = window.at(first, length + 4)
    if len(block) < length + 4:
        raise Damaged("truncated record")
    if block[length:] != b"\r\n\r\n":
        raise Damaged("record end")
    return first + length + 4, headers, block[:length]


def _same_digest(stated: str | None, data: bytes) -> bool:
    """Whether a stated SHA-1, in base32 or hex, fits; digests of other kinds are not checked."""
    if stated is None or not stated.lower().startswith("sha1:"):
        return True
    return _hex(stated) == hashlib.sha1(data).hexdigest()


def _hex(stated: str | None) -> str | None:
    if stated is None:
        return None
    value = stated.partition(":")[2]
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return value.lower()
    return value.lower()


def _checked(headers: dict[str, str], block: bytes) -> dict[str, object]:
    """The fields of a record after the checks of its digests."""
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damaged("mandatory header")
    if not _same_digest(headers.get("warc-block-digest"), block):
        raise Damaged("block digest")
    kind, payload, size = headers["warc-type"].lower(), block, len(block)
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size = int(stated.group(1)) if kind == "revisit" and stated else len(payload)
    if kind != "revisit" and not _same_digest(headers.get("warc-payload-digest"), payload):
        raise Damaged("payload digest")
    return {
        "record_type": kind, "record_id": headers["warc-record-id"].strip("<>"), "uri": headers.get("warc-target-uri"),
        "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
        "payload_digest": _hex(headers.get("warc-payload-digest")), "payload_bytes": size, "payload": payload,
    }


Row = tuple[str, int, int, "str | None", dict[str, object]]
START = re.compile(rb"\x1f\x8b\x08|WARC/")


def _unit(window: Window, at: int, synced: bool) -> Generator[Row, None, tuple[int, str | None]]:
    """The rows of what starts at ``at``, then (end, None), or how far they go and the check that failed there.

    Without a record there are no rows. Rows follow on one another without space between; those of one member share out its
    bytes, each up to where they were needed to complete it. Unless ``synced``, three bytes may only look like a member, and its
    content has to begin with a version line.
    """
    if window.at(at, 3) != b"\x1f\x8b\x08":
        try:
            end, headers, block = _plain(window, at)
            fields = _checked(headers, block)
        except Damaged as error:
            return at, str(error)
        yield "record", at, end, None, fields
        return end, None

    inflated = Inflated(window, at)
    content = Window(inflated, MEMBER_BYTES)
    if not synced and content.at(0, 5) != b"WARC/":
        return at, "version line"
    past, place, held, count, reason = at, 0, None, 0, "empty member"
    while content.at(place, 1):
        try:
            stop, headers, block = _plain(content, place)
            fields = _checked(headers, block)
        except Damaged as error:
            reason = held[1] if held else str(error)
            held = held or (place, reason)
            place = _next_version(content, place + 1)
            continue
        last = not content.at(stop, 1)
        here = inflated.place if last and inflated.fault is None else inflated.surely(stop)
        if last and inflated.fault == "member checksum" and count == 0:
            return at, inflated.fault
        if held:
            yield "gap", past, past, held[1], {"member": at, "content_first": held[0], "content_end": place}
            held = None
        yield "record", past, here, None, {**fields, "member": at, "content_first": place, "content_end": stop}
        past, place, count = here, stop, count + 1
        content.forget(place)
        window.forget(past)
    if count == 0 or inflated.fault:
        return past, inflated.fault or reason
    if held:
        yield "gap", past, inflated.place, held[1], {"member": at, "content_first": held[0], "content_end": place}
    return inflated.place, None


def _next_version(content: Window, look: int) -> int:
    """Where the next version line may start, or the end."""
    while True:
        content.forget(look)
        data = content.at(look, MEMBER_BYTES)
        hit = data.find(b"WARC/")
        if hit >= 0:
            return look + hit
        if len(data) < MEMBER_BYTES:
            return look + len(data)
        look += len(data) - 4  # a start may lie across the border


def salvage(stream: io.RawIOBase, size: int | None = None) -> Iterator[Row]:
    """("record", first, end, None, fields) and ("gap", first, end, reason, {}) that cover the stream in order.

    ``size`` is the length of the stream, if it is known. Rows from a member also say where they lie in its content. An empty
    stream gives nothing.
    """
    window, at = Window(stream, size=size), 0
    while window.at(at, 1):
        window.forget(at)
        end, reason = yield from _unit(window, at, True)
        while reason is not None:
            # Search from behind what has been recovered for a start that gives a record.
            past, look = end, max(at + 1, end)
            found = None
            while found is None:
                window.forget(look)
                data = window.at(look, READ_BYTES)
                hit = START.search(data)
                if hit is None:
                    look += len(data) if len(data) < READ_BYTES else len(data) - 4
                    if len(data) < READ_BYTES:
                        break
                    continue
                look += hit.start()
                found = _peeked(_unit(window, look, False))
                if found is None:
                    look += 1
            yield "gap", past, look, reason, {}
            if found is None:
                end, reason = look, None
            else:
                at = look
                end, reason = yield from found
        at = end


def _peeked(rows: Generator[Row, None, tuple[int, str | None]]) -> Generator[Row, None, tuple[int, str | None]] | None:
    """The same rows if there are any."""
    try:
        first = next(rows)
    except StopIteration:
        return None

    def again() -> Generator[Row, None, tuple[int, str | None]]:
        yield first
        return (yield from rows)

    return again()


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``kind``) of the archives named in column ``archive``, one task per few archives.

    ``payload`` is null unless ``payloads``. Gaps have their byte range and the check that failed at its start; ``member``,
    ``content_first`` and ``content_end`` place what comes from a member in its content.
    """
    names = ["archive", "kind", "first", "end", "reason", "record_type", "record_id", "uri", "refers_to", "payload_digest", "payload_bytes", "payload", "member",
             "content_first", "content_end"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), *[pa.int64()] * 3]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                length = files.get_file_info(f"{root}/{name}").size
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for kind, first, end, reason, fields in salvage(stream, length):
                        if not payloads:
                            fields = {**fields, "payload": None}
                        rows.append((name, kind, first, end, reason, *[fields.get(n) for n in names[5:]]))
                        held += len(rows[-1][-4] or b"") + 300
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    count = max(1, min(archives.count(), 100_000))
    return archives.select("archive").repartition(count, "archive").mapInArrow(read, SCHEMA)


def round_trip(pages: DataFrame, compressed: bool = True) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back: records and gaps, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, compressed), folder, payloads=False)
