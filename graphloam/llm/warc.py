"""WARC archives: a writer, and a reader that salvages what comes after damage."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

SCHEMA = "kind string, file string, offset bigint, length bigint, record_type string, uri string, record_id string, payload binary, reason string"
_ARROW = pa.schema([("kind", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("record_id", pa.string()), ("payload", pa.binary()), ("reason", pa.string())])
_MAGIC, _BLOCK = b"\x1f\x8b\x08", 1 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def record(uri: str | None, record_id: str, payload: bytes, record_type: str = "resource") -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = f"WARC-Target-URI: {uri}\r\n" if uri is not None else ""
    head = f"WARC/1.0\r\nWARC-Type: {record_type}\r\n{target}WARC-Record-ID: <{record_id}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, without a time so that equal records give equal bytes."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _uri(path: str) -> str:
    """As Arrow's file systems want it: three slashes for local files, s3 for what Hadoop calls s3a."""
    if path.startswith(("s3a://", "s3n://")):
        return "s3" + path[3:]
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _write(batches, path: str, damage: Callable | None):
    """A task writes one file under a name of its attempt and renames it, so that a repeated attempt does no harm."""
    fs, root = _filesystem(path)
    task = TaskContext.get()
    name = f"part-{task.partitionId():05d}.warc.gz"
    draft = f"{root}/_{name}.{task.taskAttemptId()}"
    n = size = 0
    with fs.open_output_stream(draft, compression=None) as out:
        for b in batches:
            for number, uri, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = member(record(uri, f"urn:page:{'' if number is None else number}", (text or "").encode()))
                data = damage(number, data) if damage else data
                out.write(data)
                n, size = n + 1, size + len(data)
    fs.move(draft, f"{root}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", damage: Callable | None = None) -> DataFrame:
    """Write one gzip member a row into files in ``path``; (file, records, bytes) of each.

    A null text is an empty record, a null uri has no header. Ids may be of any type, null or repeated. An empty table gives
    no records. Other columns are ignored.
    """
    spark = pages.sparkSession
    ship_package(spark)
    target = _uri(path)
    fs, root = _filesystem(target)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(text_col).cast("string").alias("text"))
    done = rows.mapInArrow(partial(_write, path=target, damage=damage), "file string, records bigint, bytes bigint").collect()
    return spark.createDataFrame(done, "file string, records bigint, bytes bigint")


class _Window:
    """A sliding view of a file: bytes from ``base`` on are held, those before are let go."""

    def __init__(self, f):
        self.f, self.base, self.data, self.ended = f, 0, bytearray(), False

    def more(self) -> bool:
        block = self.f.read(_BLOCK)
        if not block:
            self.ended = True
            return False
        self.data += block
        return True

    def let_go(self, to: int) -> None:
        if to - self.base >= _BLOCK:
            del self.data[: to - self.base]
            self.base = to

    def find(self, pattern: re.Pattern, at: int) -> int | None:
        """Offset of the next match from ``at`` on."""
        while True:
            m = pattern.search(self.data, at - self.base)
            if m:
                return self.base + m.start()
            at = max(at, self.base + len(self.data) - 16)
            self.let_go(at)
            if not self.more():
                return None


def _inflate(w: _Window, at: int, most: int) -> tuple[bytes | None, int, str]:
    """The member at ``at``: (content, end, why not). No more than ``most`` bytes are ever inflated."""
    d, out, pos, size = zlib.decompressobj(31), [], at, 0
    try:
        while not d.eof:
            if not d.unconsumed_tail:
                if pos >= w.base + len(w.data) and not w.more():
                    return None, pos, "truncated member"
                block = bytes(w.data[pos - w.base : pos - w.base + _BLOCK])
                pos += len(block)
            out.append(d.decompress(d.unconsumed_tail or block, most - size + 1))
            size += len(out[-1])
            if size > most:
                return None, pos, "member too large"
    except zlib.error as e:
        return None, pos, "bad member: " + str(e).rpartition(": ")[2]
    return b"".join(out), pos - len(d.unused_data), ""


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``: (fields, end, why not). Version line, header, length, closing lines and digest are checked."""
    if not _VERSION.match(data, at):
        return None, at, "no version line"
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None, at, "unfinished header"
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, at, "bad length"
    body, end = head_end + 4, head_end + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    payload = data[body:end]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return None, at, "wrong digest"
    return {"record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"), "payload": payload}, end + 4, ""


_START = re.compile(re.escape(_MAGIC))


#: A record or member of more bytes than this isn't held in memory but logged as a gap; a cell can't hold 2 GB in any case.
MOST_BYTES = 1 << 28


def salvage(f, name: str, most: int = MOST_BYTES) -> Iterator[tuple]:
    """Rows of :data:`SCHEMA` for a file, in order: its good records, and a gap for every run of bytes given up.

    Offsets of records in gzip members are those of their members. In a gap the search goes on at the byte after the bad
    start: for the next gzip magic whose member inflates and holds a record, or in plain archives for the next version line.
    """
    w = _Window(f)
    while len(w.data) < 16 and w.more():
        pass
    first = w.find(re.compile(re.escape(_MAGIC) + rb"|" + _VERSION.pattern), 0)
    if first is None:
        if w.base + len(w.data):
            yield ("gap", name, 0, w.base + len(w.data), None, None, None, None, "no record")
        return
    zipped = w.data[first - w.base : first - w.base + 3] == _MAGIC
    at, gap, why = first, 0 if first else None, "bad start" if first else ""
    while True:
        while at >= w.base + len(w.data) and w.more():
            pass
        if at >= w.base + len(w.data):
            break
        rows, end, bad = _member_records(w, at, name, most) if zipped else _plain_record(w, at, name, most)
        if bad:
            if gap is None:
                gap, why = at, bad
            found = w.find(_START if zipped else _VERSION, at + 1)
            if found is None:
                at = w.base + len(w.data)
                break
            at = found
            continue
        if gap is not None:
            yield ("gap", name, gap, at - gap, None, None, None, None, why)
            gap = None
        yield from rows
        at = end
        w.let_go(at)
    if gap is not None:
        yield ("gap", name, gap, at - gap, None, None, None, None, why)


def _member_records(w: _Window, at: int, name: str, most: int) -> tuple[list[tuple], int, str]:
    data, end, bad = _inflate(w, at, most)
    if data is None:
        return [], at, bad
    rows, pos, lost = [], 0, None
    while pos < len(data):
        fields, to, bad = parse_record(data, pos)
        if fields is None:
            nxt = _VERSION.search(data, pos + 1)
            lost = lost or bad
            if nxt is None:
                break
            pos = nxt.start()
            continue
        rows.append(("record", name, at, end - at, *(fields[k] for k in ("record_type", "uri", "record_id", "payload")), None))
        pos = to
    if not rows:
        return [], at, lost or "empty member"
    if lost:
        rows.append(("gap", name, at, end - at, None, None, None, None, f"part of a member: {lost}"))
    return rows, end, ""


_LENGTH = re.compile(rb"(?i)\r\ncontent-length: *(\d+)\r\n")


def _plain_record(w: _Window, at: int, name: str, most: int) -> tuple[list[tuple], int, str]:
    while (head := w.data.find(b"\r\n\r\n", at - w.base)) < 0 and len(w.data) - (at - w.base) < _BLOCK and w.more():
        pass
    stop = len(w.data)
    if head >= 0:
        size = _LENGTH.search(w.data, at - w.base, head + 2)
        if size and int(size[1]) > most:
            return [], at, "record too large"
        if size:
            stop = head + 8 + int(size[1])
            while len(w.data) < stop and w.more():
                pass
    fields, end, bad = parse_record(bytes(w.data[at - w.base : stop]), 0)
    if fields is None:
        return [], at, bad
    return [("record", name, at, end, *(fields[k] for k in ("record_type", "uri", "record_id", "payload")), None)], at + end, ""


def _read(batches, most: int):
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, root = _filesystem(_uri(path))
            rows, size = [], 0
            with fs.open_input_stream(root, compression=None) as f:
                for row in salvage(f, os.path.basename(path), most):
                    rows.append(row)
                    size += len(row[7] or b"")
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_warc(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Records and gaps of all archives in ``path`` (``*.warc``, ``*.warc.gz``, plain or by member), a task a file or several.

    ``record`` rows passed every check: inflation and CRC, version line, header, length, digest. ``gap`` rows log the file,
    offset and length of each quarantined run of bytes and what failed first. Together they cover each file once. Empty
    files have no rows; a folder without archives gives an empty table; a record without a uri has null there, an empty
    payload stays empty. Repeated records each come out. A record or member of more than ``most_bytes`` is a gap
    ("record too large", "member too large"), so a member that inflates without end does no harm; the search goes on inside it.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(partial(_read, most=most_bytes), SCHEMA)


def damage_some(number, data: bytes) -> bytes:
    """The damage of the registered query, by id modulo 97: a flipped byte, a lost tail, a spoilt magic, junk before the member, a wrong digest in a sound member."""
    d = number % 97 if isinstance(number, int) else zlib.crc32(str(number).encode()) % 97
    if d == 11:
        return data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 0x55]) + data[len(data) // 2 + 1 :]
    if d == 31:
        return data[: len(data) * 2 // 3]
    if d == 47:
        return b"\0\0" + data[2:]
    if d == 61:
        return b"\x1f\x8b\x08junk" * 9 + data
    if d == 83:
        return member(zlib.decompress(data, 31).replace(b"sha1:", b"sha1:A", 1))
    return data
