"""Packed archives and raw byte ranges as Python data sources.

An archive is a header (magic, version), the files' bytes one after the other, a JSON index and a footer of 64 bytes: magic,
index offset and length (little-endian), SHA-256 of the index, zeros.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterable, Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the archive format.
HEADER_MAGIC, FOOTER_MAGIC, VERSION = b"OFPK", b"OFPKIDX1", 1
HEADER_BYTES, FOOTER_BYTES = 8, 64


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it; the driver and all executors open files through it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def create(path: str):
    """An output stream; the folder is made."""
    store, p = storage(path)
    store.create_dir(os.path.dirname(p), recursive=True)
    return store.open_output_stream(p)


def opened(path: str):
    """A file for reading at any place."""
    store, p = storage(path)
    return store.open_input_file(p)


def safe_name(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts


def write(path: str, files: Iterable[tuple[str, bytes]], format_name: str = "packed") -> dict:
    """Writes files (name, bytes) in order of their names; the index. A list is sorted; other iterables come in order and are streamed."""
    entries, at, last = [], HEADER_BYTES, ""
    with create(path) as f:
        f.write(HEADER_MAGIC + struct.pack("<I", VERSION))
        for name, data in sorted(files) if isinstance(files, list) else files:
            if name < last:
                raise ValueError(f"out of order: {name}")
            last = name
            f.write(data)
            entries.append({"path": name.replace("\\", "/"), "offset": at, "length": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            at += len(data)
        index = {"format": format_name, "version": VERSION, "entries": entries}
        raw = json.dumps(index, separators=(",", ":")).encode()
        f.write(raw + FOOTER_MAGIC + struct.pack("<QQ", at, len(raw)) + hashlib.sha256(raw).digest() + bytes(8))
    return index


def _footer(f) -> tuple[int, int, bytes]:
    """Place, length and SHA-256 of an open archive's index; f stands at the index."""
    size = f.size()
    if size < HEADER_BYTES + FOOTER_BYTES:
        raise ValueError("the archive is too small")
    if f.read(4) != HEADER_MAGIC:
        raise ValueError("header magic")
    f.seek(size - FOOTER_BYTES)
    foot = f.read(FOOTER_BYTES)
    if foot[:8] != FOOTER_MAGIC:
        raise ValueError("footer magic")
    at, n = struct.unpack("<QQ", foot[8:24])
    if at < HEADER_BYTES or at + n + FOOTER_BYTES > size:
        raise ValueError("index bounds")
    f.seek(at)
    return at, n, foot[24:56]


def _check_bounds(e: dict, end: int) -> None:
    if e["offset"] < HEADER_BYTES or e["offset"] + e["length"] > end:
        raise ValueError(f"entry bounds: {e['path']}")


def read_index(path: str) -> list[dict]:
    """Entries of an archive; ValueError names what is wrong with it."""
    with opened(path) as f:
        at, n, digest = _footer(f)
        raw = f.read(n)
    if hashlib.sha256(raw).digest() != digest:
        raise ValueError("index checksum")
    entries = json.loads(raw)["entries"]
    for e in entries:
        _check_bounds(e, at)
    return entries


class _Text:
    """JSON text of an open file, read BLOCK bytes at a time; a byte is a character, so that places are the file's."""

    BLOCK, _decode = 1 << 20, json.JSONDecoder().raw_decode

    def __init__(self, f, n: int):
        self.f, self.left, self.base, self.at, self.buf, self.sha = f, n, f.tell(), 0, "", hashlib.sha256()

    def fill(self) -> bool:
        raw = self.f.read(min(self.BLOCK, self.left))
        self.left -= len(raw)
        self.sha.update(raw)
        self.base, self.buf, self.at = self.base + self.at, self.buf[self.at :] + raw.decode("latin-1"), 0
        return bool(raw)

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            while self.at < len(self.buf) and self.buf[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.buf):
                return self.buf[self.at]
            if not self.fill():
                return ""

    def take(self, mark: str) -> bool:
        if self.peek() != mark:
            return False
        self.at += 1
        return True

    def value(self):
        self.peek()
        while True:
            try:
                v, end = self._decode(self.buf, self.at)
                if end < len(self.buf) or not self.fill():
                    self.at = end if end <= len(self.buf) else len(self.buf)
                    return v
            except ValueError:
                if not self.fill():
                    raise ValueError("index text") from None


def index_runs(path: str, entries: int, size: int | None = None) -> list[tuple[int, int]]:
    """Places (first, end) in an archive's file of its index's entries, in runs of `entries` or of `size` bytes of content. The index is read as a
    stream and checked as by read_index(), but for its checksum, which is known at its end."""
    runs, first, last, count, held = [], None, 0, 0, 0
    with opened(path) as f:
        end, n, digest = _footer(f)
        t = _Text(f, n)
        t.take("{")
        while t.peek() == '"':
            key = t.value()
            t.take(":")
            if key != "entries":
                t.value()
            else:
                t.take("[")
                while t.peek() not in ("]", ""):
                    begin = t.base + t.at
                    e = t.value()
                    _check_bounds(e, end)
                    first, last, count, held = (begin if first is None else first), t.base + t.at, count + 1, held + e["length"]
                    if count >= entries or size is not None and held >= size:
                        runs.append((first, last))
                        first, count, held = None, 0, 0
                    t.take(",")
                t.take("]")
            t.take(",")
        while t.fill():
            pass
    if t.sha.digest() != digest:
        raise ValueError("index checksum")
    return runs + ([(first, last)] if first is not None else [])


def unpack(path: str, folder: str) -> int:
    """Extracts all files, checking names and digests."""
    entries = read_index(path)
    with opened(path) as f:
        for e in entries:
            if not safe_name(e["path"]):
                raise ValueError(f"unsafe name: {e['path']}")
            f.seek(e["offset"])
            data = f.read(e["length"])
            if hashlib.sha256(data).hexdigest() != e["sha256"]:
                raise ValueError(f"checksum: {e['path']}")
            with create(os.path.join(folder, e["path"])) as out:
                out.write(data)
    return len(entries)


#: Bytes that a copy holds at once.
COPY_BYTES = 8 << 20


def copy(sources: Iterable[str], out, *digests, skip: int = 0) -> int:
    """Appends files to a stream (or none) and to digests, in order; bytes in all. skip: bytes left out at the start."""
    total = 0
    for path in sources:
        with opened(path) as f:
            while block := f.read(COPY_BYTES):
                block, skip = block[skip:], max(0, skip - len(block))
                total += len(block)
                if out is not None:
                    out.write(block)
                for d in digests:
                    d.update(block)
    return total


def join_archive(path: str, contents: list[str], index: list[str], format_name: str = "packed") -> None:
    """An archive of files with the contents and files with the index's entries, each with a comma before it."""
    sha = hashlib.sha256()
    with create(path) as f:
        f.write(HEADER_MAGIC + struct.pack("<I", VERSION))
        at = HEADER_BYTES + copy(contents, f)
        head, tail = f'{{"format":{json.dumps(format_name)},"version":{VERSION},"entries":['.encode(), b"]}"
        f.write(head), sha.update(head)
        n = len(head) + copy(index, f, sha, skip=1) + len(tail)
        f.write(tail), sha.update(tail)
        f.write(FOOTER_MAGIC + struct.pack("<QQ", at, n) + sha.digest() + bytes(8))


class _Slice(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class PackedSource(DataSource):
    """One row an entry of an archive; option content=true adds the bytes. Entries are dealt to tasks in runs."""

    @classmethod
    def name(cls) -> str:
        return "packed_archive"

    def schema(self) -> str:
        more = ", content binary" if self.options.get("content", "").lower() == "true" else ""
        return "path string, offset bigint, length bigint, sha256 string" + more

    def reader(self, schema):
        return _PackedReader(self.options["path"], self.options.get("content", "").lower() == "true", int(self.options.get("run", "4096")))


class _PackedReader(DataSourceReader):
    def __init__(self, path: str, content: bool, run: int):
        self.path, self.content, self.run = path, content, run

    def partitions(self):
        return [_Slice(self.path, a, b) for a, b in index_runs(self.path, self.run, RUN_BYTES if self.content else None)]

    def read(self, part) -> Iterator[tuple]:
        if part is None:  # no entries
            return
        with opened(part.path) as f:
            f.seek(part.first)
            for e in json.loads(b"[" + f.read(part.last - part.first) + b"]"):
                row = (e["path"], e["offset"], e["length"], e["sha256"])
                if self.content:
                    f.seek(e["offset"])
                    row += (f.read(e["length"]),)
                yield row


#: Bytes of a file that a task reads at least; a file more in a folder counts as FILE_COST bytes.
RUN_BYTES, FILE_COST = 16 << 20, 64 << 10


def heads(path: str, least: int = 64) -> list[str]:
    """Files and folders that together hold all data files below a folder: its levels are opened until there are `least` folders.
    So the driver lists few folders of a large store, tasks the others."""
    store, p = storage(path)
    head = path[: len(path) - len(p)] if "://" in path and not path.startswith("file:") else ""
    files, folders = [], [p] if store.get_file_info(p).type == pafs.FileType.Directory else []
    while 0 < len(folders) < least:
        found = [x for f in folders for x in store.get_file_info(pafs.FileSelector(f)) if _is_data(x.path)]
        files += [x.path for x in found if x.type == pafs.FileType.File]
        folders = [x.path for x in found if x.type == pafs.FileType.Directory]
    return [head + x for x in sorted(files + folders)]


def _is_data(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return not name.startswith((".", "_")) and not name.endswith((".crc", ".tmp"))


def files(head: str) -> Iterator[tuple[str, int]]:
    """(path, size) of a data file or of all below a folder, a folder at a time."""
    store, p = storage(head)
    prefix = head[: len(head) - len(p)] if "://" in head and not head.startswith("file:") else ""
    first = store.get_file_info(p)
    waiting = [first] if first.type == pafs.FileType.Directory else []
    if first.type == pafs.FileType.File:
        yield prefix + first.path, first.size
    while waiting:
        found = [x for x in store.get_file_info(pafs.FileSelector(waiting.pop().path)) if _is_data(x.path)]
        yield from ((prefix + x.path, x.size) for x in found if x.type == pafs.FileType.File)
        waiting += [x for x in found if x.type == pafs.FileType.Directory]


class RangeSource(DataSource):
    """Rows (path, piece, start, content) of fixed-size ranges of a file. Folders: readers.pieces()."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, piece bigint, start bigint, content binary"

    def reader(self, schema):
        piece = int(self.options.get("piece", str(64 << 20)))
        return _RangeReader(self.options["path"], piece, int(self.options.get("run", max(1, RUN_BYTES // piece))))


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, piece: int, run: int):
        self.path, self.piece, self.run = path, piece, run

    def partitions(self):
        (path, size), = files(self.path)
        n = -(-size // self.piece)
        return [_Slice(path, i, min(n, i + self.run)) for i in range(0, n, self.run)]

    def read(self, part) -> Iterator[tuple]:
        if part is None:  # an empty file
            return
        with opened(part.path) as f:
            for k in range(part.first, part.last):
                f.seek(k * self.piece)
                yield (part.path, k, k * self.piece, f.read(self.piece))
