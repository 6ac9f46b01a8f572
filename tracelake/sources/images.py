"""Synthetic disk structures, as inputs for the parsers."""

from __future__ import annotations

import struct
import zlib

from .disk import SECTOR


def boot_record(entries: list[tuple[int, int, int, int]]) -> bytes:
    """A boot record of (flag, type, first sector, sectors)."""
    s = bytearray(SECTOR)
    for k, (flag, kind, first, n) in enumerate(entries):
        s[446 + 16 * k : 462 + 16 * k] = struct.pack("<B3xB3xII", flag, kind, first, n)
    s[510:] = b"\x55\xaa"
    return bytes(s)


def guid_bytes(text: str) -> bytes:
    a, b, c, d, e = text.split("-")
    return struct.pack("<IHH", int(a, 16), int(b, 16), int(c, 16)) + bytes.fromhex(d + e)


def gpt_image(parts: list[tuple[str, int, int, str]], sectors: int = 2048) -> bytes:
    """An image with a primary and a backup table of (type, first, last, name)."""
    image, table = bytearray(sectors * SECTOR), bytearray(128 * 128)
    for k, (kind, first, last, name) in enumerate(parts):
        table[128 * k : 128 * k + 128] = guid_bytes(kind) + bytes([k + 1] * 16) + struct.pack("<QQQ", first, last, 0) + name.encode("utf-16-le")[:72].ljust(72, b"\0")
    for lba, at in ((1, 2), (sectors - 1, sectors - 33)):
        head = bytearray(b"EFI PART" + struct.pack("<IIII", 0x10000, 92, 0, 0) + struct.pack("<QQQQ", lba, 0, 34, sectors - 34) + bytes(16) + struct.pack("<QIII", at, 128, 128, 0))
        head[16:20] = struct.pack("<I", zlib.crc32(bytes(head)))
        image[lba * SECTOR : lba * SECTOR + 92] = head
        image[at * SECTOR : at * SECTOR + len(table)] = table
    return bytes(image)


def boot_sector(kind: str) -> bytes:
    """A boot sector of a file system."""
    s = bytearray(SECTOR)
    at, text = {"NTFS": (3, b"NTFS    "), "exFAT": (3, b"EXFAT   "), "FAT32": (82, b"FAT32   ")}.get(kind, (54, kind.encode().ljust(8)))
    s[at : at + 8] = text
    if kind == "NTFS":
        s[11:14], s[48:56], s[64:65] = struct.pack("<HB", 512, 8), struct.pack("<Q", 4), struct.pack("<b", -10)
    s[510:] = b"\x55\xaa"
    return bytes(s)


def _resident(kind: int, body: bytes) -> bytes:
    size = (24 + len(body) + 7) // 8 * 8
    return (struct.pack("<IIBBHHH", kind, size, 0, 0, 24, 0, 0) + struct.pack("<IHH", len(body), 24, 0) + body).ljust(size, b"\0")


def name_attribute(parent: int, text: str, space: int) -> bytes:
    return _resident(0x30, struct.pack("<Q", parent | 1 << 48) + bytes(56) + bytes([len(text), space]) + text.encode("utf-16-le"))


def times_attribute(filetime: int, flags: int) -> bytes:
    return _resident(0x10, struct.pack("<4QI", filetime, 0, 0, 0, flags) + bytes(12))


def list_attribute(records: list[int]) -> bytes:
    return _resident(0x20, b"".join(struct.pack("<IHBBQQ", 0x30, 32, 0, 26, 0, r) + bytes(8) for r in records))


def run_bytes(runs: list[tuple[int, int]]) -> bytes:
    """Run list of (first cluster, clusters) with four-byte offsets."""
    out, last = b"", 0
    for lcn, n in runs:
        out += bytes([0x44]) + struct.pack("<Ii", n, lcn - last)
        last = lcn
    return out + b"\0"


def data_attribute(runs: list[tuple[int, int]], size: int) -> bytes:
    a = struct.pack("<IIBBHHH", 0x80, 0, 1, 0, 64, 0, 0) + struct.pack("<QQHHI", 0, 0, 64, 0, 0) + struct.pack("<QQQ", size, size, size) + run_bytes(runs)
    a = a.ljust((len(a) + 7) // 8 * 8, b"\0")
    return a[:4] + struct.pack("<I", len(a)) + a[8:]


def file_record(attributes: list[bytes], flags: int = 1, base: int = 0) -> bytes:
    """A record of two sectors with its update sequence applied."""
    body = b"".join(attributes) + struct.pack("<II", 0xFFFFFFFF, 0)
    r = bytearray(1024)
    r[:8] = b"FILE" + struct.pack("<HH", 48, 3)
    r[20:24], r[32:40] = struct.pack("<HH", 56, flags), struct.pack("<Q", base)
    r[56 : 56 + len(body)] = body
    r[48:50] = b"\x07\x07"
    for k in (1, 2):
        r[48 + 2 * k : 50 + 2 * k] = r[512 * k - 2 : 512 * k]
        r[512 * k - 2 : 512 * k] = b"\x07\x07"
    return bytes(r)
