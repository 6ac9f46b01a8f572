"""Scalar functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def tagged(digest: Column) -> Column:
    """`sha256:` before a bare digest."""
    return F.when(digest.startswith("sha256:"), digest).otherwise(F.concat(F.lit("sha256:"), digest))


def bare(digest: Column) -> Column:
    """A digest without its `sha256:`."""
    return F.regexp_replace(digest, "^sha256:", "")


def cas_path(store: str, digest: Column, suffix: str) -> Column:
    """Two-level path of a blob by its digest; null for a digest of under four characters."""
    h = bare(digest)
    return F.when(F.length(h) >= 4, F.concat(F.lit(f"{store}/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h, F.lit(suffix)))


def chunk_path(digest: Column) -> Column:
    return cas_path("chunks", digest, ".chunk")


def evidence_path(digest: Column) -> Column:
    return cas_path("evidence/objects", digest, ".bin")


def derived_path(digest: Column) -> Column:
    return cas_path("derived/objects", digest, ".bin")


def _joined_id(prefix: str, *parts: Column) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]  # concat_ws would skip nulls
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 24))


def object_id(*parts: Column) -> Column:
    return _joined_id("obj-fsfile-", *parts)


def edge_id(parent: Column, child: Column, relation: Column) -> Column:
    return _joined_id("edge-", parent, child, relation)


def derivation_id(*parts: Column) -> Column:
    return _joined_id("drv-", *parts)


def collect_object_id(digest: Column) -> Column:
    """Short id of a collected file; files of equal content share it."""
    return F.concat(F.lit("obj-"), F.substring(bare(digest), 1, 16))


def normalize_path(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def _last_part(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension_scope(name: Column, path: Column) -> Column:
    """Extension of the name, else of the path: lower case, null without a dot or with only a leading one."""
    base = _last_part(F.coalesce(name, path))
    ext = F.element_at(F.split(base, r"\."), -1)
    return F.when(F.instr(F.substring(base, 2, 1 << 20), ".") > 0, F.nullif(F.lower(ext), F.lit("")))


def extension_index(filename: Column, is_directory: Column) -> Column:
    """What follows the last dot anywhere, lower case; empty for directories and without a dot."""
    return F.when(is_directory | (F.instr(filename, ".") == 0), F.lit("")).otherwise(F.lower(F.element_at(F.split(filename, r"\."), -1)))


def replay_id(case_id: Column, job_id: Column, task: Column, raw: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", case_id, job_id, task, raw), 256))


def check_slug(number: Column, name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.format_string("check-%03d-", number), slug)


def status_name(status: Column) -> Column:
    return F.when(status == "ok", "pass").when(status == "warn", "warning").otherwise("fail")


def severity(status: Column) -> Column:
    return F.when(status == "ok", "low").when(status == "warn", "medium").otherwise("high")


#: 100 ns steps between 1601 and 1970.
FILETIME_EPOCH = 116444736000000000


def filetime_micros(ft: Column) -> Column:
    """Microseconds since 1970 of a file time; null for 0 and times before."""
    return F.when(ft >= FILETIME_EPOCH, F.call_function("div", ft - FILETIME_EPOCH, F.lit(10)))


def attr_flags(bits: Column) -> tuple[Column, Column, Column]:
    """Sparse, compressed and encrypted."""
    return tuple(bits.bitwiseAND(b) != 0 for b in (0x200, 0x800, 0x4000))


def guid_text(raw: Column) -> Column:
    """Text of a 16-byte identifier whose first three fields are little-endian."""
    h = F.lower(F.hex(raw))
    pick = lambda *at: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in at])
    return F.concat_ws("-", pick(3, 2, 1, 0), pick(5, 4), pick(7, 6), pick(8, 9), pick(10, 11, 12, 13, 14, 15))


def utf16_text(raw: Column) -> Column:
    """UTF-16LE up to the first NUL."""
    return F.element_at(F.split(F.decode(raw, "UTF-16LE"), "\u0000"), 1)


# Names of boot-record partition types.
MBR_TYPES = {
    0x00: "Empty",
    0x01: "FAT12",
    0x04: "FAT16 < 32 MiB",
    0x05: "Extended (CHS)",
    0x06: "FAT16",
    0x07: "NTFS / exFAT",
    0x0B: "FAT32 (CHS)",
    0x0C: "FAT32 (LBA)",
    0x0E: "FAT16 (LBA)",
    0x0F: "Extended (LBA)",
    0x11: "Hidden FAT12",
    0x14: "Hidden FAT16 < 32 MiB",
    0x16: "Hidden FAT16",
    0x17: "Hidden NTFS",
    0x1B: "Hidden FAT32 (CHS)",
    0x1C: "Hidden FAT32 (LBA)",
    0x1E: "Hidden FAT16 (LBA)",
    0x42: "Dynamic Disk",
    0x82: "Linux Swap",
    0x83: "Linux Filesystem",
    0x85: "Linux Extended",
    0x8E: "Linux LVM",
    0xA5: "FreeBSD",
    0xA8: "Apple macOS",
    0xEE: "GPT Protective MBR",
    0xEF: "EFI System Partition (FAT)",
    0xFB: "VMware VMFS",
    0xFC: "VMware kcore crash protection",
}

# Names of partition type identifiers.
TYPE_GUIDS = {
    "c12a7328-f81f-11d2-ba4b-00a0c93ec93b": "EFI System Partition",
    "21686148-6449-6e6f-744e-656564454649": "BIOS Boot Partition",
    "e3c9e316-0b5c-4db8-817d-f92df00215ae": "Microsoft Reserved",
    "ebd0a0a2-b9e5-4433-87c0-68b6b72699c7": "Basic Data Partition",
    "de94bba4-06d1-4d40-a16a-bfd50179d6ac": "Windows Recovery Environment",
    "0fc63daf-8483-4772-8e79-3d69d8477de4": "Linux Filesystem Data",
    "0657fd6d-a4ab-43c4-84e5-0933c84b4f4f": "Linux Swap",
    "e6d6d379-f507-44c2-a23c-238f2a3df928": "Linux LVM",
    "48465300-0000-11aa-aa11-00306543ecac": "Apple HFS+",
    "7c3457ef-0000-11aa-aa11-00306543ecac": "Apple APFS",
}


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit("Unknown"))


def part_type(code: Column) -> Column:
    return _lookup(MBR_TYPES, code.cast("int"))


def type_guid(guid: Column) -> Column:
    return _lookup(TYPE_GUIDS, F.lower(guid))


def parse_size(text: Column) -> Column:
    """Bytes of `64M`, `1G`, `512K` or a plain number; null otherwise."""
    t = F.upper(F.trim(text))
    n = F.regexp_extract(t, "^([0-9]+)[KMG]?$", 1).try_cast("long")
    return n * F.when(t.endswith("K"), 1 << 10).when(t.endswith("M"), 1 << 20).when(t.endswith("G"), 1 << 30).otherwise(1).cast("long")


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text)


def dot_escape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(t, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def is_semver(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.lit(False))


def is_extension_key(text: Column) -> Column:
    """`namespace:name`, both non-empty."""
    return F.coalesce(text.rlike("^[^:]+:.+$"), F.lit(False))


def parse_file_id(text: Column) -> Column:
    """Number of `file-000123` or `123`; null otherwise."""
    return F.regexp_extract(text, "^(?:file-)?([0-9]+)$", 1).try_cast("long")


def rfc3339(text: Column) -> Column:
    """Timestamp of a text with date, time and zone; null if it does not parse."""
    ok = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(ok, F.try_to_timestamp(text))


def path_is_safe(path: Column) -> Column:
    """No `..` part and not absolute, after `\\` became `/`."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.startswith("/") & (F.length(p) > 0)


def job_id_is_safe(job_id: Column) -> Column:
    return F.coalesce(job_id.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False)) & ~job_id.contains("..")
