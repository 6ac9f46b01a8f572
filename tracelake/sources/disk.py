"""Disk structures: boot records, partition tables and NTFS file records.

Each parser takes a range reader read(offset, length) -> bytes, so that it works over a file, a chunk store or bytes in memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MBR_TYPES, TYPE_GUIDS

SECTOR = 512
#: Longest chain of extended boot records that is followed; named streams and attribute-list entries taken of a record.
MAX_EBR, MAX_ADS, MAX_LIST = 256, 64, 4096
#: Types of extended containers.
EXTENDED = (0x05, 0x0F)

Reader = Callable[[int, int], bytes]


def reader_of(data: bytes) -> Reader:
    return lambda offset, length: data[offset : offset + length]


def range_reader(parts: list[tuple[int, bytes]]) -> Reader:
    """Reader over (offset, bytes) pieces; ValueError where a range is not covered."""
    parts = sorted(parts)

    def read(offset: int, length: int) -> bytes:
        out, at = [], offset
        for start, data in parts:
            if start <= at < start + len(data) and at < offset + length:
                out.append(data[at - start : offset + length - start])
                at += len(out[-1])
        if at < offset + length:
            raise ValueError(f"no bytes at {at}")
        return b"".join(out)

    return read


def volume_type(sector: bytes) -> str | None:
    """File system of a boot sector; None if it is none."""
    if len(sector) < SECTOR or sector[510:512] != b"\x55\xaa":
        return None
    if sector[3:11] == b"NTFS    ":
        return "NTFS"
    if sector[3:11] == b"EXFAT   ":
        return "exFAT"
    if sector[82:90] == b"FAT32   ":
        return "FAT32"
    kind = sector[54:62].rstrip().decode("latin-1")
    return kind if kind in ("FAT16", "FAT12", "FAT") else None


def _entry(pid: str, kind: str, first: int, count: int, **more) -> dict:
    return {"partition_id": pid, "name": None, "partition_type": kind, "type_guid": None, "unique_guid": None, "start_offset": first * SECTOR, "length": count * SECTOR, "first_lba": first, "last_lba": first + count - 1, "attributes": None, "bootable": None} | more


def _slots(sector: bytes) -> Iterator[tuple[int, int, int, int]]:
    for k in range(4):
        e = sector[446 + 16 * k : 462 + 16 * k]
        first, count = struct.unpack("<II", e[8:16])
        yield e[0], e[4], first, count


def _mbr_type(kind: int) -> str:
    return f"{MBR_TYPES.get(kind, 'Unknown')} (0x{kind:02X})"


def parse_mbr(read: Reader) -> list[dict]:
    """Primary partitions mbr-n, numbered as they are found, then the logical ones of the extended container.

    Empty slots and containers give no row; of several containers the last is followed."""
    sector = read(0, SECTOR)
    if sector[510:512] != b"\x55\xaa":
        return []
    used = [slot for slot in _slots(sector) if slot[1] and slot[3]]
    primary = [slot for slot in used if slot[1] not in EXTENDED]
    out = [_entry(f"mbr-{k}", _mbr_type(kind), first, n, bootable=flag == 0x80) for k, (flag, kind, first, n) in enumerate(primary, 1)]
    containers = [first for _, kind, first, _ in used if kind in EXTENDED]
    return out + (list(_logical(read, containers[-1])) if containers else [])


def _logical(read: Reader, container: int) -> Iterator[dict]:
    """Logical partitions ebr-n, n the link of the chain: a link without a partition takes its number too. An unreadable link ends the chain."""
    at = container
    for link in range(1, MAX_EBR + 1):
        try:
            sector = read(at * SECTOR, SECTOR)
        except ValueError:
            return
        if len(sector) < SECTOR:
            return
        (_, kind, first, n), (_, more, step, size), *_ = _slots(sector)
        if kind and n:
            yield _entry(f"ebr-{link}", _mbr_type(kind), at + first, n)
        if not more or not size:
            return
        at = container + step


def guid(raw: bytes) -> str:
    a, b, c = struct.unpack("<IHH", raw[:8])
    return f"{a:08x}-{b:04x}-{c:04x}-{raw[8:10].hex()}-{raw[10:].hex()}"


def utf16(raw: bytes) -> str:
    return raw.decode("utf-16-le", "replace").split("\x00", 1)[0]


def _gpt_at(read: Reader, lba: int) -> list[dict] | None:
    head = read(lba * SECTOR, SECTOR)
    if head[:8] != b"EFI PART":
        return None
    size, crc = struct.unpack("<II", head[12:20])
    if not 92 <= size <= SECTOR or zlib.crc32(head[:16] + bytes(4) + head[20:size]) != crc:
        return None
    table, n, width = struct.unpack("<QII", head[72:88])
    if width < 128:
        return None
    raw, out = read(table * SECTOR, n * width), []
    for k in range(n):
        e = raw[k * width : (k + 1) * width]
        if len(e) < 128 or e[:16] == bytes(16):
            continue
        first, last, attributes = struct.unpack("<QQQ", e[32:56])
        if last < first:
            continue
        kind = guid(e[:16])
        out.append(_entry(f"gpt-{k + 1}", TYPE_GUIDS.get(kind, "Unknown"), first, last - first + 1, name=utf16(e[56:128]), type_guid=kind, unique_guid=guid(e[16:32]), attributes=attributes))
    return out


def parse_gpt(read: Reader, size: int) -> list[dict] | None:
    """Partitions of the primary table, else of the backup in the last sector; None if neither is valid."""
    for lba in (1, size // SECTOR - 1):
        if lba > 0:
            try:
                found = _gpt_at(read, lba)
            except ValueError:
                found = None
            if found is not None:
                return found
    return None


def parse_image(read: Reader, size: int) -> tuple[str, list[dict]]:
    """Scheme (volume, gpt, mbr or unknown) and partitions; a bare volume is one partition."""
    sector = read(0, min(SECTOR, size))
    kind = volume_type(sector)
    if kind:
        return "volume", [_entry("volume-0", kind, 0, size // SECTOR, filesystem_type=kind)]
    found = parse_gpt(read, size)
    scheme = "gpt"
    if found is None:
        found, scheme = parse_mbr(read), "mbr"
        if not found:
            return "unknown", []
    for p in found:
        try:
            p["filesystem_type"] = volume_type(read(p["start_offset"], SECTOR))
        except ValueError:
            p["filesystem_type"] = None
    return scheme, found


# NTFS ---------------------------------------------------------------------------------------------------------


def parse_vbr(sector: bytes) -> dict:
    """Geometry of an NTFS boot sector; ValueError if it is none."""
    if volume_type(sector) != "NTFS":
        raise ValueError("not an NTFS boot sector")
    bps, spc = struct.unpack("<HB", sector[11:14])
    spc = spc if spc < 0x80 else 1 << (256 - spc)
    mft, = struct.unpack("<Q", sector[48:56])
    rec, = struct.unpack("<b", sector[64:65])
    cluster = bps * spc
    if not bps or not spc:
        raise ValueError("empty geometry")
    return {"bytes_per_sector": bps, "cluster": cluster, "mft_offset": mft * cluster, "record": rec * cluster if rec > 0 else 1 << -rec}


def parse_runs(data: bytes) -> list[tuple[int | None, int]]:
    """(first cluster, clusters) of a run list; the cluster is None for a sparse run."""
    out, at, lcn = [], 0, 0
    while at < len(data) and data[at]:
        n_len, n_off = data[at] & 15, data[at] >> 4
        if not n_len or at + 1 + n_len + n_off > len(data):
            break
        count = int.from_bytes(data[at + 1 : at + 1 + n_len], "little")
        if n_off:
            lcn += int.from_bytes(data[at + 1 + n_len : at + 1 + n_len + n_off], "little", signed=True)
            out.append((lcn, count))
        else:
            out.append((None, count))
        at += 1 + n_len + n_off
    return out


def fixup(record: bytes, sector: int = SECTOR) -> bytes | None:
    """The record with its sector ends restored; None if one does not carry the update number."""
    off, n = struct.unpack("<HH", record[4:8])
    if off + 2 * n > len(record) or n == 0:
        return None
    out, mark = bytearray(record), record[off : off + 2]
    for k in range(1, n):
        end = k * sector
        if end > len(record) or record[end - 2 : end] != mark:
            return None
        out[end - 2 : end] = record[off + 2 * k : off + 2 * k + 2]
    return bytes(out)


# Order of preference of the name spaces POSIX, Win32, DOS and both.
NAME_RANK = {1: 0, 3: 1, 0: 2, 2: 3}


def best_name(names: list[dict]) -> dict | None:
    """Preferred of several names; the first of equals."""
    return min(names, key=lambda n: NAME_RANK.get(n["namespace"], 9), default=None)


def parse_record(raw: bytes, number: int) -> dict | None:
    """One file record: names, size, runs, times, flags, streams, attribute-list references; None if it is not in use as one."""
    if raw[:4] != b"FILE":
        return None
    rec = fixup(raw)
    out = {"record": number, "status": "ok", "in_use": False, "directory": False, "names": [], "size": 0, "runs": [], "streams": [], "times": (0, 0, 0, 0), "flags": 0, "base": 0, "refs": []}
    if rec is None:
        return out | {"status": "error"}
    flags, = struct.unpack("<H", rec[22:24])
    out["in_use"], out["directory"] = bool(flags & 1), bool(flags & 2)
    out["base"] = struct.unpack("<Q", rec[32:40])[0] & 0xFFFFFFFFFFFF
    at, = struct.unpack("<H", rec[20:22])
    while at + 8 <= len(rec):
        kind, size = struct.unpack("<II", rec[at : at + 8])
        if kind == 0xFFFFFFFF:
            break
        if size < 16 or at + size > len(rec):
            out["status"] = "partial"
            break
        a = rec[at : at + size]
        name = utf16(a[struct.unpack("<H", a[10:12])[0] :][: 2 * a[9]]) if a[9] else ""
        if a[8] == 0:
            n, start = struct.unpack("<IH", a[16:22])
            body = a[start : start + n]
            if kind == 0x10 and len(body) >= 36:
                out["times"], out["flags"] = struct.unpack("<4Q", body[:32]), struct.unpack("<I", body[32:36])[0]
            elif kind == 0x20:
                out["status"] = "partial"
                out["refs"] = attribute_list(body)
            elif kind == 0x30 and len(body) >= 66:
                out["names"].append({"parent": struct.unpack("<Q", body[:8])[0] & 0xFFFFFFFFFFFF, "namespace": body[65], "name": utf16(body[66 : 66 + 2 * body[64]])})
            elif kind == 0x80:
                if name:
                    out["streams"] = [*out["streams"], (name, n)][:MAX_ADS]
                else:
                    out["size"] = n
        elif kind == 0x80 and len(a) >= 64:
            start, = struct.unpack("<H", a[32:34])
            allocated, real, valid = struct.unpack("<QQQ", a[40:64])
            if name:
                out["streams"] = [*out["streams"], (name, real)][:MAX_ADS]
            else:
                out["size"], out["runs"] = valid, parse_runs(a[start:])
        at += size
    return out


def attribute_list(body: bytes) -> list[int]:
    """Records that hold more attributes of a file."""
    out, at = [], 0
    while at + 26 <= len(body) and len(out) < MAX_LIST:
        size, = struct.unpack("<H", body[at + 4 : at + 6])
        if size < 26:
            break
        out.append(struct.unpack("<Q", body[at + 16 : at + 24])[0] & 0xFFFFFFFFFFFF)
        at += size
    return sorted(set(out))


RECORD_SCHEMA = (
    "record long, status string, in_use boolean, directory boolean, base long, names array<struct<parent:long,namespace:int,name:string>>, size long, "
    "runs array<struct<lcn:long,clusters:long>>, streams array<struct<name:string,size:long>>, created long, modified long, changed long, accessed long, flags long, refs array<long>"
)


def file_records(records: DataFrame) -> DataFrame:
    """Parsed records of (record, content) rows; every record is parsed on its own."""

    def run(batches):
        for pdf in batches:
            rows = []
            for n, raw in zip(pdf["record"], pdf["content"]):
                r = parse_record(bytes(raw), int(n))
                if r:
                    c, m, x, a = r["times"]
                    rows.append((r["record"], r["status"], r["in_use"], r["directory"], r["base"], r["names"], r["size"], [{"lcn": l, "clusters": k} for l, k in r["runs"]], [{"name": s, "size": k} for s, k in r["streams"]], c, m, x, a, r["flags"], r["refs"]))
            yield pd.DataFrame(rows, columns=["record", "status", "in_use", "directory", "base", "names", "size", "runs", "streams", "created", "modified", "changed", "accessed", "flags", "refs"])

    return records.select("record", "content").mapInPandas(run, RECORD_SCHEMA)


def merge_lists(parsed: DataFrame) -> DataFrame:
    """Base records with the names (by name and name space) and streams (by name) of their extension records; the partial mark goes."""
    ext = parsed.where("base <> 0").select("base", "names", "streams")
    more = ext.groupBy("base").agg(F.flatten(F.collect_list("names")).alias("more_names"), F.flatten(F.collect_list("streams")).alias("more_streams"))
    j = parsed.where("base = 0").join(more.withColumnRenamed("base", "record"), "record", "left")
    names = F.array_distinct(F.concat("names", F.coalesce("more_names", F.array().cast("array<struct<parent:long,namespace:int,name:string>>"))))
    streams = F.slice(F.array_distinct(F.concat("streams", F.coalesce("more_streams", F.array().cast("array<struct<name:string,size:long>>")))), 1, MAX_ADS)
    met = F.col("more_names").isNotNull()
    return j.withColumns({"names": names, "streams": streams, "status": F.when(met & (F.col("status") == "partial"), "ok").otherwise(F.col("status"))}).drop("more_names", "more_streams")


def preferred(names: F.Column) -> F.Column:
    """Struct of the preferred name of an array of names."""
    rank = F.create_map(*[F.lit(x) for kv in NAME_RANK.items() for x in kv])
    ranked = F.transform(names, lambda x, i: F.struct(F.coalesce(F.try_element_at(rank, x["namespace"]), F.lit(9)).alias("r"), i.alias("i"), x["parent"].alias("parent"), x["name"].alias("name")))
    return F.array_min(ranked)


def file_rows(parsed: DataFrame, cluster: int, volume: int) -> DataFrame:
    """File rows of merged records: paths from the root record 5, extents in bytes, flags, times in microseconds."""
    from ..functions import scalars as S
    from ..operators.graph import paths

    best = merge_lists(parsed).withColumn("n", preferred(F.col("names"))).where("n IS NOT NULL")
    full = paths(best.select(F.col("record").alias("id"), F.col("n.parent").alias("parent"), F.col("n.name").alias("name")), 5)
    extents = F.transform(F.filter("runs", lambda r: r["lcn"].isNotNull()), lambda r: F.struct((r["lcn"] * cluster + volume).alias("offset"), (r["clusters"] * cluster).alias("length")))
    sparse, packed, secret = S.attr_flags(F.col("flags"))
    rows = best.join(full, best["record"] == full["id"])
    return rows.select(
        F.col("record").alias("file_id"), "path", F.col("n.name").alias("filename"), S.extension_index(F.col("n.name"), F.col("directory")).alias("extension"), F.col("size").alias("size_bytes"), F.to_json(extents).alias("physical_extents"),
        F.col("directory").alias("is_directory"), (~F.col("in_use")).alias("is_deleted"), sparse.alias("is_sparse"), packed.alias("is_compressed"), secret.alias("is_encrypted"),
        F.to_json("streams").alias("ads_streams"), S.filetime_micros(F.col("created")).alias("created"), S.filetime_micros(F.col("modified")).alias("modified"), F.col("status").alias("parser_status"),
    )
