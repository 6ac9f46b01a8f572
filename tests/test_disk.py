"""Synthetic disk images."""

import struct
import zlib

from pyspark.sql import functions as F

from tracelake.sources import disk


def mbr(entries):
    s = bytearray(512)
    for k, (flag, kind, first, n) in enumerate(entries):
        s[446 + 16 * k : 462 + 16 * k] = struct.pack("<B3xB3xII", flag, kind, first, n)
    s[510:] = b"\x55\xaa"
    return bytes(s)


def test_mbr_and_extended_chain():
    image = bytearray(10 << 20)
    image[:512] = mbr([(0x80, 7, 2048, 2048), (0, 0x83, 4096, 2048), (0, 5, 8000, 4000)])
    image[8000 * 512 : 8000 * 512 + 512] = mbr([(0, 0x83, 10, 100), (0, 5, 1000, 500)])
    image[9000 * 512 : 9000 * 512 + 512] = mbr([(0, 0x82, 20, 200)])
    scheme, found = disk.parse_image(disk.reader_of(bytes(image)), len(image))
    assert scheme == "mbr"
    assert [(p["partition_id"], p["start_offset"] // 512, p["length"] // 512, p["bootable"]) for p in found] == [
        ("mbr-1", 2048, 2048, True), ("mbr-2", 4096, 2048, False), ("ebr-1", 8010, 100, None), ("ebr-2", 9020, 200, None),
    ]
    assert found[0]["partition_type"] == "NTFS / exFAT (0x07)"


def test_mbr_gaps_and_links():
    image = bytearray(10 << 20)
    image[:512] = mbr([(0, 0, 10, 0), (0, 0x0F, 8000, 4000), (0, 0x99, 2048, 10), (0, 7, 4096, 0)])
    image[8000 * 512 : 8000 * 512 + 512] = mbr([(0, 0, 0, 0), (0, 0x83, 100, 500)])  # no partition, but a link of any type
    image[8100 * 512 : 8100 * 512 + 512] = mbr([(0x80, 0x83, 7, 9), (0, 5, 200, 0)])  # a link without a size ends the chain
    found = disk.parse_mbr(disk.reader_of(bytes(image)))
    assert [(p["partition_id"], p["partition_type"], p["first_lba"], p["last_lba"], p["bootable"]) for p in found] == [
        ("mbr-1", "Unknown (0x99)", 2048, 2057, False), ("ebr-2", "Linux Filesystem (0x83)", 8107, 8115, None),
    ]
    assert [p["partition_id"] for p in disk.parse_mbr(disk.range_reader([(0, bytes(image[: 8000 * 512]))]))] == ["mbr-1"]


def gpt_image(parts, sectors=20480):
    image = bytearray(sectors * 512)
    table = bytearray(128 * 128)
    for k, (kind, first, last, name) in enumerate(parts):
        a, b, c, d, e = kind.split("-")
        raw = struct.pack("<IHH", int(a, 16), int(b, 16), int(c, 16)) + bytes.fromhex(d + e)
        table[128 * k : 128 * k + 128] = raw + bytes([k + 1] * 16) + struct.pack("<QQQ", first, last, 0) + name.encode("utf-16-le").ljust(72, b"\0")
    for lba, at in ((1, 2), (sectors - 1, sectors - 33)):
        head = bytearray(b"EFI PART" + struct.pack("<IIII", 0x10000, 92, 0, 0) + struct.pack("<QQQQ", lba, 0, 34, sectors - 34) + bytes(16) + struct.pack("<QIII", at, 128, 128, 0))
        head[16:20] = struct.pack("<I", zlib.crc32(bytes(head[:92])))
        image[lba * 512 : lba * 512 + 92] = head[:92]
        image[at * 512 : at * 512 + len(table)] = table
    return image


def test_gpt_primary_and_backup():
    efi, data = "c12a7328-f81f-11d2-ba4b-00a0c93ec93b", "ebd0a0a2-b9e5-4433-87c0-68b6b72699c7"
    image = gpt_image([(efi, 2048, 4095, "EFI"), (data, 4096, 6143, "Data"), (data, 9, 8, "none")])
    for damage in (False, True):
        if damage:
            image[512 + 60] ^= 1
        scheme, found = disk.parse_image(disk.reader_of(bytes(image)), len(image))
        assert scheme == "gpt" and [(p["partition_id"], p["name"], p["partition_type"], p["first_lba"], p["last_lba"]) for p in found] == [("gpt-1", "EFI", "EFI System Partition", 2048, 4095), ("gpt-2", "Data", "Basic Data Partition", 4096, 6143)]
    image[-512 + 60] ^= 1
    assert disk.parse_image(disk.reader_of(bytes(image)), len(image))[0] == "unknown"


def test_volume_types():
    s = bytearray(512)
    s[510:] = b"\x55\xaa"
    for at, text, kind in ((3, b"NTFS    ", "NTFS"), (3, b"EXFAT   ", "exFAT"), (82, b"FAT32   ", "FAT32"), (54, b"FAT16   ", "FAT16"), (54, b"FAT     ", "FAT")):
        v = bytearray(s)
        v[at : at + 8] = text
        assert disk.volume_type(bytes(v)) == kind
    assert disk.volume_type(bytes(s)) is None and disk.volume_type(b"") is None


def test_runs():
    assert disk.parse_runs(bytes.fromhex("11082000")) == [(0x20, 8)]
    assert disk.parse_runs(bytes.fromhex("110a6411053200")) == [(100, 10), (150, 5)]
    assert disk.parse_runs(bytes.fromhex("11010511 01fa 00".replace(" ", ""))) == [(5, 1), (-1, 1)]
    assert disk.parse_runs(bytes.fromhex("010300")) == [(None, 3)]


def test_range_reader():
    read = disk.range_reader([(0, b"A" * 512), (512, b"B" * 512)])
    assert read(508, 8) == b"AAAABBBB"
    try:
        read(1000, 100)
        raise AssertionError
    except ValueError:
        pass


def attribute(kind, body):
    size = (24 + len(body) + 7) // 8 * 8
    return (struct.pack("<IIBBHHH", kind, size, 0, 0, 24, 0, 0) + struct.pack("<IHH", len(body), 24, 0) + body).ljust(size, b"\0")


def name_attribute(parent, text, space):
    return attribute(0x30, struct.pack("<Q", parent | 1 << 48) + bytes(56) + bytes([len(text), space]) + text.encode("utf-16-le"))


def record(attrs, flags=1, base=0):
    body = b"".join(attrs) + struct.pack("<II", 0xFFFFFFFF, 0)
    r = bytearray(1024)
    r[:4] = b"FILE"
    r[4:8] = struct.pack("<HH", 48, 3)
    r[20:24] = struct.pack("<HH", 56, flags)
    r[32:40] = struct.pack("<Q", base)
    r[56 : 56 + len(body)] = body
    r[48:50] = b"\x07\x07"
    for k in (1, 2):
        r[48 + 2 * k : 50 + 2 * k] = r[512 * k - 2 : 512 * k]
        r[512 * k - 2 : 512 * k] = b"\x07\x07"
    return bytes(r)


def data_runs(runs, size):
    head = struct.pack("<IIBBHHH", 0x80, 0, 1, 0, 64, 0, 0) + struct.pack("<QQHHI", 0, 0, 64, 0, 0) + struct.pack("<QQQ", size, size, size)
    a = head + runs
    a = a.ljust((len(a) + 7) // 8 * 8, b"\0")
    return a[:4] + struct.pack("<I", len(a)) + a[8:]


def test_ntfs_rows(spark):
    std = lambda flags: attribute(0x10, struct.pack("<4QI", 134116992000000000, 0, 0, 0, flags) + bytes(12))
    records = [
        (5, record([name_attribute(5, ".", 3)], 3)),
        (30, record([name_attribute(5, "DIR~1", 2), name_attribute(5, "Directory", 1)], 3)),
        (31, record([std(0x200), name_attribute(30, "a.TXT", 1), data_runs(bytes.fromhex("110220 00".replace(" ", "")), 5000)])),
        (32, record([name_attribute(99, "lost.bin", 1), attribute(0x80, b"resident")], 0)),
        (33, record([attribute(0x20, (struct.pack("<IHBBQQ", 0x30, 32, 0, 26, 0, 40) + bytes(8)))])),
        (40, record([name_attribute(30, "listed.txt", 1)], base=33)),
        (41, b"FILE" + bytes(1020)),
        (42, bytes(1024)),
    ]
    raw = spark.createDataFrame([(k, bytearray(b)) for k, b in records], "record long, content binary")
    parsed = disk.file_records(raw).cache()
    assert parsed.count() == 7 and parsed.where("record = 41").first().status == "error"
    rows = {r.file_id: r for r in disk.file_rows(parsed, 4096, 1 << 20).collect()}
    assert rows[31].path == "\\Directory\\a.TXT" and rows[31].extension == "txt" and rows[31].is_sparse and rows[31].size_bytes == 5000
    assert rows[31].physical_extents == '[{"offset":%d,"length":8192}]' % (0x20 * 4096 + (1 << 20))
    assert rows[31].created == 1767225600000000
    assert rows[32].path == "[orphan]\\lost.bin" and rows[32].is_deleted
    assert rows[33].path == "\\Directory\\listed.txt" and rows[33].parser_status == "ok"
    assert rows[30].is_directory and rows[30].extension == ""


def test_vbr():
    s = bytearray(512)
    s[3:11], s[510:] = b"NTFS    ", b"\x55\xaa"
    s[11:14], s[48:56], s[64:65] = struct.pack("<HB", 512, 8), struct.pack("<Q", 4), struct.pack("<b", -10)
    assert disk.parse_vbr(bytes(s)) == {"bytes_per_sector": 512, "cluster": 4096, "mft_offset": 16384, "record": 1024}


def test_preferred_name(spark):
    df = spark.createDataFrame([([(5, 2, "D"), (5, 0, "P"), (6, 3, "B"), (7, 3, "C")],)], "n array<struct<parent:long,namespace:int,name:string>>")
    assert df.select(disk.preferred(F.col("n")).alias("x")).first().x.name == "B"


def test_records_of_a_small_file_are_dealt_to_many_tasks(spark, sf, monkeypatch):
    from tracelake.plans import q_disk

    monkeypatch.setattr(q_disk, "RECORDS", 50)
    assert q_disk.mft(spark, sf).rdd.getNumPartitions() == 4  # 200 parts; the session's shuffles have 4 partitions
