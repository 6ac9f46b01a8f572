"""python -m tracelake verify|list|export|pack|unpack|index ...: the container's verbs on a local session."""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracelake")
    sub = p.add_subparsers(dest="verb", required=True)
    v = sub.add_parser("verify")
    v.add_argument("root"), v.add_argument("--profile", default="core", choices=("core", "blobs", "objects", "lineage"))
    o = sub.add_parser("objects")
    o.add_argument("root"), o.add_argument("--type"), o.add_argument("--offset", type=int, default=0), o.add_argument("--limit", type=int, default=100)
    e = sub.add_parser("export")
    e.add_argument("root"), e.add_argument("output")
    k = sub.add_parser("pack")
    k.add_argument("folder"), k.add_argument("output")
    u = sub.add_parser("unpack")
    u.add_argument("archive"), u.add_argument("folder")
    n = sub.add_parser("list")
    n.add_argument("archive")
    a = p.parse_args(argv)

    from .sources import packed

    if a.verb == "pack":
        names = sorted(os.path.relpath(os.path.join(d, f), a.folder) for d, _, fs in os.walk(a.folder) for f in fs)
        packed.write(a.output, ((x, open(os.path.join(a.folder, x), "rb").read()) for x in names))
        return 0
    if a.verb == "unpack":
        print(packed.unpack(a.archive, a.folder))
        return 0
    if a.verb == "list":
        for x in packed.read_index(a.archive):
            print(x["path"], x["length"], x["sha256"])
        return 0

    from pyspark.sql import SparkSession

    from .api import Container

    c = Container(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.root)
    if a.verb == "export":
        print(c.export(a.output))
        return 0
    rows = (c.verify(a.profile) if a.verb == "verify" else c.list_objects(a.type, a.offset, a.limit)).collect()
    for r in rows:
        print(*r, sep="\t")
    return int(a.verb == "verify" and any(r.status == "fail" for r in rows))


if __name__ == "__main__":
    sys.exit(main())
