"""A container from end to end: create, read, damage, verify, export, pack."""

import os

import pytest
from pyspark.sql import functions as F

from tracelake import __main__ as cli
from tracelake import api
from tracelake.operators.scope import Selectors
from tracelake.plans.q_io import write_graph


@pytest.fixture(scope="module")
def made(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("case"))
    data = [bytes([k]) * 1000 for k in (1, 2, 2, 3)] + [b"tail"]
    parts = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)], "sequence long, content binary")
    c = api.create(spark, root, parts, "case-1")
    write_graph(spark, sf, root)
    return c, b"".join(data)


def test_read_verify_export(made, tmp_path):
    c, data = made
    assert c.chunk_map().count() == 5 and c.chunks().where("outcome = 'ok'").count() == 5
    assert c.read_bytes(0, len(data)) == data and c.read_bytes(990, 2020) == data[990:3010] and c.read_bytes(5, 0) == b""
    with pytest.raises(ValueError):
        c.read_bytes(len(data) - 2, 10)
    assert [(r.sequence, r.delta) for r in c.at(2500).collect()] == [(2, 500)]
    assert {r.status for r in c.verify().collect()} == {"pass"}
    c.export(str(tmp_path / "raw"))
    assert (tmp_path / "raw").read_bytes() == data
    with pytest.raises(FileExistsError):
        api.create(c.spark, c.root, c.spark.createDataFrame([(0, bytearray(b"x"))], "sequence long, content binary"), "case-2")


def test_graph_and_jobs(made):
    c, _ = made
    assert {r.status for r in c.verify("lineage").collect()} >= {"fail"}  # the fixture has bad derivation hashes
    assert c.list_objects("filesystem").count() == 5 and c.children("r0").count() > 0
    assert c.roots().count() == 5 and c.ancestors("n1").count() == 1
    assert c.shard(Selectors(object_types=("artifact",)), "j", "round_robin", 3).agg(F.sum("n")).first()[0] == c.objects().where("object_type = 'artifact'").count()
    c.append("policies", c.spark.createDataFrame([("p1", "retention")], "policy_ref string, policy_type string"))
    assert c.extension("policies").first().policy_ref == "p1"


def test_damage_is_found(made):
    c, _ = made
    path = next(os.path.join(d, f) for d, _, fs in os.walk(f"{c.root}/chunks") for f in fs if f.endswith(".chunk"))
    raw = bytearray(open(path, "rb").read())
    raw[0] ^= 1
    open(path, "wb").write(raw)
    assert c.verify("blobs").first().status == "fail"
    assert cli.main(["verify", c.root, "--profile", "blobs"]) == 1
    with pytest.raises(ValueError):
        c.read_bytes(0, 4000)


def test_versions(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"case_id": "c", "version": "9.9.9"}')
    with pytest.raises(ValueError):
        api.Container(spark, str(tmp_path), "strict")
    assert api.Container(spark, str(tmp_path), "permissive").version == "9.9.9"
    (tmp_path / "manifest.json").write_text('{"case_id": "c"}')
    assert api.Container(spark, str(tmp_path)).version == "0.1.0"


def test_pack_verbs(tmp_path, capsys):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a").write_bytes(b"1")
    (tmp_path / "in/sub/b").write_bytes(b"22")
    assert cli.main(["pack", str(tmp_path / "in"), str(tmp_path / "x.pk")]) == 0
    assert cli.main(["list", str(tmp_path / "x.pk")]) == 0 and "sub/b 2" in capsys.readouterr().out
    assert cli.main(["unpack", str(tmp_path / "x.pk"), str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/sub/b").read_bytes() == b"22"
