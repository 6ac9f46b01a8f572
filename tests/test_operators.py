"""Small hand-made inputs, injected faults and round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import cases, graph, lineage, merkle, replay, scan, scope, shards
from tracelake.operators.ordered import running
from tracelake.operators.ranges import overlap_join, point_join
from tracelake.plans import checks
from tracelake.sources import packed, readers, schemas, sinks


def sha(b):
    return hashlib.sha256(b).hexdigest()


def plain_root(leaves):
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


def leaves_df(spark, leaves):
    return spark.createDataFrame(list(enumerate(leaves)), "sequence long, plaintext_sha256 string")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_merkle_root_tree_and_proofs(spark, n):
    leaves = [sha(bytes([k])) for k in range(n)]
    df = leaves_df(spark, leaves)
    top = plain_root(leaves)
    assert merkle.root(df).first().root == top
    nodes = merkle.tree(df)
    assert nodes.orderBy(F.desc("level")).first().h == top
    assert merkle.invalid_nodes(nodes).count() == 0
    assert merkle.fold_proof(merkle.proof(nodes, n - 1), leaves[-1]).first().root == (top if n > 1 else leaves[0])


def test_merkle_root_spans_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    for n in (4, 5, 9, 17):
        leaves = [sha(bytes([k])) for k in range(n)]
        assert merkle.root(leaves_df(spark, leaves)).first().root == plain_root(leaves)


def test_merkle_blob_tamper():
    hashes = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    data = merkle.blob(list(merkle.levels_of(hashes)), b"TREE")
    assert merkle.check_blob(data, b"TREE", 5) == []
    assert merkle.check_blob(b"XXXX" + data[4:], b"TREE", 5) == ["magic"]
    assert merkle.check_blob(data[:4] + b"\x02" + data[5:], b"TREE", 5) == ["version"]
    assert merkle.check_blob(data, b"TREE", 6) == ["length"]
    assert merkle.check_blob(data[:9] + b"\0" + data[10:], b"TREE", 5) == ["node 1/0"]
    assert merkle.check_blob(data[:-1] + b"\0", b"TREE", 5) == ["root"]
    with pytest.raises(ValueError):
        merkle.fold([])


def test_overlap_join_edges(spark):
    chunks = spark.createDataFrame([(0, 0, 100), (1, 100, 200), (2, 200, 300)], "seq long, cs long, ce long")
    want = spark.createDataFrame([("a", 50, 150), ("b", 100, 200), ("c", 120, 120), ("d", 0, 300), ("e", 299, 900)], "r string, s long, e long")
    for width in (1, 7, 64, 1000):
        got = sorted((x.r, x.seq) for x in overlap_join(want, chunks, ("s", "e"), ("cs", "ce"), width).collect())
        assert got == [("a", 0), ("a", 1), ("b", 1), ("d", 0), ("d", 1), ("d", 2), ("e", 2)]
    points = spark.createDataFrame([(0,), (99,), (100,), (300,)], "x long")
    got = sorted((r.x, r.seq if r.seq is not None else -1) for r in point_join(points, chunks, "x", ("cs", "ce"), 64).collect())
    assert got == [(0, 0), (99, 0), (100, 1), (300, -1)]


def edges_df(spark, pairs):
    return spark.createDataFrame([(f"e{k}", a, b, "contains") for k, (a, b) in enumerate(pairs)], "edge_id string, parent_object_id string, child_object_id string, relation_type string")


def test_missing_child_is_seen(spark):
    objects = spark.createDataFrame([("a",)], "object_id string")
    e = edges_df(spark, [("a", "b")])
    assert lineage.missing_endpoint(e, objects, "child_object_id").count() == 1
    assert lineage.missing_endpoint(e, objects, "parent_object_id").count() == 0


def test_cycles(spark):
    both = edges_df(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("z", "z")])
    assert sorted(r.node for r in graph.cycle_nodes(both).collect()) == ["a", "b", "d", "e", "z"]
    assert graph.cycle_core(edges_df(spark, [("a", "b"), ("b", "c"), ("a", "c")])).count() == 0
    assert {(r.node, r.depth) for r in graph.closure(both, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)}


def test_cycles_of_random_graphs_against_plain(spark):
    rng = random.Random(5)
    pairs = [(f"{g}-{rng.randrange(14):02d}", f"{g}-{rng.randrange(14):02d}") for g in range(4) for _ in range(16)]
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    for _ in pairs:
        for a in reach:
            reach[a] = reach[a].union(*[reach.get(b, set()) for b in reach[a]])
    want = sorted(a for a in reach if a in reach[a])
    assert len(want) > 4
    assert sorted(r.node for r in graph.cycle_nodes(edges_df(spark, pairs)).collect()) == want
    assert graph.cycle_nodes(edges_df(spark, [("a", "b")])).count() == 0


def test_running_sums_with_an_outlier_key(spark):
    keys = [*range(-50, 3000), 10**15]
    found = running(spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long"), "k", {"before": F.col("v"), "rank": F.lit(1)})
    sums = {r.k: (r.before, r["rank"]) for r in found.collect()}
    assert sums == {k: (sum(x % 7 for x in keys[:i]), i) for i, k in enumerate(keys)}
    widest = running(spark.range(20_000).selectExpr("if(id = 0, -1000000000000000, id) AS k"), "k", {"rank": F.lit(1)})
    assert widest.count() == 20_000 and widest.where("k = 19999").first()["rank"] == 19_999
    assert running(spark.createDataFrame([], "k long"), "k", {"rank": F.lit(1)}).count() == 0


def test_lineage_path_errors(spark):
    p = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "y"), ("y", "x")], "object_id string, parent_id string")
    assert graph.lineage_path(p, "c") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        graph.lineage_path(p, "x")
    with pytest.raises(ValueError):
        graph.lineage_path(p, "c", max_depth_=1)


def test_paths_orphans(spark):
    e = spark.createDataFrame([(5, 5, "."), (10, 5, "a"), (11, 10, "b"), (12, 99, "lost"), (13, 14, "x"), (14, 13, "y")], "id long, parent long, name string")
    got = {r.id: r.path for r in graph.paths(e, 5).collect()}
    assert got == {10: "\\a", 11: "\\a\\b", 12: "[orphan]\\lost", 13: "[orphan]\\x", 14: "[orphan]\\y"}


def test_shards_twenty_inputs(spark):
    inputs = spark.createDataFrame([(k, f"o{k:02d}") for k in range(20)], "position long, object_id string")
    m = shards.manifests(inputs, "j", "range", 4).orderBy("shard_index").collect()
    assert [r.n for r in m] == [5, 5, 5, 5] and m[1].ids[0] == "o01" and m[0].shard_id == "j-shard-00"
    many = shards.manifests(inputs, "j", "hash_modulo", 50)
    assert many.count() == 50 and many.agg(F.sum("n")).first()[0] == 20
    for bad in (0, -1):
        with pytest.raises(ValueError):
            shards.shard_of("range", bad)


def test_shard_issues_each_kind(spark):
    plan = spark.createDataFrame([("s0",), ("s1",), ("s2",)], "shard_id string")
    found = spark.createDataFrame([("s0",), ("s1",)], "shard_id string")
    results = spark.createDataFrame([("s0", "h", "a", "a"), ("s1", "other", "a", "b")], "shard_id string, scope_hash string, artifact_sha256 string, artifact_actual string")
    results = results.union(spark.createDataFrame([("s9", "h", "a", None)], results.schema))
    members = spark.createDataFrame([("o1", "s0"), ("o1", "s1"), ("o2", "s0"), ("o2", "s0")], "object_id string, shard_id string")
    got = {(r.kind, r.id) for r in shards.issues(plan, found, results, members, "h").collect()}
    assert got == {("missing_shard_manifest", "s2"), ("missing_result", "s2"), ("scope_hash_mismatch", "s1"), ("artifact_hash_mismatch", "s1"), ("artifact_unreadable", "s9"), ("duplicate_input", "o1")}


def test_job_status_rules(spark):
    plan = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], "job_id string, shard_id string")
    res = spark.createDataFrame([("1", "completed"), ("3", "completed")], "shard_id string, status string")
    assert {r.job_id: r.status for r in shards.job_status(plan, res).collect()} == {"a": "partial", "b": "completed", "c": "failed"}


def test_scope_extensions_and_hash(spark):
    rows = [("1", "file", "contract.docx", "p"), ("2", "file", "image.JPEG", "p"), ("3", "file", ".gitignore", "p.jpeg"), ("4", "file", "noext", "p"), ("5", "email", None, "a\\b.Docx")]
    o = spark.createDataFrame([(*r, None, None, "ok", "h") for r in rows], "object_id string, object_type string, name string, logical_path string, media_type string, size_bytes long, parser_status string, sha256 string")
    got = scope.resolve(o, scope.Selectors(extensions=("..DOCX", "jpeg")))
    assert [(r.input_id, r.object_id) for r in got.orderBy("position").collect()] == [("input-000001", "1"), ("input-000002", "2"), ("input-000003", "5")]
    assert scope.scope_hash(got).first().scope_hash == "sha256:" + sha(b"1\n2\n5")
    assert scope.select(o, scope.Selectors(min_size=1)).count() == 0
    assert scope.select(o, scope.Selectors()).count() == 5


def test_replay_ignores_unknown_and_null(spark):
    e = spark.createDataFrame([(1, "a", "discovered", 1.0), (2, "a", "viewed", 9.0), (3, "b", "discovered", 1.0), (4, "b", "removed", None), (5, "c", "updated", None)], "seq long, object_id string, event_type string, payload_value double")
    assert [(r.object_id, r.payload_value) for r in replay.replay_objects(e).collect()] == [("a", 1.0)]
    assert sorted(r.object_id for r in replay.replay_objects(e, null_payload_counts=True).collect()) == ["a", "c"]


def test_first_writer_and_same_rows(spark):
    d = spark.createDataFrame([("o", "job-b", 1, "late"), ("o", "job-a", 2, "early"), ("o", "job-a", 3, "later")], "object_id string, job_dir string, line long, v string")
    old = spark.createDataFrame([("o", "old"), ("p", "kept")], "object_id string, v string")
    assert sorted((r.object_id, r.v) for r in replay.merge_indexes(d, old, "object_id").collect()) == [("o", "early"), ("p", "kept")]
    assert replay.same_rows(old, old) and not replay.same_rows(old, old.limit(1))


def test_provenance_first_error_only(spark):
    ok = [(k, f"evt-{k:06d}", "u", "a", "t", "1") for k in range(1, 9)]
    log = lambda rows: spark.createDataFrame(rows, "line_no long, event_id string, actor string, action string, tool_name string, tool_version string")
    assert checks.provenance(log(ok)).count() == 0
    bad = [*ok]
    bad[3] = (4, "evt-000002", "u", "a", "t", "1")
    bad[5] = (6, "evt-000006", " ", "a", "t", "1")
    got = checks.provenance(log(bad)).collect()
    assert [(r.line_no, r.problem) for r in got] == [(4, "repeated event_id")]
    assert checks.provenance(log(bad), first_only=False).count() == 2
    equal = [(1, "evt-000003", "u", "a", "t", "1"), (2, "evt-3", "u", "a", "t", "1")]
    assert checks.provenance(log(equal)).count() == 0


def test_missing_keys_stop_at_bad_json(spark):
    lines = spark.createDataFrame([(1, '{"a":""}'), (2, '{"b":1}'), (3, "{"), (4, "{}")], "line_no long, value string")
    assert [(r.line_no, r.problem) for r in checks.missing_keys(lines, ("a",)).orderBy("line_no").collect()] == [(2, "missing a"), (3, "bad JSON")]


def test_core_rules_fail_on_faults(spark):
    h = [sha(bytes([k])) for k in range(4)]
    rows = [(k, f"sha256:{h[k]}", 10 * k, 10, h[k], h[k], "none", 10) for k in range(4)]
    schema = "sequence long, chunk_id string, source_offset long, source_length long, plaintext_sha256 string, stored_sha256 string, compression string, stored_length long"
    leaves = spark.createDataFrame(list(enumerate(h)), "sequence long, plaintext_sha256 string")
    good = checks.report(checks.core(spark.createDataFrame(rows, schema), leaves))
    assert {r.status for r in good.collect()} == {"pass"}
    rows[1] = (1, rows[1][1], 11, 10, h[2], h[1], "lzma", 10)
    failed = {r["name"] for r in checks.report(checks.core(spark.createDataFrame([*rows, rows[3]], schema), leaves)).collect() if r.status == "fail"}
    assert failed == {"mapping gaps", "chunk id is the plaintext hash", "unknown compression", "leaves match mapping", "sequence repeats"}


def test_case_registry(spark):
    r = spark.createDataFrame([("r1", "active", "online")], "root_id string, status string, availability string")
    assert cases.attach(r, "r2").count() == 2
    with pytest.raises(ValueError):
        cases.attach(r, "r1")
    with pytest.raises(ValueError):
        cases.detach(r, "r9")
    assert cases.detach(r, "r1").first().status == "detached"


def test_keyword_across_chunks(spark):
    data = b"xxneedlexx" + "needle".encode("utf-16le") + b"nee"
    parts = [data[:5], data[5:12], data[12:24], data[24:]]
    at = [0, 5, 12, 24]
    chunks = spark.createDataFrame([(k, at[k], bytearray(p)) for k, p in enumerate(parts)], "sequence long, source_offset long, content binary")
    got = sorted((r.encoding, r.physical_offset, r.sequence) for r in scan.keyword_hits(chunks, ["needle"]).collect())
    assert got == [("utf-16le", 10, 1), ("utf-8", 2, 0)]


def test_rules_subset(spark):
    rules = scan.compile_rules('rule a {\n strings:\n  $x = "Foo" nocase\n  $y = { 00 ?? ff }\n condition: $x and $y\n}\nrule b {\n strings:\n  $r = /ba+r/\n condition: any of them\n}\nrule t {\n condition: true\n}\n')
    assert [r.name for r in rules] == ["a", "b", "t"]
    chunks = spark.createDataFrame([(0, 0, bytearray(b"fOO \x00a\xff")), (1, 7, bytearray(b"baaar"))], "sequence long, source_offset long, content binary")
    got = sorted((r.rule_name, r.sequence, r.physical_offset, r.match_length) for r in scan.rule_hits(chunks, rules, "h").collect())
    assert got == [("a", 0, 0, 3), ("a", 0, 4, 3), ("b", 1, 7, 5), ("t", 0, 0, 0), ("t", 1, 7, 0)]


def test_packed_round_trip_and_damage(tmp_path, spark):
    files = [("b/x.bin", b"\x00\x01"), ("a.txt", b"hello"), ("empty", b"")]
    p = str(tmp_path / "a.pk")
    packed.write(p, files)
    assert [e["path"] for e in packed.read_index(p)] == ["a.txt", "b/x.bin", "empty"]
    assert packed.unpack(p, str(tmp_path / "out")) == 3
    assert (tmp_path / "out/b/x.bin").read_bytes() == b"\x00\x01"
    spark.dataSource.register(packed.PackedSource)
    rows = spark.read.format("packed_archive").option("content", "true").option("run", 1).load(p).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == sorted(files)
    raw = bytearray((tmp_path / "a.pk").read_bytes())
    for at, message in ((0, "header"), (len(raw) - 64, "footer"), (len(raw) - 80, "checksum")):
        hurt = raw[:]
        hurt[at] ^= 1
        (tmp_path / "b.pk").write_bytes(hurt)
        with pytest.raises(ValueError, match=message):
            packed.read_index(str(tmp_path / "b.pk"))
    packed.write(str(tmp_path / "c.pk"), [("../x", b"1")])
    with pytest.raises(ValueError, match="unsafe"):
        packed.unpack(str(tmp_path / "c.pk"), str(tmp_path / "o2"))


def test_reader_conforms_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "h")], "sequence int, chunk_id string, plaintext_sha256 string")
    assert readers.conform(df, schemas.LEAVES).schema["sequence"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        readers.conform(df.drop("chunk_id"), schemas.LEAVES)
    assert readers.jsonl(spark, str(tmp_path / "absent"), "a string").count() == 0
    (tmp_path / "log.jsonl").write_text('{"a":"1"}\n\n{"a":"2"}\n')
    assert [(r.seq, r.a) for r in readers.ordered_log(spark, str(tmp_path / "log.jsonl"), "a string").orderBy("seq").collect()] == [(1, "1"), (3, "2")]
    (tmp_path / "bad.jsonl").write_text('{"a":"1"}\n{oops\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "a string").collect()


def test_lines_are_numbered_across_the_pieces_of_a_file(spark, tmp_path):
    """Two files in pieces of 64 bytes, with blank lines and both line ends; no file is one record."""
    for k in range(2):
        (tmp_path / f"p{k}.jsonl").write_bytes(b"".join(b'{"a":"%d-%d"}' % (k, i) + (b"\r\n" if i % 3 else b"\n\n") for i in range(60)))
    want, base = [], 0
    for k in range(2):
        lines = (tmp_path / f"p{k}.jsonl").read_text().split("\n")
        want += [(base + i + 1, f"{k}-{v.split('-')[1].split(chr(34))[0]}") for i, v in enumerate(lines) if v.strip()]
        base += max(i + 1 for i, v in enumerate(lines) if v.strip())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert readers.numbered_lines(spark, str(tmp_path / "p0.jsonl")).rdd.getNumPartitions() > 1
        got = [(r.seq, r.a) for r in readers.ordered_log(spark, str(tmp_path / "p*.jsonl"), "a string").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == want


@pytest.mark.parametrize("width", [4, 100])
def test_overlap_join_meets_empty_chunks(spark, width):
    """An empty chunk is met by ranges that start before its place and end behind it, at bin borders too; an empty range meets none."""
    chunks = [(k, s, e) for k, (s, e) in enumerate([(0, 4), (4, 4), (4, 8), (8, 8), (8, 8), (8, 9)])]
    ranges = [("a", 0, 4), ("b", 3, 5), ("c", 4, 8), ("d", 7, 12), ("e", 8, 9), ("f", 4, 4)]
    got = overlap_join(spark.createDataFrame(ranges, "r string, s long, e long"), spark.createDataFrame(chunks, "seq long, cs long, ce long"), ("s", "e"), ("cs", "ce"), width)
    want = [(r, q) for r, s, e in ranges if e > s for q, cs, ce in chunks if cs < e and ce > s]
    assert sorted((x.r, x.seq) for x in got.collect()) == sorted(want)


def test_batched_makes_the_lists_of_batches(spark):
    """Lists run over the borders of partitions, in the table's order, as those that the driver fetches."""
    df = spark.range(0, 107, 1, 9).select("id", (F.col("id") * 2).alias("x"))
    want = list(readers.batches(df, 10))
    got = readers.batched(df, 10).orderBy("batch").collect()
    assert [r.batch for r in got] == list(range(11)) and [r.rows for r in got] == want
    assert readers.batched(df.where("id < 0"), 10).count() == 0


def test_archives_and_digests_are_not_collected(spark, tmp_path, monkeypatch):
    """What many tasks write and one joins equals what a list gives; no row of content goes to the driver."""
    from pyspark.sql import DataFrame

    def refuse(*a, **k):
        raise AssertionError("rows are fetched")

    files = [(f"d\u00e9/{k:03d}", b"%d" % k * (k % 7)) for k in range(300)]
    df = spark.createDataFrame([(n, bytearray(x)) for n, x in files], "path string, content binary").repartition(5)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    p = str(tmp_path / "a.pk")
    sinks.archive(df, p)
    packed.write(str(tmp_path / "b.pk"), files)
    assert packed.read_index(p) == packed.read_index(str(tmp_path / "b.pk"))
    spark.dataSource.register(packed.PackedSource)
    rows = spark.read.format("packed_archive").option("content", "true").option("run", 7).load(p).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == files
    monkeypatch.setattr(packed._Text, "BLOCK", 50)
    runs = packed.index_runs(p, 7)
    assert len(runs) == 43 and runs == packed.index_runs(p, 7, 1 << 30) and len(packed.index_runs(p, 300, 1)) > 43
    whole = sha(b"".join(x for _, x in files))
    assert sinks.stream_digest(df, "path", "content") == whole
    for shared in (False, True):
        assert sinks.raw_export(df, "path", "content", str(tmp_path / "r"), whole, shared) == whole
    sinks.archive(df.where("path < ''"), p)
    assert packed.read_index(p) == [] and spark.read.format("packed_archive").load(p).count() == 0


def test_write_once_refuses(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "a string")
    sinks.write_once(df, str(tmp_path), "job", "r.jsonl")
    with pytest.raises(FileExistsError):
        sinks.write_once(df, str(tmp_path), "job", "r.jsonl")
    for job, name in (("..", "r"), ("a/b", "r"), ("j", "/etc"), ("j", "../r")):
        with pytest.raises(ValueError):
            sinks.write_once(df, str(tmp_path), job, name)


def test_raw_export_checks_hash(spark, tmp_path):
    parts = spark.createDataFrame([(1, bytearray(b"b")), (0, bytearray(b"a"))], "k long, c binary")
    p = tmp_path / "out.raw"
    assert sinks.raw_export(parts, "k", "c", str(p), sha(b"ab")) == sha(b"ab") and p.read_bytes() == b"ab"
    with pytest.raises(ValueError):
        sinks.raw_export(parts, "k", "c", str(p), "0" * 64)
    assert not p.exists()


def test_tokens(spark):
    from tracelake.functions.udfs import make_token, token_claims

    good, old = make_token({"exp": 100, "sub": "u"}, "k"), make_token({"exp": 1}, "k")
    df = spark.createDataFrame([(good,), (old,), (good[:-1] + ("A" if good[-1] != "A" else "B"),), ("junk",)], "t string")
    assert [r.x for r in df.select(token_claims("t", F.lit("k"), F.lit(50)).alias("x")).collect()] == ["ok", "expired", "bad_signature", "malformed"]


def test_tree_and_paths_have_no_depth_cap(spark):
    chain = edges_df(spark, [(f"n{k}", f"n{k + 1}") for k in range(36)])
    got = graph.tree(chain, spark.createDataFrame([("n0",)], "node string"))
    assert sorted(r.depth for r in got.collect()) == list(range(37))
    loop = spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (1, 2, "a")], "id long, parent long, name string")
    assert {r.path for r in graph.paths(loop, 5).collect()} == {"\\a", "\\a\\b"}
