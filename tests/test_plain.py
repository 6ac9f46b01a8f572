"""Queries without a twin against plain Python on the smallest tables."""

import hashlib
import json

from tracelake import catalog
from tracelake.sources import fixtures as X


def test_byte_ranges_equal_plain_slices(spark, sf):
    docs = X.read(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    image = b"".join((r.text or "").encode() for r in docs)
    want = {}
    for r in X.partitions(spark, sf).collect():
        part = image[r.start_offset + 17 : r.start_offset + 5017]
        if part:
            want[r.partition_id] = (hashlib.sha256(part).hexdigest(), len(part), len(part) == 5000)
    got = {r.range_id: (r.digest, r.filled, r.complete) for r in catalog.queries()["join_byte_range"](spark, sf).collect()}
    assert got == want and want


def test_json_paths_equal_a_plain_walk(spark, sf):
    def walk(v, path):
        if isinstance(v, str):
            yield path, v
        for k, x in enumerate(v) if isinstance(v, list) else v.items() if isinstance(v, dict) else ():
            yield from walk(x, f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}")

    want = []
    for r in X.read(spark, sf, "events").select("event_id", "event_type", "props").collect():
        if r.props is not None:
            want += [(r.event_id, *x) for x in walk({"files": [f"a/{r.event_type}", {"x": "b"}], "n": 1, "props": json.loads(r.props)}, "$")]
    assert sorted(tuple(r) for r in catalog.queries()["ext_paths_flatten"](spark, sf).collect()) == sorted(want)


def test_decisions_name_targets_of_twelve_digits(spark, tmp_path):
    """An id of seven digits and its first six are two targets; a null label is released."""
    spark.createDataFrame([(1, 0), (123456, 1), (1234567, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.decision_id: (r.actor_type, r.target_id, r.outcome) for r in catalog.queries()["scan_ext_decisions"](spark, str(tmp_path)).collect()}
    assert got == {"dec-1": ("user", "obj-000000000001", "released"), "dec-123456": ("user", "obj-000000123456", "withheld"), "dec-1234567": ("user", "obj-000001234567", "released")}


def test_empty_documents_are_objects(spark, tmp_path):
    """An empty text is a blob of no bytes, which every reader of a store lists."""
    texts = ["", "a", "b" * 10_000, "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    run = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    each = sorted((h(t), len(t)) for t in set(texts))
    assert run("list_evidence_objects") == each
    assert run("scan_evidence_object") == run("scan_derived_object") == [(d, n, True) for d, n in each]
    assert run("object_sha_compute") == [(d, d) for d, _ in each]
    assert run("scan_blob_chunk") == [("ok", 3)]
    assert run("scan_derived_streaming") == sorted((h(t), -(-len(t) // 4096)) for t in set(texts) if t)


def test_keys_of_seven_digits(spark, tmp_path):
    """Ids are padded to six digits, not cut to them; records of parts and extension records are told apart."""
    keys = [999_999, 1_000_000, 1_000_001, 1_234_568, 2_000_040]
    parts = spark.createDataFrame([(k, f"n{k}") for k in keys], "p_partkey long, p_name string")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    run = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    assert run("fn_parse_file_id") == [(k, None if k % 3 == 2 else k) for k in keys]
    assert run("parse_ntfs_fixup") == [(k, k % 3 != 0) for k in keys if k % 40]
    assert run("ntfs_attrlist_merge") == [(k, "ok", 2) for k in keys if k % 40 == 0]


def test_case_event_ids_are_never_cut(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 999_998, 999_999, 1_000_008)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.id for r in catalog.queries()["case_event_id"](spark, str(tmp_path)).collect()}
    assert got == {0: "case-evt-000001", 999_998: "case-evt-999999", 999_999: "case-evt-1000000", 1_000_008: "case-evt-1000009"}
