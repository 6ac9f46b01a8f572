"""Schemas of tables and logs. Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(required: str, optional: str = "") -> T.StructType:
    """Columns as `name:type ...`; types default to string."""
    kinds = {"long": T.LongType(), "bool": T.BooleanType(), "double": T.DoubleType()}
    fields = []
    for text, nullable in ((required, False), (optional, True)):
        for item in text.split():
            name, _, kind = item.partition(":")
            fields.append(T.StructField(name, kinds.get(kind, T.StringType()), nullable))
    return T.StructType(fields)


CHUNK_MAP = _struct("sequence:long source_offset:long source_length:long chunk_id stored_length:long compression plaintext_sha256 stored_sha256")
LEAVES = _struct("sequence:long chunk_id plaintext_sha256")
FILE_INDEX = _struct(
    "file_id:long filesystem_id partition_id path filename extension size_bytes:long physical_extents chunk_refs",
    "is_directory:bool is_deleted:bool is_sparse:bool is_compressed:bool is_encrypted:bool created_at modified_at accessed_at changed_at ads_streams parser parser_version parser_status parser_error",
)
OBJECT_INDEX = _struct(
    "object_id object_type source_layer parser_status schema_version",
    "name logical_path media_type size_bytes:long sha256 storage_ref content_ref content_hash_status root_source_ref root_id collection_relative_path created_by_job_id provenance_ref original_created_at original_modified_at original_accessed_at",
)
OBJECT_EDGES = _struct("edge_id parent_object_id child_object_id relation_type schema_version", "parent_root_id child_root_id method logical_path sequence:long created_by_job_id provenance_ref")
DERIVATIONS = _struct("derivation_id parent_object_id child_object_id job_id method tool_id tool_name tool_version storage_mode created_at schema_version", "parent_root_id child_root_id parameters_hash input_sha256 output_sha256 provenance_ref")
KEYWORD_HITS = _struct("hit_id job_id keyword chunk_id physical_offset:long file_id context_before context_after encoding worker_id timestamp")
YARA_HITS = _struct("hit_id job_id rule_name ruleset_hash chunk_id physical_offset:long match_length:long file_id worker_id timestamp")

_TOOL = "struct<name:string,version:string>"
_TARGET = "struct<type:string,id:string>"
_LISTS = "array<string>"

#: Schemas of the logs, as DDL.
LOGS = {
    "labels": f"label_event_id string, timestamp string, actor string, tool {_TOOL}, target {_TARGET}, label string, reason string, policy_ref string, provenance_ref string",
    "scopes": f"scope_id string, created_at string, created_by string, description string, include struct<file_ids:{_LISTS},object_ids:{_LISTS},chunk_ids:{_LISTS},artifact_types:{_LISTS},date_range:struct<`from`:string,to:string>>, exclude struct<labels:{_LISTS},sets:{_LISTS}>, policy_refs {_LISTS}, provenance_ref string",
    "sets": f"set_id string, set_type string, created_at string, created_by string, scope_ref string, members struct<file_ids:{_LISTS},object_ids:{_LISTS},chunk_ids:{_LISTS},artifact_ids:{_LISTS}>, decision_ref string, policy_refs {_LISTS}, provenance_ref string",
    "decisions": f"decision_id string, timestamp string, actor struct<type:string,id:string,role:string>, decision_type string, target {_TARGET}, outcome string, reason string, policy_refs {_LISTS}, provenance_ref string",
    "policies": "policy_ref string, policy_type string, title string, issuer string, issued_at string, uri string, hash string, description string, provenance_ref string",
    "access": f"access_event_id string, timestamp string, actor string, tool {_TOOL}, action string, target {_TARGET}, scope_ref string, policy_refs {_LISTS}, result string, provenance_ref string",
    "denied": f"denied_event_id string, timestamp string, actor string, tool {_TOOL}, action string, target {_TARGET}, result string, reason_code string, scope_ref string, policy_refs {_LISTS}, provenance_ref string",
    "audit": f"audit_event_id string, timestamp string, actor string, event_type string, target {_TARGET}, result string, provenance_ref string",
    "annotations": "annotation_id string, timestamp string, actor string, origin string, annotation_type string, target struct<file_id:string,chunk_id:string,artifact_id:string>, label string, comment string, classification string, confidence double, input_scope string, model_name string, model_version string, model_hash string, correction_of string",
    "object_events": "event_id string, timestamp string, event_type string, object_id string, job_id string, payload string, schema_version string",
    "edge_events": "event_id string, timestamp string, event_type string, edge_id string, source_object_id string, target_object_id string, relationship string, job_id string, schema_version string",
    "custody": f"event_id string, timestamp string, actor string, action string, tool {_TOOL}, details string",
}

# Where the logs lie, and the keys that each of their records must have.
LOG_FILES = {
    "labels": "extensions/labels/labels.jsonl",
    "scopes": "extensions/scopes/scopes.jsonl",
    "working": "extensions/sets/working_sets.jsonl",
    "release": "extensions/sets/release_sets.jsonl",
    "exclusion": "extensions/sets/exclusion_sets.jsonl",
    "decisions": "extensions/decisions/decisions.jsonl",
    "policies": "extensions/policies/policy_refs.jsonl",
    "access": "extensions/access/access_events.jsonl",
    "denied": "extensions/access/denied_access_events.jsonl",
    "audit": "extensions/audit/audit_events.jsonl",
}
REQUIRED_KEYS = {
    "labels": ("label_event_id", "timestamp", "actor", "target", "label"),
    "scopes": ("scope_id", "created_at", "created_by"),
    "working": ("set_id", "set_type", "created_at", "created_by"),
    "release": ("set_id", "set_type", "created_at", "created_by"),
    "exclusion": ("set_id", "set_type", "created_at", "created_by"),
    "decisions": ("decision_id", "timestamp", "actor", "decision_type", "target", "outcome"),
    "policies": ("policy_ref", "policy_type"),
    "access": ("access_event_id", "timestamp", "actor", "action", "target", "result"),
    "denied": ("denied_event_id", "timestamp", "actor", "action", "target", "result"),
    "audit": ("audit_event_id", "timestamp", "actor", "event_type"),
}
