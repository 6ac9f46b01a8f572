"""Replay of event logs and merges of tables: the last event, or the first writer, of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_state(events: DataFrame, key: str, order: str, keep: tuple[str, ...], remove: tuple[str, ...]) -> DataFrame:
    """The last event of each key among those that set or remove it, but for removed keys. One aggregate, no sort."""
    seen = events.where(F.col("event_type").isin(*keep, *remove))
    rest = [c for c in events.columns if c not in (key,)]
    last = seen.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("e"))
    return last.select(key, "e.*").where(F.col("event_type").isin(*keep))


def replay_objects(events: DataFrame, null_payload_counts: bool = False) -> DataFrame:
    """Live objects after a log (seq, object_id, event_type, payload_value). An event without payload is ignored,
    or, with null_payload_counts, sets an empty object."""
    if not null_payload_counts:
        events = events.where((F.col("event_type") == "removed") | F.col("payload_value").isNotNull())
    return last_state(events, "object_id", "seq", ("discovered", "updated"), ("removed",))


def replay_edges(events: DataFrame) -> DataFrame:
    """Live edges after a log (seq, edge_id, event_type, ...)."""
    return last_state(events, "edge_id", "seq", ("discovered",), ("removed",))


def first_writer(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in an order of columns (src_rank, job_dir, line); the order's columns stay."""
    rest = [c for c in rows.columns if c != key and c not in order]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest, *order), F.struct(*order)).alias("r"))
    return first.select(key, "r.*")


def merge_indexes(deltas: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Deltas (with job_dir, line) before the existing index; the first row of a key wins."""
    old = existing.withColumns({"src_rank": F.lit(1), "job_dir": F.lit(""), "line": F.lit(0).cast("long")})
    both = deltas.withColumn("src_rank", F.lit(0)).unionByName(old, allowMissingColumns=True)
    return first_writer(both, key, ["src_rank", "job_dir", "line"])


def union_case(tables: dict[str, DataFrame], column: str = "root_id") -> DataFrame:
    """Tables of several roots as one; a null root becomes the table's own."""
    out = None
    for root, df in sorted(tables.items()):
        part = df.withColumn(column, F.coalesce(column, F.lit(root)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cross_root(edges: DataFrame, derivations: DataFrame) -> DataFrame:
    """(kind, id, parent_root_id, child_root_id) of links whose roots are both known and differ."""
    part = lambda df, kind, key: df.where("parent_root_id <> child_root_id").select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "parent_root_id", "child_root_id")
    return part(derivations, "derivation", "derivation_id").union(part(edges, "edge", "edge_id"))


def digest(df: DataFrame, key: str) -> DataFrame:
    """One row (rows, checksum) that does not depend on row order: counts and sums of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("checksum"), F.count(key).alias("keys"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often; a digest first, the differences only if it agrees."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns) or digest(a, cols[0]).first() != digest(b, cols[0]).first():
        return False
    return not a.select(cols).exceptAll(b.select(cols)).limit(1).count()
