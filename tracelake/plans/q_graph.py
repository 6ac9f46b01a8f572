"""Queries of the object graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lineage as L
from ..registry import RELATIONS, query
from ..sources import fixtures as X
from ..sources.store import shared_dir, staged, stored
from .q_joins import live_edges, live_objects, pointers

RELATIONS["fx_up"] = "SELECT node, min(depth) AS depth FROM (WITH RECURSIVE up(node, depth) AS (SELECT 's3' AS node, 0 AS depth UNION ALL SELECT e.parent_object_id, up.depth + 1 FROM up JOIN fx_edges e ON e.child_object_id = up.node) SELECT * FROM up) GROUP BY node"


@query("graph_ancestors", "SELECT edge_id, parent_object_id, child_object_id FROM fx_edges WHERE child_object_id IN (SELECT node FROM fx_up) AND parent_object_id IN (SELECT node FROM fx_up)")
def graph_ancestors(spark, sf):
    return G.ancestor_edges(X.edges(spark, sf), "s3").select("edge_id", "parent_object_id", "child_object_id")


@query("graph_ancestors_edges", "SELECT edge_id, e.parent_object_id, e.child_object_id FROM fx_edges e JOIN fx_up c ON c.node = child_object_id JOIN fx_up p ON p.node = parent_object_id WHERE p.depth > c.depth")
def graph_ancestors_edges(spark, sf):
    return G.ancestor_edges(X.edges(spark, sf), "s3", shortcuts=False).select("edge_id", "parent_object_id", "child_object_id")


@query("graph_lineage_path", "WITH RECURSIVE up(node, depth) AS (SELECT 'c14' AS node, 0 AS depth UNION ALL SELECT p.parent_id, depth + 1 FROM up JOIN fx_pointers p ON p.object_id = up.node) SELECT CAST(max(depth) OVER () - depth AS BIGINT) AS position, node FROM up")
def graph_lineage_path(spark, sf):
    path = G.lineage_path(pointers(spark, sf), "c14")
    return spark.createDataFrame(list(enumerate(path)), "position long, node string")


def _with_cycles(spark, sf):
    """The edges, an edge back from suppliers to a region, and two objects that point at each other."""
    more = spark.createDataFrame([("s1", "r0"), ("x1", "x2"), ("x2", "x1"), ("x2", "x3")], "parent_object_id string, child_object_id string")
    return X.edge_pairs(spark, sf).select("parent_object_id", "child_object_id").union(more)


RELATIONS["fx_cyclic"] = "SELECT parent_object_id, child_object_id FROM fx_edge_pairs UNION ALL VALUES ('s1', 'r0'), ('x1', 'x2'), ('x2', 'x1'), ('x2', 'x3')"


@query("graph_cycles", "WITH RECURSIVE down(node) AS (SELECT 'r0' AS node UNION SELECT e.child_object_id FROM down JOIN fx_cyclic e ON e.parent_object_id = down.node), up(node) AS (SELECT 'r0' AS node UNION SELECT e.parent_object_id FROM up JOIN fx_cyclic e ON e.child_object_id = up.node) SELECT node FROM down WHERE node IN (SELECT node FROM up) AND 's1' IN (SELECT node FROM down) UNION ALL VALUES ('x1'), ('x2')")
def graph_cycles(spark, sf):
    return G.cycle_nodes(_with_cycles(spark, sf))


@query("graph_has_cycle", "SELECT 'plain' AS graph, false AS cyclic UNION ALL SELECT 'with_cycles', true")
def graph_has_cycle(spark, sf):
    flag = lambda df, name: df.agg((F.count(F.lit(1)) > 0).alias("cyclic")).select(F.lit(name).alias("graph"), "cyclic")
    return flag(G.cycle_core(X.edge_pairs(spark, sf)), "plain").union(flag(G.cycle_core(_with_cycles(spark, sf)), "with_cycles"))


RELATIONS["fx_far"] = "SELECT node, min(depth) AS depth FROM (WITH RECURSIVE down(node, depth) AS (SELECT object_id AS node, 0 AS depth FROM fx_objects WHERE object_id NOT IN (SELECT child_object_id FROM fx_edges) UNION ALL SELECT e.child_object_id, depth + 1 FROM down JOIN fx_edges e ON e.parent_object_id = down.node) SELECT * FROM down) GROUP BY node"


@query("graph_max_depth", "SELECT CAST(max(depth) AS BIGINT) AS max_depth FROM fx_far")
def graph_max_depth(spark, sf):
    return G.max_depth(X.objects(spark, sf), X.edges(spark, sf))


@query("graph_roots", "SELECT object_id, object_type FROM fx_objects WHERE object_id NOT IN (SELECT child_object_id FROM fx_live_edges)")
def graph_roots(spark, sf):
    return L.roots(X.objects(spark, sf), live_edges(spark, sf)).select("object_id", "object_type")


@query("graph_roots_pointers", "SELECT object_id, object_type FROM fx_objects WHERE object_id NOT IN (SELECT child_object_id FROM fx_live_edges WHERE relation_type <> 'contains') AND object_id NOT IN (SELECT object_id FROM fx_pointers)")
def graph_roots_pointers(spark, sf):
    e = live_edges(spark, sf).where("relation_type <> 'contains'")
    return L.roots(X.objects(spark, sf), e).join(pointers(spark, sf).select("object_id"), "object_id", "left_anti").select("object_id", "object_type")


@query("graph_leaves", "SELECT object_id, object_type FROM fx_objects WHERE object_id NOT IN (SELECT parent_object_id FROM fx_edges)")
def graph_leaves(spark, sf):
    return L.leaves(X.objects(spark, sf), X.edges(spark, sf)).select("object_id", "object_type")


@query("graph_tree", "WITH RECURSIVE t(root, node, depth, path) AS (SELECT object_id AS root, object_id AS node, CAST(0 AS BIGINT) AS depth, object_id AS path FROM fx_objects WHERE object_id IN ('n0', 'n1') UNION ALL SELECT root, child_object_id, depth + 1, path || '/' || child_object_id FROM t JOIN fx_edges e ON e.parent_object_id = t.node) SELECT * FROM t")
def graph_tree(spark, sf):
    start = X.objects(spark, sf).where(F.col("object_id").isin("n0", "n1")).select(F.col("object_id").alias("node"))
    return G.tree(X.edges(spark, sf), start).withColumn("depth", F.col("depth").cast("long"))


RELATIONS["fx_entries"] = "SELECT p_partkey AS id, CASE WHEN p_partkey < 20 THEN 5 WHEN p_partkey % 31 = 0 THEN p_partkey + 100000 ELSE p_partkey // 7 + 6 END AS parent, 'd' || p_partkey AS name FROM part"


def entries(spark, sf):
    """A folder hierarchy of parts below root 5; some parents do not exist, so what hangs below them is orphaned."""
    i = F.col("p_partkey")
    parent = F.when(i < 20, F.lit(5)).when(i % 31 == 0, i + 100000).otherwise(F.call_function("div", i, F.lit(7)) + 6)
    return X.read(spark, sf, "part").select(i.alias("id"), parent.cast("long").alias("parent"), F.concat(F.lit("d"), i.cast("string")).alias("name"))


@query("path_build", r"WITH RECURSIVE w(id, path) AS (SELECT id, '\' || name AS path FROM fx_entries WHERE parent = 5 AND id <> 5 UNION ALL SELECT e.id, w.path || '\' || e.name FROM w JOIN fx_entries e ON e.parent = w.id WHERE e.id <> 5) SELECT e.id, coalesce(w.path, '[orphan]\' || e.name) AS path FROM fx_entries e LEFT JOIN w ON w.id = e.id WHERE e.id <> 5")
def path_build(spark, sf):
    return G.paths(entries(spark, sf), 5)


RELATIONS["fx_graph_issues"] = """
SELECT 'missing_edge_parent' AS rule, edge_id AS id FROM fx_live_edges WHERE parent_object_id NOT IN (SELECT object_id FROM fx_live_objects)
UNION ALL SELECT 'missing_edge_child', edge_id FROM fx_live_edges WHERE child_object_id NOT IN (SELECT object_id FROM fx_live_objects)
UNION ALL SELECT 'missing_derivation_parent', derivation_id FROM fx_derivations WHERE parent_object_id NOT IN (SELECT object_id FROM fx_live_objects)
UNION ALL SELECT 'missing_derivation_child', derivation_id FROM fx_derivations WHERE child_object_id NOT IN (SELECT object_id FROM fx_live_objects)
UNION ALL SELECT 'derivation_without_edge', derivation_id FROM fx_derivations d WHERE NOT EXISTS (SELECT 1 FROM fx_live_edges e WHERE e.parent_object_id = d.parent_object_id AND e.child_object_id = d.child_object_id)"""


def graph_issues(objects, edges, derivations):
    """(rule, id): everything that is wrong with a graph, but for cycles."""
    named = lambda df, rule, col: df.select(F.lit(rule).alias("rule"), F.col(col).alias("id"))
    out = named(L.missing_endpoint(edges, objects, "parent_object_id"), "missing_edge_parent", "edge_id")
    out = out.union(named(L.missing_endpoint(edges, objects, "child_object_id"), "missing_edge_child", "edge_id"))
    out = out.union(named(L.missing_endpoint(derivations, objects, "parent_object_id"), "missing_derivation_parent", "derivation_id"))
    out = out.union(named(L.missing_endpoint(derivations, objects, "child_object_id"), "missing_derivation_child", "derivation_id"))
    return out.union(named(L.derivations_without_edge(derivations, edges), "derivation_without_edge", "derivation_id"))


@query("graph_validate", "SELECT rule, id FROM fx_graph_issues")
def graph_validate(spark, sf):
    o, e, d = staged(live_objects(spark, sf), live_edges(spark, sf), X.derivations(spark, sf))
    issues = graph_issues(o, e, d)
    cycles = G.cycle_nodes(e).select(F.lit("cycle").alias("rule"), F.col("node").alias("id"))
    return issues.union(cycles)


@query("agg_lineage_stats", "SELECT (SELECT count(*) FROM fx_objects) AS objects, (SELECT count(*) FROM fx_edges) AS edges, (SELECT count(*) FROM fx_derivations) AS derivations, (SELECT count(*) FROM fx_objects WHERE object_id NOT IN (SELECT child_object_id FROM fx_edges)) AS roots, (SELECT count(*) FROM fx_objects WHERE object_id NOT IN (SELECT parent_object_id FROM fx_edges)) AS leaves, (SELECT CAST(max(depth) AS BIGINT) FROM fx_far) AS max_depth")
def agg_lineage_stats(spark, sf):
    base = shared_dir(spark)
    o, e = stored(X.objects(spark, sf).select("object_id"), f"{base}/o"), stored(X.edges(spark, sf), f"{base}/e")
    n = F.count(F.lit(1))
    rows = {"objects": o.agg(n), "edges": e.agg(n), "derivations": X.derivations(spark, sf).agg(n), "roots": L.roots(o, e).agg(n), "leaves": L.leaves(o, e).agg(n), "max_depth": G.max_depth(o, e)}
    # One row for each figure, turned into columns by one aggregate.
    tall = None
    for name, df in rows.items():
        part = df.toDF("v").select(F.lit(name).alias("k"), F.col("v").cast("long").alias("v"))
        tall = part if tall is None else tall.union(part)
    return tall.agg(*[F.max(F.when(F.col("k") == name, F.col("v"))).alias(name) for name in rows])


@query("agg_parents_csv", "SELECT child_object_id, string_agg(parent_object_id, '|' ORDER BY edge_id) AS parents FROM fx_edges GROUP BY child_object_id")
def agg_parents_csv(spark, sf):
    return L.parents_csv(X.edges(spark, sf))
