"""Queries over graphs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators.triples import dense_ids
from brindle.plans.tables import LINKS_SQL, PROPERTY, links, table, triples, triples_sql
from brindle.storage import stash


def _graph(spark, d):
    vertices, edges = G.graph_of(links(spark, d))
    return stash(vertices), stash(edges)


def graph_vertices(spark, d):
    return dense_ids(triples(spark, d).select(F.explode(F.array("subject", "object")).alias("value")), "value")


def graph_edges(spark, d):
    return G.graph_of(links(spark, d))[1]


def graph_counts(spark, d):
    return G.graph_counts(*G.graph_of(triples(spark, d)))


def in_degrees(spark, d):
    return G.in_degrees(G.graph_of(links(spark, d))[1])


def subgraph_by_attr(spark, d):
    return G.subgraph(G.graph_of(links(spark, d))[1], PROPERTY + "region")


def connected_components(spark, d):
    return G.components(*_graph(spark, d))


def pagerank_k3(spark, d):
    """Ranks after three rounds, by value."""
    v, e = _graph(spark, d)
    return G.pagerank_fixed(v, e, 3).join(v, "id").select("value", F.round("rank", 6).alias("rank"))


def pagerank_tol(spark, d):
    v, e = _graph(spark, d)
    return G.pagerank(v, e).join(v, "id").select("value", F.round("rank", 6).alias("rank"))


def pagerank_top5(spark, d):
    v, e = _graph(spark, d)
    return G.pagerank_fixed(v, e, 3).join(v, "id").select("value", F.round("rank", 6).alias("rank")).orderBy(F.col("rank").desc(), "value").limit(5)


def top_components(spark, d):
    v, e = _graph(spark, d)
    out = G.top_components(G.pagerank_fixed(v, e, 3), G.components(v, e))
    return out.select("component", F.round("rank", 6).alias("rank"), "n_vertices")


def _co_ordered(spark, d):
    """Parts that share an order."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    other = items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    # pairs of parts that repeat are dropped where edges are packed
    return items.join(other, "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")


def triangle_count(spark, d):
    return G.triangle_count(_co_ordered(spark, d))


def node_similarity_jaccard(spark, d):
    """Parts that two suppliers of a nation deliver."""
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    groups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_nationkey").alias("group"))
    return G.group_similarity(edges, groups).select("v1", "v2", F.round("jaccard", 6).alias("jaccard"))


def name_edit_distance(spark, d):
    """Distinct part names that share their first word."""
    names = table(spark, d, "part").select(F.col("p_name").alias("a"), F.substring_index("p_name", " ", 1).alias("w")).distinct()
    pairs = names.join(names.withColumnRenamed("a", "b"), "w").where("a < b").select("a", "b")
    return G.name_similarity(pairs, "a", "b").select("a", "b", F.col("edit_distance").cast("bigint").alias("edit_distance"))


_V = f"""WITH RECURSIVE t AS ({LINKS_SQL}), v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT subject AS value FROM t UNION SELECT object FROM t)),
  e AS (SELECT a.id AS src, b.id AS dst, predicate AS attr FROM t JOIN v a ON t.subject = a.value JOIN v b ON t.object = b.value)"""
_RANK = """,
  l AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM e),
  r0 AS (SELECT id, CAST(1.0 AS DOUBLE) AS rank FROM v),"""
for _i in range(3):
    _RANK += f"""
  r{_i + 1} AS (SELECT v.id, CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * coalesce(g.got, 0) AS rank FROM v LEFT JOIN (
        SELECT dst, sum(rank / n) AS got FROM l JOIN r{_i} ON src = id GROUP BY dst) g ON v.id = g.dst){"," if _i < 2 else ""}"""
# every path leads from a customer or supplier to its nation and region, so a component is a region's
_COMPONENT = """,
  up AS (SELECT a.src AS id, coalesce(b.dst, a.dst) AS top FROM e a LEFT JOIN e b ON a.dst = b.src UNION SELECT dst, dst FROM e WHERE dst NOT IN (SELECT src FROM e)),
  c AS (SELECT id, min(id) OVER (PARTITION BY top) AS component FROM up)"""

ORACLE_SQL = {
    "graph_vertices": f"WITH t AS ({triples_sql()}) SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT subject AS value FROM t UNION SELECT object FROM t)",
    "graph_edges": _V + " SELECT src, dst, attr FROM e",
    "graph_counts": f"""WITH t AS ({triples_sql()}) SELECT (SELECT count(*) FROM (SELECT subject FROM t UNION SELECT object FROM t)) AS n_vertices,
      (SELECT count(*) FROM t) AS n_edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY object)) AS max_in_degree""",
    "in_degrees": _V + " SELECT dst, count(*) AS in_degree FROM e GROUP BY dst",
    "subgraph_by_attr": _V + f" SELECT src, dst, attr FROM e WHERE attr = '{PROPERTY}region'",
    "connected_components": _V + _COMPONENT + " SELECT DISTINCT id, component FROM c",
    "pagerank_k3": _V + _RANK + " SELECT value, round(rank, 6) AS rank FROM r3 JOIN v ON r3.id = v.id",
    "pagerank_tol": _V + _RANK + " SELECT value, round(rank, 6) AS rank FROM r3 JOIN v ON r3.id = v.id",
    "pagerank_top5": _V + _RANK + " SELECT value, round(rank, 6) AS rank FROM r3 JOIN v ON r3.id = v.id ORDER BY rank DESC, value LIMIT 5",
    "top_components": _V + _RANK + _COMPONENT + " SELECT component, round(sum(rank), 6) AS rank, count(*) AS n_vertices FROM (SELECT DISTINCT id, component FROM c) x JOIN r3 ON x.id = r3.id GROUP BY component ORDER BY rank DESC, component LIMIT 5",
    "triangle_count": """WITH i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
      SELECT count(*) AS n_triangles FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""",
    "node_similarity_jaccard": """WITH s AS (SELECT DISTINCT l_suppkey AS v, l_partkey AS n FROM lineitem), z AS (SELECT v, count(*) AS n FROM s GROUP BY v),
      p AS (SELECT a.s_suppkey AS v1, b.s_suppkey AS v2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey),
      o AS (SELECT v1, v2, count(*) AS k FROM p JOIN s a ON a.v = v1 JOIN s b ON b.v = v2 AND a.n = b.n GROUP BY v1, v2)
      SELECT p.v1, p.v2, round(coalesce(k, 0) / CAST(x.n + y.n - coalesce(k, 0) AS DOUBLE), 6) AS jaccard FROM p JOIN z x ON x.v = p.v1 JOIN z y ON y.v = p.v2 LEFT JOIN o ON o.v1 = p.v1 AND o.v2 = p.v2""",
    "name_edit_distance": """WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b, levenshtein(x.a, y.a) AS edit_distance FROM n x JOIN n y
      ON split_part(x.a, ' ', 1) = split_part(y.a, ' ', 1) AND x.a < y.a""",
}
NAMES = [graph_vertices, graph_edges, graph_counts, in_degrees, subgraph_by_attr, connected_components, pagerank_k3, pagerank_tol, pagerank_top5, top_components, triangle_count, node_similarity_jaccard, name_edit_distance]
QUERIES = {f.__name__: f for f in NAMES}
