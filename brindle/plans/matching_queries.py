"""Queries of entity matching: blocks over benchmark items and documents, and names of suppliers and customers of a nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import matching as M
from brindle.plans.tables import table
from brindle.plans.triple_queries import STOPS_SQL

FRACTION = 0.5
KG1, KG2 = "http://one.example.org/data/wiki/", "http://two.example.org/data/wiki/"


def _tokens(spark, d):
    """Tokens of benchmark items (graph 1) and documents (graph 2)."""
    one = table(spark, d, "benchmark").select(F.lit(1).alias("kg"), F.col("item_id").alias("id"), F.col("text").alias("object"))
    two = table(spark, d, "documents").select(F.lit(2).alias("kg"), F.col("doc_id").alias("id"), F.col("text").alias("object"))
    return M.literal_tokens(one.unionByName(two))


def _limit(spark, d):
    return min(table(spark, d, "benchmark").count(), table(spark, d, "documents").count())


def block_sizes(spark, d):
    return M.block_sizes(_tokens(spark, d), _limit(spark, d), FRACTION)


def token_blocks(spark, d):
    """Blocks with the numbers of their ids, and a checksum of them."""
    blocks = M.token_blocks(_tokens(spark, d), _limit(spark, d), FRACTION)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.select("token", F.size("ids1").alias("n1"), F.size("ids2").alias("n2"), "n_cmp", total("ids1").alias("sum1"), total("ids2").alias("sum2"))


def block_split(spark, d):
    """All blocks after splitting: how many have so many comparisons."""
    blocks = M.split_blocks(M.token_blocks(_tokens(spark, d), _limit(spark, d), FRACTION))
    return blocks.groupBy("n_cmp").agg(F.count(F.lit(1)).alias("cnt"))


def candidate_pairs(spark, d):
    return M.candidate_pairs(_tokens(spark, d), _limit(spark, d), FRACTION)


def _entities(spark, d):
    """Triples of both graphs: customers are graph 1, suppliers graph 2; ids of suppliers are below zero."""
    subject = lambda kg, name: F.concat(F.lit(kg), F.col("n_name"), F.lit("/"), F.col(name))
    nation = table(spark, d, "nation")
    one = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), subject(KG1, "c_name").alias("subject"), F.lit(f"{KG1}property/nation").alias("predicate"), F.col("n_name").alias("object"), F.lit(1).alias("kg"))
    two = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select((-1 - F.col("s_suppkey")).alias("id"), subject(KG2, "s_name").alias("subject"), F.lit(f"{KG2}property/nation").alias("predicate"), F.col("n_name").alias("object"), F.lit(2).alias("kg"))
    return one.unionByName(two)


def entity_attributes(spark, d):
    e = _entities(spark, d)
    return M.entity_attributes(e, e.select("id"))


def _members(spark, d):
    """Customers and suppliers, with their nation as the block."""
    return _entities(spark, d).select(F.col("object").alias("block"), "id", "kg")


def filter_candidates(spark, d):
    """Customers and suppliers that share a nation, those that differ in their ids alone paired as one."""
    return M.each_id(M.block_pairs(_members(spark, d), entity_attributes(spark, d)).select("ids1", "ids2", "name1", "name2"))


def uri_similarity(spark, d):
    return M.scored_pairs(_members(spark, d), entity_attributes(spark, d), digits=6)


def _truth(spark, d):
    """An alignment cell for each supplier and the customer of the same number and nation."""
    nation = table(spark, d, "nation")
    both = table(spark, d, "supplier").join(table(spark, d, "customer"), (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    prefix = "http://example.org/alignment/alignment"
    name = lambda kg, c: F.concat(F.lit(kg), F.col("n_name"), F.lit("/"), F.col(c))
    row = lambda p, o: F.struct(F.lit(prefix + p).alias("predicate"), o.alias("object"))
    relation = F.when(F.col("s_acctbal") > 0, F.lit('"="')).otherwise(F.lit('"<"'))
    cells = F.array(row("entity1", name(KG1, "c_name")), row("entity2", name(KG2, "s_name")), row("relation", relation))
    return both.select(F.concat(F.lit("_:c"), F.col("s_suppkey").cast("string")).alias("subject"), F.explode(cells).alias("x")).select("subject", "x.*")


def true_alignment(spark, d):
    return M.true_alignment(_truth(spark, d))


def match_entities(spark, d):
    return M.scored_pairs(_members(spark, d), entity_attributes(spark, d), above=0.36).distinct()


def evaluate_matches(spark, d):
    out = M.evaluate(match_entities(spark, d), true_alignment(spark, d))
    return out.select("n_true", "n_pred", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f_measure")))


def false_negatives(spark, d):
    return M.false_negatives(match_entities(spark, d), true_alignment(spark, d))


def reduced_dataset(spark, d):
    e = _entities(spark, d)
    return M.reduce_dataset(e.where("kg = 1"), e.where("kg = 2"), 0.1, seed=3)


_BLOCKS = f"""WITH r AS (SELECT 1 AS kg, item_id AS id, text FROM benchmark UNION ALL SELECT 2, doc_id, text FROM documents),
  t AS (SELECT DISTINCT kg, id, unnest(string_split_regex(replace(lower(text), '-', ''), '[^a-z0-9]+')) AS token FROM r),
  k AS (SELECT * FROM t WHERE length(token) > 1 AND token NOT IN ({STOPS_SQL})),
  b AS (SELECT token, count(*) FILTER (kg = 1) AS n1, count(*) FILTER (kg = 2) AS n2, CAST(coalesce(sum(id) FILTER (kg = 1), 0) AS BIGINT) AS sum1,
        CAST(coalesce(sum(id) FILTER (kg = 2), 0) AS BIGINT) AS sum2 FROM k GROUP BY token),
  s AS (SELECT * FROM b WHERE n1 > 0 AND n2 > 0 AND least(n1, n2) < CAST({FRACTION} AS DOUBLE) * least((SELECT count(*) FROM benchmark), (SELECT count(*) FROM documents)))"""
_ENTITIES = f"""WITH e AS (SELECT c_custkey AS id, '{KG1}' || n_name || '/' || c_name AS subject, n_name, n_name || c_name AS name, 1 AS kg FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT -1 - s_suppkey, '{KG2}' || n_name || '/' || s_name, n_name, n_name || s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  p AS (SELECT a.id AS id1, b.id AS id2, a.name AS name1, b.name AS name2, a.subject AS entity1, b.subject AS entity2 FROM e a JOIN e b ON a.n_name = b.n_name AND a.kg = 1 AND b.kg = 2)"""
_GRAMS = """,
  u AS (SELECT DISTINCT id, name FROM e),
  g AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest([substr(name, CAST(i AS BIGINT), 2) FOR i IN generate_series(1, greatest(length(name) - 1, 1))]) AS gram FROM u WHERE name <> '') GROUP BY id, gram),
  z AS (SELECT id, sum(n) AS size FROM g GROUP BY id),
  o AS (SELECT p.id1, p.id2, sum(least(a.n, b.n)) AS shared FROM p JOIN g a ON a.id = p.id1 JOIN g b ON b.id = p.id2 AND a.gram = b.gram GROUP BY p.id1, p.id2),
  q AS (SELECT p.*, coalesce(o.shared, 0) / CAST(x.size + y.size AS DOUBLE) AS sim FROM p LEFT JOIN o ON p.id1 = o.id1 AND p.id2 = o.id2 JOIN z x ON x.id = p.id1 JOIN z y ON y.id = p.id2)"""
_TRUTH = f""",
  w AS (SELECT '{KG1}' || n_name || '/' || c_name AS entity1, '{KG2}' || n_name || '/' || s_name AS entity2 FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey
        JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0)"""
_MATCH = ", m AS (SELECT DISTINCT entity1, entity2 FROM q WHERE sim > CAST(0.36 AS DOUBLE))"

ORACLE_SQL = {
    "block_sizes": _BLOCKS + " SELECT token, n1, n2 FROM s",
    "token_blocks": _BLOCKS + " SELECT token, CAST(n1 AS INTEGER) AS n1, CAST(n2 AS INTEGER) AS n2, n1 * n2 AS n_cmp, sum1, sum2 FROM s",
    "block_split": _BLOCKS + """,
      a AS (SELECT token, n1, n2, n1 * n2 AS n_cmp, (SELECT avg(n1 * n2) FROM s) AS mean FROM s),
      v AS (SELECT *, greatest(n1, n2) AS big, least(n1, n2) AS small, greatest(1, CAST(floor(greatest(n1, n2) / CAST((
            SELECT min(v) FROM generate_series(2, 1000000) x(v) WHERE n1 * n2 / CAST(v AS DOUBLE) <= mean) AS DOUBLE)) AS BIGINT)) AS step FROM a WHERE n_cmp > mean),
      c AS (SELECT n_cmp FROM a WHERE n_cmp <= mean UNION ALL SELECT unnest([small * least(step, big - i * step) FOR i IN generate_series(0, (big + step - 1) // step - 1)]) FROM v)
      SELECT CAST(n_cmp AS BIGINT) AS n_cmp, count(*) AS cnt FROM c GROUP BY n_cmp""",
    "candidate_pairs": _BLOCKS + " SELECT DISTINCT a.id AS id1, b.id AS id2 FROM s JOIN k a ON a.token = s.token AND a.kg = 1 JOIN k b ON b.token = s.token AND b.kg = 2",
    "entity_attributes": _ENTITIES + " SELECT id, subject, 'nation' AS rel_name, name AS subj_name, 'wiki' AS category, '' AS subcategory FROM e",
    "filter_candidates": _ENTITIES + " SELECT id1, id2, name1, name2 FROM p",
    "uri_similarity": _ENTITIES + _GRAMS + " SELECT id1, id2, round(sim, 6) AS sim FROM q",
    "true_alignment": _ENTITIES + _TRUTH + " SELECT DISTINCT entity1, entity2 FROM w",
    "match_entities": _ENTITIES + _GRAMS + _MATCH + " SELECT * FROM m",
    "evaluate_matches": _ENTITIES + _GRAMS + _MATCH + _TRUTH + """,
      c AS (SELECT (SELECT count(*) FROM w) AS n_true, (SELECT count(*) FROM m) AS n_pred, (SELECT count(*) FROM (SELECT * FROM m INTERSECT SELECT * FROM w)) AS tp),
      r AS (SELECT *, n_pred - tp AS fp, n_true - tp AS fn, CAST(tp AS DOUBLE) / nullif(n_pred, 0) AS p, CAST(tp AS DOUBLE) / nullif(n_true, 0) AS r FROM c)
      SELECT n_true, n_pred, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f_measure FROM r""",
    "false_negatives": _ENTITIES + _GRAMS + _MATCH + _TRUTH + " SELECT * FROM w EXCEPT SELECT * FROM m",
}
NAMES = [block_sizes, token_blocks, block_split, candidate_pairs, entity_attributes, filter_candidates, uri_similarity, true_alignment, match_entities, evaluate_matches, false_negatives, reduced_dataset]
QUERIES = {f.__name__: f for f in NAMES}
