"""Queries over triples, texts and ontologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.functions.lemmatize import lemmatize
from brindle.operators import inference, triples as T
from brindle.operators.matching import stop_words
from brindle.plans.tables import CLASS, ITEM, PLACES, PROPERTY, table, triples, triples_sql
from brindle.sources.text import format_ntriples, parse_ntriples
from brindle.sources.xml import axioms, fragments, parse_rdfxml, records

WITH = f"WITH triple AS ({triples_sql()}) "
CUSTOMER = f"{ITEM}customer/1"
XML_HEAD = (
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" '
    'xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://example.org/ontology">'
)


def triples_build(spark, d):
    return triples(spark, d)


def subject_distribution(spark, d):
    return T.distribution(triples(spark, d), "subject")


def subject_distribution_sql(spark, d):
    triples(spark, d).createOrReplaceTempView("triple")
    return spark.sql("SELECT subject, count(*) AS cnt FROM triple GROUP BY subject")


def subject_topk(spark, d):
    return T.top(subject_distribution(spark, d), 20, "cnt", "subject")


def property_distribution(spark, d):
    return T.distribution(triples(spark, d), "predicate")


def class_distribution_top100(spark, d):
    return T.class_distribution(triples(spark, d))


def triples_by_subject(spark, d):
    return T.by_subject(triples(spark, d), CUSTOMER)


def triples_by_predicate(spark, d):
    return T.by_predicate(triples(spark, d), "region")


def triples_by_predicate_object(spark, d):
    return T.by_predicate_object(triples(spark, d), "nation", "nation/7")


def class_triples(spark, d):
    return T.class_triples(triples(spark, d))


def literal_triples(spark, d):
    return T.literal_triples(triples(spark, d))


def ntriples_roundtrip(spark, d):
    """All triples as N-Triples lines, and parsed back."""
    return parse_ntriples(format_ntriples(triples(spark, d)), "value").select("subject", "predicate", "object_value", "object_kind")


def word_count(spark, d):
    return T.word_count(table(spark, d, "documents"), "text")


def tokenize_literals(spark, d):
    """How many documents have each token."""
    found = table(spark, d, "documents").select("doc_id", F.explode(C.tokens(F.col("text"), stop_words(), False)).alias("token"))
    return T.distribution(found, "token")


def lemmatize_literals(spark, d):
    tokens = lemmatize(C.tokens(F.col("text"), stop_words(), False))
    return T.distribution(table(spark, d, "benchmark").select(F.explode(tokens).alias("lemma")), "lemma")


def set_union(spark, d):
    parts = T.union_all(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    return T.distribution(parts, "k")


def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


def _first_priority(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1"))


def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(_first_priority(spark, d).select(F.col("o_custkey").alias("k")))


def distinct_objects(spark, d):
    return triples(spark, d).select("object").distinct()


def _numbered(spark, d):
    return triples(spark, d).withColumn("id", F.xxhash64("subject", "predicate", "object"))


def semi_join_either(spark, d):
    """Triples about the nations of suppliers, as subject or object."""
    names = table(spark, d, "supplier").select(F.concat(F.lit(f"{ITEM}nation/"), F.col("s_nationkey").cast("string")).alias("name")).distinct()
    return T.semi_join_either(_numbered(spark, d), names).drop("id")


def semi_join_ids(spark, d):
    orders = table(spark, d, "orders")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def anti_join_pool(spark, d):
    orders = _first_priority(spark, d)
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def sample_fraction(spark, d):
    return triples(spark, d).sample(False, 0.01, 7)


def id_encode(spark, d):
    """Triples between resources and to values, with entities and relations numbered in order."""
    t = triples(spark, d, PLACES)
    entities = T.dense_ids(t.select(F.explode(F.array("subject", "object")).alias("name")), "name")
    relations = T.dense_ids(t.select(F.col("predicate").alias("name")), "name")
    return T.encode(t, entities, relations)


def first_wins_ids(spark, d):
    """Names of parts with the id that comes first."""
    return T.first_wins_dictionary(table(spark, d, "part").select("p_name", "p_partkey", F.col("p_partkey").alias("line")), "p_name", "line", "p_partkey")


def sum_of_cubes(spark, d):
    return table(spark, d, "nation").select("n_nationkey", C.sum_over(F.lit(2), F.col("n_nationkey") + 4, lambda i: i.cast("long") * i * i).alias("total"))


def point_distance(spark, d):
    x = lambda c: F.col(c).cast("double")
    return table(spark, d, "nation").select("n_nationkey", F.round(C.distance(x("n_nationkey"), x("n_regionkey"), F.lit(0.0), F.lit(1.0)), 6).alias("dist"))


def monte_carlo_pi(spark, d):
    """Share of pairs of hashed draws inside the circle, for every order."""
    unit = lambda s: F.pmod(F.xxhash64("o_orderkey", F.lit(s)), F.lit(1 << 30)).cast("double") / (1 << 30)
    x, y = unit("x"), unit("y")
    return table(spark, d, "orders").agg((4 * F.avg((x * x + y * y <= 1).cast("double"))).alias("pi"))


def _ontologies(spark, d):
    """An ontology for each region: a class for each nation, and two properties."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    one = lambda n: F.concat(F.lit('<owl:Class rdf:ID="'), n, F.lit('"><rdfs:label xml:lang="en">'), n, F.lit('</rdfs:label><rdfs:subClassOf rdf:resource="#Place"/></owl:Class>'))
    rest = '<owl:ObjectProperty rdf:ID="near"><rdfs:domain rdf:resource="#Place"/></owl:ObjectProperty><owl:DatatypeProperty rdf:ID="size"><rdfs:label>size</rdfs:label></owl:DatatypeProperty>'
    return nations.select(F.concat(F.lit(XML_HEAD), F.array_join(F.transform("names", one), "\n"), F.lit(rest), F.lit("</rdf:RDF>")).alias("value"))


def owl_fragments(spark, d):
    return T.distribution(fragments(_ontologies(spark, d)), "kind")


def owl_records(spark, d):
    return T.distribution(records(_ontologies(spark, d)), "kind")


def owl_axioms(spark, d):
    return T.distribution(axioms(fragments(_ontologies(spark, d)), XML_HEAD), "axiom_type")


def rdfxml_triples(spark, d):
    return T.distribution(parse_rdfxml(_ontologies(spark, d)), "predicate")


def rdfs_inference(spark, d):
    """All that follows for places, suppliers and customers from a small schema; counted by predicate and object's last part."""
    schema = [
        (CLASS + "Customer", inference.SUB_CLASS, CLASS + "Agent"), (CLASS + "Supplier", inference.SUB_CLASS, CLASS + "Agent"),
        (CLASS + "Agent", inference.SUB_CLASS, CLASS + "Thing"), (PROPERTY + "nation", inference.SUB_PROPERTY, PROPERTY + "location"),
        (PROPERTY + "region", inference.SUB_PROPERTY, PROPERTY + "location"), (PROPERTY + "location", inference.RANGE, CLASS + "Place"),
    ]
    base = triples(spark, d, PLACES).unionByName(spark.createDataFrame(schema, "subject string, predicate string, object string"))
    return T.distribution(inference.infer_rdfs(base).withColumn("predicate", C.local_name(F.col("predicate"))), "predicate")


STOPS_SQL = ", ".join(f"'{w}'" for w in stop_words() if w.isalpha())

ORACLE_SQL = {
    "triples_build": WITH + "SELECT subject, predicate, object FROM triple",
    "subject_distribution": WITH + "SELECT subject, count(*) AS cnt FROM triple GROUP BY subject",
    "subject_distribution_sql": WITH + "SELECT subject, count(*) AS cnt FROM triple GROUP BY subject",
    "subject_topk": WITH + "SELECT subject, count(*) AS cnt FROM triple GROUP BY subject ORDER BY cnt DESC, subject LIMIT 20",
    "property_distribution": WITH + "SELECT predicate, count(*) AS cnt FROM triple GROUP BY predicate",
    "class_distribution_top100": WITH + f"SELECT object AS class, count(*) AS cnt FROM triple WHERE predicate = '{C.RDF_TYPE}' GROUP BY object ORDER BY cnt DESC, class LIMIT 100",
    "triples_by_subject": WITH + f"SELECT * FROM triple WHERE subject = '{CUSTOMER}'",
    "triples_by_predicate": WITH + "SELECT * FROM triple WHERE ends_with(predicate, '/region')",
    "triples_by_predicate_object": WITH + "SELECT * FROM triple WHERE ends_with(predicate, '/nation') AND ends_with(object, '/nation/7')",
    "class_triples": WITH + f"SELECT * FROM triple WHERE predicate = '{C.RDF_TYPE}'",
    "literal_triples": WITH + "SELECT * FROM triple WHERE NOT starts_with(object, 'http://')",
    "ntriples_roundtrip": WITH + "SELECT subject, predicate, object AS object_value, CASE WHEN starts_with(object, 'http://') THEN 'iri' ELSE 'literal' END AS object_kind FROM triple",
    "word_count": "SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) WHERE word <> '' GROUP BY word",
    "tokenize_literals": f"""SELECT token, count(*) AS cnt FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(replace(lower(text), '-', ''), '[^a-z0-9]+')) AS token FROM documents)
      WHERE length(token) > 1 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({STOPS_SQL}) GROUP BY token""",
    "set_union": "SELECT k, count(*) AS cnt FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE starts_with(o_orderpriority, '1')",
    "distinct_objects": WITH + "SELECT DISTINCT object FROM triple",
    "semi_join_either": WITH + f", n AS (SELECT DISTINCT '{ITEM}nation/' || CAST(s_nationkey AS VARCHAR) AS name FROM supplier) SELECT * FROM triple WHERE subject IN (SELECT name FROM n) OR object IN (SELECT name FROM n)",
    "semi_join_ids": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_join_pool": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE starts_with(o_orderpriority, '1'))",
    "id_encode": f"""WITH t AS ({triples_sql(PLACES)}),
      e AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT subject AS name FROM t UNION SELECT object FROM t)),
      p AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT predicate AS name FROM t))
      SELECT a.id AS h, p.id + (SELECT count(*) FROM e) AS r, b.id AS t FROM t JOIN e a ON t.subject = a.name JOIN e b ON t.object = b.name JOIN p ON t.predicate = p.name""",
    "first_wins_ids": "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name",
    "sum_of_cubes": "SELECT n_nationkey, CAST(list_sum([x * x * x FOR x IN generate_series(CAST(2 AS BIGINT), CAST(n_nationkey + 4 AS BIGINT))]) AS BIGINT) AS total FROM nation",
    "point_distance": "SELECT n_nationkey, round(sqrt(CAST(n_nationkey AS DOUBLE) * n_nationkey + CAST(n_regionkey - 1 AS DOUBLE) * (n_regionkey - 1)), 6) AS dist FROM nation",
    "owl_fragments": "SELECT 'Class' AS kind, count(*) AS cnt FROM nation UNION ALL SELECT unnest(['ObjectProperty', 'DatatypeProperty']), (SELECT count(DISTINCT n_regionkey) FROM nation)",
    "owl_records": "SELECT 'Class' AS kind, count(*) AS cnt FROM nation UNION ALL SELECT unnest(['ObjectProperty', 'DatatypeProperty']), (SELECT count(DISTINCT n_regionkey) FROM nation)",
    "owl_axioms": """WITH c AS (SELECT count(*) AS n, count(DISTINCT n_regionkey) AS r FROM nation)
      SELECT 'Declaration' AS axiom_type, n + 2 * r AS cnt FROM c UNION ALL SELECT 'AnnotationAssertion', n + r FROM c UNION ALL SELECT 'SubClassOf', n FROM c UNION ALL SELECT 'Domain', r FROM c""",
    "rdfxml_triples": f"""WITH c AS (SELECT count(*) AS n, count(DISTINCT n_regionkey) AS r FROM nation)
      SELECT '{C.RDF_TYPE}' AS predicate, n + 2 * r AS cnt FROM c UNION ALL SELECT '{inference.RDFS}label', n + r FROM c
      UNION ALL SELECT '{inference.SUB_CLASS}', n FROM c UNION ALL SELECT '{inference.DOMAIN}', r FROM c""",
    "rdfs_inference": f"""WITH t AS (SELECT DISTINCT * FROM ({triples_sql(PLACES)})),
      loc AS (SELECT DISTINCT subject, object FROM t WHERE predicate IN ('{PROPERTY}nation', '{PROPERTY}region')),
      ty AS (SELECT subject, object FROM t WHERE predicate = '{C.RDF_TYPE}' UNION SELECT object, '{CLASS}Place' FROM loc),
      up AS (SELECT subject, object FROM ty UNION SELECT subject, '{CLASS}Agent' FROM ty WHERE object IN ('{CLASS}Customer', '{CLASS}Supplier')
             UNION SELECT subject, '{CLASS}Thing' FROM ty WHERE object IN ('{CLASS}Customer', '{CLASS}Supplier'))
      SELECT regexp_extract(predicate, '[^/]*$') AS predicate, count(*) AS cnt FROM t WHERE predicate <> '{C.RDF_TYPE}' GROUP BY 1
      UNION ALL SELECT 'location', count(*) FROM loc UNION ALL SELECT regexp_extract('{C.RDF_TYPE}', '[^/]*$'), count(*) FROM up
      UNION ALL SELECT 'rdf-schema#subClassOf', 5 UNION ALL SELECT 'rdf-schema#subPropertyOf', 2 UNION ALL SELECT 'rdf-schema#range', 1""",
}
NAMES = [
    triples_build, subject_distribution, subject_distribution_sql, subject_topk, property_distribution, class_distribution_top100, triples_by_subject,
    triples_by_predicate, triples_by_predicate_object, class_triples, literal_triples, ntriples_roundtrip, word_count, tokenize_literals, lemmatize_literals,
    set_union, set_intersect, set_except, distinct_objects, semi_join_either, semi_join_ids, anti_join_pool, sample_fraction, id_encode, first_wins_ids,
    sum_of_cubes, point_distance, monte_carlo_pi, owl_fragments, owl_records, owl_axioms, rdfxml_triples, rdfs_inference,
]
QUERIES = {f.__name__: f for f in NAMES}
