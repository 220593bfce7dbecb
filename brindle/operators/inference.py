"""Forward inference of the RDFS kind, semi-naively: each round joins only what the last one found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import RDF_TYPE
from brindle.storage import stash

RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = (RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transitive closure of (a, b): paths of double length join each round until nothing new comes."""
    known = stash(edges.select("a", "b").where("a != b").distinct())
    for _ in range(max_rounds):
        two = known.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).where("a != b")
        new = stash(two.distinct().join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        known = stash(known.unionByName(new))
    return known


def infer_rdfs(triples: DataFrame) -> DataFrame:
    """Distinct triples and all that follow from subclass, subproperty, domain and range statements.

    The schema is closed first; then properties are lifted, types follow from domains and ranges, and types are lifted to
    superclasses. In this order one pass over the data is enough.
    """
    base = stash(triples.select("subject", "predicate", "object").distinct())
    rule = lambda p: base.where(F.col("predicate") == p).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    classes, properties = closure(rule(SUB_CLASS)), closure(rule(SUB_PROPERTY))
    as_triples = lambda pairs, p: pairs.select(F.col("a").alias("subject"), F.lit(p).alias("predicate"), F.col("b").alias("object"))
    lifted = base.join(properties, F.col("predicate") == F.col("a")).select("subject", F.col("b").alias("predicate"), "object")
    facts = stash(base.unionByName(lifted).distinct())
    typed = lambda rules, end: facts.join(rules, F.col("predicate") == F.col("a")).select(F.col(end).alias("subject"), F.lit(RDF_TYPE).alias("predicate"), F.col("b").alias("object"))
    types = facts.where(F.col("predicate") == RDF_TYPE).unionByName(typed(rule(DOMAIN), "subject")).unionByName(typed(rule(RANGE), "object").where("NOT startswith(subject, '\"')"))
    types = types.distinct()
    super_types = types.join(classes, F.col("object") == F.col("a")).select("subject", "predicate", F.col("b").alias("object"))
    parts = (types, super_types, as_triples(classes, SUB_CLASS), as_triples(properties, SUB_PROPERTY))
    out = facts
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()
