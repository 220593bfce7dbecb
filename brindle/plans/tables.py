"""The driver's tables, and the triples, graphs and entities that queries derive from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.columns import RDF_TYPE

ITEM = "http://example.org/data/resource/"
PROPERTY = "http://example.org/property/"
CLASS = "http://example.org/ontology/"

#: table -> (key column, class, [(property, column, kind of resource or None for a literal)])
MODEL: dict[str, tuple[str, str, list[tuple[str, str, str | None]]]] = {
    "region": ("r_regionkey", "Region", [("name", "r_name", None)]),
    "nation": ("n_nationkey", "Nation", [("name", "n_name", None), ("region", "n_regionkey", "region")]),
    "supplier": ("s_suppkey", "Supplier", [("name", "s_name", None), ("nation", "s_nationkey", "nation")]),
    "customer": ("c_custkey", "Customer", [("name", "c_name", None), ("segment", "c_mktsegment", None), ("nation", "c_nationkey", "nation")]),
    "orders": ("o_orderkey", "Order", [("status", "o_orderstatus", None), ("priority", "o_orderpriority", None), ("customer", "o_custkey", "customer")]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _resource(kind: str, key: str):
    return F.concat(F.lit(f"{ITEM}{kind}/"), F.col(key).cast("string"))


def triples(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(MODEL)) -> DataFrame:
    """(subject, predicate, object) of the rows of some tables: each table is scanned once and its columns exploded."""
    parts = []
    for name in names:
        key, kind, columns = MODEL[name]
        pairs = [F.struct(F.lit(RDF_TYPE).alias("predicate"), F.lit(CLASS + kind).alias("object"))]
        for prop, column, target in columns:
            value = _resource(target, column) if target else F.col(column).cast("string")
            pairs.append(F.struct(F.lit(PROPERTY + prop).alias("predicate"), value.alias("object")))
        parts.append(table(spark, sf_dir, name).select(_resource(name, key).alias("subject"), F.explode(F.array(*pairs)).alias("p")).select("subject", "p.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def triples_sql(names: tuple[str, ...] = tuple(MODEL)) -> str:
    """The same triples as a SQL query."""
    parts = []
    for name in names:
        key, kind, columns = MODEL[name]
        subject = f"'{ITEM}{name}/' || CAST({key} AS VARCHAR)"
        parts.append(f"SELECT {subject} AS subject, '{RDF_TYPE}' AS predicate, '{CLASS}{kind}' AS object FROM {name}")
        for prop, column, target in columns:
            value = f"'{ITEM}{target}/' || CAST({column} AS VARCHAR)" if target else f"CAST({column} AS VARCHAR)"
            parts.append(f"SELECT {subject}, '{PROPERTY}{prop}', {value} FROM {name}")
    return " UNION ALL ".join(parts)


PLACES = ("region", "nation", "supplier", "customer")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples between resources, of all tables but orders."""
    return triples(spark, sf_dir, PLACES).where(F.col("object").startswith(ITEM))


LINKS_SQL = f"SELECT * FROM ({triples_sql(PLACES)}) WHERE starts_with(object, '{ITEM}')"
