"""Operators over triples (subject, predicate, object): filters, distributions, set operations, encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import RDF_TYPE, XSD_INTEGER, is_iri

KEYS = ("subject", "predicate", "object")


def by_subject(triples: DataFrame, subject: str) -> DataFrame:
    return triples.where(F.col("subject") == subject)


def by_predicate(triples: DataFrame, name: str) -> DataFrame:
    """Triples whose predicate's last segment is ``name``."""
    return triples.where(F.col("predicate").endswith(f"/{name}"))


def by_predicate_object(triples: DataFrame, name: str, object_name: str) -> DataFrame:
    return by_predicate(triples, name).where(F.col("object").endswith(f"/{object_name}"))


def class_triples(triples: DataFrame) -> DataFrame:
    """rdf:type triples whose object is an IRI."""
    return triples.where((F.col("predicate") == RDF_TYPE) & is_iri(F.col("object")))


def literal_triples(triples: DataFrame, keep_integers: bool = False) -> DataFrame:
    """Triples whose object does not start with ``http://``, without integer literals unless they are kept."""
    kept = triples.where(~F.col("object").startswith("http://"))
    return kept if keep_integers else kept.where(~F.contains(F.col("object"), F.lit(XSD_INTEGER)))


def distribution(df: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """How often each value of a column occurs; counts are combined before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def top(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """The first rows by a column descending, ties by another ascending: a bounded heap for each task, no sort of it all."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)


def class_distribution(triples: DataFrame, n: int = 100) -> DataFrame:
    return top(distribution(class_triples(triples).withColumnRenamed("object", "class"), "class"), n, "cnt", "class")


def word_count(df: DataFrame, column: str, pattern: str = r"[^a-z0-9]+") -> DataFrame:
    """Words of all texts in lower case, and how often they occur."""
    words = df.select(F.explode(F.split(F.lower(F.col(column)), pattern)).alias("word"))
    return distribution(words.where("word != ''"), "word")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def semi_join_either(triples: DataFrame, names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """Triples whose subject or object is among the names.

    As a disjunction this would be a nested loop; here both ends are keys of an equi-join, and the ids found are joined back.
    """
    ends = triples.select(id_col, F.explode(F.array("subject", "object")).alias(name_col))
    hits = ends.join(names.select(name_col), name_col, "left_semi").select(id_col).distinct()
    return triples.join(hits, id_col, "left_semi")


def first_wins_dictionary(names: DataFrame, name_col: str, order_col: str, id_col: str) -> DataFrame:
    """(name, id): for names that occur more than once, the id that came first."""
    return names.groupBy(name_col).agg(F.min_by(id_col, order_col).alias(id_col))


def dense_ids(df: DataFrame, column: str, id_name: str = "id") -> DataFrame:
    """Distinct values and dense ids from 0 in the order of the values.

    Ids come from a range partitioning: each task numbers its own range, and the ranges' sizes (one row for each task) are
    summed up. No task sees all values.
    """
    from brindle.storage import stash

    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    dealt = stash(values.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    a, b = sizes.alias("a"), sizes.alias("b")
    starts = a.join(F.broadcast(b), F.col("b._p") < F.col("a._p"), "left").groupBy(F.col("a._p").alias("_p"), F.col("a._first").alias("_first")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_p").select(column, (F.col("_i") - F.col("_first") + F.col("_start")).alias(id_name))


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame, shift: int = 1) -> DataFrame:
    """(h, r, t) ids of triples from (name, id) tables: entities from ``shift`` on, relations after all entities.

    Left joins, so that a name without an id shows as null; Spark broadcasts a dictionary only if it is small.
    """
    n = entities.agg(F.count(F.lit(1)).alias("n"))
    side = lambda table, key, out, extra: table.select(F.col("name").alias(key), (F.col("id") + extra).alias(out))
    out = triples.join(side(entities, "subject", "h", shift), "subject", "left").join(side(entities, "object", "t", shift), "object", "left")
    out = out.join(side(relations, "predicate", "r", shift), "predicate", "left").crossJoin(F.broadcast(n))
    return out.select("h", (F.col("r") + F.col("n")).alias("r"), "t")


def exists_in_group(condition: Column) -> Column:
    """Aggregate: whether some row of the group meets the condition."""
    return F.coalesce(F.bool_or(condition), F.lit(False))
