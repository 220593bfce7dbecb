"""Line sources: N-Triples, delimited dictionaries and triples, JSON dictionaries; and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.columns import TRIPLE, is_comment, parse_triple


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """subject, predicate, object, object_kind, object_value, lang, datatype of every triple; comments and bad lines go."""
    return parse_ntriples(spark.read.text(path), "value")


def parse_ntriples(lines: DataFrame, column: str) -> DataFrame:
    """As ``read_ntriples``, from a table of lines."""
    return lines.where(~is_comment(column) & F.col(column).rlike(TRIPLE)).select(*parse_triple(column))


def format_ntriples(triples: DataFrame) -> DataFrame:
    """(value): a line for each triple; objects with a scheme become IRIs, all others plain literals."""
    escaped = F.col("object")
    for mark, value in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(value))
    obj = F.when(F.col("object").rlike(r"^[a-z][a-z0-9+.-]*://[^\s\"<>]*$"), F.concat(F.lit("<"), "object", F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))
    return triples.select(F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), obj, F.lit(" .")).alias("value"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a tab-separated file without header."""
    return spark.read.csv(path, sep="\t", schema="name string, id bigint")


def read_delimited_triples(spark: SparkSession, path: str, order: str = "htr") -> DataFrame:
    """(h, r, t) names of a tab-separated file whose columns are in the given order, "htr" or "hrt"."""
    return spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in order)).select("h", "r", "t")


def write_tsv(df: DataFrame, path: str) -> None:
    """Replaces what is at ``path``; nothing is appended."""
    df.write.mode("overwrite").csv(path, sep="\t")


def write_json_dictionary(df: DataFrame, path: str) -> None:
    """A JSON object for each row."""
    df.write.mode("overwrite").json(path)


def dictionary_json(df: DataFrame, key: str = "name", value: str = "id") -> DataFrame:
    """One row with a JSON object of a dictionary; for dictionaries that one row can hold."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))
