"""SQL functions for queries in SQL: they are expanded into the plan, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from brindle.functions.columns import TRIPLE

GRAMS = "CASE WHEN length({x}) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(1, greatest(length({x}) - 1, 1)), i -> substring({x}, i, 2)) END"


def register(spark: SparkSession) -> None:
    """uri_similarity(a, b), tokenize_literal(text) and parse_ntriple(line) as temporary functions."""
    shared = "aggregate(array_distinct(x), 0, (n, g) -> n + least(size(filter(x, e -> e = g)), size(filter(y, e -> e = g))))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION uri_similarity(a STRING, b STRING) RETURNS DOUBLE
      RETURN (SELECT try_divide(CAST({shared} AS DOUBLE), CAST(size(x) + size(y) AS DOUBLE)) FROM (SELECT {GRAMS.format(x="a")} AS x, {GRAMS.format(x="b")} AS y))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION tokenize_literal(t STRING) RETURNS ARRAY<STRING>
      RETURN array_distinct(filter(split(replace(lower(t), '-', ''), '[^a-z0-9]+'), x -> length(x) > 1))""")
    pattern = TRIPLE.replace("\\", "\\\\").replace("'", "\\'")
    part = lambda i: f"regexp_replace(regexp_extract(line, '{pattern}', {i}), '^<|>$', '')"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION parse_ntriple(line STRING) RETURNS STRUCT<subject: STRING, predicate: STRING, object: STRING>
      RETURN named_struct('subject', {part(1)}, 'predicate', {part(2)}, 'object', {part(3)})""")
