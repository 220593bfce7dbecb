"""Column expressions against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.functions.lemmatize import lemma, lemmatize


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, want", [("spider", "spider", 0.5), ("a", "a", 0.5), ("ab", "cd", 0.0), ("", "", None), ("aaa", "aaa", 0.5)])
def test_uri_similarity(spark, a, b, want):
    assert one(spark, C.uri_similarity(F.col("a"), F.col("b")), a=a, b=b) == want
    grams = [C.numbered(C.bigrams(F.col(c))) for c in "ab"]
    assert one(spark, C.set_similarity(*grams), a=a, b=b) == want


def test_bigrams(spark):
    assert one(spark, C.bigrams(F.col("a")), a="spider") == ["sp", "pi", "id", "de", "er"]
    assert one(spark, C.bigrams(F.col("a")), a="") == []


@pytest.mark.parametrize("n1, n2, limit, want", [(10, 10, 5.0, 20), (4, 6, 10.0, 3), (1, 1, 100.0, 2)])
def test_divisor(spark, n1, n2, limit, want):
    assert one(spark, C.smallest_divisor(F.lit(n1), F.lit(n2), F.lit(limit))) == want


def test_divisor_like_a_search(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.randint(1, 400), rng.randint(1, 400), rng.random() * 300 + 0.1) for _ in range(800)]
    got = spark.createDataFrame(rows, "a long, b long, m double").select("a", "b", "m", C.smallest_divisor(F.col("a"), F.col("b"), F.col("m")).alias("v")).collect()
    for r in got:
        v = 2
        while r.a * r.b / v > r.m:
            v += 1
        assert v == r.v


def test_chunks(spark):
    assert one(spark, C.chunks(F.array(*map(F.lit, range(7))), F.lit(3))) == [[0, 1, 2], [3, 4, 5], [6]]


def test_sum_of_cubes(spark):
    assert one(spark, C.sum_over(2, 4, lambda i: i * i * i)) == 99


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, C.transe_score(v(1, 2), v(0, 1), v(3, 1))) == 4
    assert one(spark, C.distmult_score(v(1, 2), v(3, 4), v(5, 6))) == 63
    assert one(spark, C.sphere(v(1, 2))) == 5
    assert one(spark, C.rosenbrock(v(1, 2))) == 100
    assert one(spark, C.inverse_distance(v(1, 2), 5)) == 5.2
    assert one(spark, C.margin_loss(F.lit(3.0), F.lit(1.0))) == 0
    assert one(spark, C.margin_loss(F.lit(1.0), F.lit(1.5))) == 1.5
    assert one(spark, C.distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))) == 5


def test_names(spark):
    assert one(spark, C.strip_id_prefix(F.lit("/m/01qscs"))) == "01qscs"
    assert one(spark, C.local_name(F.lit("/film/actor/film./film/performance/film"))) == "film"
    row = spark.createDataFrame([("http://h/a/wiki/Sub:Name/more",), ("http://h/x",)], "s string").select(*C.entity_parts("s")).collect()
    assert tuple(row[0]) == ("Sub:Namemore", "wiki", "Sub")
    assert tuple(row[1]) == (None, None, None)


def test_tokens(spark):
    got = one(spark, C.tokens(F.lit("The e-mail of 2004, a Mail_box!"), ["the", "of"]))
    assert got == ["email", "2004", "mail", "box"]
    assert one(spark, C.tokens(F.lit("x 2004 yy"), [], False)) == ["yy"]


def test_lemmas(spark):
    assert [lemma(w) for w in ("cities", "boxes", "cats", "running", "was", "glass", "making")] == ["city", "box", "cat", "run", "be", "glass", "mak"]
    got = spark.createDataFrame([(["cats", "cat"],), (None,)], "t array<string>").select(lemmatize(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["cat"], None]


def test_iri(spark):
    assert one(spark, C.is_iri(F.lit("http://a/b"))) and not one(spark, C.is_iri(F.lit("a b")))
    assert one(spark, C.is_lang_tag(F.lit("@en")))
    assert math.isclose(one(spark, C.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))), 1 / 3)
