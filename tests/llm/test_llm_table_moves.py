"""Whole rows are moved as seldom as can be."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing, simhash


@pytest.mark.parametrize("per_octave", [1, 128])
def test_rows_that_stay_in_place_are_taken_as_often(spark, per_octave):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "z", None]), " ".join(["w"] * rng.randint(0, 40)) or None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    plain = mixing.mix_sources(docs, per_octave=per_octave)
    kept = mixing.mix_sources(docs, per_octave=per_octave, keep_row=True)
    assert sorted((r.doc_id, r.copies, r.taken) for r in kept.collect()) == sorted((r.doc_id, r.copies, r.taken) for r in plain.collect())
    if per_octave == 128:
        few = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in few and "SortMergeJoin" not in few


def test_repeated_rows_become_one_and_others_move_once(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", None]
    rows = [(i, t, "x") for i, t in enumerate(texts)] * 3 + [(None, "alone among all the others here", "x")] * 2 + [(7, "a text that comes once and not again", "y")]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, more string"))
    assert sorted(((r.doc_id, r.more) for r in got.collect()), key=str) == sorted([(0, "x"), (1, "x"), (2, "x"), (None, "x"), (7, "y")], key=str)
    plan = got._jdf.queryExecution().optimizedPlan()
    assert "Union" in plan.toString() and got.agg(F.count("*")).first()[0] == 5
