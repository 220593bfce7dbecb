"""Operators on small tables, held against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.columns import RDF_TYPE
from brindle.operators import embeddings as E
from brindle.operators import graph as G
from brindle.operators import inference, learning, matching, swarm
from brindle.operators import triples as T

S = "subject string, predicate string, object string"


def test_word_count(spark):
    rows = T.word_count(spark.createDataFrame([("Hello Hello World",), (None,), ("",)], "t string"), "t").collect()
    assert {(r.word, r.cnt) for r in rows} == {("hello", 2), ("world", 1)}


def test_filters(spark):
    t = spark.createDataFrame([("s", "http://p/author", "http://o/Andre"), ("s", RDF_TYPE, "http://o/C"), ("s", RDF_TYPE, "no iri"), ("x", "http://p/n", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>')], S)
    assert T.by_subject(t, "s").count() == 3 and T.by_predicate(t, "author").count() == 1
    assert T.by_predicate_object(t, "author", "Andre").count() == 1
    assert T.class_triples(t).count() == 1 and T.literal_triples(t).count() == 1 and T.literal_triples(t, True).count() == 2
    assert T.class_distribution(t).collect()[0].cnt == 1


def test_dense_ids_are_dense(spark):
    values = [f"v{random.Random(i).randint(0, 300)}" for i in range(500)] + [None]
    got = T.dense_ids(spark.createDataFrame([(v,) for v in values], "v string").repartition(7), "v").collect()
    want = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
    assert {r.v: r.id for r in got} == want


def test_semi_join_either(spark):
    t = spark.createDataFrame([(1, "a", "p", "b"), (2, "c", "p", "d"), (3, "x", "p", "a")], "id long, " + S)
    assert sorted(r.id for r in T.semi_join_either(t, spark.createDataFrame([("a",), ("d",)], "name string")).collect()) == [1, 2, 3]


def test_first_wins(spark):
    t = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("b", 7, 3)], "name string, id long, line long")
    assert {tuple(r) for r in T.first_wins_dictionary(t, "name", "line", "id").collect()} == {("a", 5), ("b", 7)}


def _random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), "p") for _ in range(m)]


@pytest.mark.parametrize("m", [0, 20, 60])
def test_graph(spark, m):
    n, rows = 40, _random_edges(40, m, m)
    edges = spark.createDataFrame(rows, "src long, dst long, attr string")
    vertices = spark.range(n).withColumn("value", F.col("id").cast("string"))
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, _ in rows:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert {r.id: r.component for r in G.components(vertices, edges).collect()} == {i: find(i) for i in range(n)}
    near = {frozenset((a, b)) for a, b, _ in rows if a != b}
    want = {(a, b, c) for a in range(n) for b in range(a) for c in range(b) if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= near}
    assert {tuple(sorted((r.a, r.b, r.c), reverse=True)) for r in G.triangles(edges).collect()} == want
    counts = G.graph_counts(vertices, edges).first()
    assert counts.n_vertices == n and counts.n_edges == m and counts.max_in_degree == max(Counter(b for _, b, _ in rows).values(), default=0)


def test_chain_component(spark):
    rows = [(i, i + 1, "p") for i in range(200)]
    random.Random(1).shuffle(rows)
    got = G.components(spark.range(201), spark.createDataFrame(rows, "src long, dst long, attr string")).collect()
    assert {r.component for r in got} == {0} and len(got) == 201


def test_components_by_rounds(spark):
    from brindle.operators.components import connected_components

    rows = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 100), (7, 7), (None, 1)] + [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want = {i: 0 for i in range(61)} | {i: 100 for i in (100, 200, 300)} | {1000 + i: 1000 for i in range(50)}
    for small in (0, 500_000):
        assert {r.node: r.component for r in connected_components(edges, small=small).collect()} == want
    assert connected_components(edges.where("false"), small=0).count() == 0


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, 1, "p"), (1, 2, "p"), (2, 0, "p"), (2, 1, "p")], "src long, dst long, attr string")
    got = {r.id: r.rank for r in G.pagerank(spark.range(3), edges, 1e-9).collect()}
    a = np.array([[0, 0, 0.5], [1, 0, 0.5], [0, 1, 0]])
    r = np.ones(3)
    for _ in range(500):
        r = 0.15 + 0.85 * a @ r
    assert np.allclose([got[i] for i in range(3)], r, atol=1e-6) and abs(sum(got.values()) - 3) < 1e-6


def test_inference(spark):
    t = [("A", inference.SUB_CLASS, "B"), ("B", inference.SUB_CLASS, "C"), ("x", RDF_TYPE, "A"), ("p", inference.SUB_PROPERTY, "q"), ("q", inference.DOMAIN, "D"), ("q", inference.RANGE, "B"), ("u", "p", "v")]
    got = {tuple(r) for r in inference.infer_rdfs(spark.createDataFrame(t, S)).collect()}
    assert got == {*t, ("A", inference.SUB_CLASS, "C"), ("x", RDF_TYPE, "B"), ("x", RDF_TYPE, "C"), ("u", "q", "v"), ("u", RDF_TYPE, "D"), ("v", RDF_TYPE, "B"), ("v", RDF_TYPE, "C")}


def test_blocks(spark):
    rng = random.Random(2)
    rows = [(k, i, f"t{min(rng.randrange(12), rng.randrange(12))}") for k in (1, 2) for i in range(30) for _ in range(3)]
    tokens = spark.createDataFrame(rows, "kg int, id long, token string")
    blocks = matching.token_blocks(tokens, 30, 0.5)
    want = {}
    for t in {r[2] for r in rows}:
        a, b = ({i for k, i, x in rows if x == t and k == kg} for kg in (1, 2))
        if a and b and min(len(a), len(b)) < 15:
            want[t] = (sorted(a), sorted(b))
    assert {r.token: (r.ids1, r.ids2) for r in blocks.collect()} == want
    pairs = {tuple(r) for r in matching.pairs_of_blocks(blocks).collect()}
    split = matching.split_blocks(blocks)
    assert {tuple(r) for r in matching.pairs_of_blocks(split).collect()} == pairs == {tuple(r) for r in matching.candidate_pairs(tokens, 30, 0.5).collect()}
    assert split.count() >= blocks.count()


def test_evaluate(spark):
    e = "entity1 string, entity2 string"
    out = matching.evaluate(spark.createDataFrame([("a", "b"), ("c", "d")], e), spark.createDataFrame([("a", "b"), ("x", "y"), ("u", "v")], e)).first()
    assert (out.n_true, out.n_pred, out.tp, out.fp, out.fn) == (3, 2, 1, 1, 2) and out.precision == 0.5
    empty = matching.evaluate(spark.createDataFrame([], e), spark.createDataFrame([], e)).first()
    assert empty.precision is None and empty.f_measure is None


def test_embeddings(spark):
    rows = [(i, (i * 3) % 10 + 0, (i * 7 + 1) % 10) for i in range(10)]
    triples = spark.createDataFrame([(h, 10 + r % 2, t) for h, r, t in rows], "h long, r long, t long")
    neg = E.corrupt(triples, 10, 1).collect()
    assert neg == E.corrupt(triples.repartition(3), 10, 1).orderBy("h", "r", "t").collect() or len(neg) == 10
    assert all((r.neg_h != r.h) + (r.neg_t != r.t) <= 1 for r in neg)
    vectors, losses = E.train(triples, 10, 2, dim=8, epochs=12, rate=0.05)
    assert vectors.count() == 12 and min(losses[6:]) < losses[0]
    ranks = E.rank_triples(triples, vectors.where("id < 10").select("id"), vectors).collect()
    v = {r.id: np.array(r.vec) for r in vectors.collect()}
    score = lambda h, r, t: round(float(np.abs(v[h] + v[r] - v[t]).sum()), 9)
    for x in ranks:
        other = [score(e, x.r, x.t) if x.side == "head" else score(x.h, x.r, e) for e in range(10)]
        assert x["rank"] == sum(o < score(x.h, x.r, x.t) for o in other)
    assert E.rank_summary(spark.createDataFrame([(0,), (20,)], "rank long")).first().hits_at_n == 0.5


def test_swarm(spark):
    from brindle.sources.arrays import random_swarm

    s = random_swarm(spark, 40, 2, 1)
    first = swarm.run_pso(s, "sphere", 3, 10)[1].first()
    again = swarm.run_pso(s.repartition(5), "sphere", 3, 10)[1].first()
    start = swarm.global_best(swarm.with_fitness(s)).first().best_fitness
    assert first == again and first.best_fitness < start
    assert swarm.serial_pso(10, 2, 30)[1] < 0.5


def test_learning(spark):
    from brindle.sources.arrays import linear_data

    d = linear_data(spark, 500)
    fit = learning.linear_fit(d, "x", "y").first()
    assert abs(fit.slope - 2) < 0.1 and abs(fit.intercept - 7) < 0.1
    a, b, losses = learning.linear_sgd(d, "x", "y", 0.5, 60)
    assert losses[-1] < losses[0] and abs(a - 2) < 0.6
    assert learning.accuracy(spark.createDataFrame([(1, 1), (0, 1)], "prediction int, label int")).first().accuracy == 0.5
    assert learning.nll_loss(spark.createDataFrame([([0.5, 0.5], 1)], "p array<double>, label int"), "p", "label").first().loss == pytest.approx(np.log(2))
    z = learning.normalise(spark.createDataFrame([([1.0, 3.0],), ([5.0, 7.0],)], "v array<double>"), "v").collect()
    assert np.allclose([r.z for r in z], (np.array([[1, 3], [5, 7]]) - 4) / np.sqrt(5))


def test_cnn_gradient():
    rng = np.random.default_rng(0)
    p = learning.init_cnn(12, 3, (2, 3), 3, 5)
    x, y = rng.random((4, 12, 12)), np.array([0, 1, 2, 1])
    g, _ = learning.cnn_gradient(p, x, y)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-6
        up = learning.cnn_gradient(q, x, y)[1]
        q[k][at] -= 2e-6
        assert (up - learning.cnn_gradient(q, x, y)[1]) / 2e-6 == pytest.approx(g[k][at], rel=1e-3, abs=1e-6)


def test_true_alignment(spark):
    rows = [("c1", "x/alignmententity1", "A"), ("c1", "x/alignmententity2", "B"), ("c1", "x/alignmentrelation", '"="'), ("c2", "x/alignmententity1", "C"), ("c2", "x/alignmententity2", "D"), ("c2", "x/alignmentrelation", '"<"')]
    assert [tuple(r) for r in matching.true_alignment(spark.createDataFrame(rows, S)).collect()] == [("A", "B")]


@pytest.mark.parametrize("chunk, deal", [(1024, 16), (2, 3)])
def test_block_pairs_are_the_filtered_candidates(spark, chunk, deal):
    """Pairs made block by block, alike members as one, are those of the stored pairs; repeated names keep all their ids."""
    wiki = "http://one.example.org/data/wiki/"
    rows = [(i, f"{wiki}{'AB'[i % 2]}/name{i % 3}", "p/x" if i % 5 else "p/y", "AB"[i % 2], 1) for i in range(23)] + [(-1 - i, f"{wiki}{'AB'[i % 2]}/name{i % 4}", "p/x", "AB"[i % 2], 2) for i in range(11)]
    e = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, kg int")
    attributes = matching.entity_attributes(e, e.select("id"))
    pairs = e.where("kg = 1").select("object", F.col("id").alias("id1")).join(e.where("kg = 2").select("object", F.col("id").alias("id2")), "object").select("id1", "id2")
    for predicates in (True, False):
        want = matching.similarities(matching.filter_candidates(pairs, attributes, predicates)).select("id1", "id2", "subject1", "subject2", "sim").collect()
        blocks = matching.block_pairs(e.select(F.col("object").alias("block"), "id", "kg"), attributes, predicates, chunk=chunk, deal=deal)
        found = matching.each_id(matching.similarities(blocks).select("ids1", "ids2", "subject1", "subject2", "sim")).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(want) > 50
        assert len(blocks.collect()) < len(found)


@pytest.mark.parametrize("grams, deal, held", [(2048, 16, 65_536), (3, 2, 2)])
def test_scored_pairs_are_the_similarities_of_block_pairs(spark, monkeypatch, grams, deal, held):
    """Every pair once with its similarity: names of their own, repeated, without characters and beyond ASCII, ids alike but for their
    names, blocks of one graph; and no set of bigrams is intersected pair by pair."""
    monkeypatch.setattr(matching, "GRAMS", grams)
    monkeypatch.setattr(matching, "FIRST", grams)
    monkeypatch.setattr(matching, "OUT", 8)
    names = ["", "a", "aaaaa", "aa", "Customer#000000017", "Customer#000001717", "Süd😀😀x", "😀😀", "banana", "x" * 40]
    wiki = "http://one.example.org/data/wiki/"
    rows = [(i, f"{wiki}{'ABC'[i % 3]}/{names[i % 10]}{i % 7 or ''}", "p/x" if i % 5 else "p/y", "ABC"[i % 3], 1) for i in range(60)] + [(-1 - i, f"{wiki}{'AB'[i % 2]}/{names[-i % 10]}", "p/x", "AB"[i % 2], 2) for i in range(30)]
    rows += [(100, f"{wiki[:-1]}", "p/x", "A", 1), (101, f"{wiki}", "p/x", "A", 1), (-101, f"{wiki}", "p/x", "A", 2)]
    e = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, kg int")
    attributes, members = matching.entity_attributes(e, e.select("id")), e.select(F.col("object").alias("block"), "id", "kg")
    for options in ({}, {"predicates": False}, {"categories": False}):
        blocks = matching.similarities(matching.block_pairs(members, attributes, **options))
        rounded = matching.scored_pairs(members, attributes, **options, digits=6, chunk=4, deal=deal, held=held)
        want = matching.each_id(blocks.select("ids1", "ids2", F.round("sim", 6).alias("sim"))).collect()
        assert sorted(map(repr, map(tuple, rounded.collect()))) == sorted(map(repr, map(tuple, want))) and len(want) > 300
        assert rounded.dtypes == [("id1", "bigint"), ("id2", "bigint"), ("sim", "double")]
        above = matching.scored_pairs(members, attributes, **options, above=0.25, chunk=4, deal=deal, held=held).distinct()
        some = blocks.where("sim > 0.25").select("subject1", "subject2").distinct().collect()
        assert sorted(map(tuple, above.collect())) == sorted(map(tuple, some)) and some
    assert any(r.sim is None for r in want)
    assert "array_intersect" not in rounded._jdf.queryExecution().optimizedPlan().toString()


def test_queries_of_similar_names_do_not_intersect_pair_by_pair(spark):
    from brindle.plans import registry

    for name in ("uri_similarity", "match_entities", "evaluate_matches", "false_negatives"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "array_intersect" not in plan and "MapInArrow" in plan


def test_group_similarity_counts_where_vertices_meet(spark):
    """The same values as from the pairs, pairs without a shared neighbour and repeated edges included."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(12), rng.randrange(30)) for _ in range(90)] + [(3, 4)] * 5, "src long, dst long")
    groups = spark.createDataFrame([(v, v % 3) for v in range(14)], "v long, group long")
    pairs = groups.alias("a").join(groups.alias("b"), (F.col("a.group") == F.col("b.group")) & (F.col("a.v") < F.col("b.v"))).select(F.col("a.v").alias("v1"), F.col("b.v").alias("v2"))
    want = sorted(tuple(r) for r in G.neighbour_similarity(edges, pairs).collect())
    assert sorted(tuple(r) for r in G.group_similarity(edges, groups).collect()) == want and any(r[2] == 0 for r in want)


def test_triangles_by_colours(spark, monkeypatch):
    """However many edges a task may hold and paths it makes at a time, each triangle is found once and no path is shuffled."""
    rng = np.random.default_rng(4)
    pairs = [*map(tuple, rng.integers(-40, 40, (900, 2)).tolist()), *((10**15, i) for i in range(-40, 40)), (3, None), (None, None)]
    edges = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs[:50])], "src long, dst long").repartition(3)
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = sorted((a, b, c) for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c)
    for held, paths in ((10**6, 1 << 20), (700, 101)):
        monkeypatch.setattr(G, "HELD", held), monkeypatch.setattr(G, "PATHS", paths)
        assert sorted(map(tuple, G.triangles(edges).collect())) == want
    assert G.triangle_count(edges).first().n_triangles == len(want)
    assert G.triangle_count(edges.where("false")).first().n_triangles == 0
    plan = G.triangle_count(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
