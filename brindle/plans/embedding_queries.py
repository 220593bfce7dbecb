"""Queries of embeddings, swarms and small models over the embeddings and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import embeddings as E
from brindle.operators import learning as L
from brindle.operators import swarm as S
from brindle.operators.triples import dense_ids, encode
from brindle.plans.tables import PLACES, table, triples
from brindle.sources.arrays import linear_data, random_swarm


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _facts(spark, d):
    """(h, r, t) of all vectors by arithmetic on their ids."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("h"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return v.crossJoin(F.broadcast(n)).select("h", F.pmod(F.col("h") * 7 + 1, F.col("n")).alias("r"), F.pmod(F.col("h") * 3 + 2, F.col("n")).alias("t"))


def transe_score(spark, d):
    return E.score_triples(_facts(spark, d), _vectors(spark, d)).withColumn("score", F.round("score", 6))


def distmult_score(spark, d):
    return E.score_triples(_facts(spark, d), _vectors(spark, d), "distmult").withColumn("score", F.round("score", 6))


def _negatives(spark, d):
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return _facts(spark, d).crossJoin(F.broadcast(n)).select("h", "r", "t", F.pmod(F.col("h") + 11, F.col("n")).alias("neg_h"), F.col("t").alias("neg_t"))


def margin_loss(spark, d):
    out = E.score_differences(_negatives(spark, d), _vectors(spark, d))
    return out.select("h", "r", "t", F.round("diff", 6).alias("diff"), F.round("loss", 6).alias("loss"))


def transe_rank_eval(spark, d):
    """Ranks of the triples of vectors whose id is divisible by 100, held against all vectors, those of all triples not counted."""
    facts = _facts(spark, d)
    v = _vectors(spark, d)
    return E.rank_triples(facts.where("h % 100 = 0"), v.select("id"), v, facts)


def transe_rank_summary(spark, d):
    out = E.rank_summary(transe_rank_eval(spark, d))
    return out.select("n", F.round("mean_rank", 6).alias("mean_rank"), F.round("hits_at_n", 6).alias("hits_at_n"))


def corrupt_training(spark, d):
    n = table(spark, d, "embeddings").count()
    return E.corrupt(_facts(spark, d), n, seed=5, filter_known=True)


def corrupt_heads(spark, d):
    return E.corrupt_heads(_facts(spark, d), seed=5)


def _train(spark, d, model):
    t = triples(spark, d, PLACES)
    entities = dense_ids(t.select(F.explode(F.array("subject", "object")).alias("name")), "name")
    relations = dense_ids(t.select(F.col("predicate").alias("name")), "name")
    n, m = entities.count(), relations.count()
    vectors, losses = E.train(encode(t, entities, relations, 0), n, m, model, dim=16, epochs=3)
    return spark.createDataFrame([(i, x) for i, x in enumerate(losses)], "epoch int, loss double").crossJoin(vectors.agg(F.count(F.lit(1)).alias("n_vectors")))


def transe_train(spark, d):
    return _train(spark, d, "transe")


def distmult_train(spark, d):
    return _train(spark, d, "distmult")


def pso_sphere_fitness(spark, d):
    return _vectors(spark, d).select("id", F.round(C.sphere(F.col("vec")), 6).alias("fitness"))


def pso_rosenbrock_fitness(spark, d):
    return _vectors(spark, d).select("id", F.round(C.rosenbrock(F.col("vec")), 6).alias("fitness"))


def pso_inverse_fitness(spark, d):
    return _vectors(spark, d).select("id", F.round(C.inverse_distance(F.col("vec")), 6).alias("fitness"))


def pso_global_best(spark, d):
    swarm = S.with_fitness(_vectors(spark, d).select(F.col("id").alias("p_id"), F.col("vec").alias("position")))
    return S.global_best(swarm).select("p_id", F.round("best_fitness", 6).alias("best_fitness"))


def pso_run(spark, d):
    """A swarm that starts from all vectors."""
    start = _vectors(spark, d).select(F.col("id").cast("int").alias("p_id"), F.col("vec").alias("position"), F.transform("vec", lambda x: x * 0).alias("velocity"), F.col("vec").alias("best"))
    return S.run_pso(start, outer=3, inner=10)[1].select("p_id", "best_fitness")


def pso_random(spark, d):
    """A seeded random swarm with a particle for each vector."""
    return S.run_pso(random_swarm(spark, table(spark, d, "embeddings").count(), 4, 2), "rosenbrock", 3, 10)[1].select("p_id", "best_fitness")


def linreg_fit(spark, d):
    out = L.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


def linreg_sgd(spark, d):
    """Gradient descent on generated data, as many points as there are orders."""
    a, b, losses = L.linear_sgd(linear_data(spark, table(spark, d, "orders").count()), "x", "y", 0.5, 30)
    return spark.createDataFrame([(a, b, losses[-1])], "slope double, intercept double, loss double")


def feature_normalize(spark, d):
    out = L.normalise(_vectors(spark, d), "vec")
    return out.select("id", F.posexplode("z").alias("pos", "z")).select("id", "pos", F.round("z", 6).alias("z"))


def mlp_train_accuracy(spark, d):
    e = table(spark, d, "embeddings")
    _, out = L.train_perceptron(e, "embedding", "label", [64, 32, 10], max_iter=30)
    return L.accuracy(out)


def cnn_train(spark, d):
    """A convolution network on vectors as 8 x 8 images: mean loss by epoch."""
    e = table(spark, d, "embeddings")
    _, losses = L.train_cnn(e, "embedding", "label", 8, 10, epochs=3, rate=0.1, maps=(4, 8), kernel=3, hidden=32)
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


_F = """WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS vec FROM embeddings),
  f AS (SELECT vec_id AS h, (vec_id * 7 + 1) % n AS r, (vec_id * 3 + 2) % n AS t FROM embeddings, n)"""
_L1 = "list_sum([abs(a.vec[i] + b.vec[i] - c.vec[i]) FOR i IN generate_series(1, len(a.vec))])"
_VEC = "JOIN v a ON a.id = {h} JOIN v b ON b.id = {r} JOIN v c ON c.id = {t}"

ORACLE_SQL = {
    "transe_score": _F + f" SELECT h, r, t, round({_L1}, 6) AS score FROM f {_VEC.format(h='h', r='r', t='t')}",
    "distmult_score": _F + f" SELECT h, r, t, round(list_sum([a.vec[i] * b.vec[i] * c.vec[i] FOR i IN generate_series(1, len(a.vec))]), 6) AS score FROM f {_VEC.format(h='h', r='r', t='t')}",
    "margin_loss": _F + f""", p AS (SELECT h, r, t, {_L1} AS s FROM f {_VEC.format(h='h', r='r', t='t')}),
      g AS (SELECT h, r, t, {_L1} AS s FROM f CROSS JOIN n {_VEC.format(h='(h + 11) % n', r='r', t='t')})
      SELECT p.h, p.r, p.t, round(p.s - g.s, 6) AS diff, round(greatest(0, 1 - (g.s - p.s)), 6) AS loss FROM p JOIN g ON p.h = g.h AND p.r = g.r AND p.t = g.t""",
    "transe_rank_eval": _F + f""", q AS (SELECT h, r, t, {_L1} AS own FROM f {_VEC.format(h='h', r='r', t='t')} WHERE h % 100 = 0),
      x AS (SELECT q.*, 'head' AS side, v.id AS nh, t AS nt FROM q CROSS JOIN v UNION ALL SELECT q.*, 'tail', h, v.id FROM q CROSS JOIN v),
      y AS (SELECT x.*, {_L1} AS s FROM x {_VEC.format(h='nh', r='r', t='nt')}),
      k AS (SELECT h, r, t, side, count(*) AS rank FROM y WHERE round(s, 9) < round(own, 9) AND NOT EXISTS (SELECT 1 FROM f WHERE f.h = y.nh AND f.r = y.r AND f.t = y.nt) GROUP BY h, r, t, side)
      SELECT q.h, q.r, q.t, s.side, coalesce(k.rank, 0) AS rank FROM q CROSS JOIN (VALUES ('head'), ('tail')) s(side) LEFT JOIN k ON k.h = q.h AND k.r = q.r AND k.t = q.t AND k.side = s.side""",
    "pso_sphere_fitness": _F + " SELECT id, round(list_sum([x * x FOR x IN vec]), 6) AS fitness FROM v",
    "pso_rosenbrock_fitness": _F + " SELECT id, round(list_sum([100 * pow(vec[i + 1] - pow(vec[i], 2), 2) + pow(vec[i] - 1, 2) FOR i IN generate_series(1, len(vec) - 1)]), 6) AS fitness FROM v",
    "pso_inverse_fitness": _F + " SELECT id, round(1 + 1 / (vec[1] * vec[1] + vec[2] * vec[2]), 6) AS fitness FROM v",
    "pso_global_best": _F + " SELECT id AS p_id, round(list_sum([x * x FOR x IN vec]), 6) AS best_fitness FROM v ORDER BY list_sum([x * x FOR x IN vec]), id LIMIT 1",
    "linreg_fit": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem",
    "feature_normalize": """WITH x AS (SELECT vec_id AS id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
      s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM x) SELECT id, pos, round((v - m) / sd, 6) AS z FROM x, s""",
}
ORACLE_SQL["transe_rank_summary"] = "SELECT count(*) AS n, round(avg(rank), 6) AS mean_rank, round(avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_n FROM (" + ORACLE_SQL["transe_rank_eval"] + ")"
NAMES = [
    transe_score, distmult_score, margin_loss, transe_rank_eval, transe_rank_summary, corrupt_training, corrupt_heads, transe_train, distmult_train,
    pso_sphere_fitness, pso_rosenbrock_fitness, pso_inverse_fitness, pso_global_best, pso_run, pso_random, linreg_fit, linreg_sgd, feature_normalize,
    mlp_train_accuracy, cnn_train,
]
QUERIES = {f.__name__: f for f in NAMES}
