"""Knowledge-graph embeddings: corruption, scoring, ranking evaluation and training (translation and bilinear models)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import distmult_score, margin_loss, transe_score
from brindle.session import ship
from brindle.storage import stash

SCORES = {"transe": transe_score, "distmult": distmult_score}


def corrupt(triples: DataFrame, n_entities: int, seed: int = 0, first_id: int = 0, filter_known: bool = False) -> DataFrame:
    """(h, r, t, neg_h, neg_t): one negative for each triple, its head replaced with probability one half, else its tail.

    The draw is a hash of the triple and the seed, so it does not depend on partitions. With ``filter_known``, negatives
    that are triples themselves are left out.
    """
    draw = lambda salt: F.pmod(F.xxhash64("h", "r", "t", F.lit(seed), F.lit(salt)), F.lit(n_entities)) + first_id
    head = F.pmod(F.xxhash64("h", "r", "t", F.lit(seed), F.lit("side")), F.lit(2)) == 0
    out = triples.select("h", "r", "t", F.when(head, draw("e")).otherwise(F.col("h")).alias("neg_h"), F.when(head, F.col("t")).otherwise(draw("e")).alias("neg_t"))
    if filter_known:
        known = triples.select(F.col("h").alias("neg_h"), "r", F.col("t").alias("neg_t"))
        out = out.join(known, ["neg_h", "r", "neg_t"], "left_anti").select("h", "r", "t", "neg_h", "neg_t")
    return out


def corrupt_heads(triples: DataFrame, low: int = 1, high: int = 14500, seed: int = 0) -> DataFrame:
    """(h, r, t, neg_h): the head replaced by an id drawn from low .. high."""
    return triples.withColumn("neg_h", F.pmod(F.xxhash64("h", "r", "t", F.lit(seed)), F.lit(high - low + 1)) + low)


def score_triples(triples: DataFrame, vectors: DataFrame, model: str = "transe") -> DataFrame:
    """(h, r, t, score), by three joins with the vectors (id, vec)."""
    side = lambda n: vectors.select(F.col("id").alias(n), F.col("vec").alias(f"v_{n}"))
    joined = triples.join(side("h"), "h").join(side("r"), "r").join(side("t"), "t")
    return joined.select("h", "r", "t", SCORES[model](F.col("v_h"), F.col("v_r"), F.col("v_t")).alias("score"))


def score_differences(pairs: DataFrame, vectors: DataFrame, model: str = "transe") -> DataFrame:
    """(h, r, t, positive, negative, diff, loss) of triples with their negatives."""
    pos = score_triples(pairs.select("h", "r", "t").distinct(), vectors, model).withColumnRenamed("score", "positive")
    neg = pairs.select(F.col("neg_h").alias("h"), "r", F.col("neg_t").alias("t")).distinct()
    neg = score_triples(neg, vectors, model).select(F.col("h").alias("neg_h"), "r", F.col("t").alias("neg_t"), F.col("score").alias("negative"))
    out = pairs.join(pos, ["h", "r", "t"]).join(neg, ["neg_h", "r", "neg_t"])
    better, worse = (F.col("negative"), F.col("positive")) if model == "transe" else (F.col("positive"), F.col("negative"))
    return out.select("h", "r", "t", "positive", "negative", (F.col("positive") - F.col("negative")).alias("diff"), margin_loss(better, worse).alias("loss"))


def rank_triples(test: DataFrame, entities: DataFrame, vectors: DataFrame, known: DataFrame | None = None, model: str = "transe", places: int = 9) -> DataFrame:
    """(h, r, t, side, rank): how many corruptions of the head or tail score strictly better than the triple itself.

    ``test`` is a stated query set, held against all entities: it is broadcast behind a check of its size, and the entities
    stream past it with their vectors, so the work is spread over the entities' partitions and only counts are shuffled.
    ``known`` triples are not counted. Beyond the check, queries are cut to blocks and joined by a shuffle.
    """
    own = score_triples(test, vectors, model).withColumnRenamed("score", "own")
    side = lambda n: vectors.select(F.col("id").alias(n), F.col("vec").alias(f"v_{n}"))
    queries = stash(test.distinct().join(own, ["h", "r", "t"]).join(side("h"), "h").join(side("r"), "r").join(side("t"), "t"))
    both = queries.withColumn("side", F.explode(F.array(F.lit("head"), F.lit("tail"))))
    pool = entities.select(F.col("id").alias("e")).join(vectors.select(F.col("id").alias("e"), F.col("vec").alias("v_e")), "e")
    if queries.count() <= 10_000:
        pairs = pool.crossJoin(F.broadcast(both))
    else:  # queries in blocks, each entity sent to every block
        blocks = 64
        pairs = pool.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(both.withColumn("b", F.pmod(F.xxhash64("h", "r", "t", "side"), F.lit(blocks)).cast("int")), "b").drop("b")
    at_head = F.col("side") == "head"
    new_h, new_t = F.when(at_head, F.col("e")).otherwise(F.col("h")), F.when(at_head, F.col("t")).otherwise(F.col("e"))
    v_h, v_t = F.when(at_head, F.col("v_e")).otherwise(F.col("v_h")), F.when(at_head, F.col("v_t")).otherwise(F.col("v_e"))
    scored = pairs.select("h", "r", "t", "side", "own", new_h.alias("new_h"), new_t.alias("new_t"), SCORES[model](v_h, F.col("v_r"), v_t).alias("score"))
    better = scored.where(F.round("score", places) < F.round("own", places) if model == "transe" else F.round("score", places) > F.round("own", places))
    if known is not None:
        better = better.join(known.select(F.col("h").alias("new_h"), "r", F.col("t").alias("new_t")), ["new_h", "r", "new_t"], "left_anti")
    counts = better.groupBy("h", "r", "t", "side").agg(F.count(F.lit(1)).alias("rank"))
    return both.select("h", "r", "t", "side").join(counts, ["h", "r", "t", "side"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def rank_summary(ranks: DataFrame, hits: int = 10) -> DataFrame:
    """One row: n, mean_rank and hits_at_n (share of ranks below ``hits``, counted from 0)."""
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("mean_rank"), F.avg((F.col("rank") < hits).cast("double")).alias("hits_at_n"))


def initial_vectors(ids: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(id, vec): uniform in +-6 / sqrt(dim), from a hash of id, dimension and seed."""
    unit = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1 << 20)).cast("double") / (1 << 20)
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (unit(i) * 2 - 1) * (6 / dim**0.5)).alias("vec"))


def _gradients(model: str, margin: float):
    def run(frames):
        for f in frames:
            h, r, t, nh, nt = (np.stack(f[c].to_numpy()) for c in ("v_h", "v_r", "v_t", "v_nh", "v_nt"))
            if model == "transe":
                pos, neg = h + r - t, nh + r - nt
                loss = np.maximum(0.0, margin + np.abs(pos).sum(1) - np.abs(neg).sum(1))
                gp, gn = np.sign(pos), np.sign(neg)
                parts = [("h", gp), ("r", gp - gn), ("t", -gp), ("neg_h", -gn), ("neg_t", gn)]
            else:
                loss = np.maximum(0.0, margin - (h * r * t).sum(1) + (nh * r * nt).sum(1))
                parts = [("h", -r * t), ("r", -h * t + nh * nt), ("t", -h * r), ("neg_h", r * nt), ("neg_t", r * nh)]
            active = loss > 0
            ids = np.concatenate([f[c].to_numpy()[active] for c, _ in parts])
            grads = np.concatenate([g[active] for _, g in parts]) if active.any() else np.zeros((0, h.shape[1]))
            # gradients of an id within the batch are summed before they are shuffled
            unique, at = np.unique(ids, return_inverse=True)
            sums = np.zeros((len(unique), h.shape[1]))
            np.add.at(sums, at, grads)
            yield pd.DataFrame({"id": np.append(unique, -1), "g": [*sums, np.array([loss.sum(), float(len(loss))])]})

    return run


def train(triples: DataFrame, n_entities: int, n_relations: int, model: str = "transe", dim: int = 50, epochs: int = 10, rate: float = 0.01, decay: float = 0.001, weight_decay: float = 0.001, margin: float = 1.0, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((id, vec), mean loss by epoch). Entities are 0 .. n_entities - 1, relations follow.

    Full-batch gradient descent: an epoch joins the triples and fresh negatives with the vectors, takes gradients by Arrow
    batches, sums them by id and updates the vectors, which stay distributed and are stored after each epoch. The loss is
    the published one, max(0, margin + d(positive) - d(negative)). A row with id -1 carries the loss.
    """
    spark = triples.sparkSession
    ship(spark)
    triples = stash(triples.select("h", "r", "t"))
    vectors = stash(initial_vectors(spark.range(n_entities + n_relations), dim, seed))
    degree = stash(triples.select(F.explode(F.array("h", "r", "t")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    losses = []
    for epoch in range(epochs):
        pairs = corrupt(triples, n_entities, seed * 1000 + epoch)
        for key, name in (("h", "v_h"), ("r", "v_r"), ("t", "v_t"), ("neg_h", "v_nh"), ("neg_t", "v_nt")):
            pairs = pairs.join(vectors.select(F.col("id").alias(key), F.col("vec").alias(name)), key)
        grads = stash(pairs.mapInPandas(_gradients(model, margin), "id long, g array<double>"))
        total = grads.where("id = -1").agg(F.sum(F.get("g", F.lit(0))), F.sum(F.get("g", F.lit(1)))).first()
        losses.append(float(total[0] or 0.0) / max(1.0, float(total[1] or 0.0)))
        by_id = grads.where("id >= 0").select("id", F.posexplode("g").alias("i", "g")).groupBy("id", "i").agg(F.sum("g").alias("g"))
        summed = by_id.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda s: s.g).alias("g"))
        step = rate / (1 + decay * epoch)
        merged = vectors.join(summed, "id", "left").join(degree, "id", "left")
        scale = F.lit(step) / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) * 10
        moved = F.when(F.col("g").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "g", lambda v, g: v - scale * g - F.lit(step * weight_decay) * v))
        if model == "transe":  # entities stay inside the unit ball
            merged = merged.withColumn("m", moved)
            norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
            moved = F.when((F.col("id") < n_entities) & (norm > 1), F.transform("m", lambda x: x / norm)).otherwise(F.col("m"))
        vectors = stash(merged.select("id", moved.alias("vec")))
    return vectors, losses
