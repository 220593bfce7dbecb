"""Particle swarm optimisation: distributed rounds with a shared best position, and the serial form.

Within an outer round each partition's particles move for some inner rounds by themselves; then the best of all is found by
one aggregation and shared. Positions are copied, draws are seeded by particle and round, and exactly N rounds run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import sphere
from brindle.session import ship
from brindle.storage import stash

#: Objectives over the rows of a matrix.
OBJECTIVES = {
    "sphere": lambda x: (x * x).sum(1),
    "rosenbrock": lambda x: (100 * (x[:, 1:] - x[:, :-1] ** 2) ** 2 + (x[:, :-1] - 1) ** 2).sum(1),
}
SCHEMA = "p_id int, position array<double>, velocity array<double>, best array<double>, fitness double, best_fitness double"


def with_fitness(swarm: DataFrame, objective: Column | None = None) -> DataFrame:
    """Adds fitness and best_fitness; the best position so far is the position."""
    value = sphere(F.col("position")) if objective is None else objective
    return swarm.withColumn("best", F.col("position")).withColumn("fitness", value).withColumn("best_fitness", F.col("fitness"))


def global_best(swarm: DataFrame) -> DataFrame:
    """One row (p_id, best, best_fitness): the smallest fitness, of equals the smallest p_id."""
    first = F.min(F.struct("best_fitness", "p_id", "best")).alias("g")
    return swarm.agg(first).select("g.p_id", "g.best", "g.best_fitness")


def move(position, velocity, best, best_fitness, leader, objective, rounds, rng, w, c1, c2):
    """Some rounds of a set of particles after a leader; all arrays are copies."""
    fitness = objective(position)
    for _ in range(rounds):
        r1, r2 = rng.random((len(position), 1)), rng.random((len(position), 1))
        velocity = w * velocity + c1 * r1 * (best - position) + c2 * r2 * (leader - position)
        position = position + velocity
        fitness = objective(position)
        better = fitness < best_fitness
        best = np.where(better[:, None], position, best)
        best_fitness = np.where(better, fitness, best_fitness)
        lead = int(np.argmin(best_fitness))
        if best_fitness[lead] < objective(leader[None, :])[0]:
            leader = best[lead].copy()
    return position, velocity, best, fitness, best_fitness


def run_pso(swarm: DataFrame, objective: str = "sphere", outer: int = 5, inner: int = 20, groups: int = 8, w: float = 0.5, c1: float = 1.0, c2: float = 2.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(swarm after the rounds, its global best). Particles stay in ``groups`` groups by id."""
    ship(swarm.sparkSession)
    f = OBJECTIVES[objective]
    start = swarm.withColumn("fitness", F.lit(0.0)).withColumn("best_fitness", F.lit(0.0)).select(*[c.split()[0] for c in SCHEMA.split(", ")])

    def first(frames):
        for x in frames:
            if len(x):
                fit = f(np.stack(x["position"].to_numpy()))
                yield x.assign(best=x["position"], fitness=fit, best_fitness=fit)

    now = stash(start.mapInPandas(first, SCHEMA))

    def advance_from(turn: int, leader: np.ndarray):
        def advance(x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values("p_id")
            m = [np.stack(x[c].to_numpy()) for c in ("position", "velocity", "best")]
            rng = np.random.default_rng([seed, turn, int(x["p_id"].iloc[0])])
            position, velocity, best, fitness, best_fitness = move(*m, x["best_fitness"].to_numpy(), leader, f, inner, rng, w, c1, c2)
            return pd.DataFrame({"p_id": x["p_id"], "position": list(position), "velocity": list(velocity), "best": list(best), "fitness": fitness, "best_fitness": best_fitness})

        return advance

    for turn in range(outer):
        leader = np.array(global_best(now).first()["best"])
        now = stash(now.groupBy(F.pmod("p_id", F.lit(groups)).alias("g")).applyInPandas(advance_from(turn, leader), SCHEMA))
    return now, global_best(now)


def serial_pso(particles: int, dim: int, rounds: int, objective: str = "sphere", seed: int = 0) -> tuple[np.ndarray, float]:
    """The same algorithm in one process, the best moving within a round: (position, fitness)."""
    rng = np.random.default_rng(seed)
    f = OBJECTIVES[objective]
    x, v = rng.random((particles, dim)), rng.random((particles, dim))
    best, values, leader = x.copy(), f(x), rng.random(dim)
    for _ in range(rounds):
        for i in range(particles):
            v[i] = 0.5 * v[i] + rng.random() * (best[i] - x[i]) + 2 * rng.random() * (leader - x[i])
            x[i] = x[i] + v[i]
            if (now := f(x[i : i + 1])[0]) < values[i]:
                values[i], best[i] = now, x[i]
                if now < f(leader[None, :])[0]:
                    leader = x[i].copy()
    return leader, float(f(leader[None, :])[0])
