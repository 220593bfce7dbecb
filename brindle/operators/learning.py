"""Small supervised models: linear regression, perceptron and convolution kernels, normalisation, losses and accuracy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import ship
from brindle.storage import stash


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, n) of the least-squares line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


def linear_sgd(df: DataFrame, x: str, y: str, rate: float = 0.2, epochs: int = 15) -> tuple[float, float, list[float]]:
    """(slope, intercept, mean squared error by epoch) by gradient descent; an epoch is one aggregation."""
    a = b = 0.0
    losses = []
    for _ in range(epochs):
        e = F.lit(a) * F.col(x) + F.lit(b) - F.col(y)
        ga, gb, loss = df.agg(F.avg(2 * e * F.col(x)), F.avg(2 * e), F.avg(e * e)).first()
        losses.append(loss)
        a, b = a - rate * ga, b - rate * gb
    return a, b, losses


def predict_linear(df: DataFrame, x: str, slope: float, intercept: float) -> DataFrame:
    return df.withColumn("prediction", F.lit(slope) * F.col(x) + F.lit(intercept))


def normalise(df: DataFrame, column: str) -> DataFrame:
    """Adds ``z``: the vector less the mean, over the population standard deviation, of all its elements in the table."""
    stats = df.select(F.explode(column).alias("x")).agg(F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_std"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", F.transform(column, lambda v: F.try_divide(v.cast("double") - F.col("_mean"), F.col("_std")))).drop("_mean", "_std")


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def nll_loss(df: DataFrame, probabilities: str, label: str) -> DataFrame:
    """Mean of -log of the probability of the label (an index from 0)."""
    return df.agg(F.avg(-F.log(F.get(F.col(probabilities), F.col(label).cast("int")))).alias("loss"))


def epoch_means(losses: DataFrame, steps_per_epoch: int) -> DataFrame:
    """(epoch, loss): means of the losses of each epoch's steps, from (step, loss)."""
    return losses.groupBy(F.floor(F.col("step") / steps_per_epoch).alias("epoch")).agg(F.avg("loss").alias("loss"))


def perceptron(layers: list[int], max_iter: int = 50, seed: int = 1) -> Pipeline:
    """A pipeline that takes (features vector, label)."""
    return Pipeline(stages=[MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, featuresCol="features", labelCol="label")])


def train_perceptron(df: DataFrame, features: str, label: str, layers: list[int], max_iter: int = 50, seed: int = 1):
    """(model, table with its predictions) on an array column."""
    table = df.select("*", array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("_f"), F.col(label).cast("double").alias("_l"))
    table = table.drop(*[c for c in ("features", "label") if c in df.columns]).withColumnsRenamed({"_f": "features", "_l": "label"})
    model = perceptron(layers, max_iter, seed).fit(table)
    return model, model.transform(table)


# --- a convolution network: conv, tanh, pool, conv, tanh, pool, linear, tanh, linear, log-softmax --------------------------


def init_cnn(side: int = 28, classes: int = 10, maps: tuple[int, int] = (6, 12), kernel: int = 5, hidden: int = 100, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    one = (side - kernel + 1) // 2
    two = (one - kernel + 1) // 2
    u = lambda *s, n: rng.uniform(-1, 1, s) / np.sqrt(n)
    flat = maps[1] * two * two
    return {
        "k1": u(maps[0], 1, kernel, kernel, n=kernel * kernel), "b1": np.zeros(maps[0]),
        "k2": u(maps[1], maps[0], kernel, kernel, n=maps[0] * kernel * kernel), "b2": np.zeros(maps[1]),
        "w1": u(flat, hidden, n=flat), "c1": np.zeros(hidden), "w2": u(hidden, classes, n=hidden), "c2": np.zeros(classes),
    }


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    v = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(2, 3))
    return v.transpose(0, 2, 3, 1, 4, 5).reshape(x.shape[0], x.shape[2] - k + 1, x.shape[3] - k + 1, -1)


def _conv(x, kernel, bias):
    cols = _windows(x, kernel.shape[-1])
    return (cols @ kernel.reshape(len(kernel), -1).T + bias).transpose(0, 3, 1, 2), cols


def _pool(x):
    n, c, h, w = x.shape
    blocks = x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
    at = blocks.argmax(-1)
    return np.take_along_axis(blocks, at[..., None], -1)[..., 0], at


def _unpool(g, at, shape):
    n, c, h, w = g.shape
    blocks = np.zeros((n, c, h, w, 4))
    np.put_along_axis(blocks, at[..., None], g[..., None], -1)
    out = np.zeros(shape)
    out[:, :, : h * 2, : w * 2] = blocks.reshape(n, c, h, w, 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h * 2, w * 2)
    return out


def cnn_forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probabilities of images (n, side, side), and what the gradient needs."""
    z1, cols1 = _conv(x[:, None], p["k1"], p["b1"])
    a1 = np.tanh(z1)
    m1, at1 = _pool(a1)
    z2, cols2 = _conv(m1, p["k2"], p["b2"])
    a2 = np.tanh(z2)
    m2, at2 = _pool(a2)
    flat = m2.reshape(len(x), -1)
    h = np.tanh(flat @ p["w1"] + p["c1"])
    logits = h @ p["w2"] + p["c2"]
    logits = logits - logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True)), (cols1, a1, at1, m1, cols2, a2, at2, m2.shape, flat, h)


def cnn_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Sums over the batch: gradients of the negative log likelihood, and the loss."""
    out, (cols1, a1, at1, m1, cols2, a2, at2, shape2, flat, h) = cnn_forward(p, x)
    d = np.exp(out)
    d[np.arange(len(x)), y] -= 1
    g = {"w2": h.T @ d, "c2": d.sum(0)}
    dh = (d @ p["w2"].T) * (1 - h * h)
    g |= {"w1": flat.T @ dh, "c1": dh.sum(0)}
    da2 = _unpool((dh @ p["w1"].T).reshape(shape2), at2, a2.shape) * (1 - a2 * a2)
    flat2 = da2.transpose(0, 2, 3, 1).reshape(-1, da2.shape[1])
    g |= {"k2": (flat2.T @ cols2.reshape(len(flat2), -1)).reshape(p["k2"].shape), "b2": flat2.sum(0)}
    k = p["k2"].shape[-1]
    padded = np.pad(da2, ((0, 0), (0, 0), (k - 1, k - 1), (k - 1, k - 1)))
    dm1, _ = _conv(padded, p["k2"].transpose(1, 0, 2, 3)[:, :, ::-1, ::-1], np.zeros(p["k2"].shape[1]))
    da1 = _unpool(dm1, at1, a1.shape) * (1 - a1 * a1)
    flat1 = da1.transpose(0, 2, 3, 1).reshape(-1, da1.shape[1])
    g |= {"k1": (flat1.T @ cols1.reshape(len(flat1), -1)).reshape(p["k1"].shape), "b1": flat1.sum(0)}
    return g, float(-out[np.arange(len(x)), y].sum())


def train_cnn(df: DataFrame, pixels: str, label: str, side: int, classes: int, epochs: int = 5, rate: float = 0.5, seed: int = 0, **shape) -> tuple[dict[str, np.ndarray], list[float]]:
    """(parameters, mean loss by epoch). Each task sends one gradient; the driver sums those of a size that the network fixes."""
    ship(df.sparkSession)
    table = stash(df.select(F.col(pixels).alias("x"), F.col(label).cast("int").alias("y")))
    p, losses = init_cnn(side, classes, seed=seed, **shape), []
    for _ in range(epochs):

        def grads(frames, p=p):
            total, loss, n = None, 0.0, 0
            for f in frames:
                for at in range(0, len(f), 256):
                    part = f.iloc[at : at + 256]
                    g, one = cnn_gradient(p, np.stack(part["x"].to_numpy()).reshape(-1, side, side).astype(float), part["y"].to_numpy())
                    total = g if total is None else {k: total[k] + g[k] for k in g}
                    loss, n = loss + one, n + len(part)
            if n:
                yield pd.DataFrame({"g": [np.concatenate([total[k].ravel() for k in sorted(total)])], "loss": [loss], "n": [n]})

        sent = table.mapInPandas(grads, "g array<double>, loss double, n long")
        parts = sent.select("loss", "n", F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).orderBy("i").collect()
        n, at = parts[0].n, 0
        flat = np.array([r.g for r in parts]) / n
        losses.append(parts[0].loss / n)
        new = {}
        for k in sorted(p):
            new[k] = p[k] - rate * flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        p = new
    return p, losses


def predict_cnn(df: DataFrame, pixels: str, side: int, p: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``prediction``, the most likely class."""
    ship(df.sparkSession)

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(cnn_forward(p, np.stack(x.to_numpy()).reshape(-1, side, side).astype(float))[0].argmax(1).astype("int32"))

    return df.withColumn("prediction", run(F.col(pixels)))
