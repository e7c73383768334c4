"""M6: a feed-forward network trained in mini-batches by workers in step.

The rows are dealt to ``workers`` tasks. In an epoch every task starts from the same
weights, takes its rows batch by batch as they stream in, and steps with Adam; at
its end the tasks' weights and moments are averaged by their rows, and the next epoch
starts from the mean. Hidden layers are ReLU with dropout, the output is a sigmoid
with cross-entropy loss. Validation rows, which no gradient has seen, are measured
with the weights that an epoch ended with.

An epoch is one Spark job whose tasks return a state each (weights and Adam's
moments, some 80 kB), so a lost executor costs one task of one epoch. Gradients
aren't exchanged per step: a barrier stage's ``allGather``, the only exchange that
needs no port of its own, is slow: 50 epochs of 30 steps weren't done after 20
minutes when tried.

The rows are dealt and sorted once, into the shared checkpoint folder: an epoch reads
its tasks' rows in order, without a shuffle. A task holds one Arrow batch of rows, its
features as one matrix over the batch's own memory. Initial weights, the deal of the rows, their
order and the dropout follow from the seed.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorte.operators.graph import stored
from cohorte.operators.split import assign_split

# Layers, dropout and training parameters of the reference's network.
HIDDEN, DROPOUT = [64, 32, 16], [0.3, 0.2, 0.0]
EPOCHS, BATCH, RATE, VALIDATION = 50, 32, 0.001, 0.2
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7

PART = "parte int, n long, n_validacion long, pasos long, perdida double, perdida_validacion double, aciertos long, estado binary"
PART_ARROW = pa.schema(
    [("parte", pa.int32()), ("n", pa.int64()), ("n_validacion", pa.int64()), ("pasos", pa.int64()), ("perdida", pa.float64()), ("perdida_validacion", pa.float64()), ("aciertos", pa.int64()), ("estado", pa.binary())]
)


@dataclass
class State:
    """Weights and Adam's moments as flat vectors, and the number of steps taken."""

    weights: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: int

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, m=self.m, v=self.v, steps=self.steps)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> State:
        z = np.load(io.BytesIO(data))
        return State(z["weights"], z["m"], z["v"], int(z["steps"]))


def shapes(layers: list[int]) -> list[tuple[int, int]]:
    return list(zip(layers[:-1], layers[1:], strict=True))


def initial(layers: list[int], seed: int) -> State:
    """Uniform weights within sqrt(6 / (in + out)), zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(layers):
        bound = math.sqrt(6 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    w = np.concatenate(parts)
    return State(w, np.zeros_like(w), np.zeros_like(w), 0)


def matrices(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the flat vector as one (weights, biases) pair per layer."""
    out, at = [], 0
    for a, b in shapes(layers):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, flat: np.ndarray, layers: list[int]) -> np.ndarray:
    """Logit of every row, without dropout."""
    pairs = matrices(flat, layers)
    for w, b in pairs[:-1]:
        x = np.maximum(x @ w + b, 0)
    w, b = pairs[-1]
    return (x @ w + b)[:, 0]


def cross_entropy(logit: np.ndarray, y: np.ndarray) -> float:
    """Sum over rows, stable for large logits."""
    return float(np.sum(np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))))


def views_of(flat: np.ndarray, layers: list[int]):
    """The weights' and a gradient's vectors and their views by layer: a task makes them once for all its steps."""
    grad = np.empty_like(flat)
    return grad, matrices(flat, layers), matrices(grad, layers)


def gradient(
    x: np.ndarray, y: np.ndarray, flat: np.ndarray, layers: list[int], dropout: list[float], rng: np.random.Generator | None, views: tuple | None = None
) -> tuple[np.ndarray, float]:
    """Gradient of the summed loss, and the loss; dropout scales what it keeps. With
    ``views`` (of ``flat``) the gradient is theirs, and the next step overwrites it."""
    grad, pairs, grads = views or views_of(flat, layers)
    inputs, masks = [x], []
    for i, (w, b) in enumerate(pairs[:-1]):
        h = inputs[-1] @ w
        h += b
        np.maximum(h, 0, out=h)
        keep = 1 - dropout[i]
        scale = 1 / keep if rng is not None and keep < 1 else 1.0
        if scale != 1:
            h *= (rng.random(h.shape) < keep) * scale
        masks.append((h > 0, scale))
        inputs.append(h)
    w, b = pairs[-1]
    logit = (inputs[-1] @ w + b)[:, 0]
    back = (1 / (1 + np.exp(-np.minimum(np.maximum(logit, -60), 60))) - y)[:, None]
    for i in range(len(pairs) - 1, -1, -1):
        np.matmul(inputs[i].T, back, out=grads[i][0])
        back.sum(axis=0, out=grads[i][1])
        if i:
            back = back @ pairs[i][0].T
            on, scale = masks[i - 1]
            back *= on
            if scale != 1:
                back *= scale
    return grad, cross_entropy(logit, y)


def adam(state: State, grad: np.ndarray, rate: float) -> None:
    state.steps += 1
    change = grad - state.m
    change *= 1 - BETA1
    state.m += change
    np.multiply(grad, grad, out=change)
    change -= state.v
    change *= 1 - BETA2
    state.v += change
    m, v = state.m / (1 - BETA1**state.steps), state.v / (1 - BETA2**state.steps)
    np.sqrt(v, out=v)
    v += EPSILON
    m *= rate
    m /= v
    state.weights -= m


def averaged(states: list[tuple[float, State]]) -> State:
    """The mean state, weighted by rows; Adam's step count is the largest."""
    total = sum(n for n, _ in states)
    mean = lambda part: sum(n / total * getattr(s, part) for n, s in states)
    return State(mean("weights"), mean("m"), mean("v"), max(s.steps for _, s in states))


def _epoch(state: bytes, layers: list[int], dropout: list[float], epoch: int, batch: int, rate: float, seed: int, learn: bool = True):
    """One task's part of an epoch: measure the validation rows with the weights at its start, train on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        start, now = State.load(state), State.load(state)
        n = n_valid = right = steps = 0
        loss = valid = 0.0
        views = views_of(now.weights, layers)
        for k, f in enumerate(batches):
            x, y, held = (f.column(c) for c in ("x", "y", "validacion"))
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(f), layers[0])
            y, held = y.to_numpy(zero_copy_only=False), held.to_numpy(zero_copy_only=False).astype(bool)
            logit = forward(x[held], start.weights, layers)
            valid += cross_entropy(logit, y[held])
            right += int(np.sum((logit > 0) == (y[held] > 0.5)))
            n_valid += int(held.sum())
            if not learn:
                continue
            rng = np.random.default_rng([seed, epoch, me, k])
            rows = rng.permutation(np.flatnonzero(~held))
            x, y = x[rows], y[rows]
            for at in range(0, len(rows), batch):
                part = slice(at, at + batch)
                g, lost = gradient(x[part], y[part], now.weights, layers, dropout, rng, views)
                g /= len(y[part])
                adam(now, g, rate)
                loss += lost
                n, steps = n + len(y[part]), steps + 1
        out = {"parte": me, "n": n, "n_validacion": n_valid, "pasos": steps, "perdida": loss, "perdida_validacion": valid, "aciertos": right, "estado": now.dump() if n else None}
        yield pa.RecordBatch.from_pylist([out], schema=PART_ARROW)

    return run


class MiniBatchNetwork(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id: decides worker, order and validation", TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "hidden layers", TypeConverters.toListInt)
    dropout = Param(Params._dummy(), "dropout", "dropped share after each hidden layer", TypeConverters.toListFloat)
    epochs = Param(Params._dummy(), "epochs", "passes over the rows", TypeConverters.toInt)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a worker's step", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    validation = Param(Params._dummy(), "validation", "share of rows that only measure", TypeConverters.toFloat)
    workers = Param(Params._dummy(), "workers", "tasks of an epoch; each returns a state to the driver", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        featuresCol: str = "features",
        labelCol: str = "label",
        idCol: str = "id_paciente",
        hidden: list[int] = HIDDEN,
        dropout: list[float] = DROPOUT,
        epochs: int = EPOCHS,
        batchSize: int = BATCH,
        rate: float = RATE,
        validation: float = VALIDATION,
        workers: int = 4,
        seed: int = 42,
    ):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", idCol="id_paciente", hidden=HIDDEN, dropout=DROPOUT, epochs=EPOCHS, batchSize=BATCH,
            rate=RATE, validation=VALIDATION, workers=4, seed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MiniBatchNetworkModel":
        g = self.getOrDefault
        key, seed = g(self.idCol), g(self.seed)
        parts = assign_split(df, key, g(self.validation), seed + 1).select(
            F.col(key).alias("id"),
            vector_to_array(g(self.featuresCol)).alias("x"),
            F.col(g(self.labelCol)).cast("double").alias("y"),
            (F.col("conjunto") == "test").alias("validacion"),
        )
        rows = stored(parts, "red")
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("sin filas de entrenamiento")
        layers = [first["n"], *g(self.hidden), 1]
        order = F.xxhash64("id")
        # every epoch reads the dealt rows: without the checkpoint each would shuffle and sort them again
        dealt = rows.repartition(g(self.workers), order).sortWithinPartitions(order, "id").select("x", "y", "validacion").checkpoint(eager=True)
        now, history = initial(layers, seed), []
        for epoch in range(g(self.epochs) + 1):
            learn = epoch < g(self.epochs)
            run = _epoch(now.dump(), layers, g(self.dropout), epoch, g(self.batchSize), g(self.rate), seed, learn)
            parts = sorted(dealt.mapInArrow(run, PART).collect(), key=lambda r: r["parte"])  # one row per worker
            n, n_valid = sum(r["n"] for r in parts), sum(r["n_validacion"] for r in parts)
            if history and n_valid:
                history[-1] |= {"perdida_validacion": sum(r["perdida_validacion"] for r in parts) / n_valid, "exactitud_validacion": sum(r["aciertos"] for r in parts) / n_valid}
            if learn:
                if not n:
                    raise ValueError("sin filas de entrenamiento")
                now = averaged([(r["n"], State.load(bytes(r["estado"]))) for r in parts if r["estado"] is not None])
                history.append(
                    {"epoca": epoch + 1, "filas_entrenamiento": n, "filas_validacion": n_valid, "pasos": sum(r["pasos"] for r in parts), "perdida": sum(r["perdida"] for r in parts) / n,
                     "perdida_validacion": None, "exactitud_validacion": None}
                )
        return self._copyValues(MiniBatchNetworkModel(weights=json.dumps({"layers": layers, "weights": now.weights.tolist()}), history=json.dumps(history)))


class MiniBatchNetworkModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "JSON {layers, weights}", TypeConverters.toString)
    history = Param(Params._dummy(), "history", "JSON, one entry per epoch", TypeConverters.toString)
    featuresCol = MiniBatchNetwork.featuresCol
    labelCol = MiniBatchNetwork.labelCol

    @keyword_only
    def __init__(self, weights: str = "{}", history: str = "[]"):
        super().__init__()
        self._setDefault(weights="{}", history="[]", featuresCol="features", labelCol="label")
        self._set(**self._input_kwargs)

    def get_history(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.history))

    def _transform(self, df: DataFrame) -> DataFrame:
        net = json.loads(self.getOrDefault(self.weights))
        layers, flat = net["layers"], np.array(net["weights"])

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="object")
            logit = forward(np.array(x.tolist(), np.float64).reshape(len(x), -1), flat, layers)
            p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
            return pd.Series(np.stack([1 - p, p], axis=1).tolist())

        return df.withColumn("probability", array_to_vector(probabilities(vector_to_array(self.getOrDefault(self.featuresCol)))))
