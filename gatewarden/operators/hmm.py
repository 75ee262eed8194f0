"""Hidden Markov models of symbol sequences: Baum-Welch for each group, forward scoring, in NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES, ITERATIONS, SYMBOLS, TOLERANCE, SEED = 4, 100, "ANS", 1e-2, 17
MODEL = "n_values long, start array<double>, trans array<array<double>>, emit array<array<double>>"


def _forward(o: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and the scales; a scale is 0 where the sequence is impossible."""
    alpha, scale = np.zeros((len(o), len(start))), np.zeros(len(o))
    row = start * emit[:, o[0]]
    for t in range(len(o)):
        if t:
            row = (alpha[t - 1] @ trans) * emit[:, o[t]]
        scale[t] = row.sum()
        if not scale[t]:
            break
        alpha[t] = row / scale[t]
    return alpha, scale


def log_likelihood(shape: str, start, trans, emit) -> float:  # noqa: ANN001
    """Of a sequence of symbols; 0 for the empty one, minus infinity for an impossible one."""
    o = np.array([SYMBOLS.index(c) for c in shape], dtype=int)
    if not len(o):
        return 0.0
    _, scale = _forward(o, np.asarray(start), np.asarray(trans), np.asarray(emit))
    return float(np.log(scale).sum()) if scale.all() else -np.inf


def baum_welch(shapes: list[str], counts: list[int], states: int = STATES, iterations: int = ITERATIONS, seed: int = SEED) -> tuple:
    """start, trans, emit that locally maximise the likelihood of sequences with multiplicities; seeded."""
    rng = np.random.default_rng(seed)
    start, trans, emit = (rng.dirichlet(np.full(k, 5.0), n) for n, k in ((1, states), (states, states), (states, len(SYMBOLS))))
    start = start[0]
    data = [(np.array([SYMBOLS.index(c) for c in s], dtype=int), n) for s, n in zip(shapes, counts, strict=True) if s]
    before = -np.inf
    for _ in range(iterations if data else 0):
        s, t, e = np.zeros(states), np.zeros((states, states)), np.zeros((states, len(SYMBOLS)))
        total = 0.0
        for o, n in data:
            alpha, scale = _forward(o, start, trans, emit)
            if not scale.all():
                continue
            total += n * np.log(scale).sum()
            beta = np.ones((len(o), states))
            for k in range(len(o) - 2, -1, -1):
                beta[k] = trans @ (emit[:, o[k + 1]] * beta[k + 1]) / scale[k + 1]
            gamma = alpha * beta
            s += n * gamma[0]
            for k in range(len(o) - 1):
                t += n * trans * np.outer(alpha[k], emit[:, o[k + 1]] * beta[k + 1] / scale[k + 1])
            np.add.at(e.T, o, n * gamma)
        floor = 1e-8
        start = (s + floor) / (s + floor).sum()
        trans = (t + floor) / (t + floor).sum(axis=1, keepdims=True)
        emit = (e + floor) / (e + floor).sum(axis=1, keepdims=True)
        if total - before < TOLERANCE:
            break
        before = total
    return start, trans, emit


def fit_groups(shapes: DataFrame, keys: list[str], min_values: int, **options) -> DataFrame:  # noqa: ANN003
    """A model for each group of (keys..., shape, n) with enough values in all. A group in memory is its distinct shapes,
    all of them."""
    sizes = shapes.groupBy(*keys).agg(F.sum("n").alias("total")).filter(F.col("total") >= min_values)
    rows = shapes.join(sizes, keys)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shape")
        start, trans, emit = baum_welch(group["shape"].tolist(), group["n"].tolist(), **options)
        row = {k: group[k].iloc[0] for k in keys}
        row |= {"n_values": int(group["total"].iloc[0]), "start": start.tolist(), "trans": trans.tolist(), "emit": emit.tolist()}
        return pd.DataFrame([row])

    types = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + MODEL)


def score(rows: DataFrame, shape: str) -> DataFrame:
    """``rows`` (with a model's columns) with the log-likelihood of their shape."""

    @F.pandas_udf("double")
    def logp(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series([log_likelihood(x, s, np.stack(list(t)), np.stack(list(e))) for x, s, t, e in zip(*parts, strict=True)], dtype=float)

    return rows.withColumn("logp", logp(shape, "start", "trans", "emit"))
